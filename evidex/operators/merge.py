"""Upserts, change detection and duplicates by key, hash and title."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidex.functions.text import content_hash, shingles3, title_norm
from evidex.runtime import materialize, parallel


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the greatest by ``order`` (nulls least, all other columns breaking ties); null keys are left out.

    An aggregation, not a window: partial maxima are taken before the shuffle, so a hot key is no burden.
    """
    rest = [c for c, t in df.dtypes if c != key and c not in order and not t.startswith("map")]
    maps = [c for c, t in df.dtypes if t.startswith("map")]
    rank = F.struct(*[F.col(c) for c in (*order, *rest)])
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in (*order, *rest, *maps)]), rank).alias("row"))
    return rows.select(*[F.col(key) if c == key else F.col(f"row.{c}") for c in df.columns])


def upsert(table: DataFrame, batch: DataFrame, key: str, *order: str) -> DataFrame:
    """``table`` with the rows of ``batch`` merged by key, last write wins; replaying a batch changes nothing."""
    return latest(table.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1))), key, "_new", *order).drop("_new")


def zip_vectors(chunks: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, ...) with ``dense`` (chunk_id, vector) and ``sparse`` (chunk_id, sparse), joined by key.

    A chunk without one of them, or a vector without a chunk, is an error when the rows are read.
    """
    both = chunks.withColumn("_c", F.lit(1)).join(dense.withColumn("_d", F.lit(1)), "chunk_id", "full_outer").join(sparse.withColumn("_s", F.lit(1)), "chunk_id", "full_outer")
    whole = F.col("_c").isNotNull() & F.col("_d").isNotNull() & F.col("_s").isNotNull()
    checked = F.when(whole, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("chunk and vectors do not match: "), F.coalesce("chunk_id", F.lit("null")))))
    return both.withColumn("chunk_id", checked).drop("_c", "_d", "_s")


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash, duplicate_of): every row with the least key of its normalised content; null where that is itself.

    Blank content makes no duplicates. The classes come from an aggregation and are joined back.
    """
    rows = df.select(key, F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(None)).otherwise(content_hash(F.col(text))).alias("hash"))
    first = rows.where("hash is not null").groupBy("hash").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first.select("hash", "first"), "hash", "left").select(key, "hash", F.when(F.col("first") < F.col(key), F.col("first")).alias("duplicate_of"))


def change_status(stored: DataFrame, incoming: DataFrame, key: str = "doc_id", digest: str = "hash") -> DataFrame:
    """(key, status) of the incoming keys: new, changed or unchanged against ``stored``; a null hash counts as any other."""
    old = stored.select(key, F.col(digest).alias("old"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("old").eqNullSafe(F.col(digest)), "unchanged").otherwise("changed")
    return incoming.join(old, key, "left").select(key, status.alias("status"))


#: Counts of substrings are kept by so many bits of a hash, and a set of them as the parities of so many buckets.
COUNT_BITS, PARITIES = 16, 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, substring) of the distinct substrings of three characters of each text, a substring as the number its three code points make."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(lengths - 2, 0)
    row = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(row)) + np.repeat(np.cumsum(lengths) - lengths - np.cumsum(counts) + counts, counts)
    gram = codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2] if len(at) else at
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _bucket_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): titles with a substring, by bucket of substrings."""
    for part in parts:
        n = np.bincount(_mixed(_grams(part.column("t").to_pylist())[1]) >> np.uint64(64 - COUNT_BITS), minlength=1 << COUNT_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.flatnonzero(n), n[n > 0])], ["bucket", "n"])


def _prefixes(counts: np.ndarray, minimum: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, id, n, i, b0 ...) of titles (id, source, t): the rarest substrings of each that one alike must share one of.

    ``key`` stands for source and substring, ``n`` is the size of the set, ``i`` the place among its
    rarest from 0, ``b`` the parities of its buckets: sets that differ in d substrings differ in d parities at most.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, gram = _grams(part.column("t").to_pylist())
            mixed = _mixed(gram)
            n = np.bincount(row, minlength=part.num_rows)
            odd = np.bincount(row * PARITIES + (mixed % np.uint64(PARITIES)).astype(np.int64), minlength=part.num_rows * PARITIES) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(part.num_rows, PARITIES), axis=1).view(np.int64)
            order = np.lexsort((gram, counts[mixed >> np.uint64(64 - COUNT_BITS)], row))
            row, mixed = row[order], mixed[order]
            place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            kept = place <= n[row] - np.ceil(n[row] * minimum - 1e-9)
            row, mixed, place = row[kept], mixed[kept], place[kept]
            key = _mixed(mixed + part.column("source").to_numpy().view(np.uint64)[row]).view(np.int64)
            columns = [key, part.column("id").to_numpy()[row], n[row].astype(np.int32), place.astype(np.int32), *bits[row].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "id", "n", "i", *(f"b{i}" for i in range(bits.shape[1]))])

    return run


def title_duplicates(df: DataFrame, minimum: float = 0.9) -> DataFrame:
    """(source_type, title_a, title_b, similarity): distinct normalised titles of one source alike by three-character substrings.

    ``df`` has (source_type, title). Equal titles are one, so copies make no pairs. Titles alike in
    ``minimum`` share one of the rarest few substrings of each (prefix filter), which are all that is
    joined. What a pair must have in common follows from the two sizes; pairs whose places in the
    order of rareness or whose parities rule that out end within the join, before any pair is moved.
    """
    titles = df.select("source_type", title_norm(F.col("title")).alias("t")).where("length(t) >= 3 and source_type is not null").distinct()
    titles = materialize(titles.withColumn("id", F.xxhash64("source_type", "t")), "titles")
    keyed = parallel(titles).select("id", F.xxhash64("source_type").alias("source"), "t")
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for r in keyed.select("t").mapInArrow(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most 2 ** COUNT_BITS
        counts[r["bucket"]] = r["n"]
    words = [f"b{i}" for i in range(PARITIES // 64)]
    prefix = keyed.mapInArrow(_prefixes(counts, minimum), f"key long, id long, n int, i int, {', '.join(f'{b} long' for b in words)}")
    a, b = prefix.alias("a"), prefix.alias("b")
    common = f"cast(ceil((a.n + b.n) * {minimum / (1 + minimum)!r}D - 1e-9D) as int)"
    differ = " + ".join(f"bit_count(a.{w} ^ b.{w})" for w in words)
    near = f"a.id < b.id and a.i <= a.n - {common} and b.i <= b.n - {common} and {differ} <= a.n + b.n - 2 * {common}"
    pairs = a.join(b, F.expr(f"a.key = b.key and {near}")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    left, right = titles.select(F.col("id").alias("a"), "source_type", F.col("t").alias("x")), titles.select(F.col("id").alias("b"), F.col("source_type").alias("of"), F.col("t").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where("source_type = of").withColumn("ga", shingles3(F.col("x"))).withColumn("gb", shingles3(F.col("y")))
    shared = F.size(F.array_intersect("ga", "gb"))
    full = both.withColumn("similarity", shared / (F.size("ga") + F.size("gb") - shared)).where(F.col("similarity") >= minimum)
    return full.select("source_type", F.least("x", "y").alias("title_a"), F.greatest("x", "y").alias("title_b"), "similarity")
