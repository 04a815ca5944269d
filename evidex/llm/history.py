"""New batches against all history: copy hashes, paragraph hashes, coverage, exact check.

Two hash relations hold what was accepted: one hash of the whole normalised text, and one per
paragraph. A record whose text hash was seen before is a repeat. Others probe the paragraph hashes
and are compared with the earlier records that cover part of them. Paragraphs here are line-bounded
sentences: whole blank-line paragraphs rarely survive small edits.

A record must share paragraphs of at least ``COVER`` of its own length with an earlier one to be
compared. It therefore probes only with its rarest paragraphs, up to the point where the rest is
shorter than that share; no partner is lost by leaving the rest out, and common phrases are rarely
probed. Similarity decides, by the shared definition; then records are accepted in order of
ingestion: a record is a repeat if it is similar to an accepted earlier one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from evidex.llm.similarity import WIDTH, normalise, verified_pairs
from evidex.runtime import materialize

COVER = 0.25
LEAST = 40
#: The low bits of a paragraph's hash that hold its length.
SIZES = (1 << 20) - 1
#: A paragraph that more records than these probe is hot: its first holder is compared with all of them first.
HOT = 256
_CUT = re.compile(r"\n+|(?<=[.!?।؟])\s+|(?<=[。！？])|(?<=[฀-๿]) +(?=[฀-๿])")
_HASHED = "id bigint, at timestamp_ntz, digest binary, total bigint, parts array<bigint>"


def _hash_texts(least: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for i, at, text in zip(pdf["id"], pdf["at"], pdf["text"]):
                if len(text.strip()) < least:
                    continue
                digest = hashlib.blake2b(normalise(text).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                kept = {}
                for part in _CUT.split(text):
                    if part := normalise(part):
                        size = min(len(part), SIZES)
                        h = xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) & ~SIZES | size
                        kept[h - (1 << 64) if h >> 63 else h] = size
                rows.append((i, at, digest, sum(kept.values()), list(kept)))
            yield pd.DataFrame(rows, columns=["id", "at", "digest", "total", "parts"])

    return run


def hashed(df: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, at, digest, total, parts) of the rows of ``df`` (id, at, text) that take part: known time, long enough.

    ``digest`` is of the normalised text; ``parts`` are distinct paragraph hashes, whose low 20 bits
    are the paragraph's length (one above a million characters counts as that); ``total`` is their length together.
    """
    fit = df.select("id", "at", "text").where(F.col("at").isNotNull() & (F.length("text") >= least))
    return fit.mapInPandas(_hash_texts(least), _HASHED)


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, at, total, h, size), a row per distinct paragraph."""
    return rows.select("id", "at", "total", F.explode("parts").alias("h")).withColumn("size", F.col("h").bitwiseAND(F.lit(SIZES)))


#: A record is never its own partner, not even where an earlier attempt at its batch left rows of it.
_EARLIER = "a <> b and (old or at_b < at_a or (at_b = at_a and b < a))"


def _probes(new: DataFrame, common: DataFrame, cover: float) -> DataFrame:
    """(a, at_a, h, size, need): the rarest paragraphs of each new record that others hold too.

    Left out are the most common ones while they are together shorter than the share asked; what
    a shares with another beyond its probes is at most their length, so that ``need`` must come from probes.
    """
    falling = W.partitionBy("id").orderBy(F.col("df").desc(), "h").rowsBetween(W.unboundedPreceding, 0)
    need = cover * F.col("total")
    probe = new.join(common, "h").withColumn("upto", F.sum("size").over(falling)).withColumn("left_out", F.when(F.col("upto") < need, F.col("size")).otherwise(0))
    probe = probe.withColumn("rest", F.sum("left_out").over(W.partitionBy("id"))).where(F.col("upto") >= need)
    return probe.select(F.col("id").alias("a"), F.col("at").alias("at_a"), "h", "size", (need - F.col("rest")).alias("need"))


def _measured(pairs: DataFrame, parts: DataFrame, cover: float) -> DataFrame:
    """(a, b) of ``pairs`` that share ``cover`` of the length of a's paragraphs, over all ``parts`` (id, total, parts) of both."""
    both = pairs.join(parts.select(F.col("id").alias("a"), "total", F.col("parts").alias("pa")), "a").join(parts.select(F.col("id").alias("b"), F.col("parts").alias("pb")), "b")
    shared = F.aggregate(F.array_intersect("pa", "pb"), F.lit(0).cast("long"), lambda s, h: s + h.bitwiseAND(F.lit(SIZES)))
    return both.where(shared >= cover * F.col("total")).select("a", "b")


def _covered(probe: DataFrame, held: DataFrame, parts: DataFrame, cover: float) -> DataFrame:
    """(a, b): new records a, and earlier ones b that share enough of a's paragraphs to be compared."""
    met = probe.join(held, "h").where(_EARLIER)
    pairs = met.groupBy("a", "b").agg(F.sum("size").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("a", "b")
    return _measured(pairs, parts, cover)


def _settled(probe: DataFrame, held: DataFrame, parts: DataFrame, hot: DataFrame, cover: float, check) -> DataFrame:
    """(id) of the records that repeat the first holder of a hot paragraph, where that is surely accepted.

    One comparison a record and hot paragraph instead of one with every earlier holder: a large group
    of near-copies is settled by its first member. A first holder is surely accepted if it is of
    history or similar to no earlier record at all. Repeats are never accepted, so that the rest
    need not be compared with them.
    """
    first = held.join(hot, "h").groupBy("h").agg(F.min(F.struct((~F.col("old")).alias("late"), "at_b", "b")).alias("f"))
    first = materialize(first.select("h", F.col("f.b").alias("b"), F.col("f.at_b").alias("at_b"), (~F.col("f.late")).alias("old")), "first")
    own = probe.join(first.where("not old").select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    late = check(_covered(own, held, parts, cover)).select(F.col("a").alias("b"))
    roots = first.where("old").unionByName(first.where("not old").join(late, "b", "left_anti").select(first.columns))
    star = probe.join(roots, "h").where(_EARLIER).select("a", "b").distinct()
    return materialize(check(_measured(star, parts, cover)).select(F.col("a").alias("id")).distinct(), "settled")


def accept_in_order(links: DataFrame) -> DataFrame:
    """(id) of the records that are similar to an accepted earlier one; ``links`` (early, late) has every similar pair.

    A record with no undecided earlier partner is accepted, its later partners are repeats, and both
    leave the graph; this goes on until no link is left. Rounds: at most the longest chain of links.
    """
    cases = None
    while not links.isEmpty():
        heads = links.select(F.col("early").alias("id")).distinct().join(links.select(F.col("late").alias("id")), "id", "left_anti")
        hit = materialize(links.join(heads.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct(), "cases")
        gone = hit.unionByName(heads)
        links = links.join(gone.withColumnRenamed("id", "early"), "early", "left_anti")
        links = materialize(links.join(gone.withColumnRenamed("id", "late"), "late", "left_anti").select("early", "late"), "links")
        cases = hit if cases is None else cases.unionByName(hit)
    return links.select(F.col("late").alias("id")) if cases is None else cases


def repeats(batch: DataFrame, history: HistoryIndex | None = None, minimum: float = 0.6, cover: float = COVER, width: int = WIDTH, least: int = LEAST, rows: DataFrame | None = None) -> DataFrame:
    """(id) of records of ``batch`` (id, at, text) that repeat an accepted one, of ``history`` or earlier in the batch.

    ``rows`` are the hashes of the batch, a written table, where they were taken before.

    Without ``history`` the table is replayed whole: its rows count as batches in order of time.
    Rows with null ``at``, null, empty or short text take no part and are no repeats; ties in ``at``
    go by id; ids must be unique; other columns are not read; an empty batch gives no rows.
    """
    rows = materialize(hashed(batch, least), "hashed") if rows is None else rows
    first = rows.groupBy("digest").agg(F.min(F.struct("at", "id")).alias("first"))
    copies = rows.select("digest", "id").join(first, "digest").select("digest", "id", F.col("first.id").alias("rep"))
    if history is not None:
        known = materialize(copies.join(history.digests(), "digest", "left_semi").select("id"), "known")
        copies = copies.join(known, "id", "left_anti")
    copies = materialize(copies.select("id", "rep"), "copies")
    new = paragraphs(rows.join(copies.where("id = rep").select("id"), "id", "left_semi")).withColumn("old", F.lit(False))
    new = materialize(new, "paragraphs")
    seen, texts, parts = new, batch.select("id", "text"), rows.select("id", "total", "parts")
    if history is not None:
        met = history.paragraphs().join(new.select("h").distinct(), "h", "left_semi")
        met = materialize(met.withColumn("old", F.lit(True)), "met")
        seen = new.unionByName(met)
        parts = parts.unionByName(met.groupBy("id").agg(F.first("total").alias("total"), F.collect_list("h").alias("parts")))
    common = materialize(seen.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common")
    probe = materialize(_probes(new, common, cover), "probes")
    held = seen.join(common, "h", "left_semi").select(F.col("id").alias("b"), F.col("at").alias("at_b"), "h", "old")

    def check(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "covered")
        old = [] if history is None else [history.texts(pairs.select(F.col("b").alias("id")))]
        return verified_pairs(pairs, reduce(DataFrame.unionByName, old, texts), minimum, width)

    hot = materialize(probe.groupBy("h").count().where(F.col("count") > HOT).select("h"), "hot")
    settled = None
    if not hot.isEmpty():
        settled = _settled(probe, held, parts, hot, cover, check)
        probe = probe.join(settled.withColumnRenamed("id", "a"), "a", "left_anti")
        held = held.join(settled.withColumnRenamed("id", "b"), "b", "left_anti")
    links = materialize(check(_covered(probe, held, parts, cover)).select(F.col("b").alias("early"), F.col("a").alias("late")), "links")
    cases = accept_in_order(links)
    cases = cases if settled is None else cases.unionByName(settled)
    found = copies.join(cases.withColumnRenamed("id", "rep"), "rep", "left_semi").select("id")
    found = found.unionByName(copies.where("id <> rep").select("id")).distinct()
    return found if history is None else found.unionByName(known)


class HistoryIndex:
    """What was accepted so far: text hashes, paragraph hashes and texts, in tables bucketed by their key.

    A batch meets history by bucket-local semi-joins on the hashes; no accepted text is hashed again.
    Every table is partitioned by batch, and a batch's rows replace what an earlier attempt at it left,
    so that no read has to remove repeats; a batch meets the rows of other batches alone. Of texts
    only the batches with covered records are read. ``texts`` (id, text), where the accepted texts
    are kept by the caller, spares a second copy of them.
    """

    _TABLES = {
        "digests": ("digest BINARY, id BIGINT", "digest"),
        "paragraphs": ("id BIGINT, at TIMESTAMP_NTZ, total BIGINT, h BIGINT, size BIGINT", "h"),
        "texts": ("id BIGINT, text STRING", "id"),
        "repeats": ("id BIGINT", "id"),
        "taken": ("id BIGINT", "id"),
    }

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, texts: DataFrame | None = None):
        self.spark, self._buckets, self._own = spark, buckets, texts
        self._name = "accepted_" + "".join(c if c.isalnum() else "_" for c in path)
        for kind, (columns, key) in self._TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name}_{kind} ({columns}, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/{kind}'")
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
            if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
                spark.sql(f"MSCK REPAIR TABLE {self._name}_{kind}")  # what another session took before
        self._now = ""

    def _table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self._name}_{kind}")

    def _others(self, kind: str) -> DataFrame:
        return self._table(kind).where(F.col("batch") != self._now)

    def digests(self) -> DataFrame:
        return self._others("digests").select("digest", "id")

    def paragraphs(self) -> DataFrame:
        return self._others("paragraphs").drop("batch")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of accepted records, those of ``ids`` among them: only the batches that hold any are read."""
        rows = self._others("digests").join(ids.distinct(), "id", "left_semi").select("id", "batch")
        batches = [r[0] for r in rows.select("batch").distinct().collect()]  # at most one row per batch taken
        if self._own is not None:
            return self._own.join(rows.select("id"), "id", "left_semi").select("id", "text")
        return self._table("texts").where(F.col("batch").isin(batches)).select("id", "text")

    def _put(self, kind: str, rows: DataFrame) -> None:
        """The rows of the batch at hand, one file per bucket, in place of what was there."""
        columns, key = self._TABLES[kind]
        rows = rows.select(*[c.split()[0] for c in columns.split(", ")]).repartition(self._buckets, key)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self._name}_{kind} PARTITION (batch = '{self._now}') SELECT * FROM {{rows}}", rows=rows)

    def take(self, batch: DataFrame, name: str, **settings) -> DataFrame:
        """(id) of the repeats in ``batch`` (id, at, text), whose other records are accepted from now on.

        ``name`` (letters, digits, - and _) stands for the batch for good: taken once more, it gives the
        first answer again; after a failure it is taken anew. The mark that it is done is written last.
        """
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError("a batch is named by letters, digits, - and _")
        if self._table("taken").where(F.col("batch") == name).isEmpty():
            self._now = name
            batch = batch.select(F.col("id").cast(T.LongType()), F.col("at").cast(T.TimestampNTZType()), "text")
            rows = materialize(hashed(batch, settings.get("least", LEAST)), "hashed")
            found = materialize(repeats(batch, self, rows=rows, **settings), "repeats")
            fresh = rows.join(found, "id", "left_anti")
            if self._own is None:
                self._put("texts", batch.join(fresh, "id", "left_semi"))
            self._put("paragraphs", paragraphs(fresh))
            self._put("digests", fresh)
            self._put("repeats", found)
            self._put("taken", self.spark.range(1))
            self._now = ""
        return self._table("repeats").where(F.col("batch") == name).select("id")


def repeats_by_batches(rows: DataFrame, index: HistoryIndex, bounds: list, **settings) -> DataFrame:
    """(id) of the repeats among ``rows`` (id, at, text), taken by ``index`` in batches that end before each of ``bounds``, and the rest."""
    found = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        fit = F.col("at").isNotNull()
        fit = fit if low is None else fit & (F.col("at") >= F.lit(low))
        fit = fit if high is None else fit & (F.col("at") < F.lit(high))
        found.append(index.take(rows.where(fit), f"until-{high:%Y%m%d%H%M%S}" if high else "rest", **settings))
    return reduce(DataFrame.unionByName, found)
