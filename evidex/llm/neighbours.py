"""The k most similar vectors of every vector, by vantage-point trees per shard.

Vectors are scaled to length one; distance is that of the points on the sphere, a metric, so that
the triangle inequality prunes. A small upper tree, fitted on a bounded sample, cuts the space into
shards; every vector lives in one and visits others as a query. Each shard builds its own tree over
all its vectors. A node's vantage point is the direction along which its points spread most, a point
of the sphere that need not be a stored vector: the triangle inequality holds for any point, so that
nothing is lost by it, and distances from it differ most. Its radius is the median distance; in the
upper tree it is moved to where the fewest points lie within reach, so that few have to visit both
sides. A query skips the side beyond the radius if it is farther from it than ``factor`` times its
search radius: with factor one nothing within the radius is lost, smaller factors trade recall for
time. Equal vectors are one class, represented by its least id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidex.runtime import materialize

FACTOR = 0.12
#: The upper tree's own factor, at most: each further shard that a query visits is another copy of it.
UPPER = 0.08
#: Vectors the upper tree is fitted on, at most.
SAMPLE = 16_384
LEAF = 64
#: Vectors of other shards searched at a time.
GUESTS = 65_536
LEAST_SHARDS, PER_SHARD = 32, 50_000
#: Sampled vectors a shard needs to be told by its sample; beyond, shards are counted and the large ones split again.
TOLD_BY = 16
#: Two products of the same vectors may differ by so much, with the size of the matrices and the machine.
ROUNDING = np.float32(2e-6)
#: Repeated or stale vectors up to this many are told to the scan by broadcast; more go by shuffle.
BROADCAST_ROWS = 1_000_000


def _direction(points: np.ndarray) -> np.ndarray:
    """The unit vector along which ``points`` spread most (power iteration on at most 1024 of them)."""
    part = points[:: max(1, len(points) // 1024)]
    part = part - part.mean(axis=0)
    v = part[np.argmax((part * part).sum(axis=1))]
    for _ in range(8):
        w = part.T @ (part @ v)
        norm = np.linalg.norm(w)
        if norm == 0:
            break
        v = w / norm
    norm = np.linalg.norm(v)
    if norm == 0:
        v = np.zeros(points.shape[1], np.float32)
        v[0] = norm = 1
    return (v / norm).astype(np.float32)


def distance(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (points @ vantage)))


def _radius(d: np.ndarray, reach: float) -> float:
    """The median of the distances, or the distance of the middle part that the fewest come within ``reach`` of."""
    if not reach:
        return float(np.median(d))
    d = np.sort(d)
    middle = d[int(len(d) * 0.3) : int(len(d) * 0.7) + 1]
    return float(middle[np.argmin(np.searchsorted(d, middle + reach) - np.searchsorted(d, middle - reach))])


def build(points: np.ndarray, rows: np.ndarray, leaf: int, reach: float = 0.0):
    """(vantage, radius, near, far), or the rows of a leaf."""
    if len(rows) <= leaf:
        return rows
    own = points[rows]
    vantage = _direction(own)
    d = distance(own, vantage)
    radius = _radius(d, reach)
    near = d < radius
    if not near.any():
        near = d <= radius
    if near.all():
        return rows
    return vantage, radius, build(points, rows[near], leaf, reach), build(points, rows[~near], leaf, reach)


def visit(tree, queries: np.ndarray, rows: np.ndarray, reach: np.ndarray, act) -> None:
    """Calls act(leaf, rows of queries) for each leaf with the queries that come within ``reach`` of it."""
    if not len(rows):
        return
    if isinstance(tree, tuple):
        vantage, radius, near, far = tree
        gap = distance(queries[rows], vantage) - radius
        visit(near, queries, rows[gap < reach[rows]], reach, act)
        visit(far, queries, rows[gap >= -reach[rows]], reach, act)
    else:
        act(tree, rows)


def _numbered(tree, number: list[int]):
    if isinstance(tree, tuple):
        return (*tree[:2], _numbered(tree[2], number), _numbered(tree[3], number))
    number[0] += 1
    return number[0] - 1


def search(points: np.ndarray, queries: np.ndarray, k: int, minimum: float, factor: float, same: np.ndarray, home: np.ndarray, tree=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) of the k best points of each query, cosine >= minimum, found with ``factor``.

    ``same`` is the row of the query among the points, or -1; ``home`` tells which queries live here; ``tree`` is
    that of the points where it was built before.
    """
    tree = build(points, np.arange(len(points)), LEAF) if tree is None else tree
    bound = np.full(len(queries), minimum, np.float32)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(leaf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = points[leaf]
        for start in range(0, len(rows), 16_384):
            part = rows[start : start + 16_384]
            cos = queries[part] @ own.T
            cos[same[part, None] == leaf[None, :]] = -2
            yield part, cos

    def first(leaf: np.ndarray, rows: np.ndarray) -> None:
        if len(leaf) > k:
            for part, cos in meet(leaf, rows):
                bound[part] = np.maximum(minimum, np.partition(cos, -k, axis=1)[:, -k])

    def second(leaf: np.ndarray, rows: np.ndarray) -> None:
        for part, cos in meet(leaf, rows):
            i, j = np.nonzero(cos >= bound[part, None] - ROUNDING)
            found.append((part[i], leaf[j], cos[i, j]))

    visit(tree, queries, np.flatnonzero(home), np.zeros(len(queries), np.float32), first)
    # near distance zero the root magnifies an error of rounding, which the radius has to cover
    reach = factor * np.sqrt(np.maximum(0, 2 - 2 * (bound - ROUNDING))) + np.float32(1e-3 if factor >= 1 else 1e-6)
    visit(tree, queries, np.arange(len(queries)), reach, second)
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    q, p, c = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-c, q))
    q, p, c = q[order], p[order], c[order]
    # what may be among the k best is measured again with doubles, so that the choice does not depend on the machine
    rank = _ranks(q)
    least = np.full(len(queries), minimum, np.float64)
    least[q[rank == k - 1]] = c[rank == k - 1]
    close = c >= least[q] - ROUNDING
    q, p = q[close], p[close]
    c = np.empty(len(q))
    for at in range(0, len(q), 65_536):
        part = slice(at, at + 65_536)
        c[part] = np.einsum("ij,ij->i", queries[q[part]].astype(np.float64), points[p[part]].astype(np.float64))
    order = np.lexsort((p, -c, q))
    order = order[c[order] >= minimum]
    q, p, c = q[order], p[order], c[order]
    best = _ranks(q) < k
    return q[best], p[best], c[best]


def _ranks(q: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal values."""
    at = np.arange(len(q))
    return at - np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], at, 0)) if len(q) else at


def _valid(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            rows = np.flatnonzero(sizes == dims)
            flat = lists.take(pa.array(rows)).flatten()
            x = np.asarray(flat.fill_null(float("nan"))).astype(np.float64).reshape(len(rows), dims)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            x = np.ascontiguousarray((x[good] / norm[good, None]).astype(np.float32))
            rows = pa.array(rows[good])
            packed = [v.tobytes() for v in x]
            keys = [hashlib.blake2b(p, digest_size=16).digest() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("at").take(rows), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["id", "at", "h", "vec"])

    return run


def valid_vectors(df: DataFrame, dims: int) -> DataFrame:
    """(id, at, h, vec): unit vectors, as bytes, of the rows of ``df`` (id, at, vec) that can be compared.

    Null ids and vectors that are null, all zero, not finite in any element or not of ``dims`` elements are left out.
    """
    kind = df.schema["at"].dataType.simpleString()
    return df.select("id", "at", "vec").where("id is not null and vec is not null").mapInArrow(_valid(dims), f"id string, at {kind}, h binary, vec binary")


def _matrix(column: pa.Array, kind: type, dims: int) -> np.ndarray:
    """Vectors kept as bytes, without a Python object for each."""
    if not len(column):
        return np.zeros((0, dims), kind)
    size = np.dtype(kind).itemsize * dims
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + size * len(column)].view(kind).reshape(-1, dims)


_ROUTED = "shard int, id string, home boolean, vec binary"


def _route(tree, reach: float, dims: int, guest: type):
    """Each vector goes home in full, and as a guest, with elements of type ``guest``, to the other shards within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), np.float32, dims)
            every = np.arange(len(x))
            home = _homes(tree, x)
            met: list[tuple[int, np.ndarray]] = []
            visit(tree, x, every, np.full(len(x), reach, np.float32), lambda leaf, rows: met.append((leaf, rows[home[rows] != leaf])))  # noqa: B023
            for own, kind, parts in ((True, np.float32, [(leaf, np.flatnonzero(home == leaf)) for leaf in np.unique(home)]), (False, guest, met)):
                if not parts:
                    continue
                rows = np.concatenate([r for _, r in parts])
                shard = np.repeat(np.array([leaf for leaf, _ in parts], np.int32), [len(r) for _, r in parts])
                packed = x.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), batch.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), own)), pa.array([packed[i].tobytes() for i in rows], pa.binary())], ["shard", "id", "home", "vec"]
                )

    return run


def _homes(tree, x: np.ndarray) -> np.ndarray:
    home = np.zeros(len(x), np.int32)

    def settle(leaf: int, rows: np.ndarray) -> None:
        home[rows] = leaf

    # of two shards at distance zero the farther one is taken, by all alike
    visit(tree, x, np.arange(len(x)), np.zeros(len(x), np.float32), settle)
    return home


def _home_rows(tree, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_homes(tree, _matrix(batch.column("vec"), np.float32, dims))), batch.column("h"), batch.column("vec")], ["shard", "h", "vec"])

    return run


def _search_shard(k: int, minimum: float, factor: float, dims: int, guest: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, names, guests, asked = [], [], [], []
        for batch in batches:
            ids = np.array(batch.column("id").to_pylist(), object)
            home = np.asarray(batch.column("home").to_numpy(zero_copy_only=False), bool)
            for own, kind, vectors, labels in ((True, np.float32, points, names), (False, guest, guests, asked)):
                rows = np.flatnonzero(home == own)
                if len(rows):
                    vectors.append(_matrix(batch.column("vec").take(pa.array(rows)), kind, dims))
                    labels.append(ids[rows])
        if not points:
            return
        x, own = np.concatenate(points), np.concatenate(names)
        order = np.argsort(own)  # ties in cosine go by id
        x, own = x[order], own[order]
        here = np.arange(len(x))
        tree = build(x, here, LEAF)
        found = [(own, search(x, x, k, minimum, factor, here, here >= 0, tree))]
        if guests:
            other, foreign = np.concatenate(guests), np.concatenate(asked)
            nobody = np.full(len(other), -1)
            for start in range(0, len(other), GUESTS):
                part = slice(start, start + GUESTS)
                found.append((foreign[part], search(x, other[part].astype(np.float32), k, minimum, factor, nobody[part], nobody[part] >= -1, tree)))
        for labels, (q, p, c) in found:
            yield pa.RecordBatch.from_arrays([pa.array(labels[q], pa.string()), pa.array(own[p], pa.string()), pa.array(c)], ["q", "x", "cosine"])

    return run


def _drawn(rows: DataFrame, total: int, sample: int, dims: int) -> DataFrame:
    """At most ``sample`` of the ``total`` vectors, spread over all by their hash."""
    share = min(1.0, 0.9 * sample / max(1, total))
    return rows.where(F.conv(F.substring(F.hex("h"), 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32))).limit(sample)


def _upper_tree(vectors: DataFrame, total: int, sample: int, reach: float, dims: int):
    """The tree whose leaves are the numbers of shards, none of many more than PER_SHARD vectors, as far as equal distances allow.

    It is fitted on ``sample`` vectors. Where so few cannot tell shards of that size, the shards are
    counted, and those too large are split again by a sample drawn of them alone, until none is left.
    """
    shards = max(LEAST_SHARDS, -(-total // PER_SHARD))
    points = _matrix(_combined(_drawn(vectors, total, sample, dims).select("vec").toArrow().column("vec")), np.float32, dims)
    leaf = max(1, 2 * len(points) // shards, TOLD_BY if shards > LEAST_SHARDS else 1)
    tree = _numbered(build(points, np.arange(len(points)), leaf, reach), [0])
    told = leaf * total <= 4 * PER_SHARD * max(1, len(points))
    while not told:
        homes = vectors.mapInArrow(_home_rows(tree, dims), "shard int, h binary, vec binary")
        large = {r["shard"]: r["count"] for r in homes.groupBy("shard").count().where(F.col("count") > 4 * PER_SHARD).collect()}  # one row per shard
        drawn = _drawn(homes.where(F.col("shard").isin(list(large))), sum(large.values()), sample, dims).select("shard", "vec").toArrow() if large else None
        parts = {}
        for shard in large:
            own = _matrix(_combined(drawn.filter(pa.compute.equal(drawn.column("shard"), shard)).column("vec")), np.float32, dims)
            grown = build(own, np.arange(len(own)), max(TOLD_BY, 2 * len(own) * PER_SHARD // large[shard]), reach)
            if isinstance(grown, tuple):
                parts[shard] = grown
        tree = _numbered(_grafted(tree, parts), [0])
        told = not parts
    return tree


def _combined(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made


def _grafted(tree, parts: dict):
    if isinstance(tree, tuple):
        return (*tree[:2], _grafted(tree[2], parts), _grafted(tree[3], parts))
    return parts.get(tree, tree)


def nearest(df: DataFrame, k: int = 10, minimum: float = 0.0, factor: float = FACTOR, dims: int = 96, sample: int = SAMPLE) -> DataFrame:
    """(q, x, cosine): for each vector q of ``df`` (id, at, vec) its k most similar x of cosine >= ``minimum``.

    Vectors that are null, zero, not finite or of another length take no part; of an id upserted
    again the latest row counts. Ties in cosine go by id. The search radius starts at ``minimum``:
    the higher it is, the more is pruned. A ``factor`` above the default holds for the upper tree too,
    so that one is exact; with less than one, a vector visits other shards in half precision. Only the
    upper tree is fitted on samples (of at most ``sample`` vectors each, spread over all by their
    hash); every vector is indexed and searched. Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = materialize(valid_vectors(df, dims), "vectors")
    keys = vectors.select("id", "at", "h")
    latest = keys.groupBy("id").agg(F.max(F.struct("at", "h"))["h"].alias("h"), F.count("*").alias("rows"))
    latest = materialize(latest, "latest")
    classes = latest.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    stale = keys.join(latest.where("rows > 1").select("id"), "id", "left_semi").select("h")
    several = materialize(classes.where("n > 1").select("h", "rep"), "classes")
    apart = stale.unionByName(several.select("h")).distinct()
    apart = materialize(apart.join(classes.select("h", "rep"), "h", "left"), "apart")
    apart = _told(apart)
    plain = vectors.join(apart.select("h"), "h", "left_anti").select("id", "vec")
    mixed = vectors.join(apart, "h").where("id = rep").select("id", "vec").dropDuplicates(["id"])
    reps = plain.unionByName(mixed)

    total = latest.count()
    reach = (factor if factor > FACTOR else min(factor, UPPER)) * float(np.sqrt(2 - 2 * minimum)) + (1e-3 if factor >= 1 else 1e-6)
    upper = _upper_tree(vectors.select("h", "vec"), total, sample, min(reach, 0.1), dims)
    guest = np.float32 if factor >= 1 else np.float16
    routed = reps.mapInArrow(_route(upper, reach, dims, guest), _ROUTED)
    found = routed.groupBy("shard").applyInArrow(_search_shard(k, minimum, factor, dims, guest), "q string, x string, cosine double")
    if not several.isEmpty():
        found = _with_copies(found, materialize(latest.join(several, "h").select("rep", "id"), "members"), several, k)
    best = W.partitionBy("q").orderBy(F.col("cosine").desc(), "x")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def _told(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast while it is small, by count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _with_copies(found: DataFrame, members: DataFrame, several: DataFrame, k: int) -> DataFrame:
    """Neighbours of all members, from those of representatives. A class counts with its k + 1 least ids at most in any list."""
    least = members.withColumn("i", F.row_number().over(W.partitionBy("rep").orderBy("id"))).where(F.col("i") <= k + 1).drop("i")
    own = several.select(F.col("rep").alias("q"), F.col("rep").alias("x"), F.lit(1.0).alias("cosine"))
    lists = found.unionByName(own).join(_told(least.withColumnRenamed("rep", "x")), "x", "left").select("q", F.coalesce("id", "x").alias("x"), "cosine")
    return lists.join(_told(members.withColumnRenamed("rep", "q")), "q", "left").select(F.coalesce("id", "q").alias("q"), "x", "cosine").where("q <> x")
