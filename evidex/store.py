"""The index of points behind search: one interface, tables below a path as its backend."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions.vectors import sparse_of
from evidex.operators import retrieve as R
from evidex.operators.merge import latest
from evidex.streaming.ingest import VersionedTable

_SPARSE = "map<int,double>"
POINT = f"point_id string, dense_vector array<float>, sparse_vector {_SPARSE}, payload map<string,string>"


def coerced_points(df: DataFrame) -> DataFrame:
    """Points of any shape met so far as (point_id, dense_vector, sparse_vector, payload).

    An id is ``point_id`` or ``id``; the vector is ``dense_vector`` and ``sparse_vector``, or ``vector``,
    an array or a struct of ``dense`` and ``sparse``; a sparse vector is a map or a struct of
    ``indices`` and ``values``, which must be of one length. What is missing is empty; other shapes are an error.
    """
    kinds = dict(df.dtypes)
    name = next((c for c in ("point_id", "id") if c in kinds), None)
    if name is None or not {"vector", "dense_vector"} & set(kinds):
        raise TypeError(f"no point: {', '.join(df.columns)}")

    def sparse(column: str, kind: str):
        if kind.startswith("struct<indices"):
            return sparse_of(F.col(f"{column}.indices").cast("array<int>"), F.col(f"{column}.values").cast("array<double>"))
        return F.col(column).cast(_SPARSE)

    empty = F.create_map().cast(_SPARSE)
    if "dense_vector" in kinds:
        dense, weights = F.col("dense_vector"), sparse("sparse_vector", kinds["sparse_vector"]) if "sparse_vector" in kinds else empty
    elif kinds["vector"].startswith("array"):
        dense, weights = F.col("vector"), empty
    else:
        inner = {f.name: f.dataType.simpleString() for f in df.schema["vector"].dataType.fields}
        dense = F.col("vector.dense") if "dense" in inner else F.lit(None)
        weights = sparse("vector.sparse", inner["sparse"]) if "sparse" in inner else empty
    payload = F.col("payload").cast("map<string,string>") if "payload" in kinds else F.create_map().cast("map<string,string>")
    return df.select(
        F.col(name).cast("string").alias("point_id"), F.coalesce(dense.cast("array<float>"), F.array().cast("array<float>")).alias("dense_vector"),
        F.coalesce(weights, empty).alias("sparse_vector"), F.coalesce(payload, F.create_map().cast("map<string,string>")).alias("payload"),
    )


def hits_of(found: DataFrame, points: DataFrame, source: str) -> DataFrame:
    """(query_id, point_id, score, rank, chunk_id, text, payload, retrieval_source) of ``found`` (query_id, id, score, rank).

    The chunk's id is that of the point where the payload names none; its text is raw_text, else
    chunk_text; vectors are no part of the payload.
    """
    kept = F.map_filter("payload", lambda k, v: ~k.isin("dense_vector", "sparse_vector", "vector"))
    p = points.select(F.col("point_id").alias("id"), kept.alias("payload"))
    text = F.coalesce(F.nullif(F.try_element_at("payload", F.lit("raw_text")), F.lit("")), F.try_element_at("payload", F.lit("chunk_text")), F.lit(""))
    chunk = F.coalesce(F.nullif(F.try_element_at("payload", F.lit("chunk_id")), F.lit("")), F.col("id"))
    return found.join(p, "id").select("query_id", F.col("id").alias("point_id"), "score", "rank", chunk.alias("chunk_id"), text.alias("text"), "payload", F.lit(source).alias("retrieval_source"))


class Store(ABC):
    """What an index of points can do; every search takes many queries at once."""

    @abstractmethod
    def ensure(self, name: str, recreate: bool = False) -> None: ...

    @abstractmethod
    def drop(self, name: str) -> None: ...

    @abstractmethod
    def exists(self, name: str) -> bool: ...

    @abstractmethod
    def upsert(self, name: str, points: DataFrame) -> int: ...

    @abstractmethod
    def search_dense(self, name: str, queries: DataFrame, top_k: int = L.HITS_TOP, filters: list | None = None) -> DataFrame: ...

    @abstractmethod
    def search_sparse(self, name: str, queries: DataFrame, top_k: int = L.HITS_TOP, filters: list | None = None) -> DataFrame: ...

    @abstractmethod
    def healthy(self) -> bool: ...


class TableStore(Store):
    """Collections as versioned tables below ``path``. Filters are on keys of the payload, as text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> VersionedTable:
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a name: {name}")
        return VersionedTable(self.spark, f"{self.path}/{name}")

    def ensure(self, name: str, recreate: bool = False) -> None:
        if recreate:
            self.drop(name)
        if not self.exists(name):
            self._table(name).commit(self.spark.createDataFrame([], POINT), 0)

    def drop(self, name: str) -> None:
        t = self._table(name)
        t._fs.delete(t._path(t.path), True)

    def exists(self, name: str) -> bool:
        return self._table(name).current() is not None

    def points(self, name: str, filters: list | None = None) -> DataFrame:
        rows = self._table(name).read()
        if rows is None:
            raise KeyError(f"no collection: {name}")
        for field, op, value in filters or []:
            key = f"_{field}"
            rows = rows.withColumn(key, F.try_element_at("payload", F.lit(field))).where(R.conditions([(key, op, value)])).drop(key)
        return rows

    def upsert(self, name: str, points: DataFrame) -> int:
        """Merges ``points`` by id, last write wins; returns how many the collection holds then. Ids repeated among them count once."""
        new = latest(coerced_points(points), "point_id")
        self.ensure(name)
        old = self.points(name)
        t = self._table(name)
        t.commit(old.join(new.select("point_id"), "point_id", "left_anti").unionByName(new), t.current()[0] + 1)
        return self.points(name).count()

    def search_dense(self, name: str, queries: DataFrame, top_k: int = L.HITS_TOP, filters: list | None = None) -> DataFrame:
        """Hits of ``queries`` (query_id, vector)."""
        points = self.points(name, filters)
        found = R.dense_topk(queries, points.where("size(dense_vector) > 0").select(F.col("point_id").alias("id"), F.col("dense_vector").alias("vector")), top_k)
        return hits_of(found, points, "dense")

    def search_sparse(self, name: str, queries: DataFrame, top_k: int = L.HITS_TOP, filters: list | None = None) -> DataFrame:
        """Hits of ``queries`` (query_id, sparse), a map of weights."""
        points = self.points(name, filters)
        postings = points.select(F.col("point_id").alias("id"), F.explode("sparse_vector").alias("idx", "weight"))
        found = R.sparse_topk(queries.select("query_id", F.explode("sparse").alias("idx", "weight")), postings, top_k)
        return hits_of(found, points, "sparse")

    def healthy(self) -> bool:
        try:
            return self.spark.range(1).count() == 1
        except Exception:  # whatever is wrong, it is not healthy
            return False


BACKENDS: dict[str, Callable[[SparkSession, str], Store]] = {"tables": TableStore}


def open_store(spark: SparkSession, path: str, backend: str = "tables") -> Store:
    """The store of a backend by name; an unknown one is an error."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}, known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[backend](spark, path)
