"""Search of many queries at once: dense, sparse, fusion, diversity, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidex.functions import lexicons as L
from evidex.functions.classify import evidence_boost, recency_boost
from evidex.functions.text import bucket, clinical_tokens, idf
from evidex.functions.vectors import dot, unit
from evidex.runtime import parallel

#: Queries held by a task at once; more are searched in several passes over the index.
QUERY_BLOCK = 4096


def conditions(filters: list[tuple[str, str, object]]) -> Column:
    """All of (field, op, value), op in eq, in, gt, gte, lt, lte; none holds for all. Built as columns, never as text."""
    ops = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}

    def one(field: str, op: str, value) -> Column:
        if op == "in":
            if not isinstance(value, (list, tuple, set)):
                raise TypeError("in needs a list, tuple or set")
            return F.col(field).isin(list(value))
        return ops[op](F.col(field), F.lit(value))

    return reduce(lambda a, b: a & b, (one(*f) for f in filters), F.lit(True))


def _best(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best by score, ties by id. Scores are rounded first: a sum's last digits depend on the order of its parts."""
    hits = hits.withColumn("score", F.round("score", 9))
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def first_ranks(rows: DataFrame, k: int, keys, *order) -> DataFrame:
    """The first k rows of each of ``keys`` by ``order``, with their rank from 0."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("rank") < k)


def rerank(queries: DataFrame, hits: DataFrame, score: Callable[[Column, Column], Column], top: int = L.RERANK_TOP) -> DataFrame:
    """``hits`` (query_id, id, text, rank, ...) in the order of ``score`` (query, the first 512 characters of a text), the best ``top``.

    Where the model gives no score for any hit of a query, their order stays; ties go by the former rank.
    """
    rows = hits.join(queries.select("query_id", "query"), "query_id")
    rows = rows.withColumn("rerank_score", score(F.col("query"), F.substring(F.coalesce("text", F.lit("")), 1, 512))).withColumnRenamed("rank", "_rank").drop("query")
    return first_ranks(rows, top, ["query_id"], F.col("rerank_score").desc_nulls_last(), "_rank").drop("_rank")


def _block_scores(names: list, matrix: np.ndarray, k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf[[v is not None and len(v) == matrix.shape[1] for v in pdf["vector"]]]
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            length = np.linalg.norm(x, axis=1)
            scores = matrix @ np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0).T
            scores[~np.isfinite(scores)] = -2
            ids = pdf["id"].to_numpy()
            if k < len(ids):
                # all that reach the k-th best of this batch, so that ties are decided later
                bound = np.partition(scores, -k, axis=1)[:, -k]
                q, j = np.nonzero(scores >= bound[:, None])
            else:
                q, j = (a.ravel() for a in np.indices(scores.shape))
            keep = scores[q, j] > -2
            yield pd.DataFrame({"query_id": np.array(names)[q[keep]], "id": ids[j[keep]], "score": scores[q[keep], j[keep]]})

    return run


def dense_topk(queries: DataFrame, index: DataFrame, k: int = L.HITS_TOP, filters: list | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k rows of ``index`` (id, vector) most similar by cosine to each of ``queries`` (query_id, vector).

    Exact: the stated queries go against all rows in blocks of QUERY_BLOCK, a pass over the index
    each; only k rows of a query leave a batch. Vectors that are null, of another length or not
    finite take no part; a zero vector scores 0; ties go by id. Filters act before the search.
    """
    index = index.where(conditions(filters or [])).select("id", "vector")
    kinds = (queries.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString())
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    rows, found = queries.select("query_id", "vector").where("vector is not null").toLocalIterator(), None
    while block := list(islice(rows, QUERY_BLOCK)):
        matrix = np.array([r["vector"] for r in block], np.float64)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
        hits = index.mapInPandas(_block_scores([r["query_id"] for r in block], matrix, k), schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    return _best(found, k, "query_id")


def sparse_vectors(df: DataFrame, key: str, text: str, buckets: int = L.BUCKETS) -> DataFrame:
    """(key, idx, weight): postings of each text, term frequency times a weight by term length, per bucket of terms.

    Weights of terms up to 0.001 are left out; texts without terms have no postings.
    """
    tokens = parallel(df.select(key, text)).select(key, clinical_tokens(F.col(text)).alias("t"))
    terms = tokens.select(key, F.size("t").alias("total"), F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"), F.max("total").alias("total"))
    weighted = terms.withColumn("weight", F.col("n") / F.col("total") * idf(F.col("term"))).where("weight > 0.001")
    return weighted.groupBy(key, bucket(F.col("term"), buckets).alias("idx")).agg(F.sum("weight").alias("weight"))


def legacy_sparse(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, weight): raw counts of words of two or more letters and figures, in two million buckets."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)
    return df.select(key, F.explode(words).alias("term")).groupBy(key, bucket(F.col("term"), L.LEGACY_BUCKETS).alias("idx")).agg(F.count("*").cast("double").alias("weight"))


def sparse_topk(queries: DataFrame, postings: DataFrame, k: int = L.HITS_TOP) -> DataFrame:
    """(query_id, id, score, rank): inner products of ``queries`` (query_id, idx, weight) with ``postings`` (id, idx, weight).

    An equi-join on the term and a sum; partial sums are taken before the second shuffle.
    """
    q = queries.select("query_id", "idx", F.col("weight").alias("wq"))
    hits = q.join(postings.select("id", "idx", "weight"), "idx").groupBy("query_id", "id").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    return _best(hits, k, "query_id")


def rrf(dense: DataFrame, sparse: DataFrame, k: int = L.RRF_K) -> DataFrame:
    """(query_id, id, score, dense_rank, sparse_rank, found_by) of two ranked lists, by sums of reciprocal ranks."""
    both = dense.select("query_id", "id", F.col("rank").alias("dense_rank")).join(sparse.select("query_id", "id", F.col("rank").alias("sparse_rank")), ["query_id", "id"], "full_outer")
    score = F.coalesce(1 / (F.lit(k) + F.col("dense_rank") + 1), F.lit(0.0)) + F.coalesce(1 / (F.lit(k) + F.col("sparse_rank") + 1), F.lit(0.0))
    by = F.when(F.col("dense_rank").isNull(), "sparse").when(F.col("sparse_rank").isNull(), "dense").otherwise("both")
    return both.withColumn("score", score).withColumn("found_by", by)


def fuse(dense: DataFrame, sparse: DataFrame, documents: DataFrame, top: int = L.FUSED_TOP, k: int = L.RRF_K) -> DataFrame:
    """rrf with boosts by evidence level and year of ``documents`` (id, evidence_level, year), the best ``top`` of each query.

    Ties go by dense rank, then sparse rank, then id. Hits without a document are not boosted.
    """
    hits = rrf(dense, sparse, k).join(documents.select("id", "evidence_level", "year"), "id", "left")
    boosted = F.round(F.col("score") * evidence_boost(F.col("evidence_level")) * recency_boost(F.coalesce("year", F.lit(0))), 10)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id")
    return hits.withColumn("score", boosted).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < top)


def mmr(hits: DataFrame, select: int = L.MMR_TOP, weight: float = L.MMR_LAMBDA) -> DataFrame:
    """(query_id, id, pos): a diverse choice from ``hits`` (query_id, id, score, vector), at most ``select`` each.

    The best first, then whatever has the highest ``weight`` * score - (1 - weight) * greatest cosine
    to those chosen; ties go to the higher score, then the lower id. A query's hits are a short list
    (the result of a top-k), folded within one row; with at most ``select`` hits all are kept in order.
    """
    item = F.struct((-F.col("score")).alias("neg"), "id", unit(F.col("vector")).alias("v"))
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("c"))
    kept = lambda x, near: F.struct(x["neg"].alias("neg"), x["id"].alias("id"), x["v"].alias("v"), near.alias("near"))
    first = F.col("c")[0]
    rest = F.transform(F.slice(F.col("c"), F.lit(2), F.size("c")), lambda x: kept(x, dot(x["v"], first["v"])))
    start = F.struct(F.array(first["id"]).alias("chosen"), rest.alias("rest"))

    def step(s, _):
        # each of the rest carries its greatest cosine to those chosen, so that a step compares it with the last alone
        loss = lambda x: -(weight * -x["neg"] - (1 - weight) * x["near"])
        best = F.array_min(F.transform(s["rest"], lambda x: F.struct(loss(x).alias("loss"), x["neg"].alias("neg"), x["id"].alias("id"), x["v"].alias("v"))))
        left = F.filter(s["rest"], lambda x: x["id"] != best["id"])
        left = F.transform(left, lambda x: kept(x, F.greatest(x["near"], dot(x["v"], best["v"]))))
        return F.when(F.size(s["rest"]) == 0, s).otherwise(F.struct(F.array_append(s["chosen"], best["id"]).alias("chosen"), left.alias("rest")))

    greedy = F.aggregate(F.sequence(F.lit(2), F.lit(select)), start, step, lambda s: s["chosen"])
    ids = F.when(F.size("c") <= select, F.transform("c", lambda x: x["id"])).otherwise(greedy) if select > 1 else F.array(first["id"])
    return lists.select("query_id", F.posexplode(ids).alias("pos", "id"))


def context_prefix(blocks: DataFrame, limit: int = L.CONTEXT_CHARS) -> DataFrame:
    """Blocks (query_id, pos, block) before the first that would exceed ``limit`` characters in all; separators do not count."""
    w = W.partitionBy("query_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("upto", F.sum(F.length("block")).over(w)).where(F.col("upto") <= limit)


def context_block(pos: Column, title: Column, year: Column, journal: Column, level: Column, kind: Column, india: Column, text: Column) -> Column:
    """The numbered block of a hit in an answer's context."""
    label = None
    for name, words in L.LABEL_OF_LEVEL.items():
        label = F.when(level == name, words) if label is None else label.when(level == name, words)
    head = F.concat(F.lit("["), pos.cast("string"), F.lit("] "), F.coalesce(title, F.lit("Untitled")), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("")), F.lit(", "), F.coalesce(journal, F.lit("")), F.lit(")\n"))
    flag = F.when(india, " India-relevant").otherwise("")
    return F.concat(head, F.lit("Evidence: "), label.otherwise(L.NO_LABEL), F.lit(" | "), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), flag, F.lit("\n"), F.coalesce(text, F.lit("")))
