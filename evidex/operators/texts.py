"""Search of all texts of a table by many texts in one pass: what is moved are the best hits of each task, never postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions.text import clinical_tokens
from evidex.operators.retrieve import _best
from evidex.runtime import parallel

#: Different questions held by a task at once; more are searched in several passes over the texts. Rows of scores held at once. Elements of a vector of term counts.
QUERY_BLOCK, SCORE_BLOCK, ELEMENTS = 131_072, 256, 64


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded, halves up as in SQL; for what is not negative."""
    return np.floor(x * 10**places + 0.5) / 10**places


def _term(term: str) -> tuple[int, float]:
    """Bucket and weight of a term: functions.text.bucket() and idf()."""
    weight = 3.5 if "_" in term else 3.0 if len(term) > 10 else 2.0 if len(term) > 6 else 1.0
    return int(md5(term.encode()).hexdigest()[:8], 16) % L.BUCKETS, weight


def postings(tokens: pa.Array, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, weight) of lists of tokens, by row and idx: retrieve.sparse_vectors() without a shuffle. ``known`` keeps what is said of terms."""
    total = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    said = [known.get(t) or known.setdefault(t, _term(t)) for t in flat.dictionary.to_pylist()]
    if not said:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    buckets, idf = np.array([b for b, _ in said], np.int64), np.array([w for _, w in said])
    pairs, n = np.unique(np.repeat(np.arange(len(total)), total) * len(said) + flat.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(pairs, len(said))
    weight = n / total[row] * idf[code]
    kept = weight > 0.001
    pairs, at = np.unique(row[kept] * L.BUCKETS + buckets[code[kept]], return_inverse=True)
    return *np.divmod(pairs, L.BUCKETS), np.bincount(at, weight[kept], len(pairs))


def _directions(row: np.ndarray, idx: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Texts as term counts of ELEMENTS elements, of length one; without terms zero."""
    x = half_up(np.bincount(row * ELEMENTS + idx % ELEMENTS, weight, n * ELEMENTS), 6).reshape(n, ELEMENTS)  # copies of a text must not differ in the last digits of a sum
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _dense_scores(asked: np.ndarray, texts: np.ndarray, k: int, bound: np.ndarray) -> Iterator[tuple]:
    """(query, text, score) of all that may be among the k best: SCORE_BLOCK queries at a time."""
    held = np.flatnonzero(texts.any(axis=1))
    texts = np.ascontiguousarray(texts[held].T)
    for at in range(0, len(asked), SCORE_BLOCK):
        scores, low = asked[at : at + SCORE_BLOCK] @ texts, bound[at : at + SCORE_BLOCK]
        few = scores[:, : max(1024, 8 * k)]
        if few.shape[1] >= k:
            low = np.maximum(low, np.partition(few, -k, axis=1)[:, -k])
        q, j = np.nonzero(scores >= low[:, None] - 1e-9)
        yield q + at, held[j], scores[q, j]


def _sparse_scores(asked: tuple, row: np.ndarray, idx: np.ndarray, weight: np.ndarray, n: int, k: int, bound: np.ndarray) -> Iterator[tuple]:
    """As _dense_scores() for inner products of weights; texts without a term of the query take no part."""
    first, terms, weights = asked
    order = np.argsort(idx, kind="stable")
    row, idx, weight = row[order], idx[order], weight[order]
    begins, ends = np.searchsorted(idx, terms), np.searchsorted(idx, terms + 1)
    score = np.empty(n)
    for at in range(0, len(first) - 1, SCORE_BLOCK):
        found, of = [], first[at : at + SCORE_BLOCK + 1]
        held = list(zip(*(x[of[0] : of[-1]].tolist() for x in (begins, ends, weights))))
        of = (of - of[0]).tolist()
        for q in range(at, at + len(of) - 1):
            score[:] = 0
            for a, b, w in held[of[q - at] : of[q - at + 1]]:
                if a < b:
                    score[row[a:b]] += w * weight[a:b]
            j = np.flatnonzero(score >= bound[q] - 1e-9) if bound[q] > 1e-9 else np.flatnonzero(score)
            if len(j) > 4 * k:
                s = score[j]
                j = j[s >= np.partition(s, -k)[-k] - 1e-9]
            if len(j):
                found.append((np.full(len(j), q), j, score[j]))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _search(names: pa.Array, tokens: pa.Array, sparse: int, dense: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best hits in each batch of (id, t), of those that a batch before does not exclude; ties go by id."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        n = len(names)
        row, terms, weights = postings(tokens, known)
        first = np.searchsorted(row, np.arange(n + 1))
        directions = _directions(row, terms, weights, n) if dense else None
        bounds = {kind: np.full(n, -np.inf) for kind in (0, 1)}  # a score that k texts reach
        for part in parts:
            if not part.num_rows:
                continue
            held = postings(part.column("t"), known)
            place = pc.rank(part.column("id"), null_placement="at_start", tiebreaker="first").to_numpy()
            searches = []
            if dense:
                searches.append((0, dense, _dense_scores(directions, _directions(*held, part.num_rows), dense, bounds[0])))
            if sparse:
                searches.append((1, sparse, _sparse_scores((first, terms, weights), *held, part.num_rows, sparse, bounds[1])))
            for kind, k, found in searches:
                for q, j, score in found:
                    score = half_up(score, 9)
                    order = np.lexsort((place[j], -score, q))
                    q, j, score = q[order], j[order], score[order]
                    begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
                    rank = np.arange(len(q)) - np.repeat(begins, np.diff([*begins, len(q)]))
                    last = rank == k - 1
                    bounds[kind][q[last]] = np.maximum(bounds[kind][q[last]], score[last])
                    q, j, score = (x[rank < k] for x in (q, j, score))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(np.full(len(q), kind, np.int32)), part.column("id").take(pa.array(j)), pa.array(score)], ["key", "of", "id", "score"])

    return run


def search(queries: DataFrame, texts: DataFrame, sparse: int, dense: int = 0) -> DataFrame:
    """(query_id, of, id, score, rank) of ``queries`` (query_id, query) in ``texts`` (id, text); ``of`` is 0 for dense hits, 1 for sparse ones.

    Sparse: the ``sparse`` texts of greatest inner product of sparse_vectors(); dense: the ``dense``
    texts most similar by cosine of 64 term counts. Exact. Equal lists of terms are searched once;
    each batch of texts is turned into weights where it is read and held against all of them, of
    which QUERY_BLOCK go to the tasks in a pass. A text without terms is not found and finds nothing.
    """
    asked = queries.select("query_id", F.array_sort(clinical_tokens(F.col("query"))).alias("t")).where(F.size("t") > 0).withColumn("key", F.md5(F.array_join("t", " ")))
    wanted = asked.groupBy("key").agg(F.first("t").alias("t")).toArrow()
    held = parallel(texts.select("id", "text")).select("id", clinical_tokens(F.col("text")).alias("t"))
    schema = f"key string, of int, id {texts.schema['id'].dataType.simpleString()}, score double"
    found = None
    for at in range(0, wanted.num_rows, QUERY_BLOCK):
        block = wanted.slice(at, QUERY_BLOCK).combine_chunks()
        hits = held.mapInArrow(_search(block.column("key").combine_chunks(), block.column("t").combine_chunks(), sparse, dense), schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = texts.sparkSession.createDataFrame([], schema)
    best = _best(found, max(sparse, dense), "key", "of").where(F.col("rank") < F.when(F.col("of") == 0, dense).otherwise(sparse))
    return best.join(asked.select("key", "query_id"), "key").select("query_id", "of", "id", "score", "rank")
