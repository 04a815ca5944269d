"""Where models plug in. No weights are shipped: the stand-ins are deterministic and say so.

Factories turn a model into a pandas UDF that loads it once per Python worker and works on Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


class Nli(Protocol):
    def label(self, premises: list[str], hypotheses: list[str]) -> list[str]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """A stand-in for an embedding model: signed word hashes in ``dims`` dimensions, length one. Not a semantic model."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dims] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class OverlapScorer:
    """A stand-in for a reranking model: shared words over words of the query. Not a cross-encoder."""

    def score(self, queries: list[str], texts: list[str]) -> np.ndarray:
        pairs = ((set(q.lower().split()), set(t[:512].lower().split())) for q, t in zip(queries, texts))
        return np.array([len(q & t) / len(q) if q else 0.0 for q, t in pairs])


def embed_udf(load: Callable[[], Embedder], batch: int = 32):
    """text -> array<float>; null texts give null."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            held = s.dropna()
            made = iter([v for i in range(0, len(held), batch) for v in model.embed(held.iloc[i : i + batch].tolist())])
            yield pd.Series([None if t is None else next(made) for t in s.where(s.notna(), None)], s.index, dtype=object)

    return embed


def score_udf(load: Callable[[], Scorer]):
    """(query, text) -> double; null texts score as empty."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in parts:
            yield pd.Series(model.score(q.fillna("").tolist(), t.fillna("").tolist()), q.index)

    return score


def label_udf(load: Callable[[], Nli]):
    """(premise, hypothesis) -> label."""

    @F.pandas_udf("string")
    def label(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in parts:
            yield pd.Series(model.label(a.fillna("").tolist(), b.fillna("").tolist()), a.index)

    return label


def generate_udf(load: Callable[[], Generator]):
    """prompt -> text; a failing batch gives nulls, for the caller's fallback."""

    @F.pandas_udf("string")
    def generate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            try:
                yield pd.Series(model.generate(s.fillna("").tolist()), s.index)
            except Exception:  # the model's failure is the caller's to handle, by coalesce
                yield pd.Series([None] * len(s), s.index, dtype=object)

    return generate
