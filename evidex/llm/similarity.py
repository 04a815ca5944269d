"""Text similarity shared by the duplicate operators.

Similarity of two texts: lower-case, trim, collapse white space, take the set of distinct
substrings of ``width`` characters (the whole text if shorter); intersection over union.
Substrings are handled as 64-bit rolling hashes, computed for many texts in one numpy pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``codes[i:i+width]`` for every i, by doubling; shorter input gives one hash of it all."""
    h = codes.astype(np.uint64) + np.uint64(1)
    width = min(width, len(h))
    if width < 1:
        return np.zeros(0, np.uint64)
    out, done, span = None, 0, 1
    while True:
        if width & span:
            if out is None:
                out, done = h, span
            else:
                n = len(codes) - done - span + 1
                out = out[:n] + _power(done) * h[done : done + n]
                done += span
        span *= 2
        if span > width:
            return _mix(out[: len(codes) - width + 1])
        half = span // 2
        h = h[: len(h) - half] + _power(half) * h[half:]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a normalised text."""
    return np.unique(rolling(codes_of(text), width))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def _verify(width: int, minimum: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = None, None
        for pdf in parts:
            sims = np.empty(len(pdf))
            for i, (a, x, y) in enumerate(zip(pdf["a"], pdf["text_a"], pdf["text_b"])):
                if key != a:
                    key, held = a, shingles(normalise(x), width)
                sims[i] = jaccard(held, shingles(normalise(y), width))
            keep = sims >= minimum
            yield pd.DataFrame({"a": pdf["a"][keep], "b": pdf["b"][keep], "similarity": sims[keep]})

    return run


#: Candidate documents up to this many are told to the scan by broadcast (8 bytes each); more go by shuffle.
BROADCAST_IDS = 1_000_000


def verified_pairs(pairs: DataFrame, texts: DataFrame, minimum: float, width: int = WIDTH) -> DataFrame:
    """Exact similarity of candidate pairs (a, b) over ``texts`` (id, text): (a, b, similarity >= minimum).

    ``pairs`` is read three times and should be a written table. Only texts of candidates are
    shuffled: their ids are counted first, and broadcast to the scan while at most BROADCAST_IDS.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    kind = texts.schema["id"].dataType.simpleString()
    return (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
        .mapInPandas(_verify(width, minimum), f"a {kind}, b {kind}, similarity double")
    )
