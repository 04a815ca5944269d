"""Near-duplicate records: HyperMinHash registers, banding, corrected estimate, exact check.

Each text becomes ``REGISTERS`` registers. A substring hash picks a register by its low bits;
the register keeps the least of the remaining 57-bit values as its leading-zero count and ten
mantissa bits, which is the exponent and top mantissa of that value as a float, 16 bits in all.
Bands of registers are joined for candidates, whose similarity is estimated from equal registers
less the equalities expected by chance; what may reach the threshold is then checked exactly.
Exact copies are one class, represented by its least id, before any pair is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.similarity import WIDTH, codes_of, normalise, rolling, verified_pairs
from evidex.runtime import materialize

REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
EMPTY = np.uint16(65535)
#: Contents of fewer characters, but for the blanks around them, are never a case.
LEAST = 40
#: Chance of equal registers of different sets: 0.1699 * 2^-mantissa * 4x/(1+x)^2 for sizes in ratio x.
CHANCE = 0.169919487159739 / 2**MANTISSA

_detour = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)


def registers(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Registers of normalised texts (n x REGISTERS, uint16) and how many each had before empties were filled."""
    codes = [codes_of(t) for t in texts]
    sizes = np.array([len(c) for c in codes])
    joined = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    counts = np.maximum(sizes - width + 1, 0)
    hashes = rolling(joined, width) if len(joined) >= width else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    hashes = hashes[at]
    for i in np.flatnonzero(counts == 0):  # shorter than one substring: the whole text is one
        if sizes[i]:
            hashes = np.append(hashes, rolling(codes[i], width))
            owner = np.append(owner, i)
    low = np.uint64((1 << 57) - 1)
    slot = ((hashes >> np.uint64(57)) * np.uint64(REGISTERS) >> np.uint64(7)).astype(np.int64)
    value = ((hashes & low) | np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    value = (value - np.uint64(1023 << MANTISSA)).astype(np.uint16)
    flat = np.full(len(texts) * REGISTERS, EMPTY, np.uint16)
    np.minimum.at(flat, owner * REGISTERS + slot, value)
    regs = flat.reshape(len(texts), REGISTERS)
    filled = (regs != EMPTY).sum(axis=1)
    for i in np.flatnonzero((filled < REGISTERS) & (filled > 0)):  # an empty register borrows along its own fixed detour
        full = regs[i] != EMPTY
        first = full[_detour].argmax(axis=1)
        regs[i] = np.where(full, regs[i], regs[i][_detour[np.arange(REGISTERS), first]])
    return regs, filled


def _sketch(width: int, least: int, chars: int = 1_000_000):
    def flush(ids, texts):
        regs, filled = registers(texts, width)
        return pd.DataFrame(
            {
                "id": ids,
                "digest": [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts],
                "size": [max(1, len(t) - width + 1) for t in texts],
                "filled": filled.astype(np.int32),
                "regs": [r.tobytes() for r in regs],
            }
        )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids, texts, held = [], [], 0
            for i, t in zip(pdf["id"], pdf["text"]):
                if t is None or len(t.strip()) < least:
                    continue
                t = normalise(t)
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held > chars:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield flush(ids, texts)

    return run


def sketches(df: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(id, digest, size, filled, regs) of ``df`` (id, text); null and short texts give no row."""
    kind = df.schema["id"].dataType.simpleString()
    return (
        df.select("id", "text")
        .where(F.length("text") >= least)
        .mapInPandas(_sketch(width, least), f"id {kind}, digest binary, size int, filled int, regs binary")
    )


def _band_keys() -> F.Column:
    bytes_ = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * bytes_, bytes_)) for i in range(BANDS)])


def candidate_pairs(reps: DataFrame, minimum: float) -> DataFrame:
    """(a, b), a < b, of ``reps`` (id, size, filled, regs) sharing a band, whose corrected estimate may reach ``minimum``."""
    keys = reps.select("id", F.explode(_band_keys()).alias("band"))
    left, right = keys.withColumnRenamed("id", "a"), keys.withColumnRenamed("id", "b")
    pairs = left.join(right, "band").where("a < b").select("a", "b").distinct()
    side = lambda x: reps.select(*[F.col(c).alias(f"{c}_{x}" if c != "id" else x) for c in ("id", "size", "filled", "regs")])
    equal = F.lit(0)
    for i in range(REGISTERS):
        equal = equal + (F.substring("regs_a", 1 + 2 * i, 2) == F.substring("regs_b", 1 + 2 * i, 2)).cast("int")
    ratio = F.col("size_a") / F.col("size_b")
    by_chance = CHANCE * 4 * ratio / ((1 + ratio) * (1 + ratio)) * REGISTERS
    real = F.least("filled_a", "filled_b")
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .withColumn("estimate", (equal - by_chance) / (REGISTERS - by_chance))
        .where(F.col("estimate") >= minimum - 4 * F.sqrt(0.25 / real))
        .select("a", "b")
    )


def near_duplicates(df: DataFrame, minimum: float = 0.6, width: int = WIDTH, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates among ``df`` (id, text): (pairs, members).

    ``pairs`` (a, b, similarity): representatives a < b of different texts with similarity of at
    least ``minimum``. ``members`` (id, rep): every record of at least ``least`` trimmed characters
    and its class of exact (normalised) copies. Null, empty and short texts are in neither; repeated
    ids give one member; other columns of ``df`` are not read; an empty table gives empty results.
    """
    sketch = materialize(sketches(df, width, least), "sketches")
    members = sketch.select("id", "digest")
    classes = members.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = sketch.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    pairs = materialize(candidate_pairs(reps, minimum), "candidates")
    found = verified_pairs(pairs, df.select("id", "text"), minimum, width)
    copied = members.join(classes.where("n > 1").select("digest", "rep"), "digest", "left")
    return found, copied.select("id", F.coalesce("rep", "id").alias("rep")).distinct()


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All (record_a, record_b), record_a < record_b, of linked or equal classes.

    Only classes of several members, or in a pair, are joined: single texts stay out.
    """
    linked = pairs.select("a", "b")
    several = members.where("id <> rep").select("rep").distinct().select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    both = linked.unionByName(several)
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    all_ = both.join(left, "a").join(right, "b").where("a <> b or x < y")
    return all_.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of every id in ``pairs`` (a, b): root is the least id that links lead to.

    Each round takes the least label among neighbours, then that label's own label, so that chains
    shorten by half; partial minima are taken before the shuffle. Ends when no label changes.
    """
    pairs = pairs.select("a", "b")
    edges = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    labels = materialize(labels, "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "root"), "b").select(F.col("a").alias("id"), "root").unionByName(labels)
        near = near.groupBy("id").agg(F.min("root").alias("root"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("top"))
        after = materialize(near.join(up, "root", "left").select("id", F.least("root", F.coalesce("top", "root")).alias("root")), "labels")
        changed = not after.join(labels.withColumnRenamed("root", "was"), "id").where("root <> was").isEmpty()
        labels = after
        if not changed:
            return labels


def near_duplicate_groups(df: DataFrame, minimum: float = 0.6, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(id, group, links): every record of near_duplicates' members, its group's least id, and how many different texts its own is linked to.

    A text without copies or links is a group of its own; null, empty and short texts have no row.
    """
    pairs, members = near_duplicates(df, minimum, width, least)
    pairs = materialize(pairs, "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    rows = members.join(components(pairs).withColumnRenamed("id", "rep"), "rep", "left").join(links, "rep", "left")
    return rows.select("id", F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
