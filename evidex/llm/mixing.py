"""Sources mixed to target weights by entropy balancing.

Each document gets a rate, the number of times it is used, that is as near to one (in the sense of
relative entropy) as lets the tokens of each source meet its target: rate = min(cap, exp(l * tokens /
mean)), one multiplier l per source. The convex dual is solved by Newton steps for all sources at
once; a step needs two sums per source, taken over a histogram of the tokens of documents. Rates are
then rounded to whole copies by systematic sampling: documents of a source stand in order of their
hash, each as long as the tokens its rate gives, and one that covers a mark, the marks a document's
tokens apart, is used. What a source gets differs from its target by less than its largest document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from evidex.llm.bpe import token_counts
from evidex.runtime import materialize

TOLERANCE, STEPS = 1e-9, 60
#: Parts into which documents of one source and length are counted.
BUCKETS = 1024


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, share, cap): target shares; null sources and weights, and weights not above zero, have none."""
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_weight").alias("w"), F.max("max_repeats").alias("cap"))
    rows = rows.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(0.0))
    total = rows.agg(F.sum("w").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("source", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(0.0).alias("share"), F.greatest(F.coalesce("cap", F.lit(1)), F.lit(0)).alias("cap"))


def _solve(histogram: DataFrame, aims: dict[str, tuple[float, int]], means: dict[str, float]) -> dict[str, float]:
    """The multiplier of each source whose aim lies strictly between nothing and everything at its cap."""
    spark = histogram.sparkSession
    low, high, at = dict.fromkeys(aims, -50.0), dict.fromkeys(aims, 50.0), dict.fromkeys(aims, 0.0)
    open_ = set(aims)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("l", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("cap", T.DoubleType())])
    for _ in range(STEPS):
        if not open_:
            break
        now = spark.createDataFrame([(s, at[s], means[s], float(aims[s][1])) for s in sorted(open_)], schema)
        free = F.exp(F.col("l") * F.col("tokens") / F.col("mean"))
        mass = F.col("n") * F.col("tokens")
        sums = (
            histogram.join(F.broadcast(now), "source")
            .groupBy("source")
            .agg(F.sum(mass * F.least(free, "cap")).alias("got"), F.sum(F.when(free < F.col("cap"), mass * free * F.col("tokens") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        for row in sums.collect():  # one row per source
            s, gap = row["source"], row["got"] - aims[row["source"]][0]
            if abs(gap) <= TOLERANCE * aims[s][0]:
                open_.discard(s)
                continue
            if gap < 0:
                low[s] = at[s]
            else:
                high[s] = at[s]
            step = at[s] - gap / row["slope"] if row["slope"] > 0 else math.inf
            at[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return at


def _whole_copies(sized: DataFrame, rates: DataFrame, histogram: DataFrame) -> DataFrame:
    """``sized`` (key, source, tokens) with rate and copies, rates being by source and tokens alone.

    Systematic sampling of the fractions: documents stand by source and tokens, then by hash, and each
    whose span of the running sum of fractions holds a half is used once more. As tokens rise along
    that order, a source's tokens differ from those its rates give by less than its largest document.
    The running sum is put together from the histogram, from counts of hash buckets within a length,
    and from the places within a bucket, so that no task holds a whole source or length.
    """
    rate = F.when(F.col("tokens") == 0, 0.0).when(F.col("inner"), F.least(F.exp(F.col("l") * F.col("tokens") / F.col("mean")), "cap")).otherwise(F.col("cap"))
    before = W.partitionBy("source").orderBy("tokens").rowsBetween(W.unboundedPreceding, -1)
    lengths = histogram.join(F.broadcast(rates), "source").withColumn("rate", rate).withColumn("part", F.col("rate") - F.floor("rate"))
    lengths = lengths.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("part")).over(before), F.lit(0.0))).drop("n", "l", "mean", "cap", "inner")
    placed = sized.withColumn("hash", F.xxhash64("key")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    of = ["source", "tokens", "bucket"]
    counts = placed.groupBy(*of).agg(F.count("*").alias("m"))
    upto = W.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("skip", F.coalesce(F.sum("m").over(upto), F.lit(0))).drop("m")
    placed = placed.withColumn("place", F.row_number().over(W.partitionBy(*of).orderBy("hash", "key")))
    rows = placed.join(counts, of).join(lengths, ["source", "tokens"])
    end = F.col("start") + (F.col("skip") + F.col("place")) * F.col("part") + 0.5
    more = F.floor(end) - F.floor(end - F.col("part"))
    return rows.select("key", "source", "tokens", "rate", (F.floor("rate") + more).cast("int").alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, report) of a mix as large as all ``documents`` (key, source, text) in tokens.

    ``copies`` (key, source, tokens, rate, copies) has a row per document of a source in ``targets``
    (source, target_weight, max_repeats), zero copies included. ``report`` has a row per target
    source: share wanted, documents, tokens, what it can give at most (capacity), whether that is
    short of its share, tokens in the mix, its share of all tokens, the share of the mix reached, and
    the one attainable, which is above the target where other sources fall short. A source without
    documents has none of all; null and empty texts have no tokens and get no copies; documents of
    other or null sources count in the size alone. A source that falls short gives all it has.
    """
    spark = documents.sparkSession
    counted = token_counts(documents.select(F.struct(F.col(key).alias("key"), "source").alias("k"), F.col(text).alias("text")), "k")
    sized = materialize(counted.select("k.key", "k.source", "tokens"), "sized")
    wanted = materialize(targets_of(targets), "targets")
    histogram = materialize(sized.groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")
    total = histogram.agg(F.sum(F.col("n") * F.col("tokens"))).first()[0] or 0
    held = histogram.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
    plan = wanted.join(held, "source", "left").fillna(0, ["documents", "tokens"])
    plan = plan.withColumn("capacity", F.col("tokens") * F.col("cap")).withColumn("wanted", F.col("share") * F.lit(float(total)))
    plan = materialize(plan, "plan")
    rows = plan.collect()  # one row per target source
    inner = {r["source"]: (r["wanted"], r["cap"]) for r in rows if 0 < r["wanted"] < r["capacity"]}
    means = {r["source"]: r["tokens"] / r["documents"] for r in rows if r["source"] in inner}
    found = _solve(histogram, inner, means)
    # sources at their limit: everything at the cap, or nothing at all
    settled = [(r["source"], found.get(r["source"], 0.0), means.get(r["source"], 1.0), float(r["cap"] if r["wanted"] > 0 else 0), r["source"] in inner) for r in rows]
    rates = spark.createDataFrame(settled, "source string, l double, mean double, cap double, inner boolean")
    copies = _whole_copies(sized, rates, histogram).withColumnRenamed("key", key)
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    aim = F.least("wanted", F.col("capacity").cast("double"))
    sums = plan.join(got, "source", "left").agg(F.sum(F.coalesce("mixed", F.lit(0))).alias("all"), F.sum(aim).alias("aims"))
    report = plan.join(got, "source", "left").fillna(0, ["mixed"]).crossJoin(F.broadcast(sums))
    of = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    report = report.select(
        "source", "share", "documents", "tokens", "capacity", (F.col("capacity") < F.col("wanted")).alias("short"), "mixed",
        of(F.col("mixed"), F.lit(float(total))).alias("of_all"), of(F.col("mixed"), F.col("all")).alias("reached"), of(aim, F.col("aims")).alias("attainable"),
    )
    return copies, report
