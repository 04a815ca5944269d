"""Counts of what is stored, run summaries and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = [
    "documents_fetched", "documents_stored", "documents_skipped_duplicate", "documents_failed_validation", "chunks_created",
    "chunks_embedded", "chunks_skipped_noise", "chunks_skipped_quality", "chunks_failed_validation", "embedding_errors",
]


def once(runs: DataFrame) -> DataFrame:
    """Runs without repeated rows."""
    return runs.dropDuplicates()


def finished(runs: DataFrame) -> DataFrame:
    """Runs with status and duration derived: failed with an error message, completed with an end, else running."""
    status = F.when(F.col("error_message").isNotNull(), "failed").when(F.col("finished_at").isNotNull(), "completed").otherwise("running")
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return once(runs).withColumn("status", status).withColumn("duration_seconds", F.round(seconds, 1))


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals per source and status, and over all (nulls), of runs that count once."""
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in COUNTERS]
    return once(runs).rollup("source_type", "status").agg(F.count("*").alias("runs"), *sums, F.round(F.sum(F.coalesce("duration_seconds", F.lit(0.0))), 1).alias("seconds"), F.grouping_id().cast("bigint").alias("level"))


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The n runs started last; ties by id."""
    return once(runs).orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(n)


def run_alerts(runs: DataFrame) -> DataFrame:
    """(run_id, alert): failed runs, runs with embedding errors, runs that did not finish."""
    found = F.array(
        F.when(F.col("status") == "failed", "failed"),
        F.when(F.coalesce("embedding_errors", F.lit(0)) > 0, "embedding errors"),
        F.when(F.col("finished_at").isNull(), "unfinished"),
    )
    return once(runs).select("run_id", F.explode(F.filter(found, lambda a: a.isNotNull())).alias("alert"))


def storage_stats(documents: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """(source_type, documents, chunks, embedded) per source and over all (null, level 1)."""
    part = lambda df, name: df.select("source_type", *[F.lit(1 if name == n else 0).alias(n) for n in ("documents", "chunks", "embedded")])
    rows = part(documents, "documents").unionByName(part(chunks, "chunks")).unionByName(part(points, "embedded"))
    sums = [F.sum(n).cast("bigint").alias(n) for n in ("documents", "chunks", "embedded")]
    return rows.rollup("source_type").agg(*sums, F.grouping("source_type").cast("bigint").alias("level"))
