"""Results kept under the hash of their question, with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.merge import upsert


def cache_key(namespace: str, version: str, operation: str, *parts: Column) -> Column:
    """Key of an operation on its parts; the first is a question, whose case and outer blanks do not count."""
    first = F.lower(F.trim(F.coalesce(parts[0].cast("string"), F.lit(""))))
    rest = [F.coalesce(p.cast("string"), F.lit("")) for p in parts[1:]]
    return F.concat(F.lit(f"{namespace}:{version}:{operation}:"), F.substring(F.sha2(F.concat_ws("|", first, *rest), 256), 1, 16))


def split_known(queries: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(known, unknown) of ``queries`` (key, ...): with the value of ``cache`` (key, value, expires_at), where it has not expired."""
    live = cache.where(F.col("expires_at") > now).select("key", "value")
    return queries.join(live, "key"), queries.join(live, "key", "left_anti")


def stored(cache: DataFrame, results: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """``cache`` with ``results`` (key, value) added and what has expired left out."""
    new = results.select("key", "value", (now + F.make_interval(mins=F.lit(minutes))).alias("expires_at"))
    return upsert(cache.where(F.col("expires_at") > now).select("key", "value", "expires_at"), new, "key", "expires_at")
