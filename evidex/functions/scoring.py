"""Scores of chunks and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions.classify import _lookup
from evidex.functions.text import hits


def quality(text: Column, kind: Column, level: Column, tokens: Column, entities: Column, safety: Column) -> Column:
    """Chunk quality in [0, 1] from content type, length, entities, evidence, signs of value and of noise."""
    length = (
        F.when((tokens >= 50) & (tokens <= 300), 0.10)
        .when(tokens < 50, tokens / 50 * 0.10)
        .otherwise(F.greatest(F.lit(0.0), 0.10 - (tokens - 300) / 600 * 0.10))
    )
    raw = (
        _lookup(kind, L.BASE_OF_CONTENT, L.BASE_UNKNOWN)
        + length
        + F.least(F.lit(0.10), entities * 0.015)
        + _lookup(level, L.BONUS_OF_LEVEL, 0.0)
        + F.least(F.lit(0.10), hits(text, L.HIGH_VALUE) * 0.02)
        + F.when(safety, 0.05).otherwise(0.0)
        - F.least(F.lit(0.20), hits(text, L.LOW_VALUE) * 0.07)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)


def confidence(citations: Column, average: Column, first_grade: Column, risk: Column, quality_: Column, consistency: Column, warnings: Column, high: Column) -> Column:
    """Confidence in an answer, in [0, 1]."""
    evidence = F.when(average <= 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (6 - average) / 5 + 0.1 * first_grade)))
    penalty = F.least(F.lit(0.4), F.least(F.lit(0.3), 0.05 * warnings) + F.when(high, 0.1).otherwise(0.0))
    raw = (
        0.25
        + 0.15 * F.least(F.lit(1.0), citations / 8)
        + 0.15 * evidence
        + 0.20 * F.greatest(F.lit(0.0), 1 - risk)
        + 0.15 * quality_
        + 0.10 * consistency
        - penalty
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def consistency(sources: Column, variance: Column, chunks: Column) -> Column:
    """Agreement of the chunks behind an answer: few distinct sources and spread scores lower it."""
    full = 0.4 * F.least(F.lit(1.0), sources / 3) + 0.6 * F.greatest(F.lit(0.0), 1 - 2 * variance)
    return F.when(chunks < 2, 0.8).otherwise(full)


def verdict(risk: Column, safe: Column, valid: Column, total: Column, disclaimer: Column, sure: Column, high_issues: Column) -> Column:
    return (
        F.when((risk > 0.6) | ~safe | ((valid == 0) & (total > 0)), "UNSAFE")
        .when((risk > 0.3) | disclaimer | (sure < 0.5) | (high_issues > 0), "NEEDS_REVIEW")
        .otherwise("SAFE")
    )
