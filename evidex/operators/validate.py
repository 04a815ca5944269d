"""Validation of documents and chunks: the first rule that fails is the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions.text import BLANK, garble, letter_share, strip


def validate_documents(df: DataFrame) -> DataFrame:
    """``df`` (title, content, source_type, ...) with (ok, reason); null counts as blank, reason is null where ok."""
    title, content = strip(F.coalesce("title", F.lit(""))), F.coalesce("content", F.lit(""))
    size = F.length(strip(content))
    reason = (
        F.when(title == "", "blank title")
        .when(F.length(title) < L.TITLE_LEAST, "short title")
        .when(size == 0, "blank content")
        .when(size < L.DOC_LEAST, "short content")
        .when(size > L.DOC_MOST, "long content")
        .when(~F.coalesce("source_type", F.lit("")).isin(L.SOURCE_TYPES), "unknown source")
        .when(garble(content) > L.GARBLE_MOST, "garbled")
    )
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def validate_chunks(df: DataFrame) -> DataFrame:
    """``df`` (text, ...) with (ok, reason); null counts as blank, reason is null where ok."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(strip(text))
    reason = (
        F.when(size == 0, "blank")
        .when(size < L.CHUNK_LEAST, "short")
        .when(size > L.CHUNK_MOST, "long")
        .when(garble(text) > L.GARBLE_MOST, "garbled")
        .when(letter_share(text) < L.LETTERS_LEAST, "few letters")
    )
    return df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def clean_lines(text):
    """Lines with blanks collapsed, without blank and number lines and short ones that end no sentence; tables as they are."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    state = F.struct(F.lit(False).alias("table"), F.array().cast("array<string>").alias("kept"))

    def step(s, line):
        bare = strip(line)
        flat = strip(F.regexp_replace(line, f"[{BLANK}]+", " "))
        keep = (flat != "") & ~flat.rlike(r"^\p{Nd}+$") & ((F.length(flat) >= 20) | flat.rlike(r"[.!?;:]$"))
        opens, closes = bare == "[TABLE]", bare == "[/TABLE]"
        kept = F.when(opens | closes | s["table"], F.concat(s["kept"], F.array(line))).when(keep, F.concat(s["kept"], F.array(flat))).otherwise(s["kept"])
        return F.struct(F.when(opens, True).when(closes, False).otherwise(s["table"]).alias("table"), kept.alias("kept"))

    return strip(F.array_join(F.aggregate(lines, state, step, lambda s: s["kept"]), "\n"))
