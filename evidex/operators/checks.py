"""Checks of answers against their evidence, and of evidence against itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions.text import BLANK, hits


def stance(title: Column, text: Column) -> dict[str, Column]:
    """What contradictions() needs of a text: w, the words of its topic; z, as bits, of which pairs of OPPOSITES it has the one side, and above them the other."""
    title, text = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, text))
    sides = [words for side in (1, 2) for words in (pair[side] for pair in L.OPPOSITES)]
    bits = lambda t: reduce(lambda a, b: a.bitwiseOR(b), (F.when(t.contains(words), F.lit(1 << i)).otherwise(F.lit(0)) for i, words in enumerate(sides)))
    # the variable of a function holds the text in lower case, which is else made anew for each pair
    return {"w": F.array_distinct(F.filter(F.split(title, f"[{BLANK}]+"), lambda w: F.length(w) > 4)), "z": F.transform(F.array(text), bits)[0]}


def contradictions(chunks: DataFrame) -> DataFrame:
    """(query_id, a, b, kind, evidence): pairs of a query's chunks on one topic with opposed words.

    ``chunks`` (query_id, id, title, text) are the short list of hits of each query. Topic: a shared
    word of more than four letters in the titles.
    """
    return opposed(chunks.select("query_id", "id", *[c.alias(n) for n, c in stance(F.col("title"), F.col("text")).items()]))


def opposed(chunks: DataFrame) -> DataFrame:
    """contradictions() of ``chunks`` (query_id, id, w, z) as stance() tells them: a query's hits meet in one row, and texts are not moved."""
    kept = chunks.where("query_id is not null and z <> 0")
    lists = kept.groupBy("query_id").agg(F.collect_list(F.struct("id", "w", "z")).alias("l"))
    pairs = lists.select("query_id", "l", F.explode("l").alias("a")).select("query_id", "a", F.explode("l").alias("b")).where("a.id < b.id and arrays_overlap(a.w, b.w)")
    n = len(L.OPPOSITES)
    met = F.expr(f"(a.z & shiftright(b.z, {n})) | (b.z & shiftright(a.z, {n}))")
    found = F.array(*[F.when(met.bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(kind).alias("kind"), F.lit(f"{x} vs {y}").alias("evidence"))) for i, (kind, x, y) in enumerate(L.OPPOSITES)])
    return pairs.select("query_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("query_id", "a", "b", "f.kind", "f.evidence")


def warnings(text: Column) -> Column:
    """Array of (type, severity, message) of a lower-case answer, each once."""
    made = lambda kind, severity, message: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    found = [F.when(hits(text, patterns) > 0, made(kind, severity, "Detected: " + kind.replace("_", " ").lower())) for kind, severity, patterns in L.WARNINGS]
    found += [F.when(text.contains(a) & text.contains(b), made("DRUG_INTERACTION", "HIGH", f"Potential interaction: {a} + {b}")) for a, b in L.DANGEROUS]
    found += [F.when(text.contains(d), made("MONITORING_REQUIRED", "MEDIUM", f"{d.title()}: monitoring")) for d in L.MONITORED]
    return F.array_distinct(F.filter(F.array(*found), lambda w: w.isNotNull()))


def safety(found: Column) -> dict[str, Column]:
    """What follows from the warnings() of an answer; give them as a column, so that they are found once."""
    has = lambda test: F.exists(found, test)
    return {
        "is_safe": ~has(lambda w: w["severity"] == "HIGH"),
        "needs_disclaimer": has(lambda w: w["type"].isin("TREATMENT_RECOMMENDATION", "DOSAGE_INFO")),
    }


def numbers(text: Column) -> Column:
    """Numbers claimed: before a dose unit, a per cent sign or a time, without their unit; over lower-case text."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in (L.DOSE_NUMBER, L.PERCENT_NUMBER, L.TIME_NUMBER)]))


def named(text: Column) -> Column:
    """Words with a drug's ending, or with a capital and of more than four letters, in lower case; over plain text."""
    words = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][a-z]{3,})\b"), 1)
    ends = lambda w: reduce(lambda a, b: a | b, (F.lower(w).endswith(e) for e in L.DRUG_ENDINGS))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ends(w) | (w.rlike("^[A-Z]") & (F.length(w) > 4))), F.lower))


def ungrounded(sentence: Column, known_names: Column, known_numbers: Column) -> dict[str, Column]:
    """Names and numbers of a sentence, plain text, that its evidence lacks; named() and numbers() of that are taken once."""
    return {
        "names": F.array_sort(F.array_except(named(sentence), known_names)),
        "numbers": F.array_sort(F.array_except(numbers(F.lower(sentence)), known_numbers)),
    }


def flag_weight(sentence: Column, names: Column, missing: Column, similarity: Column | None = None) -> Column:
    """How doubtful a sentence is; short ones and those that lead on (ending in a colon) are not."""
    far = F.when(similarity < 0.45, 0.4).otherwise(0.0) if similarity is not None else F.lit(0.0)
    weight = far + F.when(F.size(names) > 1, 0.3).otherwise(0.0) + F.when(F.size(missing) > 0, 0.3).otherwise(0.0)
    return F.when((F.length(sentence) < 20) | sentence.endswith(":"), 0.0).otherwise(weight)


def citation_issues(source: Column, level: Column, year: Column, now: Column, known: Column) -> Column:
    """Array of (issue, severity) of a citation; of one that is not found nothing else is said."""
    made = lambda kind, severity: F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"))
    found = F.array(
        F.when(~known, made("NOT_FOUND", "HIGH")),
        F.when(known & (now - year > L.OLD_YEARS), made("OUTDATED", "LOW")),
        F.when(known & ~F.lower(F.coalesce(source, F.lit(""))).isin(list(L.TRUSTED)), made("UNTRUSTED_SOURCE", "MEDIUM")),
        F.when(known & (F.coalesce(level, F.lit(3)) > 3), made("LOW_EVIDENCE", "LOW")),
    )
    return F.filter(found, lambda i: i.isNotNull())
