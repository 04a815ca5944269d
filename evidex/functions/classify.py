"""Classifiers of documents, chunks and queries as column expressions over plain lower-case text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions.text import contains_any, first_of, hits, plain, present, strip


def doc_type(text: Column) -> Column:
    """By words in order of rank; ``text`` is title and content in lower case."""
    return (
        F.when(contains_any(text, L.SYSTEMATIC) & text.contains("meta"), "meta_analysis")
        .when(contains_any(text, L.SYSTEMATIC), "systematic_review")
        .when(contains_any(text, L.GUIDELINE), "guideline")
        .when(contains_any(text, L.TRIAL), "rct")
        .when(contains_any(text, L.COHORT), "cohort")
        .when(contains_any(text, L.CASE), "case_report")
        .when(contains_any(text, L.EDITORIAL), "editorial")
        .when(text.contains("review"), "review")
        .otherwise("unknown")
    )


def _lookup(key: Column, values: dict, otherwise) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def evidence_level(kind: Column) -> Column:
    return _lookup(kind, L.LEVEL_OF_TYPE, "unknown")


def evidence_boost(level: Column) -> Column:
    level = F.lower(F.trim(F.coalesce(level.cast("string"), F.lit(""))))
    out = None
    for k, v in L.BOOST_OF_LEVEL.items():
        out = F.when(level.startswith(k), v) if out is None else out.when(level.startswith(k), v)
    return out.otherwise(1.0)


def recency_boost(year: Column) -> Column:
    return F.when(year >= 2025, 1.10).otherwise(_lookup(year, {y: b for y, b in L.BOOST_OF_YEAR.items() if y < 2025}, 1.0))


def evidence_number(level: Column) -> Column:
    """Level as 1 to 5: numbers clamped, a leading digit, else 3."""
    level = F.trim(F.coalesce(level.cast("string"), F.lit("")))
    whole = level.rlike(r"^-?\d{1,9}$")
    return F.when(whole, F.greatest(F.lit(1), F.least(F.lit(5), level.try_cast("int")))).when(level.rlike(r"^[1-5]"), F.substring(level, 1, 1).try_cast("int")).otherwise(3)


def study_type(title: Column, text: Column) -> Column:
    """struct(study_type, level) by patterns in title and the first 500 characters."""
    both = F.lower(F.concat(plain(title), F.lit(" "), F.substring(plain(text), 1, 500)))
    out = None
    for pattern, name, level in L.STUDY_TYPES:
        value = F.struct(F.lit(name).alias("study_type"), F.lit(level).alias("level"))
        out = F.when(both.rlike(pattern), value) if out is None else out.when(both.rlike(pattern), value)
    return out.otherwise(F.struct(F.lit("unknown").alias("study_type"), F.lit(5).alias("level")))


def content_type(text: Column, section: Column) -> Column:
    """By administrative signs, then the section's title, then signs in the text."""
    section = F.lower(plain(section))
    return (
        F.when(hits(text, L.NOISE_SIGNS) >= 2, "noise")
        .when(contains_any(section, L.SECTION_NOISE), "noise")
        .when(contains_any(section, L.SECTION_BACKGROUND), "background")
        .when(contains_any(section, L.SECTION_PRECLINICAL), "preclinical")
        .when(contains_any(section, L.SECTION_CLINICAL), "clinical")
        .when(hits(text, L.PRECLINICAL_SIGNS) >= 2, "preclinical")
        .when(hits(text, L.CLINICAL_SIGNS) >= 1, "clinical")
        .otherwise("background")
    )


def content_weight(kind: Column) -> Column:
    return _lookup(kind, L.WEIGHT_OF_CONTENT, 0.7)


def specialties(text: Column) -> Column:
    found = F.array(*[F.when(contains_any(text, words), F.lit(name)) for name, words in L.SPECIALTIES.items()])
    return F.slice(F.filter(found, lambda s: s.isNotNull()), 1, 5)


def flags(text: Column, source: Column, journal: Column) -> dict[str, Column]:
    source, journal = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(journal, F.lit("")))
    return {
        "india_relevant": contains_any(text, L.INDIA_WORDS),
        "has_indian_data": contains_any(text, L.INDIA_DATA),
        "indian_source": source.isin(L.INDIA_SOURCES) | contains_any(journal, L.INDIA_JOURNALS),
        "has_drug_dosing": contains_any(text, L.DOSING),
        "has_lab_values": contains_any(text, L.LABS),
    }


def _found(text: Column, pattern: str, most: int) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), strip)), 1, most)


def entities(text: Column) -> dict[str, Column]:
    """Entity lists by pattern, first seen first, capped; over lower-case text."""
    dosages = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), 1), strip) for p in L.DOSAGES]))
    return {
        "diseases": _found(text, L.DISEASES, 10),
        "drugs": _found(text, L.DRUGS, 10),
        "dosages": F.slice(F.array_distinct(dosages), 1, 10),
        "contraindications": F.slice(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"((?s).{{0,10}}{L.CONTRAINDICATIONS}.{{0,80}})"), 1), lambda s: F.substring(strip(s), 1, 120))), 1, 5),
        "populations": _found(text, L.POPULATIONS, 10),
        "outcomes": _found(text, L.OUTCOMES, 10),
        "has_safety_flag": text.rlike(L.SAFETY),
    }


def condition_tags(title: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(plain(title)), F.lit(r"([a-z0-9\-]+)"), 1))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(L.TAG_NOISE))


def query_intent(query: Column) -> Column:
    return first_of(query, L.INTENTS, "general")


def expansions(query: Column) -> Column:
    """Synonyms of the terms that occur in the query, each once, in order."""
    parts = [F.when(query.contains(term), F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>")) for term, words in L.SYNONYMS.items()]
    return F.array_distinct(F.flatten(F.array(*parts)))


def inferred_filters(query: Column) -> Column:
    """Conditions (field, op, value) that the query implies, all of which must hold; none if empty."""
    one = lambda field, op, value: F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.lit(value).alias("value"))
    found = F.array(
        F.when(contains_any(query, L.RECENT), one("year", "gte", "2020")),
        F.when(contains_any(query, L.GUIDED), one("doc_type", "in", "guideline,systematic_review,meta_analysis")),
        F.when(contains_any(query, L.INDIAN), one("india_relevant", "eq", "true")),
        F.when((query_intent(query) == "therapeutic") & contains_any(query, L.DOSED), one("has_drug_dosing", "eq", "true")),
    )
    return F.filter(found, lambda f: f.isNotNull())


def rewritten(query: Column) -> Column:
    """Abbreviations that occur, anywhere and in lower case, replaced in order."""
    lower, out = F.lower(query), query
    for short, full in L.ABBREVIATIONS.items():
        out = F.when(lower.contains(short), F.replace(out, F.lit(short), F.lit(full))).otherwise(out)
    return out


def search_terms(query: Column) -> Column:
    lower = F.lower(query)
    return F.filter(F.array(*[F.when(lower.contains(s), F.lit(f)) for s, f in L.ABBREVIATIONS.items()]), lambda t: t.isNotNull())


def route(query: Column) -> dict[str, Column]:
    """Complexity, confidence, intent and aspects of a question, over lower-case text."""
    patterns = hits(query, L.ROUTE_PATTERNS)
    terms = F.size(present(query, L.ROUTE_TERMS)) + F.size(F.regexp_extract_all(query, F.lit("( and )"), 1))
    words = F.size(F.regexp_extract_all(query, F.lit(r"(\S+)"), 1))
    score = F.when(words > 20, 0.3).otherwise(0.0) + F.when(words > 40, 0.2).otherwise(0.0)
    score = score + F.when(F.size(F.regexp_extract_all(query, F.lit(r"(\?)"), 1)) > 1, 0.4).otherwise(0.0)
    score = F.least(F.lit(1.0), score + F.when(query.contains(" or "), 0.2).otherwise(0.0) + F.when(contains_any(query, L.ROUTE_ADVICE), 0.3).otherwise(0.0))
    verdict = lambda kind, sure: F.struct(F.lit(kind).alias("complexity"), F.lit(sure).alias("confidence"))
    decided = (
        F.when(patterns >= 2, verdict("complex", 0.95))
        .when((patterns == 1) & ((terms >= 3) | (score > 0.5)), verdict("complex", 0.90))
        .when((patterns == 1) & (terms >= 2), verdict("medium", 0.70))
        .when(patterns == 1, verdict("medium", 0.65))
        .when(terms >= 4, verdict("complex", 0.85))
        .when((terms >= 3) & (score > 0.4), verdict("complex", 0.80))
        .when(terms >= 3, verdict("medium", 0.65))
        .when((terms >= 2) & (score > 0.5), verdict("medium", 0.60))
        .when(terms >= 2, verdict("simple", 0.80))
        .otherwise(verdict("simple", 0.75))
    )
    intent = first_of(query, L.ROUTE_INTENTS, "general")
    none = F.array().cast("array<string>")
    base = none
    for name, aspects in L.ROUTE_ASPECTS.items():
        base = F.when(intent == name, F.array(*map(F.lit, aspects))).otherwise(base)
    extra = F.when(decided["complexity"] == "complex", F.array(F.lit("safety"), F.lit("interactions"), F.lit("contraindications"))).otherwise(none)
    compare = F.when(hits(query, [L.ROUTE_PATTERNS[i] for i in L.ROUTE_COMPARING]) > 0, F.array(F.lit("comparison"))).otherwise(none)
    return {
        "patterns": patterns,
        "entities": terms,
        "structure": F.round(score, 6),
        "complexity": decided["complexity"],
        "confidence": decided["confidence"],
        "intent": intent,
        "aspects": F.slice(F.array_distinct(F.concat(base, extra, compare)), 1, 6),
        "diseases": present(query, L.ROUTE_DISEASES),
        "drugs": present(query, L.ROUTE_DRUGS),
    }
