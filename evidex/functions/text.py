"""Text expressions: pure columns, no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions import lexicons as L


#: What Unicode takes for a character of a word and for a blank, as the inside of a class; marks are no part of words.
WORD, BLANK = r"\p{L}\p{N}_", r"\p{IsWhite_Space}\x1c-\x1f"


def plain(text: Column) -> Column:
    """Null as empty; outside ASCII blanks become a blank, letters and figures ``_``, all else ``~``.

    What patterns of ASCII words are applied to: their word boundaries are then those of Unicode.
    """
    text = F.coalesce(text, F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\p{IsWhite_Space}&&[^\x00-\x7F]]", " "), r"[^\x00-\x7F\p{L}\p{N}]", "~"), r"[^\x00-\x7F]", "_")
    return F.when(text.rlike(r"[^\x00-\x7F]"), marked).otherwise(text)


def strip(text: Column) -> Column:
    """Without blanks around it, those of Unicode too."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns), F.lit(0))


def first_of(text: Column, groups: dict[str, list[str]], otherwise: str) -> Column:
    """Name of the first group of which a word occurs."""
    chosen = None
    for name, words in groups.items():
        chosen = F.when(contains_any(text, words), name) if chosen is None else chosen.when(contains_any(text, words), name)
    return chosen.otherwise(otherwise)


def present(text: Column, words: list[str]) -> Column:
    """The words that occur, in the order of the list."""
    return F.filter(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]), lambda w: w.isNotNull())


def length_tokens(text: Column) -> Column:
    """Tokens by length: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([^{BLANK}]+)"), 1))


def word_tokens(text: Column) -> Column:
    """Tokens by words: 1.3 for each."""
    return F.floor(word_count(text) * 1.3).cast("int")


def normal(text: Column) -> Column:
    """Lower case with single blanks, those of Unicode too; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[{BLANK}]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def short_hash(*parts: Column) -> Column:
    """Change-detection hash: parts stripped, empty ones left out, joined by a bar; case counts."""
    kept = F.filter(F.array(*[strip(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != "")
    return F.substring(F.sha2(F.array_join(kept, "|"), 256), 1, 16)


def title_norm(title: Column) -> Column:
    """Lower case, letters, digits and single blanks of any script; null as empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), f"[^{WORD}{BLANK}]", "")
    return F.trim(F.regexp_replace(kept, f"[{BLANK}]+", " "))


def garble(text: Column) -> Column:
    """Share of characters above 127 or control characters; 1 for empty text."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(text, r"[\x20-\x7F\n\t\r]", ""))
    return F.when(F.length(text) == 0, 1.0).otherwise(odd / F.length(text))


def letter_share(text: Column) -> Column:
    text = strip(text)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) / F.length(text))


def max_year(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(plain(text), F.lit(r"\b(19\d{2}|20\d{2})\b"), 1), lambda y: y.cast("int"))), F.lit(0))


def shingles3(text: Column) -> Column:
    """Distinct substrings of three characters; none for shorter text."""
    n = F.length(text) - 2
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))))


def clinical_tokens(text: Column) -> Column:
    """Compound terms once each, then words of three or more characters that are no stop words.

    Words are of ASCII, their boundaries of Unicode: a part of a word with other letters is no term.
    """
    compounds = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(c.replace(" ", "_")).alias("u")) for c in L.COMPOUNDS])
    start = F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("t"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        marked = F.struct(F.replace(s["t"], c["c"], F.concat(F.lit(" "), c["u"], F.lit(" "))).alias("t"), F.array_append(s["found"], c["u"]).alias("found"))
        return F.when(s["t"].contains(c["c"]), marked).otherwise(s)

    def finish(s: Column) -> Column:
        words = F.regexp_extract_all(s["t"], F.lit(rf"(?<![{WORD}])([a-z][a-z0-9\-]{{2,}})(?:(?<=-)(?=[{WORD}])|(?<!-)(?![{WORD}]))"), 1)
        return F.concat(s["found"], F.filter(words, lambda w: ~w.isin(L.STOP_WORDS)))

    # a fold keeps the text as it changes; nested calls would be evaluated anew for each compound
    return F.aggregate(compounds, start, step, finish)


def bucket(term: Column, buckets: int) -> Column:
    """A stable bucket of a term, the same in every process and engine."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def idf(term: Column) -> Column:
    return F.when(term.contains("_"), 3.5).when(F.length(term) > 10, 3.0).when(F.length(term) > 6, 2.0).otherwise(1.0)


def sentences(text: Column) -> Column:
    """Sentences by a mark, blanks and a capital; short forms are protected and come back in lower case."""
    for i, form in enumerate(L.SHORT_FORMS):
        text = F.regexp_replace(text, "(?i)" + form.replace(".", r"\."), chr(1) + chr(97 + i) + chr(2))
    split = F.split(text, rf"(?<=[.!?])[{BLANK}]+(?=[A-Z])")

    def restore(s: Column) -> Column:
        for i, form in enumerate(L.SHORT_FORMS):
            s = F.replace(s, F.lit(chr(1) + chr(97 + i) + chr(2)), F.lit(form))
        return s

    return F.transform(F.filter(F.transform(split, strip), lambda s: s != ""), restore)


def answer_sentences(text: Column) -> Column:
    """Sentences of an answer, of more than ten characters; titles and units are protected."""
    for i, form in enumerate(L.ANSWER_SHORT_FORMS):
        text = F.replace(text, F.lit(form), F.lit(form.replace(".", chr(1))))
    split = F.transform(F.split(text, rf"(?<=[.!?])[{BLANK}]+"), lambda s: strip(F.replace(s, F.lit(chr(1)), F.lit("."))))
    return F.filter(split, lambda s: F.length(s) > 10)
