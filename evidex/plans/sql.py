"""Pieces of the comparison SQL, made from the same fixed values as the column expressions."""

from __future__ import annotations

from evidex.functions import lexicons as L


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(map(text, words)) + "]"


#: The blanks of Unicode, as the inside of a class.
_WIDE = r"\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = r"\t-\r\x1c-\x20" + _WIDE


def plain(c: str) -> str:
    """Outside ASCII blanks as a blank, letters and figures as ``_``, all else as ``~``, so that ASCII word boundaries are those of Unicode."""
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[{_WIDE}]', ' ', 'g'), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '~', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


def title_norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_{BLANK}]', '', 'g'), '[{BLANK}]+', ' ', 'g'))"


def word_count(c: str) -> str:
    return f"len(regexp_extract_all(coalesce({c}, ''), '[^{BLANK}]+'))"


def or_empty(c: str) -> str:
    return f"coalesce({c}, '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {text(w)})" for w in words) + ")"


def hits(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({c}, {text(p)})::int" for p in patterns) + ")"


def first_of(c: str, groups: dict[str, list[str]], otherwise: str) -> str:
    return "case " + " ".join(f"when {any_of(c, w)} then {text(n)}" for n, w in groups.items()) + f" else {text(otherwise)} end"


def lookup(c: str, values: dict, otherwise) -> str:
    lit = lambda v: text(v) if isinstance(v, str) else str(v)
    return f"case {c} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in values.items()) + f" else {lit(otherwise)} end"


def present(c: str, words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"case when contains({c}, {text(w)}) then {text(w)} end" for w in words) + "], lambda x: x is not null)"


def normal(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[{BLANK}]+', ' ', 'g'))"


def length_tokens(c: str) -> str:
    return f"greatest(1, floor(length(coalesce({c}, '')) / 4)::bigint)"


def doc_type(c: str) -> str:
    rest = {"guideline": L.GUIDELINE, "rct": L.TRIAL, "cohort": L.COHORT, "case_report": L.CASE, "editorial": L.EDITORIAL, "review": ["review"]}
    return f"case when {any_of(c, L.SYSTEMATIC)} and contains({c}, 'meta') then 'meta_analysis' when {any_of(c, L.SYSTEMATIC)} then 'systematic_review' else {first_of(c, rest, 'unknown')} end"


def evidence_boost(level: str) -> str:
    return "case " + " ".join(f"when starts_with(lower(trim({level})), {text(k)}) then {v}" for k, v in L.BOOST_OF_LEVEL.items()) + " else 1.0 end"


def recency_boost(year: str) -> str:
    return f"case when {year} >= 2025 then 1.10 when {year} = 2024 then 1.08 when {year} = 2023 then 1.05 when {year} = 2022 then 1.03 else 1.0 end"


def tokens(c: str) -> str:
    """Token list of lower plain text: compounds once each, then words that are no stop words."""
    lower, parts = f"lower({plain(c)})", []
    for compound in L.COMPOUNDS:
        under = compound.replace(" ", "_")
        parts.append(f"case when contains({lower}, {text(compound)}) then {text(under)} end")
        lower = f"replace({lower}, {text(compound)}, {text(f' {under} ')})"
    words = f"list_filter(regexp_extract_all({lower}, '\\b([a-z][a-z0-9\\-]{{2,}})\\b', 1), lambda w: not list_contains({listed(L.STOP_WORDS)}, w))"
    return f"list_concat(list_filter([{', '.join(parts)}], lambda x: x is not null), {words})"


def bucket(c: str, buckets: int) -> str:
    return f"(('0x' || substr(md5({c}), 1, 8))::bigint % {buckets})"


def idf(c: str) -> str:
    return f"case when contains({c}, '_') then 3.5 when length({c}) > 10 then 3.0 when length({c}) > 6 then 2.0 else 1.0 end"


def entity_list(c: str, pattern: str, most: int) -> str:
    """First-seen order needs the position of each first match."""
    found = f"list_transform(regexp_extract_all({c}, {text(f'({pattern})')}, 1), lambda s: {strip('s')})"
    return f"list_slice(list_filter({found}, lambda s, i: list_position({found}, s) = i), 1, {most})"
