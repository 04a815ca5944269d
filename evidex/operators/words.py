"""The word-based chunker: sections by clinical headers, paragraphs with tables kept whole, merged with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the chunker.
TARGET, MOST, OVERLAP_WORDS, LEAST_CHARS = 300, 400, 60, 100
HEADS = (
    "treatment management therapy therapeutic dosage dose drug antibiotic medication prescription clinical diagnosis diagnostic investigation laboratory guideline recommendation protocol "
    "procedure intervention prevention prophylaxis abstract summary conclusion result finding outcome discussion introduction background overview history epidemiology etiology pathophysiology "
    "method material appendix reference acknowledgement foreword index"
).split()
_HEAD = re.compile(r"^(?:\d+\.?\d*\s+)?(?:" + "|".join(HEADS) + ")", re.IGNORECASE)
_SHAPE = re.compile(r"^\d+\.?\d*\s+\w|^[A-Z][a-z]+ [A-Z]")
_TABLE = re.compile(r"(\[TABLE\].*?\[/TABLE\])", re.DOTALL)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def words_tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


def header(line: str) -> bool:
    """A short line in capitals, numbered or in title case that begins with a known word and is no table."""
    line = line.strip()
    if not line or len(line) >= 80 or "|" in line or "+-" in line or "-+" in line or line.count("-") > 10:
        return False
    return bool((line.isupper() or _SHAPE.match(line)) and _HEAD.match(line))


def header_sections(text: str) -> list[tuple[str | None, str]]:
    """(header, text); a header with nothing before it stays in the text."""
    out: list[tuple[str | None, str]] = []
    name, lines = None, []
    for line in [*text.splitlines(), None]:
        if line is None or (lines and header(line)):
            body = "\n".join(lines).strip()
            if body:
                out.append((name, body))
            name, lines = line and line.strip(), []
        else:
            lines.append(line)
    return out


def paragraphs(text: str) -> list[str]:
    """Paragraphs by blank lines; a marked table is one."""
    out = []
    for part in _TABLE.split(text):
        out += [part.strip()] if part.startswith("[TABLE]") else [p.strip() for p in re.split(r"\n\s*\n", part) if p.strip()]
    return out


def merged(text: str) -> list[tuple[str | None, str, str]]:
    """(section, level, text) of the chunks of a text: about TARGET tokens, with an overlap of words; tables stand alone, short rests are dropped."""
    out: list[tuple[str | None, str, str]] = []
    for section, body in header_sections(text):
        open_: list[str] = []
        tokens = 0

        def flush(level: str) -> None:
            made = " ".join(open_)
            if len(made) >= LEAST_CHARS:
                out.append((section, level, made))  # noqa: B023

        for segment in paragraphs(body):
            if segment.startswith("[TABLE]"):
                flush("paragraph")
                open_, tokens = [], 0
                if table := segment.replace("[TABLE]", "").replace("[/TABLE]", "").strip():
                    out.append((section, "table", table))
                continue
            long = words_tokens(segment) > MOST
            for piece in _SENTENCE.split(segment) if long else [segment]:
                n = words_tokens(piece)
                if tokens + n > TARGET and open_:
                    flush("sentence" if long else "paragraph")
                    open_ = open_[-OVERLAP_WORDS:] + piece.split()
                    tokens = words_tokens(" ".join(open_))
                else:
                    open_ = open_ + piece.split()
                    tokens += n
        flush("paragraph")
    return out


def word_chunks(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, chunk_index, section, level, text, char_count, token_count) of every text; null and blank texts have no chunks.

    The fold carries words from chunk to chunk and runs over Arrow batches in Python; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(k, i, s, level, t, len(t), words_tokens(t)) for k, x in zip(pdf["k"], pdf["t"]) for i, (s, level, t) in enumerate(merged(x))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "section", "level", "text", "char_count", "token_count"])

    rows = df.where(df[text].isNotNull()).select(df[key].alias("k"), df[text].alias("t"))
    return rows.mapInPandas(run, f"{key} {kind}, chunk_index int, section string, level string, text string, char_count int, token_count int")
