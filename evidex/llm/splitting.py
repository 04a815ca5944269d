"""Oversized items in pieces under a limit, cut where content decides and at natural boundaries.

A rolling hash over the text marks landmarks, about one in ``every`` characters, that depend on the
characters around them alone. From the start of a piece, the first landmark beyond the minimum size
is taken and moved to the nearest natural boundary of the best kind between minimum and maximum
size: section, else paragraph, else sentence, else word end, else any character. After an edit the
same landmarks are met again, so that only pieces near the edit change.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.sentences import ends
from evidex.llm.similarity import codes_of, rolling

WINDOW = 32
_HEADING = re.compile(r"(?:^|\n)[^\S\n]*\n*(?=[^\S\n]*(?:#{1,6}\s|\d{1,2}(?:\.\d+)*\.?\s+)?[^\W\d_][^\n.!?。！？।]{0,60}(?:\n|$))")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n+")
_LINE = re.compile(r"\r\n|[\n\r]")
_BLANK = re.compile(r"\s+")


def tokens(text: str) -> int:
    return max(1, len(text) // 4)


def _boundaries(text: str) -> list[list[int]]:
    """Starts of sections, paragraphs, sentences (with lines) and words, each sorted."""
    flat = text.replace("\r\n", " \n").replace("\r", "\n")
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(flat)]
    # a heading opens a section where a blank line or a numbered line announces it
    sections = [p for p in (m.end() for m in _HEADING.finditer(flat)) if 0 < p < len(text)]
    blank = set(paragraphs)
    sections = [p for p in sections if p in blank or text[p].isdigit() or text[p] == "#"]
    sentences = []
    for e in ends(text):
        while e < len(text) and text[e].isspace():
            e += 1
        sentences.append(e)
    sentences = sorted({*sentences, *(m.end() for m in _LINE.finditer(text))})
    return [sections, paragraphs, sentences, [m.end() for m in _BLANK.finditer(text)]]


def _nearest(sorted_: list[int], low: int, high: int, at: int) -> int | None:
    i, j = bisect_left(sorted_, low), bisect_left(sorted_, high + 1)
    if i == j:
        return None
    k = min(max(bisect_left(sorted_, at), i), j - 1)
    return min(sorted_[max(i, k - 1) : k + 1], key=lambda p: (abs(p - at), p))


def pieces(text: str, limit: int, overlap: int = 50, every: int = 256) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece: it repeats text[start:core] of the piece before and adds text[core:end].

    No piece is above ``limit`` tokens and an overlap has at most ``overlap``; the cores are the text.
    """
    size, over = 4 * limit + 3, 4 * overlap + 3
    if len(text) <= size:
        return [(0, 0, len(text))]
    high = max(size - over, 4)
    low = high // 2
    kinds = _boundaries(text)
    hashes = rolling(codes_of(text), WINDOW)
    marks = (np.flatnonzero(hashes < np.uint64((1 << 64) // every - 1)) + WINDOW).tolist()
    out, core = [], 0
    while True:
        if len(text) - core <= high:
            end = len(text)
        else:
            i = bisect_left(marks, core + low)
            aim = marks[i] if i < len(marks) and marks[i] <= core + high else core + high
            found = (_nearest(kind, core + low, core + high, aim) for kind in kinds)
            end = next((p for p in found if p is not None), aim)
        start = core
        if core:
            for kind in kinds[2:]:
                i = bisect_left(kind, core - over)
                if i < len(kind) and kind[i] < core:
                    start = kind[i]
                    break
            else:
                start = max(0, core - over)
        out.append((start, core, end))
        if end == len(text):
            return out
        core = end


def _split_rows(overlap: int, every: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for kind, i, text, limit in zip(pdf["item_kind"], pdf["item_id"], pdf["text"], pdf["limit"]):
                for n, (start, core, end) in enumerate(pieces(text, int(limit), overlap, every)):
                    rows.append((kind, i, n, start, core, end, text[start:end]))
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece", "start_pos", "core_pos", "end_pos", "text"])

    return run


def split_oversized(df: DataFrame, overlap: int = 50, every: int = 256) -> DataFrame:
    """(item_kind, item_id, piece, start_pos, core_pos, end_pos, text) of every item of ``df`` above its limit.

    ``df`` has (item_kind, item_id, text, limit), limit in tokens of four characters. Items within
    the limit, null and empty ones are not in the result; rows of one item_kind and item_id count
    once; other columns are not read. Only oversized texts leave the scan.
    """
    big = df.select("item_kind", "item_id", "text", "limit").where(F.length("text") >= 4 * (F.col("limit") + 1))
    schema = "item_kind string, item_id string, piece int, start_pos int, core_pos int, end_pos int, text string"
    return big.dropDuplicates(["item_kind", "item_id"]).mapInPandas(_split_rows(overlap, every), schema)
