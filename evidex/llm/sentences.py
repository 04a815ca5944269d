"""Sentence boundaries for many languages and scripts.

The rules of the standard sentence breaks over the character properties of Unicode: every character
that is Sentence_Break=STerm or ATerm, of whatever script, may end a sentence, closing brackets and
quotes belong to it, and a full stop does not break before lower case or inside numbers. Over these,
suppression after the abbreviations of the text's own language, told by script and function words,
and quotations: a mark inside an open quotation ends nothing, and one that closes it does where the
quotation ends its sentence. Line breaks always end a sentence. Thai has no terminator: a blank
between two Thai letters ends one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence inside a line, of all languages and by language; fixed values.
ANY = "Dr Prof St vs e.g i.e p.o i.v s.c i.m b.i.d approx cf ca Approx resp incl"
NEVER = {
    "en": "Mr Mrs Ms Gen Lt Rev Hon",
    "de": "bzw z d Abb Vgl vgl med Hr Fr evtl ggf Dipl Ing Bd Hrsg u",
    "fr": "M MM Mme Mlle Pr env p.ex ex éd",
    "es": "Sr Sra Srta Dra D aprox ej pág núm p.ej Ud Uds",
    "ru": "д-р проф рис табл см ок т е д напр им ул стр гл акад",
    "ar": "د أ ص م",
    "hi": "डॉ मि मि.ग्रा ग्रा कि.ग्रा श्री प्रो",
}
#: Frequent words that tell languages of one script apart, and which begin a sentence after a letter as in "group B. The"; fixed values.
FUNCTION_WORDS = {
    "en": "the of and in to for with was were is are that this these those by on at from as be been then we it an after when while however patients there they all no two",
    "de": "der die das und in den von mit für ist im dem des ein eine einer nicht sich auf wird werden wurde wurden bei nach zu zur zum aus als auch sind es wir diese",
    "fr": "le la les de des et en un une du dans pour par est sur au aux que qui avec ont été ce cette ces sont il elle nous après chez",
    "es": "el la los las de y en un una que por con para del se es al como fue fueron su sus este esta estos más lo son entre después",
}
#: Scripts of one language among those with abbreviations of their own.
SCRIPTS = {"ru": "\u0400-\u04ff", "ar": "\u0600-\u06ff", "hi": "\u0900-\u097f"}
#: Abbreviations before a number.
BEFORE_NUMBER = frozenset("No Nos Fig Figs fig figs Tab Tabs tab Table Eq Ref ref Sec sec sect Sect Vol vol Ch ch p pp n nº art Art Nr Abs S Bl Kap env рис табл стр с vgl Abb".split())
#: Abbreviations that end a sentence only before what can begin one.
MAY_END = frozenset("a.m p.m etc al usw u.s.w г гг др пр руб тыс млн Jr Inc Ltd Co Corp U.S U.K".split())
MONTHS_AFTER_ORDINAL = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())


class _Suppressed:
    """The abbreviations of one language, or of all for ``None``."""

    def __init__(self, language: str | None):
        own = NEVER.values() if language is None else [NEVER[language]]
        self.words = frozenset(w for words in (ANY, *own) for w in words.split())
        self.loud = frozenset(w.upper() for w in self.words | BEFORE_NUMBER if len(w) > 1)

    def __contains__(self, word: str) -> bool:
        """Also with a capital, all in capitals, or after a full stop that lost its blank."""
        if word[:1].lower() + word[1:] in self.words or word in self.words or len(word) > 1 and word in self.loud:
            return True
        last = word.rpartition(".")[2]
        return len(last) > 1 and len(last) < len(word) and last[0].isupper() and last in self


_SUPPRESSED = {language: _Suppressed(language) for language in (None, *NEVER)}
_TOLD_BY: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _TOLD_BY.setdefault(_w, []).append(_language)
_ANY_WORD = re.compile(r"[^\W\d_]+")
_OF_SCRIPT = {language: re.compile(f"[{of}]+") for language, of in SCRIPTS.items()}


def language(text: str) -> str | None:
    """The language whose abbreviations hold for a text: by its script, or by function words, if at least two thirds of them agree."""
    if not text.isascii():
        letters = sum(map(len, _ANY_WORD.findall(text)))
        for name, found in _OF_SCRIPT.items():
            if 2 * sum(map(len, found.findall(text))) > letters:
                return name
    votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
    counts = Counter(text.lower().split())
    for word, of in _TOLD_BY.items():
        if n := counts.get(word):
            for name in of:
                votes[name] += n / len(of)
    best = max(votes, key=votes.__getitem__)
    return best if votes[best] >= 2 and 3 * votes[best] >= 2 * sum(votes.values()) else None


@lru_cache
def _having(properties: str) -> str:
    """All characters of a class of Unicode properties."""
    return "".join(regex.findall(f"[{properties}]", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))))


_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "《": "》"}
_CLOSE = set("”»」』›》")
_BRACKETS = set(_having(r"\p{Pe}")) - _CLOSE
_WIDE = set("。！？｡‼⁇⁈⁉．")
_SPACE = _having(r"\p{Sentence_Break=Sp}") + "\u200b\ufeff\x1c\x1d\x1e\x1f"
_LINE = re.compile("[^\n\r\x0b\x0c\x85\u2028\u2029]+")
#: Sentence terminators of all scripts, by their property, and the ellipsis.
_MARKS = _having(r"\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}") + "…"


def _events(marks: str) -> re.Pattern:
    return re.compile(rf"[{re.escape(marks)}]+|[\"“”„«»「」『』‹›《》]| +(?<=[฀-๿] )(?=[ก-ฺเ-๎])|(?<=[ก-ฺเ-๎]) +(?=[ก-ฺเ-๎])")


#: A class with characters beyond the first plane is slow to match, and few texts hold any.
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_EVERY_EVENT, _PLAIN_EVENT = _events(_MARKS), _events(_ASTRAL.sub("", _MARKS))
_THAI = re.compile("[ก-ฺเ-๎]")
_WORD = re.compile(r"[^\s(\[{\"“”„«»「」『』‘’¿¡/]+$")
_NUMBERED = re.compile(r"\s*\(?\d{1,3}(?:\.\d{1,3})*$")
_CAMEL = re.compile(r"[^\W\d_]*[a-zà-ÿа-я][A-ZÀ-ÞА-Я]")
_LETTERS = re.compile(r"[^\W\d_]+")
_NAMED = re.compile(r"(?<![^\W\d_])[^\W\d_A-ZÀ-Þ][^\W\d_]{2,}\s$")


_STARTERS = {name: frozenset(words.split()) for name, words in FUNCTION_WORDS.items()}
_NO_WORDS: frozenset = frozenset()


def _starts(line: str, at: int) -> bool:
    """Whether what begins at ``at`` may begin a sentence: not a lower-case word, unless of the kind of mRNA."""
    return not line[at].islower() or bool(_CAMEL.match(line, at))


def _period(line: str, start: int, stop: int, never: _Suppressed, starters: frozenset) -> bool:
    """Whether the single full stop at ``start`` ends a sentence; closers end at ``stop``, more text follows."""
    word = _WORD.search(line, max(0, start - 24), start)
    word = word.group() if word else ""
    after = stop
    while line[after] in _SPACE:
        after += 1
    first = line[after]
    if after == stop:  # no blank: inside a number or short form, or a lost blank between sentences
        if stop > start + 1 or not (first.isupper() or first.isdigit() and not word[-1:].isdigit()):
            return stop > start + 1 and first.isupper()
        short = word in never or word in BEFORE_NUMBER or word in MAY_END
        tail = _LETTERS.search(word[-3:])
        return not short and "." not in word and len(word) > 1 and bool(tail) and (first.isdigit() or line[after + 1 : after + 2].islower() or line[after + 1 : after + 2] in _SPACE or _CAMEL.match(line, after) is not None)
    if stop == start + 1:
        if word in never:
            return False
        if len(word) == 1 and word.isalpha() and word.isupper():  # an initial, or a letter that names a thing: "vitamin D. Then"
            before = _LETTERS.search(line[max(0, start - 24) : start - 1].rstrip(_SPACE)[-1:])
            thing = bool(before) and line[start - 2] in _SPACE and _NAMED.search(line, max(0, start - 32), start - 1)
            follow = _LETTERS.match(line, after)
            if not (thing and follow and follow.group().lower() in starters):
                return False
        if word in BEFORE_NUMBER and first.isdigit():
            return False
        if len(word) >= 3 and word[-2] == "." and word[-1].isupper() and word[:-1].replace(".", "").isupper() and first.isupper():
            return False  # initials without blanks
        if word == "h" and line[max(0, start - 4) : start - 1] == "d. ":
            return False
        if word.isdigit() and len(word) <= 2 and (m := _LETTERS.match(line, after)) and m.group() in MONTHS_AFTER_ORDINAL:
            return False
        if word in MAY_END and first in "([-–—":
            return False
        if word.isdigit() and _NUMBERED.match(line[:start]):
            return False
    return _starts(line, after)


def ends(text: str | None) -> list[int]:
    """End of each sentence, in characters from the start of the text; closing quotes in, following blanks out.

    Null, empty and blank text has none. A line without a mark (a heading) is one sentence.
    """
    out: list[int] = []
    if not text:
        return out
    name = language(text)
    never, starters = _SUPPRESSED[name], _STARTERS.get(name, _NO_WORDS)
    events = _PLAIN_EVENT if text.isascii() or not _ASTRAL.search(text) else _EVERY_EVENT
    for m in _LINE.finditer(text):
        base, line = m.start(), m.group()
        size = len(line.rstrip(_SPACE))
        if not line[:size].strip(_SPACE):
            continue
        last = 0
        for at in _line_ends(line[:size], size, events, never, starters):
            out.append(base + at)
            last = at
        if last < size:
            out.append(base + size)
    return out


def _line_ends(line: str, size: int, events: re.Pattern, never: _Suppressed, starters: frozenset) -> Iterator[int]:
    thai = bool(_THAI.search(line))
    opened: list[str] = []  # what closes each open quotation
    lead = ""  # what stands before the outer quotation
    past = 0  # events before this were taken with an earlier one
    for m in events.finditer(line):
        start, stop = m.span()
        if start < past:
            continue
        sign = line[start]
        if sign == " ":
            if not opened:
                yield start
            continue
        if sign in _OPEN or sign == '"' or sign in _CLOSE:
            if opened and sign in opened[-1]:
                opened.pop()
                if opened:
                    continue
                mark = start - 1
                while mark >= 0 and line[mark] in _SPACE:
                    mark -= 1
                if mark < 0 or line[mark] not in _MARKS:
                    continue
                while stop < size and line[stop] in _BRACKETS:
                    stop += 1
                if stop >= size or _quotation_ends(line, stop, lead):
                    yield stop
            elif sign in _OPEN or sign == '"':
                close = _OPEN.get(sign, '"')
                if not any(c in line[stop:] for c in close):
                    continue  # never closed: no quotation
                if not opened:
                    lead = line[:start].rstrip(_SPACE)[-1:]
                opened.append(close)
            continue
        if opened:
            continue
        while stop < size and (line[stop] in _BRACKETS or line[stop] in _CLOSE):
            stop += 1
        past = stop
        if stop >= size:
            yield size
            return
        run = m.group()
        if run == ".":
            if thai and (_THAI.match(line, start - 1) if start else None):
                continue
            if _period(line, start, stop, never, starters):
                yield stop
        elif run[-1] in ".…" and not run.strip(".…"):
            after = stop
            while line[after] in _SPACE:
                after += 1
            if after > stop and line[after] not in ",;:" and _starts(line, after) and not thai:
                yield stop
        elif run[-1] in _WIDE or line[stop] in _SPACE or line[stop] not in ",;:)-–—" and not line[stop].islower() and not line[stop].isdigit():
            yield stop


def _quotation_ends(line: str, stop: int, lead: str) -> bool:
    """Whether a quotation that ends with a mark also ends its sentence, given what follows and what led to it."""
    after = stop
    while line[after] in _SPACE:
        after += 1
    first = line[after]
    if first in ",;:，、；：" or first in "–—":
        return False
    if first.isalpha() and not first.isupper() and not first.islower():  # a script without case
        return bool(lead) and lead in ":：,，،"
    return _starts(line, after)


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            lists = [ends(t) for t in part.column("text").to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for ls in lists for x in ls), np.int32, int(sizes.sum()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("item_kind"), part.column("item_id"), found], ["item_kind", "item_id", "ends"])


def sentence_ends(df: DataFrame, unique: bool = False) -> DataFrame:
    """(item_kind, item_id, end_pos), a row per sentence of ``df`` (item_kind, item_id, text).

    Null, empty and blank texts give no row; other columns are not read. Rows are split where they
    are scanned. A repeated item gives its sentences again, or with ``unique`` once: then only the
    lists of positions are shuffled, not the texts.
    """
    rows = df.select("item_kind", "item_id", "text").where(F.col("text").isNotNull())
    found = rows.mapInArrow(_end_rows, "item_kind string, item_id string, ends array<int>")
    if unique:
        found = found.dropDuplicates(["item_kind", "item_id"])
    return found.select("item_kind", "item_id", F.explode("ends").alias("end_pos"))
