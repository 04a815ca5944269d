"""Text of scanned pages: page furniture dropped, broken words joined, misread characters repaired.

Noisy channel: each unlikely word of a line gets candidate words by undoing confusions of characters;
a candidate's probability is that of the confusions, as often as they are met in the scanned texts
themselves, times that of the word after its neighbour, from word and pair counts of all texts that
were not scanned, and Viterbi picks the best sequence of candidates per line. Counts are kept under 64-bit hashes of words and pairs and joined, never held
in one place. Furniture is found within the record: page numbers, lines that repeat, and the title
or a volume line as a running head. A hyphen at a line's end is part of the word where the word is
more often met with it.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.runtime import materialize

#: What was printed (right) where a scanner reads what is left; fixed values, in lower case.
CONFUSIONS = {
    "c": ["e"], "0": ["o"], "1": ["l", "i"], "!": ["i", "l"], "|": ["l", "i"], "+": ["t"], "@": ["a"], "$": ["s"],
    "5": ["s"], "6": ["b"], "8": ["b"], "9": ["g"], "cl": ["d"], "li": ["h"], "ri": ["n"], "vv": ["w"], "rn": ["m"],
}
#: Probability of a confusion with a sign or figure, and with letters, before any is seen; worth so many characters seen.
SIGN, LETTERS, PRIOR = 4e-3, 1e-3, 2000
#: Words met as often in clean text are taken as read: so many times, in a large collection this share of all its words.
CERTAIN, CERTAIN_SHARE = 20, 2e-6
#: Count given to a word never met in clean text, of up to so many words; in proportion beyond.
UNKNOWN, UNKNOWN_OF = 0.02, 1e7
SMOOTH = 2.0  # weight of single words against pairs
HYPHENS = "-‐‑­¬"

_WORD = re.compile(r"[^\s.,;:()\"“”„«»?¿¡\[\]]+")
_DIGITS = str.maketrans("OolI!|", "001111")
_NUMBER = r"(?:[0-9OolI!|]{1,4}|[ivxlIVX!1]{1,6})"
_PAGE = re.compile(rf"\s*(?:[Pp][a@]?[g9][ec]\s+{_NUMBER}(?:\s+[o0]f\s+{_NUMBER})?|[Pp]\.?\s*{_NUMBER}|[-–—]\s*{_NUMBER}\s*[-–—]|[\[(]\s*{_NUMBER}\s*[\])]|{_NUMBER}|{_NUMBER}\s*/\s*{_NUMBER})\s*$")
_NUMBERED = re.compile(rf"^\s*{_NUMBER}\s{{2,}}|\s{{2,}}{_NUMBER}\s*$")
_VOLUME = re.compile(rf",\s*[vV][o0][l1!|]\.?\s*{_NUMBER}\s*$")
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "+": "t", "@": "a", "5": "s", "6": "b", "9": "g", "8": "b", "c": "e", "q": "g"})


def _fold(text: str) -> str:
    """A form in which most misreadings of a line agree."""
    text = " ".join(text.lower().split()).replace("cl", "d").replace("li", "h").replace("rn", "m").replace("vv", "w").replace("ri", "n")
    return text.translate(_FOLD)


def _alike(a: str, b: str, least: float = 0.85) -> bool:
    if a == b:
        return True
    m = difflib.SequenceMatcher(None, a, b, False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def furniture(lines: list[str], title: str | None) -> set[int]:
    """Indexes of the lines of a record that are running heads, feet or page numbers."""
    out: set[int] = set()
    bare = {}
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        if _PAGE.match(line):
            out.add(i)
        else:
            bare[i] = _NUMBERED.sub("", line).strip()
    # the title printed over the first lines is none
    head: set[int] = set()
    name = _fold(title or "")
    first = [i for i in bare][:4]
    for n in range(1, len(first) + 1):
        as_head = any(_NUMBERED.search(lines[i]) or lines[i].isupper() and not title.isupper() for i in first[:n]) if title else True
        whole = _fold(" ".join(lines[i].strip() for i in first[:n]))
        if name and not as_head and -2 <= len(whole) - len(name) <= 6 and _alike(whole, name, 0.9):
            head = set(first[:n])
            break
    groups: dict[str, list[int]] = {}
    for i, text in bare.items():
        if i in head:
            continue
        folded = _fold(text)
        if _VOLUME.search(text):
            out.add(i)
        elif name and len(folded) >= 12 and _alike(folded, name[: len(folded)], 0.85):
            out.add(i)
        elif len(folded) >= 8:
            masked = re.sub(r"[0-9ol]+(?=\s|$)", "0", folded)
            groups.setdefault(masked, []).append(i)
    for at in groups.values():
        if len(at) > 1 and any(j - i > 3 for i, j in zip(at, at[1:])) and all({i - 1, i + 1, i - 2, i + 2} & out for i in at):
            out.update(at)
    return out


def _words(line: str) -> list[tuple[str, int]]:
    """Words of a line and where each begins, without marks around them; signs within words stay."""
    out = []
    for m in _WORD.finditer(line):
        word = m.group().rstrip("!'’*|").lstrip("'’*|")
        if word:
            out.append((word, m.start() + m.group().index(word)))
    return out


def _misread_number(word: str) -> bool:
    """Figures with letters that look like figures between them."""
    return any(c.isdigit() for c in word) and any(c in "OolI!|" for c in word) and re.fullmatch(r"[0-9OolI!|]+([-/%][0-9OolI!|]*)*", word) is not None


def _layout(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each record: lines to drop, misread numbers, and the words of kept lines with their neighbours.

    A word broken at a line's end is one row, with its second part taken from the next kept line;
    ``cut`` is the length of its first part, ``other`` the word with the hyphen kept.
    """
    for pdf in parts:
        rows = []
        for i, title, text in zip(pdf["record_id"], pdf["title"], pdf["content"]):
            lines = text.split("\n")
            drop = furniture(lines, title)
            rows += [(i, k + 1, "drop", None, None, None, None, 0, 0, 0) for k in drop]
            kept = [(k, line.rstrip(), _words(line)) for k, line in enumerate(lines) if k not in drop and line.strip()]
            for at, (k, line, words) in enumerate(kept):
                for word, _ in words:
                    if _misread_number(word):
                        rows.append((i, k + 1, "char", word, None, None, None, 0, 0, 0))
                texts = [w.lower() for w, _ in words]
                if at and kept[at - 1][1][-1] in HYPHENS and len(kept[at - 1][1]) > 1 and kept[at - 1][1][-2].isalpha():
                    texts, skipped = texts[1:], 1
                else:
                    skipped = 0
                broken = None
                if texts and line[-1] in HYPHENS and len(line) > 1 and line[-2].isalpha() and at + 1 < len(kept) and kept[at + 1][2]:
                    first = texts.pop().rstrip(HYPHENS)
                    follow, begins = kept[at + 1][2][0]
                    if follow[0].isalpha() or follow[0] in "@!01569+":
                        broken = (first, follow.lower(), kept[at + 1][0] + 1)
                for pos, word in enumerate(texts):
                    if any(c.isalpha() for c in word):
                        left = texts[pos - 1] if pos else None
                        right = texts[pos + 1] if pos + 1 < len(texts) else broken[0] + broken[1] if broken else None
                        rows.append((i, k + 1, "word", word, None, left, right, pos + skipped, 0, 0))
                if broken:
                    a, b, line2 = broken
                    rows.append((i, k + 1, "broken", a + b, a + "-" + b, texts[-1] if texts else None, None, len(texts) + skipped, len(a), line2))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LAYOUT.split(", ")])


_LAYOUT = "record_id bigint, line_no int, kind string, word string, other string, lefts string, rights string, pos int, cut int, line2 int"


def _hash(*words: str) -> int:
    h = xxhash.xxh3_64_intdigest(" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of words and pairs of neighbours under their hashes; under 0 that of all words."""
    held: Counter = Counter()
    for pdf in parts:
        for text in pdf["content"]:
            for line in text.lower().split("\n"):
                words = [w.rstrip("!'’*") for w in _WORD.findall(line)]
                held.update(words)
                held.update(map(" ".join, zip(words, words[1:])))
                held[0] += len(words)
        if len(held) > 1_000_000:
            yield _flush(held)
            held = Counter()
    if held:
        yield _flush(held)


def _flush(held: Counter) -> pd.DataFrame:
    total = held.pop(0, 0)
    return pd.DataFrame({"h": [0, *map(_hash, held)], "n": [total, *held.values()]})


def _prior(seen: str) -> float:
    return LETTERS if seen.isalpha() else SIGN


def _edits(word: str) -> list[tuple[int, str, str]]:
    """(position, seen, right) of every confusion that one character or two next to each other may be."""
    return [(i, seen, right) for i in range(len(word)) for seen in ((word[i], word[i : i + 2]) if i + 1 < len(word) else (word[i],)) for right in CONFUSIONS.get(seen, ())]


def candidates(word: str, weights: dict[tuple[str, str], float] | None = None) -> dict[str, tuple[float, int]]:
    """Words that may have been printed for ``word``: log probability of up to two confusions, and where the first is.

    ``weights`` are the log probabilities of confusions (seen, right).
    """
    weight = lambda seen, right: (weights or {}).get((seen, right), math.log(_prior(seen)))
    out: dict[str, tuple[float, int]] = {}
    single = []
    for i, seen, right in _edits(word):
        made = word[:i] + right + word[i + len(seen) :]
        single.append((i, seen, right))
        out[made] = max(out.get(made, (-99.0, i)), (weight(seen, right), i))
    for x, (i, seen, right) in enumerate(single):
        for j, seen2, right2 in single[x + 1 :]:
            # two confusions of letters alone are too unlikely to try
            if j < i + len(seen) or (seen.isalpha() and seen2.isalpha()):
                continue
            made = word[:i] + right + word[i + len(seen) : j] + right2 + word[j + len(seen2) :]
            if made not in out:
                out[made] = (weight(seen, right) + weight(seen2, right2), i)
    return out


def _candidate_rows(weights: dict[tuple[str, str], float]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(w, c, p, at, _hash(c)) for w in pdf["word"] for c, (p, at) in candidates(w, weights).items()]
            yield pd.DataFrame(rows, columns=["word", "c", "p", "at", "h"])

    return run


def _single_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = [(w, seen, right, _hash(w[:i] + right + w[i + len(seen) :])) for w in pdf["word"] for i, seen, right in _edits(w)]
        yield pd.DataFrame(rows, columns=["word", "seen", "right", "h"])


def confusion_weights(met: DataFrame, counts: DataFrame) -> dict[tuple[str, str], float]:
    """Log probability of each confusion, of the different words ``met`` (word, n) in scanned texts and the clean ``counts`` (h, n).

    A word never met clean that one confusion alone turns into a known one counts for that confusion,
    against the places in known words where it might have been; few counts lean on the prior.
    """
    single = met.where("n = 0").select("word").mapInPandas(_single_rows, "word string, seen string, right string, h bigint").join(counts.select("h"), "h")
    sure = single.groupBy("word").agg(F.count("*").alias("k"), F.first("seen").alias("seen"), F.first("right").alias("right")).where("k = 1")
    found = {(r["seen"], r["right"]): r["count"] for r in sure.groupBy("seen", "right").count().collect()}  # a row per confusion at most
    rights = sorted({right for of in CONFUSIONS.values() for right in of})
    places = [F.sum((F.length("word") - F.length(F.replace("word", F.lit(r), F.lit("")))) / len(r)).alias(r) for r in rights]
    whole = met.where("n > 0").agg(*places).first()  # one row
    out = {}
    for seen, of in CONFUSIONS.items():
        for right in of:
            k = found.get((seen, right), 0)
            out[seen, right] = math.log((k + PRIOR * _prior(seen)) / (k + (whole[right] or 0) + PRIOR))
    return out


def _hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        yield pdf.assign(h=[_hash(w) for w in pdf["word"]])


def _pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pair hashes that a line's decoding needs."""
    for pdf in parts:
        rows = []
        for i, k, units in zip(pdf["record_id"], pdf["line_no"], pdf["units"]):
            rows += [(i, k, h) for h in {_hash(a, b) for a, b in _edges(units)}]
        yield pd.DataFrame(rows, columns=["record_id", "line_no", "h"])


def _options(u, unknown: float = UNKNOWN) -> list[tuple[str, float, float, int, bool]]:
    """(word, log probability of reading, count, position of the confusion, with hyphen) of a unit."""
    out = []
    for word, n, found, hyphen in ((u["word"], u["n"], u["found"], False), (u["other"], u["n_other"], u["found_other"], True)):
        if word is None:
            continue
        odd = re.search(r"[^\W\d_][!+@$|][^\W_]|[+@$]", word) is not None
        out.append((word, 0.0, (n or 0.0) + (unknown * (0.02 if odd else 1.0) if not n else 0.0), -1, hyphen))
        out += [(f["c"], f["p"], float(f["n"]), f["at"], hyphen) for f in (found if found is not None else ())]
    return out


def _edges(units) -> Iterator[tuple[str, str]]:
    for x, u in enumerate(units):
        own = [o[0] for o in _options(u)]
        after = units[x + 1] if x + 1 < len(units) and units[x + 1]["pos"] == u["pos"] + 1 else None
        before = x and units[x - 1]["pos"] == u["pos"] - 1
        if u["lefts"] and not before:
            yield from ((u["lefts"], o) for o in own)
        if after is not None:
            yield from ((o, q[0]) for o in own for q in _options(after))
        elif u["rights"]:
            yield from ((o, u["rights"]) for o in own)


def decode(units, pairs: dict[int, int], total: float) -> list[tuple[str, float, float, int, bool]]:
    """The likeliest option of each unit of a line, by Viterbi over runs of neighbouring units."""
    chosen: list = []
    trail: list[list[tuple[float, int, tuple]]] = []

    def close() -> None:
        if not trail:
            return
        best = max(range(len(trail[-1])), key=lambda j: trail[-1][j][0])
        run = []
        for step in reversed(trail):
            run.append(step[best][2])
            best = step[best][1]
        chosen.extend(reversed(run))
        trail.clear()

    for x, u in enumerate(units):
        own = _options(u, UNKNOWN * max(1.0, total / UNKNOWN_OF))
        linked = bool(trail) and units[x - 1]["pos"] == u["pos"] - 1
        if not linked:
            close()
        follows = x + 1 < len(units) and units[x + 1]["pos"] == u["pos"] + 1
        step = []
        for o in own:
            word, read, n, _, _ = o
            single = math.log(n / total)
            if linked:
                score, back = max((s + math.log((pairs.get(_hash(q[0], word), 0) + SMOOTH * n / total) / (q[2] + SMOOTH)), j) for j, (s, _, q) in enumerate(trail[-1]))
            elif u["lefts"]:
                score, back = math.log(pairs.get(_hash(u["lefts"], word), 0) + SMOOTH * n / total), 0
            else:
                score, back = single, 0
            if u["rights"] and not follows:
                score += math.log((pairs.get(_hash(word, u["rights"]), 0) + SMOOTH * 1e-4) / (n + SMOOTH))
            step.append((score + read, back, o))
        trail.append(step)
    close()
    return chosen


def _decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for i, k, units, hashes, counts, total in zip(pdf["record_id"], pdf["line_no"], pdf["units"], pdf["hashes"], pdf["counts"], pdf["total"]):
            pairs = dict(zip(hashes, counts)) if hashes is not None else {}
            for u, (word, _, n, at, hyphen) in zip(units, decode(units, pairs, float(total))):
                broken = u["other"] is not None
                seen = u["other"] if hyphen else u["word"]
                if broken:
                    if not (u["n"] or u["n_other"] or at >= 0):  # neither form is known
                        hyphen = False
                    if not hyphen:
                        rows.append((i, k, "join", seen, word))
                # a sign within letters is misread also where no word is known for it
                odd = at < 0 and not n >= 1 and re.search(r"[^\W\d_][!+@][^\W\d_]|[+@]|[a-z][0159][a-z]", seen)
                if at >= 0 or odd:
                    spot = at if at >= 0 else odd.start() + (1 if len(odd.group()) > 1 else 0)
                    rows.append((i, u["line2"] if broken and spot >= u["cut"] else k, "char", seen, word))
        yield pd.DataFrame(rows, columns=["record_id", "line_no", "kind", "seen", "right"])


def findings(scanned: DataFrame, clean: DataFrame) -> DataFrame:
    """(record_id, line_no, kind, seen, right): what is wrong with the lines of ``scanned`` (record_id, title, content).

    kind ``drop``: a line of furniture; ``join``: its last word was broken; ``char``: ``seen`` was misread
    for ``right``. A line may have several rows of a kind. ``clean`` (content) gives the counts. Null and
    empty contents give no rows, null titles are no help; other columns are not read.
    """
    layout = materialize(scanned.select("record_id", "title", "content").where("content is not null").mapInPandas(_layout, _LAYOUT), "layout")
    partial = clean.select("content").where("content is not null").mapInPandas(_count, "h bigint, n bigint")
    counts = materialize(partial.groupBy("h").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("h = 0").agg(F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("total"))
    words = layout.where("kind in ('word', 'broken')")
    every = words.select(F.explode(F.array("word", "other")).alias("word")).where("word is not null").distinct()
    met = every.mapInPandas(_hashes, "word string, h bigint").join(counts, "h", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    certain = F.greatest(F.lit(float(CERTAIN)), CERTAIN_SHARE * F.col("total"))
    met = materialize(met.crossJoin(F.broadcast(total)).select("word", "n", (F.col("n") < certain).alias("rare")), "met")
    rare = met.where("rare").select("word")
    found = rare.mapInPandas(_candidate_rows(confusion_weights(met, counts)), "word string, c string, p double, at int, h bigint").join(counts, "h")
    found = found.groupBy("word").agg(F.sort_array(F.collect_list(F.struct((F.col("p") + F.log("n")).alias("s"), "c", "p", "at", "n")), asc=False).alias("found"))
    known = materialize(met.join(found, "word", "left"), "known")
    odd = F.col("word").rlike(r"[^\W\d_][!+@][^\W\d_]|[+@]|[a-z][0159][a-z]")
    doubtful = known.where(F.col("rare") & (F.col("found").isNotNull() | odd))
    plain = words.where("kind = 'word'").join(doubtful.drop("rare"), "word").withColumns({"n_other": F.lit(None).cast("bigint"), "found_other": F.lit(None).cast(known.schema["found"].dataType)})
    other = known.select(F.col("word").alias("other"), F.col("n").alias("n_other"), F.col("found").alias("found_other"))
    broken = words.where("kind = 'broken'").join(known.drop("rare"), "word").join(other, "other")
    unit = F.struct("pos", "word", "other", "lefts", "rights", "cut", "line2", "n", "n_other", "found", "found_other")
    lines = plain.unionByName(broken).groupBy("record_id", "line_no").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    lines = materialize(lines, "lines")
    needed = lines.mapInPandas(_pairs, "record_id bigint, line_no int, h bigint").join(counts, "h")
    needed = needed.groupBy("record_id", "line_no").agg(F.collect_list("h").alias("hashes"), F.collect_list("n").alias("counts"))
    ready = lines.join(needed, ["record_id", "line_no"], "left").crossJoin(F.broadcast(total))
    decided = ready.mapInPandas(_decide, "record_id bigint, line_no int, kind string, seen string, right string")
    direct = layout.where("kind in ('drop', 'char')").select("record_id", "line_no", "kind", F.col("word").alias("seen"), F.lit(None).cast("string").alias("right"))
    return direct.unionByName(decided)


def _rebuild(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        texts = []
        for text, marks in zip(pdf["content"], pdf["marks"]):
            drop, join, right = set(), set(), {}
            for m in marks if marks is not None else ():
                k = m["line_no"] - 1
                if m["kind"] == "drop":
                    drop.add(k)
                elif m["kind"] == "join":
                    join.add(k)
                else:
                    right.setdefault(k, []).append((m["seen"], m["right"] or m["seen"].translate(_DIGITS)))
            out, gap, glue = [], False, False
            for k, line in enumerate(text.split("\n")):
                if k in drop:
                    continue
                if not line.strip():
                    gap = True
                    continue
                line = line.strip()
                for seen, fixed in right.get(k, ()):
                    at = line.lower().find(seen.lower())
                    if at >= 0:
                        line = line[:at] + (fixed.capitalize() if line[at].isupper() else fixed) + line[at + len(seen) :]
                if not out:
                    out.append(line)
                elif glue:
                    out[-1] = out[-1].rstrip(HYPHENS) + line
                elif gap and re.search(r"[.!?。！？।؟][\"”»“’)」』]*$", out[-1]):
                    out.append(line)
                elif out[-1][-1:] in HYPHENS:
                    out[-1] += line
                else:
                    out[-1] += " " + line
                gap, glue = False, k in join
            texts.append("\n\n".join(out))
        yield pd.DataFrame({"record_id": pdf["record_id"], "text": texts})


def repaired(scanned: DataFrame, clean: DataFrame) -> DataFrame:
    """(record_id, text): contents of ``scanned`` as continuous paragraphs, by findings; null and empty contents give empty text.

    A paragraph runs on over a page break unless its last line ends a sentence.
    """
    found = findings(scanned, clean)
    marks = found.groupBy("record_id").agg(F.sort_array(F.collect_set(F.struct("line_no", "kind", "seen", "right"))).alias("marks"))
    texts = scanned.select("record_id", F.coalesce("content", F.lit("")).alias("content"))
    return texts.join(marks, "record_id", "left").mapInPandas(_rebuild, "record_id bigint, text string")
