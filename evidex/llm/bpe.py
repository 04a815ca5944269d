"""Encoding with a public byte-level BPE vocabulary as a streaming transducer, and its decoder.

The encoder takes text in pieces. A match of the split pattern is final once ``PEEK`` further
characters were seen, so only the last match is held back, and one above ``BLOCK`` characters goes
on byte by byte. Inside a match the transducer knows for every prefix the one token its encoding ends
in: the longest suffix that is a token, in agreement with the token before it. Its lookahead is
computed from the merge list, as the bytes of the longest token the merges make: no token covers more,
so that every encoding of what may follow has a boundary among the last so many prefixes, and tokens
that the encodings of all these prefixes share are stable and are emitted. Memory is a window of as
many prefixes and a bounded memo of short matches, whatever the length of the text.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
#: The split pattern belonging to the byte-level rank files; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PEEK = 3  # a contraction has three characters; a space run yields its last blank to what follows
BLOCK = 1 << 16
#: The encodings of matches of up to so many bytes are kept for the next time.
SHORT = 64
CACHED = 400_000


class Vocabulary:
    """Ranks of a vocabulary file: a token's rank is its id and the priority of the merge that makes it."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self.fits = lru_cache(1 << 18)(self._fits)
        self.made = lru_cache(None)(self._made)
        self.longest = self.lookahead()
        self.known: dict[str, tuple[int, ...]] = _Short(self)

    def lookahead(self) -> int:
        """Bytes after which a token cannot change any more: those of the longest token the merge list makes."""
        return next(len(t) for t in sorted(self.ranks, key=len, reverse=True) if self.made(self.ranks[t]))

    def merge_parts(self, data: bytes) -> list[bytes]:
        """The merges in order of rank, leftmost first, over a token or a pair of tokens."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            least = min(pairs)
            if least == 1 << 30:
                break
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _made(self, token: int) -> bool:
        """Whether the merges do make a token; a rank file may hold others, which never come out."""
        return len(self.tokens[token]) == 1 or self.merge_parts(self.tokens[token]) == [self.tokens[token]]

    def _fits(self, a: int, b: int) -> bool:
        """Whether two tokens may stand side by side: their bytes together give them again."""
        return self.merge_parts(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]


class _Short(dict):
    """Memo of the transducer's results for short matches; emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> tuple[int, ...]:
        data = match.encode("utf-8", "surrogatepass")
        ids = tuple(stream_match(self.vocabulary, data))
        if len(data) <= SHORT:
            if len(self) >= CACHED:
                self.clear()
            self[match] = ids
        return ids


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """That of a file, which a worker takes from the session's files where it has none at the path."""
    return Vocabulary(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _shipped(df: DataFrame, path: str) -> str:
    """The path of a vocabulary, whose file the session then has for workers on other machines."""
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local") and os.path.exists(path):
        context.addFile(path)
    return path


class Transducer:
    """Tokens of one match, byte by byte, each as soon as no continuation can change it."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.window, self.base = b"", 0  # the last bytes, from position ``base`` on
        self.at = self.emitted = 0  # positions are byte counts from the start of the match
        self.last: dict[int, tuple[int, int]] = {}  # position -> (token that ends there, where it begins)

    def push(self, data: bytes) -> list[int]:
        """Takes further bytes; gives the tokens that became stable."""
        out: list[int] = []
        ranks, made, fits, longest = self.voc.ranks, self.voc.made, self.voc.fits, self.voc.longest
        for start in range(0, len(data), longest):
            part = data[start : start + longest]
            self.window += part
            for at in range(self.at + 1, self.at + len(part) + 1):
                stop = at - self.base
                for begin in range(max(self.emitted, at - longest), at):
                    token = ranks.get(self.window[begin - self.base : stop])
                    if token is None or not made(token):
                        continue
                    if begin == 0 or (begin in self.last and fits(self.last[begin][0], token)):
                        self.last[at] = (token, begin)
                        break
            self.at += len(part)
            if self.at - self.emitted >= 4 * longest:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """The tokens before the point that every prefix ending within the lookahead leads back to."""
        last = self.last
        paths = {p for p in range(self.at - self.voc.longest + 1, self.at + 1) if p in last}
        while len(paths) > 1:
            far = max(paths)
            paths.discard(far)
            paths.add(last[far][1])
        stable = paths.pop() if paths else self.emitted
        if stable <= self.emitted:
            return []
        out = _walk(last, self.emitted, stable)
        self.last = {p: v for p, v in last.items() if p >= stable}
        self.emitted = stable
        cut = max(self.base, stable - self.voc.longest)
        self.window, self.base = self.window[cut - self.base :], cut
        return out

    def finish(self) -> list[int]:
        return _walk(self.last, self.emitted, self.at)


def stream_match(voc: Vocabulary, data: bytes) -> list[int]:
    """Tokens of one match, by the transducer."""
    one = voc.ranks.get(data)
    if one is not None and voc.made(one):
        return [one]
    t = Transducer(voc)
    return t.push(data) + t.finish()


def _walk(last: dict[int, tuple[int, int]], start: int, stop: int) -> list[int]:
    out = []
    while stop > start:
        token, stop = last[stop]
        out.append(token)
    return out[::-1]


#: What goes on with a match of letters, of figures, of other signs, of blanks.
_KINDS = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")))


def encode_stream(voc: Vocabulary, pieces: Iterable[str]) -> Iterator[list[int]]:
    """Ids of the text that ``pieces`` make up, in lists as they become stable."""
    held = ""
    open_: tuple[Transducer, regex.Pattern] | None = None  # a match longer than a block, and what goes on with it
    for piece in pieces:
        held += piece
        if len(held) < BLOCK:
            continue
        out: list[int] = []
        while len(held) > PEEK:
            if open_ is not None:
                t, kind = open_
                same = kind.match(held)
                # of blanks the last is left to what follows
                stop = min(same.end() if same else 0, len(held) - PEEK) if kind is not _KINDS[3] else max(0, min((same.end() if same else 0), len(held) - PEEK) - 1)
                out += t.push(held[:stop].encode("utf-8", "surrogatepass"))
                ended = same is None or same.end() <= len(held) - PEEK
                held = held[stop:]
                if not ended:
                    break
                out += t.finish()
                open_ = None
                continue
            done, found = 0, []
            for m in voc.pattern.finditer(held):
                if m.end() > len(held) - PEEK:
                    break
                found.append(m.group())
                done = m.end()
            out += chain.from_iterable(map(voc.known.__getitem__, found))
            held = held[done:]
            # the rest begins with a match that ends within PEEK of its end; a long one goes on byte by byte
            if len(held) < max(BLOCK // 2, 16 * PEEK):
                break
            kind = next(k for k in _KINDS if k.match(held[-PEEK - 1]))
            open_ = Transducer(voc), kind
            lead = 0 if kind.match(held) else 1  # the blank before a word
            out += open_[0].push(held[:lead].encode())
            held = held[lead:]
        yield out
    if open_ is not None:
        t, kind = open_
        same = kind.match(held)
        stop = same.end() if same else 0
        if kind is _KINDS[3] and stop < len(held):
            stop = max(0, stop - 1)
        yield t.push(held[:stop].encode("utf-8", "surrogatepass")) + t.finish()
        held = held[stop:]
    yield list(chain.from_iterable(map(voc.known.__getitem__, voc.pattern.findall(held))))


def encode(voc: Vocabulary, text: str) -> list[int]:
    if len(text) <= BLOCK:
        return list(chain.from_iterable(map(voc.known.__getitem__, voc.pattern.findall(text))))
    pieces = (text[i : i + BLOCK] for i in range(0, len(text), BLOCK))
    return list(chain.from_iterable(encode_stream(voc, pieces)))


def decode_stream(voc: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """Text of the ids token by token; bytes of an unfinished character wait for the next token."""
    state = codecs.getincrementaldecoder("utf-8")("surrogatepass")
    for i in ids:
        if part := state.decode(voc.tokens[i]):
            yield part
    if part := state.decode(b"", True):
        yield part


def decode(voc: Vocabulary, ids: Iterable[int]) -> str:
    return "".join(decode_stream(voc, ids))


def _encode_batches(path: str, key: str, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                lists = [encode(voc, t) if t else [] for t in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                if count:
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes)], [key, "tokens"])
                    continue
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return run


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids): token ids of every row, without special tokens, on the text as stored.

    Null and empty text give an empty list; a null key is kept; repeated rows give repeated rows;
    other columns are not read. No shuffle: rows are encoded where they are scanned.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, df[text].alias("text"))
    return rows.mapInArrow(_encode_batches(_shipped(df, f"{folder}/{name}.tiktoken"), key, False), f"{key} {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, tokens): the number of ids of every row, as encode_corpus gives them, without shipping the ids."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, df[text].alias("text"))
    return rows.mapInArrow(_encode_batches(_shipped(df, f"{folder}/{name}.tiktoken"), key, True), f"{key} {kind}, tokens bigint")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, text) of the ids; empty and null lists give empty text."""
    kind = df.schema[key].dataType.simpleString()
    path = _shipped(df, f"{folder}/{name}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = [decode(voc, i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, df[ids].alias("ids")).mapInArrow(run, f"{key} {kind}, text string")
