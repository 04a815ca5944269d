import random

import pytest

from evidex.llm import bpe
from evidex.llm.sentences import ends, sentence_ends
from evidex.llm.splitting import pieces, split_oversized, tokens


def cut(text):
    out, at = [], 0
    for e in ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Lee and Prof. Roe saw 3.5 mg p.o. daily, e.g. twice. Next one!", ["Dr. Lee and Prof. Roe saw 3.5 mg p.o. daily, e.g. twice.", "Next one!"]),
        ("It was given at 6 a.m. A group left. pH fell. mRNA rose.", ["It was given at 6 a.m.", "A group left.", "pH fell.", "mRNA rose."]),
        ("It was given at 6 a.m. (Fig. 5). Done.", ["It was given at 6 a.m. (Fig. 5).", "Done."]),
        ('They wrote: "Stop now. Wait." By then it was late.', ['They wrote: "Stop now. Wait."', "By then it was late."]),
        ('They asked, "Is it safe?" and then left. Yes.', ['They asked, "Is it safe?" and then left.', "Yes."]),
        ("1. Abstract\nA b ... or c. D", ["1. Abstract", "A b ... or c.", "D"]),
        ("Am 8. März kamen z. B. Ärzte bzw. Pfleger. „Ist es sicher?“ und so weiter.", ["Am 8. März kamen z. B. Ärzte bzw. Pfleger.", "„Ist es sicher?“ und so weiter."]),
        ("委员会写道：“不要停。请问。”治疗后，好转。“安全吗？”医生问道。", ["委员会写道：“不要停。请问。”", "治疗后，好转。", "“安全吗？”医生问道。"]),
        ("委員会は「止めないこと。相談すること。」と書いた。次。", ["委員会は「止めないこと。相談すること。」と書いた。", "次。"]),
        ("ยาดี มาก 5 ครั้ง ต่อวัน", ["ยาดี", "มาก 5 ครั้ง", "ต่อวัน"]),
        ("डॉ. राम आए। वे गए।", ["डॉ. राम आए।", "वे गए।"]),
        ("The rate fell.The next rose by 7.5.", ["The rate fell.", "The next rose by 7.5."]),
        ("", []),
        (" \n \r\n", []),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


def test_sentence_table(spark):
    rows = [("chunk", "a", "One. Two."), ("chunk", "a", "One. Two."), ("chunk", "b", None), ("record", "1", ""), ("record", "2", "x" * 100000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "item_kind string, item_id string, text string, ends int")
    got = sorted(tuple(r) for r in sentence_ends(df, unique=True).collect())
    assert got == [("chunk", "a", 4), ("chunk", "a", 9), ("record", "2", 100000)]
    assert sentence_ends(df).count() == 5
    assert sentence_ends(df.limit(0)).count() == 0


def _long(seed, n):
    rnd = random.Random(seed)
    return "\n\n".join(" ".join(f"Sentence {rnd.randrange(10**6)} of words {rnd.randrange(10**6)}." for _ in range(rnd.randrange(3, 9))) for _ in range(n))


@pytest.mark.parametrize("text", [_long(1, 80), "x" * 9000, "word " * 4000, "", "short", "。" * 5000, "\r\n" * 4000])
def test_pieces_cover_within_limit(text):
    got = pieces(text, 500)
    assert "".join(text[c:e] for _, c, e in got) == text
    assert all(tokens(text[s:e]) <= 500 and 0 <= c - s <= 203 for s, c, e in got)


def test_pieces_cut_at_paragraphs_and_change_near_edits_only():
    text = _long(2, 120)
    got = pieces(text, 500)
    assert all(text[c - 2 : c] == "\n\n" for _, c, _ in got[1:])
    edited = text[:200] + "An added sentence. " + text[200:]
    before, after = {text[c:e] for _, c, e in got}, [edited[c:e] for _, c, e in pieces(edited, 500)]
    assert sum(p not in before for p in after) <= 3


def test_split_table(spark):
    rows = [("chunk", "a", _long(3, 40), 500)] * 2 + [("chunk", "b", "x", 500), ("record", "c", None, 2000)]
    df = spark.createDataFrame(rows, "item_kind string, item_id string, text string, limit int")
    got = split_oversized(df).collect()
    assert {r.item_id for r in got} == {"a"} and [r.piece for r in sorted(got, key=lambda r: r.piece)] == list(range(len(got)))
    assert split_oversized(df.limit(0)).count() == 0


VOC = bpe.vocabulary(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken")
SAMPLES = ["", " ", "\n\n  x", "it's we'll I'D 'll", "naïve café 中国人民", "a" * 3000, "ก็" * 900, "abc  \t\n def   ", "<|endoftext|> x", "🙂🙃" * 20, " " * 700 + "x", "12345 67.8%"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library_and_round_trip(library):
    for text in SAMPLES:
        ids = bpe.encode(VOC, text)
        assert ids == library(text)
        assert bpe.decode(VOC, ids) == text


def test_stream_in_small_pieces_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    text = "".join(SAMPLES)
    parts = [text[i : i + 5] for i in range(0, len(text), 5)]
    assert [i for ids in bpe.encode_stream(VOC, parts) for i in ids] == library(text)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 5000 + "x", "x" + " " * 4500, "ab " + "1" * 4000 + " c", "." * 4200 + "it's", " " * 4093 + "'s", "w" * 4094 + "'ll go", " " + "b" * 4092 + "     " + "c" * 4500, "あ" * 4500 + "x" * 4500 + "\t" * 4500])
def test_matches_longer_than_a_block_go_on_byte_by_byte(library, monkeypatch, text):
    monkeypatch.setattr(bpe, "BLOCK", 1024)
    assert bpe.encode(VOC, text) == library(text)


def test_no_more_is_held_than_the_lookahead_allows():
    t, sent = bpe.Transducer(VOC), []
    for _ in range(200):
        sent += t.push(b"abracadabra simsalabim"[:11] * 10)
        assert len(t.window) < 8 * VOC.longest and len(t.last) < 8 * VOC.longest
    assert b"".join(VOC.tokens[i] for i in sent + t.finish()) == b"abracadabra" * 2000


def test_long_matches_are_streamed_exactly():
    rnd = random.Random(5)
    for alphabet in ("ab", "theingand", "中国人的一是", "éàüß"):
        data = "".join(rnd.choices(alphabet, k=1500)).encode()
        assert [VOC.tokens[i] for i in bpe.stream_match(VOC, data)] == VOC.merge_parts(data)


def test_corpus_columns_nulls_and_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([None, *SAMPLES])], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(SAMPLES) + 1
    counts = {r.doc_id: r.tokens for r in bpe.token_counts(df, "doc_id").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate([None, *SAMPLES])}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def test_every_terminator_of_unicode_ends_a_sentence():
    import regex

    marks = regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    assert len(marks) > 150
    assert [m for m in marks if ends(f"Abc def{m} Ghi jkl") != [8, 16]] == []
    assert ends("ᱚᱞ ᱪᱤᱠᱤ᱾ ᱚᱞ ᱪᱤᱠᱤ᱾") == [8, 17]


def test_abbreviations_are_those_of_the_language():
    english = "The lesion of the skin was graded d. Then it was removed."
    assert ends(english) == [36, len(english)]
    german = "Das wird in der Regel u. a. mit Jod behandelt, z. B. bei der Struma."
    assert ends(german) == [len(german)]
    vitamin = "All of the patients were given vitamin D. Then they were seen by J. Smith."
    assert ends(vitamin) == [41, len(vitamin)]
