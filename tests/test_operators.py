import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.functions import text
from evidex.functions.vectors import sparse_of
from evidex.operators import chunking, merge, words
from evidex.operators import retrieve as R
from evidex.operators.checks import contradictions
from evidex.operators.monitoring import run_alerts
from evidex.operators.validate import clean_lines, validate_chunks, validate_documents


def vecs(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(e) for e in v], "t") for i, v in zip(ids if ids is not None else range(len(x)), x)], "id long, vector array<double>, score string")


def test_dense_topk_equals_brute_force_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    x = np.random.default_rng(1).normal(size=(60, 8))
    x[7] = 0
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(90, None), (91, [1.0]), (92, [float("nan")] * 8), (93, [float(e) for e in x[5]])]
    index = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    q = spark.createDataFrame(rows[:8], "query_id long, vector array<double>")
    y = np.vstack([x, x[5]])
    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
    ids = [*range(60), 93]
    cos = y @ y.T
    got = {(r.query_id, r["rank"]): r.id for r in R.dense_topk(q, index, 5).collect()}
    for i in range(8):
        want = sorted(range(61), key=lambda j: (-round(float(cos[i, j]), 9), ids[j]))[:5]
        assert [got[i, n] for n in range(5)] == [ids[j] for j in want]
    assert R.dense_topk(q.limit(0), index, 5).count() == 0 and R.dense_topk(q, index.limit(0), 5).count() == 0


def test_filters_are_a_conjunction(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    assert [r.n for r in df.where(R.conditions([("n", "gte", 2), ("s", "in", ["a", "b"])])).collect()] == [2]
    assert df.where(R.conditions([])).count() == 3
    with pytest.raises(TypeError):
        R.conditions([("s", "in", "ab")])


def _greedy(scores, x, n, lam=0.7):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = y @ y.T
    order = sorted(range(len(x)), key=lambda i: (-scores[i], i))
    if len(x) <= n:
        return order
    chosen = [order[0]]
    while len(chosen) < n:
        rest = [i for i in range(len(x)) if i not in chosen]
        chosen.append(min(rest, key=lambda i: (-(lam * scores[i] - (1 - lam) * max(cos[i, j] for j in chosen)), -scores[i], i)))
    return chosen


def test_mmr_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for q in range(4):
        n = (12, 3, 1, 20)[q]
        x, s = rng.normal(size=(n, 5)), rng.random(n)
        rows += [(q, i, float(s[i]), [float(e) for e in x[i]]) for i in range(n)]
        want[q] = _greedy(s, x, 6)
    got = R.mmr(spark.createDataFrame(rows, "query_id int, id int, score double, vector array<double>")).collect()
    for q in want:
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pos)] == want[q]


def test_rrf_golden_and_symmetry(spark):
    a = spark.createDataFrame([(1, 5, 0)], "query_id int, id int, rank int")
    docs = spark.createDataFrame([(5, "1a", 2025)], "id int, evidence_level string, year int")
    assert R.fuse(a, a, docs).first()["score"] == pytest.approx(2 / 61 * 1.35 * 1.10, abs=1e-9)
    b = spark.createDataFrame([(1, 5, 3), (1, 6, 0)], "query_id int, id int, rank int")
    one, two = ({(r.id, round(r.score, 12)) for r in R.rrf(x, y).collect()} for x, y in ((a, b), (b, a)))
    assert one == two


def test_context_prefix_stops_at_the_first_block_too_long(spark):
    df = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "b" * 9), (1, 2, "c")], "query_id int, pos int, block string")
    assert [r.pos for r in R.context_prefix(df, 10).collect()] == [0]


def _windows(sentences, most=500, overlap=50):
    size = lambda s: max(1, len(s) // 4)
    out, open_, tokens = [], [], 0
    for s in sentences:
        if tokens + size(s) <= most:
            open_, tokens = open_ + [s], tokens + size(s)
        elif open_:
            out.append(" ".join(open_))
            kept, n = [], 0
            for p in reversed(open_):
                if n + size(p) > overlap:
                    break
                kept, n = [p, *kept], n + size(p)
            open_, tokens = kept + [s], n + size(s)
        else:
            out.append(s)
    return out + ([" ".join(open_)] if open_ else [])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(1, 2600), max_size=25))
def test_sentence_windows_equal_a_loop(spark, sizes):
    sentences = [chr(97 + i) * n for i, n in enumerate(sizes)]
    got = spark.createDataFrame([(sentences,)], "s array<string>").select(chunking.sentence_windows(F.col("s"))).first()[0]
    assert got == _windows(sentences)


def test_sections_and_chunks(spark):
    rnd = random.Random(3)
    long = " ".join("Sentence " + " ".join(rnd.choices(["alpha", "beta", "gamma"], k=30)) + "." for _ in range(30))
    rows = [("a", "Title", f"Lead text.\n\n\nMore.\n1. Methods\n{long}\nRESULTS\n\nDiscussion\nEnd."), ("b", None, None), ("c", "Only title", " "), ("d", "", "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id string, title string, content string")
    heads = [(r.doc_id, r.title) for r in chunking.sections(df, "doc_id", "content").orderBy("doc_id", "section_index").collect()]
    assert heads == [("a", "Main"), ("a", "1. Methods"), ("a", "Discussion"), ("d", "Main")]
    got = chunking.chunk_documents(df).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in got if r.doc_id == "a"]
    assert [r.chunk_index for r in mine] == list(range(mine[0].total_chunks)) and mine[0].chunk_type == "doc_summary"
    assert all(r.token_estimate <= 550 for r in mine) and {r.doc_id for r in got} == {"a", "c", "d"}


def test_word_chunks(spark):
    body = "Treatment Overview\n\n" + "\n\n".join("word " * 120 for _ in range(6)) + "\n\n[TABLE]\na | b\n[/TABLE]\n\n2. Management of cases\nshort"
    df = spark.createDataFrame([(1, body, 0), (2, None, 0), (3, "", 0)], "doc_id long, content string, section int")
    got = words.word_chunks(df).orderBy("chunk_index").collect()
    assert [r.level for r in got].count("table") == 1 and all(r.doc_id == 1 for r in got)
    assert all(r.token_count <= 400 for r in got) and [r.chunk_index for r in got] == list(range(len(got)))
    assert words.header("2.1 Management of sepsis") and words.header("TREATMENT") and not words.header("| Treatment |") and not words.header("treatment was given")


def test_upsert_is_idempotent_and_latest_breaks_ties(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, s string")
    new = spark.createDataFrame([(2, 5, "c"), (2, 5, "d"), (3, 1, None), (None, 1, "x")], "k int, v int, s string")
    once = merge.upsert(old, new, "k", "v")
    want = [(1, 1, "a"), (2, 5, "d"), (3, 1, None)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merge.upsert(once, new, "k", "v").collect())) == want


def test_change_status(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "doc_id string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "doc_id string, hash string")
    assert dict(map(tuple, merge.change_status(old, new).collect())) == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "new"}


def test_title_duplicates_equal_brute_force(spark):
    rnd = random.Random(8)
    base = ["management of hypertension in adults", "effects of malaria guidelines on care", "a trial of insulin in children with diabetes"]
    titles = [b if rnd.random() < 0.3 else b + " " + rnd.choice(["i", "ii", "iii", "study"]) for b in base * 8] + ["", None, "ab"]
    rows = [(f"s{i % 2}", t, i) for i, t in enumerate(titles)]
    got = {(r.source_type, r.title_a, r.title_b) for r in merge.title_duplicates(spark.createDataFrame(rows, "source_type string, title string, id int")).collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    seen = {(s, t) for s, t, _ in rows if t and len(t) > 2}
    want = {(s, a, b) for s, a in seen for u, b in seen if s == u and a < b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.9}
    assert got == want and want


def test_unequal_sparse_arrays_are_an_error(spark):
    df = spark.createDataFrame([([1, 2], [0.5])], "i array<int>, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(sparse_of(F.col("i"), F.col("v"))).collect()


def test_validation_order(spark):
    rows = [(None, "x" * 300, "who"), ("Abc", "x" * 300, "who"), ("Title", None, "who"), ("Title", "short", "who"), ("Title", "x" * 300, "zz"), ("Title", "\x80" * 300, "who"), ("Title", "x" * 300, "who")]
    df = spark.createDataFrame(rows, "title string, content string, source_type string")
    assert [r.reason for r in validate_documents(df).collect()] == ["blank title", "short title", "blank content", "short content", "unknown source", "garbled", None]
    chunks = spark.createDataFrame([(None,), ("word",), ("word " * 2000,), ("1234567890 " * 30,), ("fine words " * 10,)], "text string")
    assert [r.reason for r in validate_chunks(chunks).collect()] == ["blank", "short", "long", "few letters", None]


def test_clean_lines_keeps_tables(spark):
    s = "12\n  A line that is  long enough to keep\nshort\nEnd.\n[TABLE]\n a|b \n[/TABLE]\n"
    got = spark.createDataFrame([(s,)], "c string").select(clean_lines(F.col("c"))).first()[0]
    assert got == "A line that is long enough to keep\nEnd.\n[TABLE]\n a|b \n[/TABLE]"


def test_contradictions_need_a_topic(spark):
    rows = [(1, 1, "Aspirin therapy", "It is safe."), (1, 2, "Therapy options", "It is unsafe."), (1, 3, "Other", "unsafe"), (2, 4, "Therapy", "unsafe")]
    got = contradictions(spark.createDataFrame(rows, "query_id int, id int, title string, text string")).collect()
    assert {(r.a, r.b, r.kind) for r in got} == {(1, 2, "outcome_conflict")}


def test_alerts(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "failed", 2, t), ("a", "failed", 2, t), ("b", "completed", 0, t), ("c", "running", None, None)], "run_id string, status string, embedding_errors long, finished_at timestamp_ntz")
    assert sorted(map(tuple, run_alerts(df).collect())) == [("a", "embedding errors"), ("a", "failed"), ("c", "unfinished")]


def test_sentences_protect_short_forms(spark):
    got = spark.createDataFrame([("As Lee et al. Found it. See Fig. 3 now. Then p.o. Doses rose.",)], "c string").select(text.sentences(F.col("c"))).first()[0]
    assert got == ["As Lee et al. Found it.", "See fig. 3 now.", "Then p.o. Doses rose."]
