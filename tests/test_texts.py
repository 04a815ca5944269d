"""Search of many texts by many texts, and what follows from it over the titles of a table: results, and how little is moved."""

import random
import re

import duckdb
import pytest

from evidex.operators import merge, texts
from evidex.operators import retrieve as R
from evidex.plans import checking

WORDS = "treatment of heart failure in adults with stroke or gout after insulin type 2 diabetes hypertensive-state immunoglobulins aspirin dose trial".split()


def shuffled(spark, run):
    """Rows that ``run`` writes to shuffles."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def stages():
        bus.waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for s, n in stages().items() if s not in before)


@pytest.fixture(scope="module")
def drawn():
    rnd = random.Random(3)
    held = [(f"d{i:03}", " ".join(rnd.choices(WORDS, k=rnd.randint(0, 9)))) for i in range(300)] + [("e1", None), ("e2", ""), ("e3", "心不全 study"), ("e4", "心不全 study")]
    return held, [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 5)))) for i in range(60)] + [(60, None), (61, "study"), (62, "study")]


@pytest.mark.parametrize("block", [7, 1000])
def test_search_equals_joins_of_postings(spark, monkeypatch, drawn, block):
    monkeypatch.setattr(texts, "QUERY_BLOCK", block)
    monkeypatch.setattr(texts, "SCORE_BLOCK", 5)
    held, asked = (spark.createDataFrame(rows, schema) for rows, schema in zip(drawn, ("id string, text string", "query_id long, query string")))
    got = texts.search(asked, held, 4, 3).collect()
    index = R.sparse_vectors(held, "id", "text")
    want = {(r.query_id, r.id, round(r.score, 8), r["rank"]) for r in R.sparse_topk(R.sparse_vectors(asked, "query_id", "query"), index, 4).collect()}
    assert {(r.query_id, r.id, round(r.score, 8), r["rank"]) for r in got if r.of == 1} == want and len(want) > 150

    def vectors(df, key, text):
        out: dict = {}
        for r in R.sparse_vectors(df, key, text).collect():
            out.setdefault(r[0], [0.0] * 64)[r.idx % 64] += r.weight
        return {k: [round(x, 6) for x in v] for k, v in out.items()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    mine, its = vectors(asked, "query_id", "query"), vectors(held, "id", "text")
    near = {q: sorted((-round(cosine(v, w), 9), i) for i, w in its.items())[:3] for q, v in mine.items()}
    assert {(r.query_id, r["rank"]): r.id for r in got if r.of == 0} == {(q, n): i for q, hits in near.items() for n, (_, i) in enumerate(hits)}
    assert not texts.search(asked.limit(0), held, 4).count() and not texts.search(asked, held.limit(0), 4, 3).count()


def records(spark, folder, n):
    """Records of which all share a term; every tenth is a question."""
    rows = [(i * 5, f"drug{i % 7} for heart failure in adults", f"heart failure and drug{i % 5} in adults: report {'again ' * (i % 3)}") for i in range(n)]
    spark.createDataFrame(rows, "record_id long, title string, content string").coalesce(1).write.parquet(f"{folder}/doc_records.parquet")
    return rows


def test_sub_queries_move_hits_not_postings(spark, tmp_path):
    records(spark, tmp_path, 2000)
    query = checking.QUERIES["subquery_merge_titles"][0]
    found = []
    moved = shuffled(spark, lambda: found.extend(query(spark, str(tmp_path)).collect()))
    assert len(found) == 2000 // 10 * 2 * 5
    assert moved < 30_000  # a row for each pair of question and record that share a term would be 800,000


def test_deep_confidence_moves_hits_not_postings_or_texts(spark, tmp_path):
    records(spark, tmp_path, 2000)
    query, sql = checking.QUERIES["deep_confidence_titles"]
    found = []
    moved = shuffled(spark, lambda: found.extend(query(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view doc_records as select * from '{tmp_path}/doc_records.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(con.execute(sql).fetchall()) and len(found) == 200
    assert moved < 60_000


def test_title_pairs_move_rare_substrings_not_candidates(spark):
    rnd = random.Random(5)
    names = ["".join(rnd.choices(["ka", "lo", "mi", "ren", "sto", "高血", "ив"], k=4)) for _ in range(60)]
    rows = [(rnd.choice(["who", "cdc", None]), f"{rnd.choice(['Effect', 'Safety'])} of {rnd.choice(names)} in {rnd.choice(['gout', 'stroke', 'adults', '治疗'])}: study {rnd.randint(2000, 2012)}") for _ in range(600)]
    rows += [("who", "abc"), ("who", "ABC."), ("who", "abcd"), ("who", "ab"), ("who", ""), ("who", None)]
    df = spark.createDataFrame(rows, "source_type string, title string").repartition(3)
    clean = {(s, re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip()) for s, t in rows if s and t}
    grams = {t: {t[i : i + 3] for i in range(len(t) - 2)} for _, t in clean}
    for minimum in (0.6, 0.8, 1.0):
        want = {(s, a, b) for s, a in clean for u, b in clean if s == u and a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= minimum}
        found = []
        moved = shuffled(spark, lambda: found.extend((r.source_type, r.title_a, r.title_b) for r in merge.title_duplicates(df, minimum).collect()))
        assert len(found) == len(set(found)) and set(found) == want and (len(want) > 50 or minimum == 1)
        assert moved < (60 if minimum < 0.7 else 30) * len(clean)  # the substrings of each alone are about 30, and were moved three times
    assert not merge.title_duplicates(df.limit(0)).count()
