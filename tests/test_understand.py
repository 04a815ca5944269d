import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidex.operators import cache, understand
from evidex.operators.merge import zip_vectors
from evidex.operators.monitoring import finished
from evidex.sources import records


def questions(spark):
    return spark.createDataFrame([(1, "what causes stroke"), (2, "dm treatment with insulin"), (3, None)], "query_id int, query string")


def test_rules_without_a_model(spark):
    q = questions(spark).where("query_id < 3")
    got = {r.query_id: r for r in understand.rewrite(q).collect()}
    assert got[2].rewritten == "diabetes mellitus treatment with insulin" and got[2].intent == "therapeutic" and got[1].intent == "diagnostic"
    subs = [(r.query_id, r.sub_id) for r in understand.decompose(q).orderBy("query_id", "sub_id").collect()]
    assert subs == [(1, "q5"), (1, "q6"), (2, "q1"), (2, "q2"), (2, "q3"), (2, "q5"), (2, "q6")]


def test_a_model_is_used_and_falls_back(spark):
    def answers(prompt):
        return F.when(prompt.contains("stroke"), F.lit('Sure: {"rewritten_query": "aetiology of stroke", "intent": "diagnostic", "search_terms": ["stroke"]}')).otherwise(F.lit("no json"))

    got = {r.query_id: (r.rewritten, r.terms) for r in understand.rewrite(questions(spark).where("query_id < 3"), answers).collect()}
    assert got == {1: ("aetiology of stroke", ["stroke"]), 2: ("diabetes mellitus treatment with insulin", ["diabetes mellitus"])}
    texts = {r.query_id: r.dense_text for r in understand.search_text(questions(spark), lambda p: F.lit("passage")).collect()}
    assert texts == {1: "passage", 2: "dm treatment with insulin", 3: None}


def test_cache_expires_and_forgets_case(spark):
    now = dt.datetime(2024, 1, 1, 12)
    key = lambda s: cache.cache_key("a", "1", "hits", F.lit(s), F.lit("{}"))
    assert spark.range(1).select(key(" Stroke ") == key("stroke")).first()[0]
    held = spark.createDataFrame([("k1", "v1", now + dt.timedelta(1)), ("k2", "v2", now)], "key string, value string, expires_at timestamp")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    known, unknown = cache.split_known(asked, held, F.lit(now))
    assert [r.key for r in known.collect()] == ["k1"] and sorted(r.key for r in unknown.collect()) == ["k2", "k3"]
    after = cache.stored(held, spark.createDataFrame([("k3", "v3")], "key string, value string"), F.lit(now))
    assert sorted(r.key for r in after.collect()) == ["k1", "k3"]


def test_vectors_must_match_chunks(spark):
    chunks = spark.createDataFrame([("a", "x")], "chunk_id string, text string")
    dense, sparse = spark.createDataFrame([("a", [1.0])], "chunk_id string, vector array<double>"), spark.createDataFrame([("a", {1: 0.5})], "chunk_id string, sparse map<int,double>")
    assert zip_vectors(chunks, dense, sparse).count() == 1
    with pytest.raises(Exception, match="do not match"):
        zip_vectors(chunks, dense.limit(0), sparse).collect()


def test_finished_runs(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, t + dt.timedelta(seconds=90.25), None), ("b", t, None, None), ("c", t, None, "boom")]
    got = {r.run_id: (r.status, r.duration_seconds) for r in finished(spark.createDataFrame(rows, "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string")).collect()}
    assert got == {"a": ("completed", 90.3), "b": ("running", None), "c": ("failed", None)}


def test_model_contradictions(spark):
    rows = [(1, 1, "Aspirin therapy", "good"), (1, 2, "Therapy options", "bad"), (1, 3, "Other", "bad")]
    chunks = spark.createDataFrame(rows, "query_id int, id int, title string, text string")
    got = understand.model_contradictions(chunks, lambda a, b: F.when(a != b, "contradiction").otherwise("entailment")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_pmc_and_cochrane(spark, tmp_path):
    article = '<article><front><article-meta><article-id pub-id-type="pmc">7</article-id><title-group><article-title>T</article-title></title-group><abstract><p>One.</p><p>Two.</p></abstract><pub-date><year>2012</year></pub-date></article-meta></front></article>'
    (tmp_path / "p.xml").write_text(f"<articles>{article}<article><front><article-meta><title-group><article-title>No abstract</article-title></title-group></article-meta></front></article></articles>")
    got = records.pmc_xml(spark, str(tmp_path / "p.xml")).collect()
    assert [(r.title, r.content, r.year, r.doi) for r in got] == [("T", "One. Two.", 2012, "PMC:7")]
    one = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><Journal><Title>{1}</Title></Journal><ArticleTitle>A</ArticleTitle><Abstract><AbstractText>B</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "c.xml").write_text("<PubmedArticleSet>" + one.format(1, "Cochrane Database Syst Rev") + one.format(2, "Other") + "</PubmedArticleSet>")
    assert [r.pmid for r in records.cochrane_xml(spark, str(tmp_path / "c.xml")).collect()] == ["1"]
