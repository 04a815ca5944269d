import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidex.__main__ import parser
from evidex.engine import Engine
from evidex.operators import answers, chunking
from evidex.operators import retrieve as R
from evidex.sources.files import documents_of_files
from evidex.sources.pulls import Pull, due, run_due
from evidex.store import coerced_points, open_store

NOW = 2026
EVIDENCE = "Metformin lowers glucose in adults with diabetes at a dose of 500 mg twice daily. The effect was seen in 40% of the patients after treatment."


def _case(spark, answer, chunks=((1, EVIDENCE, 0.9), (2, EVIDENCE, 0.9)), cited=(("pubmed", 1, 2024, True), ("who", 2, 2024, True), ("cochrane", 3, 2023, True))):
    said = spark.createDataFrame([(1, answer)], "query_id long, answer string")
    cites = spark.createDataFrame([(1, *c) for c in cited], "query_id long, source_type string, evidence_level int, year int, known boolean")
    held = spark.createDataFrame([(1, i, t, s, None, "pubmed") for i, t, s in chunks], "query_id long, id long, text string, score double, quality_score double, source_type string")
    return answers.validate_answers(said, cites, held, NOW).first()


def test_grounded_and_empty_and_dangerous_answers(spark):
    good = _case(spark, "Metformin lowers glucose in adults with diabetes in most of the patients after treatment.")
    assert good.risk == 0 and good.is_safe and good.valid == 3 and good.grade_1 == 1 and good.confidence >= 0.7
    empty = _case(spark, "")
    assert (empty.confidence, empty.recommendation, empty.is_safe, empty.risk) == (0.0, "UNSAFE", False, 0.0)
    assert _case(spark, None).recommendation == "UNSAFE"
    both = _case(spark, "Warfarin and aspirin can be given together to all of the patients.")
    assert not both.is_safe and both.recommendation == "UNSAFE" and any(w["severity"] == "HIGH" for w in both.warnings)


def test_risk_reaches_confidence_and_verdict(spark):
    wrong = _case(spark, "Zoromycin and Quelstatin cure Ebola within 17 days at 900 mg of weekly infusion.")
    assert wrong.risk == pytest.approx(1.0) and wrong.recommendation == "UNSAFE"
    assert "Low semantic similarity" in wrong.unverified[0]["reason"] and "Unverified numbers" in wrong.unverified[0]["reason"]
    assert _case(spark, "Metformin lowers glucose in adults with diabetes.", chunks=()).risk == 1.0
    lost = _case(spark, "Metformin lowers glucose in adults with diabetes.", cited=(("pubmed", 2, 2024, False), ("blog", 5, 2001, True)))
    assert lost.high_issues == 1 and lost.valid == 1 and lost.issues == 1 + 3 and lost.recommendation != "SAFE"
    none = _case(spark, "Metformin lowers glucose in adults with diabetes.", cited=())
    assert none.cited == 0 and none.valid == 0 and none.recommendation != "UNSAFE"


def test_responses_reports_prompts(spark):
    q = spark.createDataFrame([(1, "what?"), (2, "why?")], "query_id long, query string")
    found = spark.createDataFrame([(1, 5, 6, "safety", "a vs b")], "query_id long, a long, b long, kind string, evidence string")
    report = {r.query_id: r for r in answers.contradiction_report(q, found).collect()}
    assert report[1].has_contradictions and report[1].summary.startswith("Found 1 potential") and report[2].summary == "" and report[2].pairs == 0
    hits = spark.createDataFrame([(1, i, str(i), None if i else "T", "who", "x" * 400, 0.5) for i in range(25)], "query_id long, pos int, id string, title string, source_type string, text string, score double")
    made = {r.query_id: r for r in answers.synthesis_prompt(q, hits).collect()}
    assert "[20] Source: who, Title: Untitled\n" + "x" * 300 + "\n" in made[1].prompt and "[21]" not in made[1].prompt and len(made[1].citations) == 10
    assert made[2].citations == [] and "why?" in made[2].prompt
    cut = spark.createDataFrame([("a" * 900,), ("b",), (None,)], "a string").select(answers.answer_sections(F.col("a")).alias("s")).collect()
    assert [(len(r.s.summary), len(r.s.details), len(r.s.recommendations)) for r in cut] == [(500, 900, 300), (1, 1, 1), (0, 0, 0)]


def test_dense_hits_come_first(spark):
    schema = "query_id long, id long, score double, rank int"
    dense, sparse = spark.createDataFrame([(1, 7, 0.1, 0), (1, 8, 0.05, 1)], schema), spark.createDataFrame([(1, 8, 9.0, 0), (1, 9, 8.0, 1), (2, 9, 1.0, 0)], schema)
    got = [(r.query_id, r.id, r.rank) for r in answers.dense_first(dense, sparse, 3, "query_id").orderBy("query_id", "rank").collect()]
    assert got == [(1, 7, 0), (1, 8, 1), (1, 9, 2), (2, 9, 0)]
    assert answers.dense_first(dense, sparse, 2, "query_id").where("query_id = 1").count() == 2


def test_rerank_keeps_the_order_without_a_score(spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    hits = spark.createDataFrame([(1, i, "a " * i, i) for i in range(5)], "query_id long, id long, text string, rank int")
    assert [r.id for r in R.rerank(q, hits, lambda q, t: F.length(t).cast("double"), 3).orderBy("rank").collect()] == [4, 3, 2]
    assert [r.id for r in R.rerank(q, hits, lambda q, t: F.lit(None).cast("double"), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_given_sections_tables_and_terms(spark):
    table = ("Doses", ["Drug", ""], [["A", "1"], ["B", None]])
    sections = [("", "Short text.", None, True, [table, (None, None, [])]), ("Results", None, 4, False, [table])]
    rows = [("d", " Title ", "unused", "About.", ["m1", " "], ["k1", "k2"], sections, "who", "rct"), ("e", None, None, None, None, None, None, None, None)]
    schema = "doc_id string, title string, content string, abstract string, mesh_terms array<string>, keywords array<string>, sections array<struct<title:string,text:string,section_index:int,has_table:boolean,tables:array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>>>, source_type string, doc_type string"
    got = chunking.chunk_documents(spark.createDataFrame(rows, schema)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.chunk_type, r.section_title, r.text) for r in got] == [
        ("doc_summary", "Document Summary", "Title\n\nAbout.\n\nMeSH: m1\n\nKeywords: k1, k2"),
        ("table", "Section 1 - Table 1", "Doses\nDrug: A | Col2: 1\nDrug: B | Col2:"),
        ("paragraph", "Section 1", "Short text."),
    ]
    assert got[0].contextual_text.startswith("Source: who\nDocument type: rct\nTitle:  Title \nSection: Document Summary\n\nTitle")
    assert {r.total_chunks for r in got} == {3} and got[2].chunk_id == "d_c2"


def test_pipe_table(spark):
    rows = [([["a", "bb"], ["ccccc", None]],), ([["a", "b"]],), ([["a", "b"], ["", "x"], ["y"]],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<array<string>>").select(chunking.pipe_table(F.col("t"))).collect()]
    assert got == ["", "", "a    | b   \n-----+-----\n     | x   \ny    |     ", ""]


def test_store(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    with pytest.raises(ValueError):
        open_store(spark, str(tmp_path), "other")
    with pytest.raises(TypeError):
        coerced_points(spark.range(1))
    assert store.healthy() and not store.exists("c")
    store.ensure("c")
    assert store.points("c").count() == 0
    a = spark.createDataFrame([("p", [1.0, 0.0], {1: 2.0}, {"source": "who", "raw_text": "t"}), ("q", [0.0, 1.0], None, None), ("q", [0.0, 1.0], None, None)], "point_id string, dense_vector array<double>, sparse_vector map<int,double>, payload map<string,string>")
    assert store.upsert("c", a) == 2 and store.upsert("c", a) == 2
    b = spark.createDataFrame([(3, ([1.0, 1.0], ([1, 5], [1.0, 1.0])), {"chunk_id": "x", "vector": "no"})], "id long, vector struct<dense:array<float>,sparse:struct<indices:array<int>,values:array<double>>>, payload map<string,string>")
    assert store.upsert("c", b) == 3
    dense = store.search_dense("c", spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vector array<double>"), 2).orderBy("rank").collect()
    assert [(r.point_id, r.chunk_id, r.text) for r in dense] == [("p", "p", "t"), ("3", "x", "")] and "vector" not in dense[1].payload
    sparse = store.search_sparse("c", spark.createDataFrame([(1, {1: 1.0})], "query_id long, sparse map<int,double>"), 5).orderBy("rank").collect()
    assert [(r.point_id, r.score) for r in sparse] == [("p", 2.0), ("3", 1.0)]
    only = store.search_dense("c", spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vector array<double>"), 5, [("source", "eq", "who")])
    assert [r.point_id for r in only.collect()] == ["p"]
    store.ensure("c", recreate=True)
    assert store.points("c").count() == 0
    store.drop("c")
    assert not store.exists("c")
    with pytest.raises(KeyError):
        store.points("c")


def test_files_go_to_their_readers(spark, tmp_path):
    (tmp_path / "a_guide.pdf").write_bytes(b"good")
    (tmp_path / "scan.PDF").write_bytes(b"scan")
    (tmp_path / "bad.pdf").write_bytes(b"bad")
    (tmp_path / "x.xml").write_text("<r><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle></r>")

    def extract(data):
        if data == b"bad":
            raise ValueError("broken")
        return [("", [])] if data == b"scan" else [("Page one. " * 10, [[["a", "b"], ["c", "d"]], [["one"]]])]

    found, failures = documents_of_files(spark, str(tmp_path), "icmr", extract, lambda data: ["text that was recognised on a page", "short"], batch=1)
    docs = {r.title: r for r in found.collect()}
    assert set(docs) == {"a guide", "scan", "T"} and docs["T"].doc_id == "pmid_5" and docs["scan"].content == "text that was recognised on a page"
    assert docs["a guide"].content == ("Page one. " * 10).strip() + "\n\n[TABLE]\na    | b   \n-----+-----\nc    | d   \n[/TABLE]"
    assert [r.error for r in failures.collect()] == ["ValueError: broken"]
    assert documents_of_files(spark, str(tmp_path), "icmr")[1].count() == 3


def test_pulls(spark):
    now, day, calls = dt.datetime(2024, 1, 2), dt.timedelta(1), []

    def read(query):
        if query == "fails":
            raise OSError("away")
        return spark.createDataFrame([(query, "t", "c")], "doc_id string, title string, content string")

    pulls = [Pull("a", day, read, ("x", "y")), Pull("b", day, read, ("x", "fails")), Pull("c", day, read, ("fails",)), Pull("d", day, read, ("x",))]
    last = {"a": now - day, "d": now - day / 2}
    assert [p.source for p in due(pulls, last, now)] == ["a", "b", "c"]
    got = run_due(pulls, last, now, lambda df, source: calls.append((source, df.count())))
    assert got == {"a": "completed", "b": "partial", "c": "failed"} and calls == [("a", 2), ("b", 1)]


def test_engine_takes_further_documents(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), buckets=4, scorer=None)
    text = lambda w: f"The {w} trial treated hypertension in adults with amlodipine. " * 12
    docs = lambda *rows: spark.createDataFrame([(i, f"Trial of {w}", text(w), 2024) for i, w in rows], "doc_id string, title string, content string, year int")
    assert {r.doc_id: r.status for r in engine.ingest(docs(("a", "first"), ("b", "second")), "pubmed").collect()} == {"a": "stored", "b": "stored"}
    again = {r.doc_id: r.status for r in engine.ingest(docs(("a", "first"), ("b", "changed"), ("c", "first"), ("d", "fourth")), "pubmed").collect()}
    assert again == {"a": "unchanged", "b": "stored", "c": "duplicate", "d": "stored"}
    assert sorted(r.doc_id for r in engine._table("documents").collect()) == ["a", "b", "d"]
    assert "changed" in engine._table("chunks").where("doc_id = 'b' and chunk_type = 'paragraph'").first().text
    runs = engine.runs().orderBy("started_at").collect()
    assert [(r.documents_fetched, r.documents_stored, r.documents_skipped_duplicate) for r in runs] == [(2, 2, 0), (4, 2, 2)]
    asked = spark.createDataFrame([(1, "treatment of hypertension with amlodipine versus others"), (2, " ")], "query_id long, query string")
    deep = {r.query_id: r for r in engine.deep_search(asked, 3).collect()}
    assert deep[1].confidence > 0.5 and deep[1].citations and deep[1].sub_queries and deep[2].confidence == 0
    hits = engine.search(asked.where("query_id = 1"), 3)
    said = asked.where("query_id = 1").select("query_id", F.lit("The first trial treated hypertension in adults with amlodipine.").alias("answer"))
    assert engine.validate(said, hits, NOW).first().valid >= 1
    now = dt.datetime(2024, 1, 1)
    first = engine.cached_search(asked.where("query_id = 1"), now, top_k=2).collect()
    assert sorted(first) == sorted(engine.cached_search(asked.where("query_id = 1"), now + dt.timedelta(minutes=5), top_k=2).collect()) and len(first) == 2
    state = engine.health()
    assert state["healthy"] and state["documents"] == 3


def test_command_line():
    args = parser().parse_args(["--path", "p", "ingest", "--dir", "d", "--source", "who", "--recreate"])
    assert (args.dir, args.source, args.recreate, args.batch_size) == ("d", "who", True, 10)
    with pytest.raises(SystemExit):
        parser().parse_args(["--path", "p", "other"])
