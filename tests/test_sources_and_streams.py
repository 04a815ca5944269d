import json

from pyspark.sql import functions as F

from evidex.engine import Engine
from evidex.models import HashEmbedder, OverlapScorer, embed_udf, generate_udf, score_udf
from evidex.schemas import EVENT
from evidex.sources import records
from evidex.sources.pages import PageSource
from evidex.streaming import ingest

ARTICLES = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 Dec</MedlineDate></PubDate></JournalIssue><ISOAbbreviation>J Test</ISOAbbreviation></Journal>
<ArticleTitle>First</ArticleTitle><Abstract><AbstractText Label="A">One.</AbstractText><AbstractText>Two.</AbstractText></Abstract><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author></AuthorList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D1">Sleep</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">13</PMID><Article></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_pubmed_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLES)
    got = {r.doc_id: r for r in records.pubmed_xml(spark, str(tmp_path / "a.xml")).collect()}
    assert set(got) == {"pmid_11", "pmid_12"}
    a = got["pmid_11"]
    assert (a.abstract, a.content, a.year, a.journal, a.doi, a.authors, a.mesh_terms) == ("One. Two.", "First\n\nOne. Two.", 1998, "J Test", "10.1/x", ["Lee Ann"], ["Sleep"])
    assert got["pmid_12"].year == 0 and got["pmid_12"].content == "No abstract"


def test_scan_and_parser_routing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.xml", "sub/b.pdf", "c.txt"):
        (tmp_path / name).write_text("x")
    found = records.scan(spark, str(tmp_path)).select("suffix", records.parser_of(F.col("suffix"), F.lit("icmr"), F.lit(False)).alias("p")).collect()
    assert sorted(map(tuple, found)) == [("pdf", "pdf_tables"), ("xml", "pubmed_xml")]


def test_service_items(spark, tmp_path):
    who = [{"name": "N", "handle": "1/2", "metadata": [{"key": "dc.description", "value": "Text"}, {"key": "dc.date", "value": "in 2019"}]}, {"name": "No text", "metadata": []}]
    cdc = [{"title": "T", "description": "D", "datePublished": "May 2020", "sourceUrl": ""}, {"title": "T"}]
    for name, rows in (("who", who), ("cdc", cdc)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    w = records.who_items(spark, str(tmp_path / "who.json")).collect()
    assert [(r.title, r.content, r.year, r.url) for r in w] == [("N", "Text", 2019, "https://iris.who.int/handle/1/2")]
    c = records.cdc_items(spark, str(tmp_path / "cdc.json")).collect()
    assert [(r.title, r.year, r.url, r.doc_id[:4]) for r in c] == [("T", 2020, None, "doc_")]


def test_tei_and_pages(spark):
    xml = '<TEI xmlns="http://x"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt><publicationStmt><date when="2011-02"/></publicationStmt></fileDesc><profileDesc><abstract><p>Abs</p></abstract></profileDesc></teiHeader><text><body><div><head>One</head><p>a</p><p>b</p></div><div><head>Two</head><p>c</p></div></body></text></TEI>'
    r = records.tei(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.title, r.year, [(s.title, s.text) for s in r.sections]) == ("T", 2011, [("One", "a b"), ("Two", "c")]) and r.content.startswith("Abstract\nAbs\n\nOne\na b")
    pages = spark.createDataFrame([(["", None, "x" * 40],), (["x" * 60],)], "p array<string>").select(records.is_scanned(F.col("p")), records.kept_pages(F.col("p"))).collect()
    assert [tuple(p) for p in pages] == [(True, "x" * 40), (False, "x" * 60)]


def test_page_source_isolates_errors(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"results": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "2.json").write_text("broken")
    spark.dataSource.register(PageSource)
    got = spark.read.format("evidex_pages").option("wait", "0").load(str(tmp_path / "*.json")).collect()
    assert sorted(r.item or "" for r in got) == ["", '{"a": 1}', '{"a": 2}'] and sum(r.error is not None for r in got) == 1


def test_models(spark):
    df = spark.createDataFrame([("a b", "b c"), (None, None)], "q string, t string")
    got = df.select(embed_udf(lambda: HashEmbedder(8))("q").alias("e"), score_udf(OverlapScorer)("q", "t").alias("s")).collect()
    assert len(got[0].e) == 8 and got[1].e is None and got[0].s == 0.5 and got[1].s == 0.0

    class Broken:
        def generate(self, prompts):
            raise RuntimeError

    assert [r[0] for r in df.select(F.coalesce(generate_udf(Broken)("q"), F.lit("rule"))).collect()] == ["rule", "rule"]


def test_upsert_stream_replayed(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "k int, v int, s string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    ingest.upsert_stream(stream(), out, "k", "v", ck).awaitTermination()
    spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], schema).write.mode("append").parquet(src)
    ingest.upsert_stream(stream(), out, "k", "v", ck).awaitTermination()
    want = [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    table = ingest.VersionedTable(spark, out)
    assert sorted(map(tuple, table.read().collect())) == want
    ingest.upsert_stream(stream(), out, "k", "v", str(tmp_path / "ck2")).awaitTermination()  # all again, from the start
    assert sorted(map(tuple, table.read().collect())) == want


def _events(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 6:02d}:{i % 60:02d}:00", i % 4, "ab"[i % 2], 1.5, "{}") for i in range(120)] + [(0, "2024-01-01 00:00:00", 0, "a", 1.5, "{}"), (999, "2024-01-09 00:00:00", 9, "z", 0.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema(EVENT).parquet(str(tmp_path / "events"))


def _run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_windows_sessions_and_state(spark, tmp_path):
    stream = _events(spark, tmp_path)
    got = _run(spark, ingest.windowed_counts(ingest.once_by_id(stream), late=None), "w")
    assert sum(r.n for r in got) == 120 and {r.event_type for r in got} == {"a", "b"}
    assert sum(r.n for r in _run(spark, ingest.sessions(stream), "s")) == 121
    totals = {r.user_id: (r.n, r.total) for r in _run(spark, ingest.running_totals(stream), "t", "update")}
    assert totals[0] == (31, 46.5) and totals[9] == (1, 0.0)


def test_engine_end_to_end(spark, tmp_path):
    body = "Metformin is the first treatment of diabetes in adults. The dose is 500 mg twice daily with food. " * 8
    rows = [(f"d{i}", f"Guideline number {i}", body + f" Trial {i} of insulin {'and sleep ' * i}.", "who", 2020 + i, "J") for i in range(6)] + [("dup", "Guideline number 0", body + " Trial 0 of insulin .", "who", 2020, "J"), ("bad", "x", None, "who", None, None)]
    engine = Engine(spark, str(tmp_path / "index"))
    status = dict(map(tuple, engine.ingest(spark.createDataFrame(rows, "doc_id string, title string, content string, source_type string, year int, journal string"), "who").collect()))
    assert status["bad"] == "short title" and sorted(status.values()).count("duplicate") == 1
    asked = spark.createDataFrame([(1, "dose of metformin in diabetes"), (2, "insulin and sleep")], "query_id int, query string")
    hits = engine.search(asked, 3)
    found = hits.collect()
    assert {(r.query_id, r.pos) for r in found} == {(q, p) for q in (1, 2) for p in range(3)}
    assert all(r.year >= 2023 for r in engine.search(asked, 3, [("year", "gte", 2023)]).collect())
    assert engine.context(hits).where("context like '[1] Guideline%'").count() == 2
    assert [r.complexity for r in engine.route(asked).orderBy("query_id").collect()] == ["medium", "simple"]
