from evidex.llm.scanned import candidates, findings, furniture, repaired

BODY = """The council met in spring and approved the annual bud-
get after a long debate. Many visitors praised the well-
known garden near the river. A committee reviewed the

Page 1 of 2
The Norland Bulletin, Vol. 8
plan with care. The wea+her was mild and the councl1 was
pleased. Every tlie school opened in 2O14 again.
Page 2 of 2
The Norland Bulletin, Vol. 8"""


def _tables(spark):
    clean = [(f"The council met in spring and approved the annual budget {i}. The weather was mild and the well-known garden near the river pleased the visitors. The school opened again after the debate.",) for i in range(40)]
    rows = [(1, "A title", BODY, 7), (2, None, None, 7), (3, "", "", 7), (4, "T", "\n\n", 7), (5, "Long", "word " * 20000, 7)]
    return spark.createDataFrame(rows, "record_id long, title string, content string, pos int"), spark.createDataFrame(clean, "content string")


def test_findings(spark):
    found = {(r.record_id, r.line_no, r.kind) for r in findings(*_tables(spark)).collect()}
    assert found == {(1, n, "drop") for n in (5, 6, 9, 10)} | {(1, 1, "join"), (1, 7, "char"), (1, 8, "char")}


def test_repaired_paragraphs(spark):
    texts = {r.record_id: r.text for r in repaired(*_tables(spark)).collect()}
    assert texts[2] == texts[3] == texts[4] == "" and len(texts) == 5
    assert "annual budget after" in texts[1] and "well-known garden" in texts[1] and "reviewed the plan with care" in texts[1]
    assert "weather" in texts[1] and "the school" in texts[1] and "2014" in texts[1] and "Bulletin" not in texts[1]


def test_empty_tables(spark):
    scanned, clean = _tables(spark)
    assert findings(scanned.limit(0), clean).count() == 0
    assert findings(scanned, clean.limit(0)).where("kind = 'drop'").count() == 4


def test_title_at_the_head_is_kept_and_running_title_dropped():
    lines = ["Effect of a drug on sleep in adults", "", "Some text that runs over", "several lines of", "3    EFFECT OF A DRUG ON SLEEP IN AD", "the page."]
    assert furniture(lines, "Effect of a drug on sleep in adults") == {4}


def test_candidates_undo_confusions():
    assert "noted" in candidates("notecl") and "after" in candidates("af+er") and "blind" not in candidates("house")
    assert "witness" in candidates("w!tne5s")
