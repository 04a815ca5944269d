import pytest

from evidex.llm.mixing import mix
from evidex.llm.truncation import truncated, truncation_rates


def _documents():
    texts = ["one two three four five " * (1 + i % 7) for i in range(300)]
    rows = [(i, "big" if i % 3 else "mid", t) for i, t in enumerate(texts)] + [(1000, "tiny", "a few words"), (1001, None, "no source"), (1002, "big", None), (1003, "big", "")]
    return [(*r, 9) for r in rows]


def test_mix_meets_targets_within_caps(spark):
    docs = spark.createDataFrame(_documents(), "doc_id long, source string, text string, copies int")
    targets = spark.createDataFrame([("big", 1.0, 2), ("mid", 1.0, 3), ("tiny", 1.0, 4), ("none", 1.0, 5), (None, 3.0, 1)], "source string, target_weight double, max_repeats int")
    copies, report = mix(docs, targets)
    rep = {r["source"]: r for r in report.collect()}
    assert {s for s, r in rep.items() if r["short"]} == {"tiny", "none"}
    assert rep["none"]["tokens"] == 0 and rep["tiny"]["mixed"] == 4 * rep["tiny"]["tokens"]
    total = sum(r.tokens for r in copies.collect()) + 2  # the document without a source has two tokens
    for s in ("big", "mid"):
        largest = max(r.tokens for r in copies.where(f"source = '{s}'").collect())
        assert abs(rep[s]["mixed"] - total / 4) <= largest
        assert rep[s]["of_all"] == pytest.approx(0.25, abs=largest / total) and rep[s]["attainable"] > 0.25
        exact = sum(r.rate * r.tokens for r in copies.where(f"source = '{s}'").collect())
        assert exact == pytest.approx(total / 4, rel=1e-6)
    caps = {"big": 2, "mid": 3, "tiny": 4}
    assert all(0 <= r.copies <= caps[r.source] for r in copies.collect())
    assert sum(r["reached"] for r in rep.values()) == pytest.approx(1)


def test_mix_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    copies, report = mix(docs, targets)
    assert copies.count() == 0 and [r["mixed"] for r in report.collect()] == [0]
    assert mix(docs, targets.limit(0))[1].count() == 0


def _cut_rows():
    heads = ["The council met in spring", "A committee reviewed the plan", "Many visitors praised the garden", "The river rose in autumn"]
    tails = ["and approved the annual budget", "after a long public debate", "because the weather was mild", "with help from the local school"]
    full = [f"{h} {t}" for h in heads for t in tails]
    rows = []
    for i in range(200):
        body = ". ".join(full[(i + k * 5) % 16] for k in range(4))
        rows.append((i, f"s{i % 4}", body + "."))
    cut = {500: "long publ", 501: "after a long", 502: "the ann…", 503: "because the [...]", 504: "with help from the lo..."}
    for i, tail in cut.items():
        rows.append((i, "s1", f"{full[3]}. The council met in spring {tail}"))
    for i in range(30):
        rows.append((600 + i, "s2", f"{full[i % 16]}.\nKeywords: garden, river, {('council', 'school', 'spring')[i % 3]}"))
    rows += [(700, "s3", full[5]), (701, "s3", None), (702, "s3", ""), (703, None, " \n "), (704, "s3", full[5])]
    return [(*r, 1) for r in rows], set(cut)


def test_cut_texts_are_found(spark):
    rows, cut = _cut_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n int")
    assert {r.doc_id for r in truncated(df).collect()} == cut
    rates = {r["source"]: r for r in truncation_rates(df).collect()}
    assert rates["s1"]["cut"] == 5 and rates["s2"]["cut"] == 0
    assert truncated(df.limit(0)).count() == 0
