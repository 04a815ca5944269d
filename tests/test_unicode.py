"""Text of any script, against brute force in Python; the comparison SQL reads every character outside ASCII as ``~``."""

import hashlib
import re

from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions import text
from evidex.operators import merge
from evidex.plans.expressions import content_hash
from evidex.plans.merging import dedupe_exact

TEXTS = [
    "维亚平治疗贫血的2012年研究", "维亚平治疗贫血的2013年研究", "Réduction de l'infirmité: étude №5", "Уменьшение боли\u00a0— обзор", "Уменьшение боли - обзор.", "高血圧の治療", "การรักษา โรค", "مرض السكري", "हिन्दी में अध्ययन",
    "  COVID-19:\ttreatment. ", "a\u3000b\x1cc _d_", "", "~~", "Crítica reducción filtered ältere x-ray- abc", "abc-é abcé éabc cafe\u0301 cafes", "İstanbul ΣΑΣ ＡＢＣ abc", None,
]


def _column(spark, build):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, c string").select("i", build(F.col("c")).alias("v")).orderBy("i")
    return [r.v for r in rows.collect()]


def _title(s):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (s or "").lower())).strip()


def test_titles_of_any_script(spark):
    assert _column(spark, text.title_norm) == [_title(s) for s in TEXTS]


def test_title_pairs_of_any_script(spark):
    titles = [*filter(None, TEXTS), "维亚平治疗贫血的2012年研究.", "高血圧の治療と予防について", "高血圧の治療と予防についての", "गर्भावस्था में मधुमेह का उपचार", "गर्भावस्था में मधुमेह के उपचार"]
    got = {(r.title_a, r.title_b, round(r.similarity, 9)) for r in merge.title_duplicates(spark.createDataFrame([("who", t) for t in titles], "source_type string, title string"), 0.6).collect()}
    names = sorted({_title(t) for t in titles})
    grams = {t: {t[i : i + 3] for i in range(len(t) - 2)} for t in names}
    want = {(a, b, round(s, 9)) for a in names for b in names if a < b and grams[a] and grams[b] and (s := len(grams[a] & grams[b]) / len(grams[a] | grams[b])) >= 0.6}
    assert len(want) == 2 and got == want


def _hash(s):
    return hashlib.sha256(re.sub(r"\s+", " ", (s or "").strip().lower()).encode()).hexdigest()


def test_hashes_of_any_script(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "record_id long, content string").coalesce(1).write.parquet(f"{tmp_path}/doc_records.parquet")
    assert {r.record_id: r.hash for r in content_hash(spark, str(tmp_path)).collect()} == {i: _hash(s) for i, s in enumerate(TEXTS)}


def test_contents_that_differ_in_letters_are_no_duplicates(spark, tmp_path):
    rows = [*TEXTS, "  高血圧の\u3000治療", "高血圧の 治療", "低血圧の 治療"]
    spark.createDataFrame(list(enumerate(rows)), "record_id long, content string").coalesce(1).write.parquet(f"{tmp_path}/doc_records.parquet")
    first: dict = {}
    want = {}
    for i, s in enumerate(rows):
        want[i] = None if not (s or "").strip() or first.setdefault(_hash(s), i) == i else first[_hash(s)]
    assert len([v for v in want.values() if v is not None]) == 1
    assert {r.record_id: r.duplicate_of for r in dedupe_exact(spark, str(tmp_path)).collect()} == want


def _tokens(s):
    lower, found = (s or "").lower(), []
    for c in L.COMPOUNDS:
        if c in lower:
            lower = lower.replace(c, f" {c.replace(' ', '_')} ")
            found.append(c.replace(" ", "_"))
    return found + [w for w in re.findall(r"\b[a-z][a-z0-9\-]{2,}\b", lower) if w not in L.STOP_WORDS]


def test_terms_of_any_script(spark):
    assert _column(spark, text.clinical_tokens) == [_tokens(s) for s in TEXTS]
