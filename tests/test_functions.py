from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.functions import classify, scoring, text, vectors


def one(spark, *columns, row=("x",), schema="c string"):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_hash_ignores_case_and_blanks(spark):
    a = one(spark, text.content_hash(F.lit("  Hello   World  ")), text.content_hash(F.lit("hello world")))
    assert a[0] == a[1] and a[0].startswith("b94d27b9934d3e08") and len(a[0]) == 64


def test_title_norm_and_token_estimates(spark):
    got = one(spark, text.title_norm(F.lit("COVID-19: treatment.")), text.word_tokens(F.lit("")), text.word_tokens(F.lit("hello")), text.word_tokens(F.lit("word " * 100)), text.length_tokens(F.lit("")), text.length_tokens(F.lit(None)))
    assert got == ("covid19 treatment", 0, 1, 130, 1, 1)


def test_three_gram_similarity(spark):
    def sim(a, b):
        x, y = text.shingles3(F.lit(a)), text.shingles3(F.lit(b))
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

    got = one(spark, sim("management of hypertension in adults", "management of hypertension in adult patients"), F.size(text.shingles3(F.lit("ab"))))
    assert abs(got[0] - 33 / 42) < 1e-9 and got[1] == 0


def test_garble(spark):
    assert one(spark, text.garble(F.lit("")), text.garble(F.lit("abc\n")), text.garble(F.lit("a\x80\x81b")), text.garble(F.lit(None))) == (1.0, 0.0, 0.5, 1.0)


def test_buckets_are_stable(spark):
    assert one(spark, text.bucket(F.lit("metformin"), 50_000)) == (40317,)


def test_quality_golden_values(spark):
    q = lambda words, kind, level, tokens, entities, safety: scoring.quality(F.lit(words), F.lit(kind), F.lit(level), F.lit(tokens), F.lit(entities), F.lit(safety))
    got = one(spark, q("dose of 5", "clinical", 1, 50, 3, False), q("10 mg", "noise", 5, 20, 0, False), q("therapy", "background", 3, 100, 0, False))
    assert got == (1.0, 0.06, 0.57)


def test_confidence_and_verdict(spark):
    bad = scoring.verdict(F.lit(0.1), F.lit(False), F.lit(3), F.lit(3), F.lit(False), F.lit(0.9), F.lit(0))
    fine = scoring.verdict(F.lit(0.1), F.lit(True), F.lit(3), F.lit(3), F.lit(False), F.lit(0.9), F.lit(0))
    sure = scoring.confidence(F.lit(8), F.lit(1.0), F.lit(8), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(False))
    assert one(spark, bad, fine, sure) == ("UNSAFE", "SAFE", 1.0)


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    got = one(spark, vectors.cosine(a, b), vectors.cosine(a, zero))
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] == 0.0


def test_evidence_levels(spark):
    levels = [classify.evidence_number(F.lit(v)) for v in ("1a", "2b", "7", "0", "unknown", None, "4")]
    assert one(spark, *levels) == (1, 2, 5, 1, 3, 3, 4)


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=80))
def test_expressions_hold_for_any_text(spark, s):
    got = one(spark, text.garble(F.col("c")), F.size(text.sentences(F.col("c"))), F.size(text.clinical_tokens(F.col("c"))), text.max_year(F.col("c")), row=(s.replace("\x00", ""),))
    assert 0 <= got[0] <= 1 and got[1] >= 0 and got[2] >= 0 and (got[3] == 0 or 1900 <= got[3] <= 2099)
