"""Understanding of questions where a model may help: its answer if it gives a usable one, else the rule's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import classify as C
from evidex.functions import lexicons as L
from evidex.functions import text
from evidex.operators.checks import contradictions

_REWRITE = "struct<rewritten_query:string,intent:string,search_terms:array<string>>"
_SUB = "array<struct<sub_id:string,sub_query:string,focus:string,priority:int,source_filter:string>>"


def parsed(answer: Column, schema: str) -> Column:
    """A model's JSON answer, with what stands around the braces cut off; null if it cannot be read."""
    bare = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)([\{\[].*[\}\]])", 1)
    return F.from_json(F.nullif(bare, F.lit("")), schema, {"mode": "PERMISSIVE"})


def rewrite(queries: DataFrame, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, query, rewritten, intent, terms) of ``queries`` (query_id, query)."""
    q = F.col("query")
    made = parsed(generate(F.concat(F.lit("Rewrite the question for a search in medical literature. Answer in JSON with rewritten_query, intent, search_terms. Question: "), q)), _REWRITE) if generate else F.lit(None).cast(_REWRITE)
    rows = queries.withColumn("_m", made)
    model = F.nullif(F.trim(F.col("_m.rewritten_query")), F.lit("")).isNotNull()
    return rows.select(
        "query_id", "query", F.when(model, F.col("_m.rewritten_query")).otherwise(C.rewritten(q)).alias("rewritten"),
        F.when(model, F.coalesce("_m.intent", F.lit("general"))).otherwise(text.first_of(F.lower(q), L.REWRITE_INTENTS, "general")).alias("intent"),
        F.when(model, F.coalesce("_m.search_terms", F.array().cast("array<string>"))).otherwise(C.search_terms(q)).alias("terms"),
    )


def rule_parts(query: Column) -> Column:
    """Sub-queries of a question by rule."""
    lower = F.lower(query)
    made = []
    for name, lead, focus, priority, source, words in L.SUB_QUERIES:
        one = F.struct(F.lit(name).alias("sub_id"), F.concat(F.lit(lead), query).alias("sub_query"), F.lit(focus).alias("focus"), F.lit(priority).alias("priority"), F.lit(source).cast("string").alias("source_filter"))
        test = text.contains_any(lower, words) if words else F.lit(True)
        made.append(F.when(test | (C.query_intent(lower) == "therapeutic") if focus in ("treatment", "dosage") else test, one))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def decompose(queries: DataFrame, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, sub_id, sub_query, focus, priority, source_filter): at most six sub-queries of each question.

    A model's readable list is taken even if it is empty, as it may say that nothing is to be asked.
    """
    rule = rule_parts(F.col("query")).cast(_SUB)
    made = F.coalesce(parsed(generate(F.concat(F.lit("Split the question into sub-questions. Answer in a JSON list of sub_id, sub_query, focus, priority, source_filter. Question: "), "query")), _SUB), rule) if generate else rule
    return queries.select("query_id", F.explode(F.slice(made, 1, 6)).alias("s")).select("query_id", "s.*")


def search_text(queries: DataFrame, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, query, dense_text, sparse_text): what each list is searched with.

    For diagnostic and prognostic questions the dense list is searched with a hypothetical answer,
    where a model gives one; the sparse list always with the question and its expansions.
    """
    q = F.col("query")
    imagined = F.lit(None).cast("string")
    if generate:
        imagined = F.nullif(F.trim(generate(F.concat(F.lit("Write a short passage that answers: "), q))), F.lit(""))
    wanted = C.query_intent(F.lower(q)).isin("diagnostic", "prognostic")
    return queries.select("query_id", "query", F.when(wanted & imagined.isNotNull(), imagined).otherwise(q).alias("dense_text"), F.concat_ws(" ", q, F.array_join(C.expansions(F.lower(q)), " ")).alias("sparse_text"))


def model_contradictions(chunks: DataFrame, label: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, a, b): the pairs of contradictions() by topic that an NLI model labels a contradiction."""
    texts = chunks.select("query_id", "id", "text")
    topical = contradictions(chunks.withColumn("text", F.lit("safe unsafe"))).select("query_id", "a", "b").distinct()
    both = topical.join(texts.select("query_id", F.col("id").alias("a"), F.col("text").alias("ta")), ["query_id", "a"]).join(texts.select("query_id", F.col("id").alias("b"), F.col("text").alias("tb")), ["query_id", "b"])
    return both.where(label(F.col("ta"), F.col("tb")) == "contradiction").select("query_id", "a", "b")
