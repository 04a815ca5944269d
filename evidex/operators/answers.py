"""Answers checked as a whole: grounding, citations, safety, confidence, verdict; and what a deep search makes of its hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidex.functions import lexicons as L
from evidex.functions import scoring, text
from evidex.functions.vectors import cosine
from evidex.operators import checks
from evidex.operators.retrieve import first_ranks

SIMILAR = 0.45  # a sentence less similar to all evidence is doubtful


def sentences_of(answers: DataFrame) -> DataFrame:
    """(query_id, pos, sentence) of ``answers`` (query_id, answer)."""
    return answers.select("query_id", F.posexplode(text.answer_sentences(F.coalesce("answer", F.lit("")))).alias("pos", "sentence"))


def _words(df: DataFrame, *keys: str, of: str) -> DataFrame:
    """(keys, word, n, norm): word counts of a text and the length of their vector."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(of), F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)
    counts = df.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("norm", F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(*keys))))


def lexical_similarity(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, pos, similarity): the greatest cosine of word counts of a sentence to any chunk of its query; a stand-in for vectors of meaning.

    An equi-join on the words both hold, so that no sentence meets a chunk it has nothing in common with.
    """
    a = _words(sentences, "query_id", "pos", of="sentence")
    b = _words(chunks.where("text is not null"), "query_id", "id", of="text").withColumnsRenamed({"n": "m", "norm": "other"})
    met = a.join(b, ["query_id", "word"]).groupBy("query_id", "pos", "id").agg((F.sum(F.col("n") * F.col("m")) / F.first("norm") / F.first("other")).alias("s"))
    return met.groupBy("query_id", "pos").agg(F.round(F.max("s"), 9).alias("similarity"))


def embedded_similarity(embed: Callable[[Column], Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """As lexical_similarity by the vectors of a model: the short list of a query's chunks against its sentences."""

    def similarity(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
        a = sentences.select("query_id", "pos", embed(F.col("sentence")).alias("v"))
        b = chunks.where("text is not null").select("query_id", embed(F.col("text")).alias("w"))
        return a.join(b, "query_id").groupBy("query_id", "pos").agg(F.max(cosine(F.col("v"), F.col("w"))).alias("similarity"))

    return similarity


def grounding(answers: DataFrame, chunks: DataFrame, similarity: Callable[[DataFrame, DataFrame], DataFrame] = lexical_similarity) -> DataFrame:
    """(query_id, pos, sentence, similarity, weight, reason): how doubtful each sentence of an answer is, against the chunks of its query."""
    sentences = sentences_of(answers)
    names = lambda c, found: F.array_distinct(F.flatten(F.collect_list(found(text.plain(F.col(c))))))
    held = chunks.groupBy("query_id").agg(names("text", checks.named).alias("known_names"), names("text", lambda c: checks.numbers(F.lower(c))).alias("known_numbers"))
    rows = sentences.join(held, "query_id", "left").join(similarity(sentences, chunks), ["query_id", "pos"], "left")
    none = F.array().cast("array<string>")
    bare = text.plain(F.col("sentence"))
    missing = checks.ungrounded(bare, F.coalesce("known_names", none), F.coalesce("known_numbers", none))
    rows = rows.withColumns(missing).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    exempt = (F.length("sentence") < 20) | F.col("sentence").endswith(":")
    weight = checks.flag_weight(F.col("sentence"), F.col("names"), F.col("numbers"), F.col("similarity"))
    why = F.array(
        F.when(F.col("similarity") < SIMILAR, F.concat(F.lit("Low semantic similarity ("), F.format_string("%.2f", "similarity"), F.lit(")"))),
        F.when(F.size("names") > 1, F.concat(F.lit("Ungrounded entities: "), F.array_join(F.slice("names", 1, 3), ", "))),
        F.when(F.size("numbers") > 0, F.concat(F.lit("Unverified numbers: "), F.array_join("numbers", ", "))),
    )
    reason = F.when(exempt, "").otherwise(F.array_join(F.filter(why, lambda w: w.isNotNull()), "; "))
    return rows.select("query_id", "pos", "sentence", "similarity", weight.alias("weight"), reason.alias("reason"))


def validate_answers(answers: DataFrame, citations: DataFrame, chunks: DataFrame, now: int, similarity: Callable[[DataFrame, DataFrame], DataFrame] = lexical_similarity) -> DataFrame:
    """What is to be thought of each of ``answers`` (query_id, answer), one row each.

    ``citations`` (query_id, source_type, evidence_level, year, known) and ``chunks`` (query_id, id,
    text, score, quality_score, source_type) are the short lists of each query. Gives (query_id, risk,
    confidence, recommendation, is_safe, needs_disclaimer, unverified, warnings, issues, high_issues,
    valid, cited, grade_1 to grade_5). A null or empty answer is unsafe with confidence 0; one without
    chunks has risk 1, one without sentences 0; other columns are not read.
    """
    answers = answers.select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))
    flags = grounding(answers, chunks, similarity)
    flag = F.when(F.col("weight") > 0, F.struct("pos", F.substring("sentence", 1, 200).alias("text"), "reason", F.col("weight").alias("confidence")))
    doubt = flags.groupBy("query_id").agg(F.least(F.lit(1.0), F.sum("weight") / F.count("*")).alias("doubt"), F.sort_array(F.collect_list(flag)).alias("unverified"))
    clipped = F.coalesce(F.col("quality_score").cast("double"), F.least(F.greatest(F.coalesce("score", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)))
    behind = chunks.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(clipped).alias("quality"), F.countDistinct(F.coalesce("source_type", F.lit("unknown"))).alias("sources"), F.var_pop(F.coalesce("score", F.lit(0.5))).alias("variance"))
    cited = citations.withColumn("i", checks.citation_issues(F.col("source_type"), F.col("evidence_level"), F.col("year"), F.lit(now), F.col("known")))
    level = F.when(F.col("known"), F.coalesce("evidence_level", F.lit(3)))
    cited = cited.groupBy("query_id").agg(
        F.count("*").alias("cited"), F.count_if("known").alias("valid"), F.coalesce(F.avg(level), F.lit(3.0)).alias("average"), *[F.count_if(level == g).alias(f"grade_{g}") for g in range(1, 6)],
        F.sum(F.size("i")).alias("issues"), F.sum(F.size(F.filter("i", lambda x: x["severity"] == "HIGH"))).alias("high_issues"),
    )
    rows = answers.join(doubt, "query_id", "left").join(behind, "query_id", "left").join(cited, "query_id", "left")
    rows = rows.withColumn("warnings", checks.warnings(F.lower(text.plain(F.col("answer")))))
    counts = {c: 0 for c in ("n", "sources", "cited", "valid", "issues", "high_issues", *[f"grade_{g}" for g in range(1, 6)])}
    rows = rows.fillna({**counts, "variance": 0.0, "quality": 0.5, "average": 0.0})
    empty = F.col("answer") == ""
    rows = rows.withColumn("risk", F.when(empty, 0.0).when(F.col("n") == 0, 1.0).otherwise(F.coalesce("doubt", F.lit(0.0))))
    safe = checks.safety(F.col("warnings"))
    steady = scoring.consistency(F.col("sources"), F.col("variance"), F.col("n"))
    sure = scoring.confidence(F.col("cited"), F.col("average"), F.col("grade_1"), F.col("risk"), F.col("quality"), steady, F.size("warnings"), ~safe["is_safe"])
    rows = rows.withColumns({**safe, "confidence": F.when(empty, 0.0).otherwise(sure)})
    judged = scoring.verdict(F.col("risk"), F.col("is_safe"), F.col("valid"), F.col("cited"), F.col("needs_disclaimer"), F.col("confidence"), F.col("high_issues"))
    return rows.select(
        "query_id", "risk", "confidence", F.when(empty, "UNSAFE").otherwise(judged).alias("recommendation"), (F.col("is_safe") & ~empty).alias("is_safe"), "needs_disclaimer",
        F.coalesce("unverified", F.array().cast("array<struct<pos:int,text:string,reason:string,confidence:double>>")).alias("unverified"), "warnings", "issues", "high_issues", "valid", "cited", *[f"grade_{g}" for g in range(1, 6)],
    )


def enriched(responses: DataFrame, validated: DataFrame) -> DataFrame:
    """``responses`` (query_id, ...) with a column ``validation``, the JSON of what validate_answers() says; null where nothing is known."""
    grades = F.struct(*[f"grade_{g}" for g in range(1, 6)])
    bare = F.transform("unverified", lambda u: F.struct(u["text"].alias("text"), u["reason"].alias("reason"), u["confidence"].alias("confidence")))
    made = F.to_json(F.struct(F.col("confidence").alias("confidence_score"), "recommendation", bare.alias("unverified_claims"), F.col("warnings").alias("safety_warnings"), grades.alias("evidence_distribution"), "is_safe", "needs_disclaimer"))
    return responses.join(validated.select("query_id", made.alias("validation")), "query_id", "left")


def contradiction_report(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, has_contradictions, pairs, summary) of every query, of ``found`` as contradictions() gives them."""
    counts = found.groupBy("query_id").agg(F.count("*").alias("pairs"))
    pairs = F.coalesce("pairs", F.lit(0))
    summary = F.concat(F.lit("Found "), pairs.cast("string"), F.lit(" potential contradiction(s) in retrieved evidence. Please verify before clinical use."))
    return queries.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", (pairs > 0).alias("has_contradictions"), pairs.alias("pairs"), F.when(pairs > 0, summary).otherwise("").alias("summary"))


def dense_first(dense: DataFrame, sparse: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, id, score, rank) of two ranked lists: the dense one first, then what only the sparse one has, cut to ``k``."""
    return lists_in_turn(dense.select(*keys, F.lit(0).alias("of"), "id", "score", "rank").unionByName(sparse.select(*keys, F.lit(1).alias("of"), "id", "score", "rank")), k, *keys)


def lists_in_turn(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, id, score, rank) of ranked lists (keys, of, id, score, rank): those of the least ``of`` first, each id once, cut to ``k``."""
    once = hits.groupBy(*keys, "id").agg(F.min(F.struct("of", F.col("rank").alias("place"), "score")).alias("b")).select(*keys, "id", "b.*")
    return first_ranks(once, k, keys, "of", "place", "id").drop("of", "place")


def deep_confidence(subs: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, confidence) over ``subs`` (query_id, sub_id), their ``hits`` (query_id, sub_id, id) and contradictions ``found`` (query_id)."""
    parts = subs.groupBy("query_id").agg(F.count("*").alias("subs"))
    met = hits.groupBy("query_id").agg(F.countDistinct("sub_id").alias("good"), F.count("*").alias("hits"))
    against = found.groupBy("query_id").agg(F.count("*").alias("against"))
    rows = parts.join(met, "query_id", "left").join(against, "query_id", "left").fillna(0)
    raw = F.col("good") / F.col("subs") * 0.4 + F.least(F.lit(1.0), F.col("hits") / F.col("subs") / 5) * 0.6 - F.least(F.lit(0.3), 0.1 * F.col("against"))
    return rows.select("query_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6).alias("confidence"))


def synthesis_prompt(queries: DataFrame, hits: DataFrame, most: int = L.SYNTHESIS_MOST, cited: int = L.CITED_MOST) -> DataFrame:
    """(query_id, prompt, citations) of ``queries`` (query_id, query) and ``hits`` (query_id, pos, id, title, source_type, text, score).

    The prompt holds the question and snippets of 300 characters of the first ``most`` hits, numbered;
    citations (id, title, source, score) are the first ``cited``.
    """
    title, source = F.coalesce("title", F.lit("Untitled")), F.coalesce("source_type", F.lit("unknown"))
    part = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] Source: "), source, F.lit(", Title: "), title, F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 300))
    lists = hits.where(F.col("pos") < max(most, cited)).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part"), F.col("id").cast("string").alias("id"), title.alias("title"), source.alias("source"), "score"))).alias("h"))
    evidence = F.array_join(F.transform(F.slice("h", 1, most), lambda x: x["part"]), "\n\n")
    prompt = F.concat(F.lit("Answer the question from the numbered evidence alone, cite it by number, and name what contradicts.\n\nQuestion: "), F.coalesce("query", F.lit("")), F.lit("\n\nEvidence:\n"), F.coalesce(evidence, F.lit("")), F.lit("\n\nAnswer:"))
    citations = F.coalesce(F.transform(F.slice("h", 1, cited), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["source"].alias("source"), x["score"].alias("score"))), F.array().cast("array<struct<id:string,title:string,source:string,score:double>>"))
    return queries.join(lists, "query_id", "left").select("query_id", prompt.alias("prompt"), citations.alias("citations"))


def answer_sections(answer: Column) -> Column:
    """struct(summary, details, recommendations): the first 500 characters, all, and the last 300."""
    answer = F.coalesce(answer, F.lit(""))
    return F.struct(F.substring(answer, 1, 500).alias("summary"), answer.alias("details"), F.right(answer, F.lit(300)).alias("recommendations"))
