"""The facade: ingest documents, search and route batches of questions."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidex.functions import classify as C
from evidex.functions import lexicons as L
from evidex.functions import text
from evidex.models import Embedder, HashEmbedder, Scorer, embed_udf, score_udf
from evidex.operators import answers, cache, checks, chunking, merge, understand
from evidex.operators import retrieve as R
from evidex.operators.payload import payload
from evidex.operators.validate import validate_chunks, validate_documents
from evidex.runtime import materialize
from evidex.schemas import DOCUMENT
from evidex.streaming.ingest import VersionedTable

RUN = (
    "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, source_type string, documents_fetched bigint, documents_stored bigint, documents_skipped_duplicate bigint, documents_failed_validation bigint, "
    "chunks_created bigint, chunks_embedded bigint, chunks_skipped_noise bigint, chunks_skipped_quality bigint, chunks_failed_validation bigint, embedding_errors bigint, duration_seconds double, status string, error_message string"
)


class Engine:
    """Documents, chunks with vectors, postings and runs as tables below ``path``; every method takes many rows at once.

    ``embedder`` makes the model on a worker; the default is a stand-in without meaning. ``scorer``
    reorders hits, ``generate`` (a function of a prompt column) imagines answers for the dense list and
    splits questions; without them the rules alone are used. Tables are partitioned by a bucket of
    the document's key: an ingestion rewrites the buckets it touches and no others.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[], Embedder] = HashEmbedder, scorer: Callable[[], Scorer] | None = None, generate: Callable[[Column], Column] | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._embed, self._score, self._generate = embed_udf(embedder), score_udf(scorer) if scorer else None, generate

    def _path(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _has(self, name: str) -> bool:
        fs, where = self._path(name)
        return fs.exists(where)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _merge(self, name: str, rows: DataFrame, gone: DataFrame) -> None:
        """Puts ``rows`` in place of those of the documents ``gone`` (doc_id), in the buckets these fall in."""
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket)
        if self._has(name):
            touched = [r[0] for r in gone.select(bucket.alias("b")).distinct().collect()]  # at most one row per bucket
            kept = self._table(name).where(F.col("bucket").isin(touched)).join(gone, "doc_id", "left_anti")
            rows = materialize(kept.unionByName(rows, allowMissingColumns=True), name)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def ingest(self, documents: DataFrame, source: str, recreate: bool = False) -> DataFrame:
        """Validates, deduplicates, enriches, chunks and indexes ``documents`` as in schemas.DOCUMENT; only doc_id, title and content must be there.

        Returns (doc_id, status): stored, unchanged, duplicate, no_chunks, or the reason of rejection.
        Of an id that comes twice the last counts; a document known before is replaced, or left alone
        where title and content are the same. Content that an earlier document has under another id
        is a duplicate. Counts of the run are kept, see runs(); ``recreate`` drops what is indexed.
        """
        started = datetime.now(timezone.utc).replace(tzinfo=None)
        if recreate:
            for name in ("documents", "chunks", "postings"):
                fs, where = self._path(name)
                fs.delete(where, True)
        kinds = {n: t for n, t in DOCUMENT.items()}
        rows = documents.select(*[(F.col(n) if n in documents.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
        rows = rows.withColumn("source_type", F.coalesce("source_type", F.lit(source))).withColumn("hash", text.short_hash(F.col("title"), F.col("content")))
        fetched = rows.count()
        rows = materialize(validate_documents(merge.latest(rows, "doc_id", "year")), "validated")
        fit = rows.where("ok")
        known = self._table("documents").select("doc_id", "hash", "content_hash") if self._has("documents") else None
        copies = merge.exact_duplicates(fit, "doc_id", "content").select("doc_id", F.col("hash").alias("content_hash"), "duplicate_of")
        found = fit.select("doc_id", "hash").join(copies, "doc_id")
        if known is not None:
            held = known.groupBy("content_hash").agg(F.min("doc_id").alias("holder"))
            found = found.join(known.select("doc_id", F.col("hash").alias("old")), "doc_id", "left").join(held, "content_hash", "left")
            found = found.withColumn("duplicate_of", F.when(F.col("old").isNull(), F.coalesce("holder", "duplicate_of")).otherwise(F.col("duplicate_of")))
        else:
            found = found.withColumn("old", F.lit(None).cast("string"))
        verdict = F.when(F.col("old") == F.col("hash"), "unchanged").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("stored")
        found = materialize(found.select("doc_id", "content_hash", verdict.alias("status")), "found")
        kept = fit.join(found.where("status = 'stored'").select("doc_id", "content_hash"), "doc_id")
        t = F.lower(F.concat(text.plain(F.col("title")), F.lit(" "), text.plain(F.col("content"))))
        kept = materialize(kept.withColumn("t", t).withColumn("doc_type", C.doc_type(F.col("t"))).drop("ok", "reason"), "kept")
        made = materialize(chunking.chunk_documents(kept), "made")
        judged = validate_chunks(made)
        good = judged.where("ok").drop("ok", "reason")
        details = payload(good, kept).drop("doc_id", "chunk_type", "section_title", "chunk_index", "total_chunks")
        indexed = materialize(good.join(details, "chunk_id").withColumn("vector", self._embed("contextual_text")), "indexed")
        gone = kept.select("doc_id")
        self._merge("documents", kept.drop("t"), gone)
        self._merge("chunks", indexed, gone)
        postings = R.sparse_vectors(indexed, "chunk_id", "text").withColumnRenamed("chunk_id", "id").join(indexed.select(F.col("chunk_id").alias("id"), "doc_id"), "id")
        self._merge("postings", postings, gone)
        empty = gone.join(indexed.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("bare", F.lit(True))
        status = rows.join(found.select("doc_id", "status"), "doc_id", "left").join(empty, "doc_id", "left")
        status = materialize(status.select("doc_id", F.when(F.col("bare"), "no_chunks").otherwise(F.coalesce("status", "reason")).alias("status")), "status")
        counted = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}  # one row per status
        bad = judged.where(~F.col("ok")).count()
        stored = counted.get("stored", 0) + counted.get("no_chunks", 0)
        skipped = counted.get("duplicate", 0) + counted.get("unchanged", 0)
        whole = indexed.agg(F.count("*"), F.count("vector")).first()
        ended = datetime.now(timezone.utc).replace(tzinfo=None)
        run = (uuid.uuid4().hex, started, ended, source, fetched, stored, skipped, sum(counted.values()) - stored - skipped, whole[0] + bad, whole[1], 0, 0, bad, whole[0] - whole[1], (ended - started).total_seconds(), "completed", None)
        self.spark.createDataFrame([run], RUN).write.mode("append").parquet(f"{self.path}/runs")
        return status

    def runs(self) -> DataFrame:
        """The counts of every ingestion, of the columns of monitoring.COUNTERS."""
        return self._table("runs") if self._has("runs") else self.spark.createDataFrame([], RUN)

    def health(self) -> dict:
        """Whether the session answers, and how much is indexed."""
        try:
            counts = {name: self._table(name).count() if self._has(name) else 0 for name in ("documents", "chunks")}
            return {"healthy": self.spark.range(1).count() == 1, **counts}
        except Exception as e:  # whatever is wrong is the answer
            return {"healthy": False, "error": f"{type(e).__name__}: {e}"}

    def _lists(self, asked: DataFrame, k: int, filters: list | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(dense hits, sparse hits, chunks) for ``asked`` (query_id, dense_text, sparse_text)."""
        fit = self._table("chunks").withColumn("id", F.col("chunk_id")).where(R.conditions(filters or []))
        dense = R.dense_topk(asked.select("query_id", self._embed("dense_text").alias("vector")), fit, k)
        postings = self._table("postings").select("id", "idx", "weight").join(fit.select("id"), "id", "left_semi")
        return dense, R.sparse_topk(R.sparse_vectors(asked, "query_id", "sparse_text"), postings, k), fit

    def search(self, queries: DataFrame, top_k: int = L.MMR_TOP, filters: list | None = None) -> DataFrame:
        """(query_id, pos, chunk_id, text, ...) for ``queries`` (query_id, query): dense and sparse lists, fused, reordered by the scorer, made diverse."""
        asked = understand.search_text(queries, self._generate)
        dense, sparse, fit = self._lists(asked, max(L.HITS_TOP, top_k), filters)
        fused = R.fuse(dense, sparse, fit).select("query_id", "id", "score", "rank")
        if self._score is not None:
            ranked = R.rerank(queries, fused.join(fit.select("id", "text"), "id"), self._score, max(L.RERANK_TOP, top_k)).drop("text")
            fused = ranked.withColumn("score", F.coalesce("rerank_score", "score"))
        chosen = R.mmr(materialize(fused, "fused").join(fit.select("id", "vector"), "id"), top_k)
        return chosen.join(fit.drop("vector", "bucket"), "id").drop("id")

    def cached_search(self, queries: DataFrame, now: datetime, minutes: int = 30, **settings) -> DataFrame:
        """search() for the questions whose hits are not kept, or no longer; (query_id, pos, chunk_id) of all of ``queries``."""
        key = cache.cache_key("search", "v1", "hits", F.col("query"), F.lit(repr(sorted(settings.items()))))
        asked = queries.select("query_id", "query", key.alias("key"))
        schema = "key string, value array<struct<pos:int,chunk_id:string>>, expires_at timestamp"
        held = VersionedTable(self.spark, f"{self.path}/cache")
        old = held.read() if held.current() else self.spark.createDataFrame([], schema)
        _, unknown = cache.split_known(asked, old, F.lit(now))
        new = unknown.groupBy("key").agg(F.min("query_id").alias("query_id"), F.first("query").alias("query"))
        new = materialize(new, "unknown")
        if not new.isEmpty():
            hits = self.search(new.select("query_id", "query"), **settings).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))).alias("value"))
            results = new.join(hits, "query_id", "left").select("key", F.coalesce("value", F.array().cast("array<struct<pos:int,chunk_id:string>>")).alias("value"))
            held.commit(cache.stored(old, results, F.lit(now), minutes), (held.current() or (-1,))[0] + 1)
            old = held.read()
        known, _ = cache.split_known(asked, old, F.lit(now))
        return known.select("query_id", F.explode("value").alias("h")).select("query_id", "h.*")

    def deep_search(self, queries: DataFrame, top_k: int = 8, filters: list | None = None) -> DataFrame:
        """One row for each of ``queries`` (query_id, query): complexity, sub-queries with their hits, contradictions, confidence, prompt and citations.

        Each sub-query is searched alone, the dense list first; a question of blanks has no sub-queries and confidence 0.
        """
        asked = queries.where(F.trim("query") != "")
        subs = materialize(understand.decompose(asked, self._generate), "subs")
        key = F.concat_ws("/", F.col("query_id").cast("string"), "sub_id")
        texts = subs.select(key.alias("query_id"), F.col("sub_query").alias("dense_text"), F.col("sub_query").alias("sparse_text"))
        dense, sparse, fit = self._lists(texts, top_k, filters)
        of = subs.select("query_id", "sub_id", "priority", key.alias("key"))
        hits = answers.dense_first(dense, sparse, top_k, "query_id").withColumnRenamed("query_id", "key").join(of, "key")
        hits = materialize(hits.join(fit.select("id", "title", "source", "text"), "id").drop("key"), "hits")
        order = W.partitionBy("query_id").orderBy("priority", "sub_id", "rank")
        listed = hits.withColumn("pos", F.row_number().over(order) - 1).withColumnRenamed("source", "source_type")
        against = checks.contradictions(hits.select("query_id", "id", "title", "text").distinct())
        report = answers.contradiction_report(queries, against)
        said = answers.synthesis_prompt(queries, listed)
        counted = subs.join(hits.groupBy("query_id", "sub_id").agg(F.count("*").alias("n")), ["query_id", "sub_id"], "left")
        parts = counted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("priority", "sub_id", "sub_query", "focus", F.coalesce("n", F.lit(0)).alias("chunks")))).alias("sub_queries"))
        sure = answers.deep_confidence(subs, hits, against)
        rows = self.route(queries).select("query_id", "query", "complexity").join(parts, "query_id", "left").join(report, "query_id", "left").join(said, "query_id", "left").join(sure, "query_id", "left")
        rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        if self._generate is not None:
            rows = rows.withColumn("answer", self._generate(F.col("prompt"))).withColumn("sections", answers.answer_sections(F.col("answer")))
        return rows

    def validate(self, said: DataFrame, hits: DataFrame, now: int) -> DataFrame:
        """What is to be thought of answers (query_id, answer) to the questions that ``hits`` of search() belong to; see validate_answers()."""
        level = F.col("evidence_level")
        known = self._table("documents").select("doc_id", F.lit(True).alias("held")).distinct()
        cited = hits.join(known, "doc_id", "left").select("query_id", F.col("source").alias("source_type"), C.evidence_number(level).alias("evidence_level"), F.when(F.col("year") > 0, F.col("year")).otherwise(now).alias("year"), F.coalesce("held", F.lit(False)).alias("known"))
        behind = hits.select("query_id", F.col("chunk_id").alias("id"), "text", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("quality_score"), F.col("source").alias("source_type"))
        return answers.validate_answers(said, cited, behind, now, answers.embedded_similarity(self._embed))

    def route(self, queries: DataFrame) -> DataFrame:
        """Complexity, intent and aspects of ``queries`` (query_id, query)."""
        return queries.select("query_id", "query", *[c.alias(n) for n, c in C.route(F.lower(F.trim("query"))).items()])

    def context(self, hits: DataFrame, limit: int = L.CONTEXT_CHARS) -> DataFrame:
        """(query_id, context): numbered blocks of the hits of ``search`` within ``limit`` characters."""
        block = R.context_block(F.col("pos") + 1, F.col("title"), F.col("year"), F.col("journal"), F.col("evidence_level"), F.col("doc_type"), F.col("india_relevant"), F.col("text"))
        kept = R.context_prefix(hits.select("query_id", "pos", block.alias("block")), limit)
        return kept.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "block"))), lambda b: b["block"]), "\n---\n").alias("context"))
