"""What the index keeps of a chunk besides its vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions import classify as C
from evidex.functions import text


def payload(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The 25 keys of each of ``chunks`` (chunk_id, doc_id, chunk_type, section_title, chunk_index, total_chunks), with its document's.

    ``documents`` has (doc_id, title, source_type, year, journal, doi) and ``content``, or ``t``, their
    lower-case plain text; (pmid, authors, mesh_terms, keywords) where known. Null and missing texts
    are empty, missing lists empty, a year that is not above 0 is the latest the text names, else 0.
    A chunk without a document has no row.
    """
    has = set(documents.columns)
    t = F.col("t") if "t" in has else F.lower(F.concat(text.plain(F.col("title")), F.lit(" "), text.plain(F.col("content"))))
    kind = C.doc_type(t)
    words = lambda c: text.strip(F.coalesce(F.col(c), F.lit(""))) if c in has else F.lit("")
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in has else F.array().cast("array<string>")
    year = F.coalesce(F.nullif(F.greatest(F.coalesce("year", F.lit(0)), F.lit(0)), F.lit(0)), text.max_year(t))
    flags = [c.alias(n) for n, c in C.flags(t, F.col("source_type"), F.col("journal")).items()]
    docs = documents.select(
        "doc_id", F.coalesce("source_type", F.lit("unknown")).alias("source"), kind.alias("doc_type"), C.evidence_level(kind).alias("evidence_level"), C.evidence_boost(C.evidence_level(kind)).alias("evidence_boost"),
        words("title").alias("title"), year.alias("year"), words("journal").alias("journal"), listed("authors").alias("authors"), F.coalesce("doi", F.lit("")).alias("doi"), words("pmid").alias("pmid"),
        C.specialties(t).alias("specialty"), listed("mesh_terms").alias("mesh_terms"), listed("keywords").alias("keywords"), *flags,
    )
    rows = chunks.select("doc_id", "chunk_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("chunk_type", "section_title")], "chunk_index", "total_chunks")
    return rows.withColumn("has_table", F.col("chunk_type") == "table").join(docs, "doc_id")
