"""Files of a folder to documents: each goes to the reader its kind and source ask for, a bad file gives a row with its error.

Decoding PDF needs a library that is not part of this one: ``extract`` gives the pages of a file and
its tables, ``recognise`` the text of page images, both as plain functions that run on the workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.text import strip
from evidex.operators.chunking import pipe_table
from evidex.schemas import DOCUMENT
from evidex.sources.records import document_key, is_scanned, kept_pages, parser_of, pubmed_xml, shaped

Extract = Callable[[bytes], list[tuple[str, list[list[list[str]]]]]]
Recognise = Callable[[bytes], list[str]]
_PAGES = "path string, source string, length bigint, pages array<struct<text:string,tables:array<array<array<string>>>>>, seen array<string>, error string"


def _decoded(extract: Extract | None, recognise: Recognise | None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, source, length, content in zip(pdf["path"], pdf["source"], pdf["length"], pdf["content"]):
                pages, seen, error = [], [], None
                try:
                    if extract is None:
                        raise RuntimeError("no reader of PDF files was given")
                    pages = [{"text": t, "tables": tables} for t, tables in extract(bytes(content))]
                    if recognise is not None and all(len((p["text"] or "").strip()) <= 50 for p in pages[:5]):
                        seen = list(recognise(bytes(content)))
                except Exception as e:  # one bad file must not fail the others
                    error = f"{type(e).__name__}: {e}"
                rows.append((path, source, length, pages, seen, error))
            yield pd.DataFrame(rows, columns=["path", "source", "length", "pages", "seen", "error"])

    return run


def page_text(pages: Column) -> Column:
    """Text of the pages of a file, each followed by its tables, marked as such; tables too small to tell are left out."""
    marked = lambda t: F.concat(F.lit("[TABLE]\n"), pipe_table(t), F.lit("\n[/TABLE]"))
    tables = lambda p: F.transform(F.filter(F.coalesce(p["tables"], F.array().cast("array<array<array<string>>>")), lambda t: pipe_table(t) != ""), marked)
    page = lambda p: F.array_join(F.filter(F.concat(F.array(strip(F.coalesce(p["text"], F.lit("")))), tables(p)), lambda x: x != ""), "\n\n")
    return F.array_join(F.filter(F.transform(pages, page), lambda x: x != ""), "\n\n")


def documents_of_files(spark: SparkSession, folder: str, source: str, extract: Extract | None = None, recognise: Recognise | None = None, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of the PDF and XML files below ``folder``: documents as in schemas.DOCUMENT, failures (path, error).

    XML files are read as PubMed articles, PDF files by ``extract``; a file none of whose first pages
    holds text is scanned, and is read by ``recognise``. A file without text or title is a failure.
    ``batch`` files make a task; other kinds of files are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF}")
    files = reader.load(folder).select("path", F.lit(source).alias("source"), "length", "content")
    if batch:
        files = files.repartition(max(1, -(-files.select("path").count() // batch)))
    rows = files.mapInPandas(_decoded(extract, recognise), _PAGES)
    scanned = is_scanned(F.transform("pages", lambda p: p["text"]))
    kind = parser_of(F.lit("pdf"), F.col("source"), scanned)
    content = F.when(kind == "ocr", kept_pages(F.col("seen"))).otherwise(page_text(F.col("pages")))
    rows = rows.withColumn("body", F.when(F.col("error").isNull(), content)).withColumn("title", F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[Pp][Dd][Ff]$", 1), "[_-]+", " "))
    good = F.col("error").isNull() & (F.coalesce("body", F.lit("")) != "")
    read = shaped(rows.where(good), title=F.col("title"), content=F.col("body"), source_type=F.lit(source))
    read = read.withColumn("doc_id", document_key(F.col("pmid"), F.col("doi"), F.col("url"), F.col("title"), F.col("content")))
    failures = rows.where(~good).select("path", F.coalesce("error", F.lit("no text")).alias("error"))
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,XML}").load(folder).select("path")
    if not names.isEmpty():
        xml = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,XML}")
        read = read.unionByName(pubmed_xml(spark, folder, source, reader=xml).select(*DOCUMENT))
    return read, failures
