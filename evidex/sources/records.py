"""Readers of files and of saved answers of web services, all to one document schema.

Fetching is not done here: a service's answers are read from files, so that a run can be repeated.
A row that lacks a title or a text is left out by each reader, as its source requires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.text import strip
from evidex.schemas import CDC_ITEM, DOCUMENT, PMC_ARTICLE, PUBMED_ARTICLE, WHO_ITEM


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    """The document schema from some columns; the rest are null."""
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in DOCUMENT.items()])


def document_key(pmid: Column, doi: Column, url: Column, title: Column, content: Column) -> Column:
    """Key of a document: by identifier, by DOI, else by a hash of address, title and content."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rest = F.substring(F.sha1(F.concat_ws("|", text(url), text(title), text(content))), 1, 12)
    pmid, doi = strip(text(pmid)), strip(text(doi))
    return F.when(pmid != "", F.concat(F.lit("pmid_"), pmid)).when(doi != "", F.concat(F.lit("doi_"), F.replace(doi, F.lit("/"), F.lit("_")))).otherwise(F.concat(F.lit("doc_"), rest))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, suffix, length) of the PDF and XML files below ``folder``; a missing folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,xml,PDF,XML}").load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("suffix"), "length")


def parser_of(suffix: Column, source: Column, scanned: Column) -> Column:
    """Which reader a file goes to."""
    return (
        F.when(suffix == "xml", "pubmed_xml")
        .when(scanned, "ocr")
        .when((suffix == "pdf") & source.isin("icmr", "nmc_guideline", "rssdi"), "pdf_tables")
        .when(suffix == "pdf", "tei")
        .otherwise("none")
    )


def _first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def pubmed_xml(spark: SparkSession, path: str, source_type: str = "pubmed", reader=None) -> DataFrame:
    """Articles of XML files: one without title and abstract is left out; several abstract parts are joined; broken files give none."""
    rows = (reader or spark.read).format("xml").option("rowTag", "PubmedArticle").option("mode", "PERMISSIVE").schema(PUBMED_ARTICLE).load(path)
    a, c = F.col("MedlineCitation.Article"), F.col("MedlineCitation")
    text = lambda x: strip(F.coalesce(x, F.lit("")))
    listed = lambda x, f: F.coalesce(F.filter(F.transform(x, f), lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))
    abstract = F.array_join(listed(a["Abstract"]["AbstractText"], lambda p: text(p["_VALUE"])), " ")
    title, pmid = text(a["ArticleTitle"]), text(c["PMID"]["_VALUE"])
    doi = F.get(F.transform(F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == "doi"), lambda i: text(i["_VALUE"])), F.lit(0))
    date = a["Journal"]["JournalIssue"]["PubDate"]
    content = strip(F.concat_ws("\n\n", title, abstract))
    found = shaped(
        rows, title=title, abstract=abstract, content=content, pmid=pmid, doi=doi, year=F.coalesce(_first_year(date["Year"]), _first_year(date["MedlineDate"]), F.lit(0)),
        journal=F.coalesce(F.nullif(text(a["Journal"]["Title"]), F.lit("")), text(a["Journal"]["ISOAbbreviation"])),
        authors=listed(a["AuthorList"]["Author"], lambda p: strip(F.concat_ws(" ", p["LastName"], p["ForeName"]))),
        mesh_terms=listed(c["MeshHeadingList"]["MeshHeading"], lambda m: text(m["DescriptorName"]["_VALUE"])), keywords=listed(c["KeywordList"]["Keyword"], lambda k: text(k["_VALUE"])),
        source_type=F.lit(source_type),
    )
    found = found.where("title <> '' or abstract <> ''")
    return found.withColumn("doc_id", document_key(F.col("pmid"), F.col("doi"), F.col("url"), F.col("title"), F.col("content")))


def cochrane_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles of the Cochrane reviews among XML files; title and abstract are both needed."""
    found = pubmed_xml(spark, path, "cochrane").where("title <> '' and abstract <> ''")
    return found.where(F.lower("journal").contains("cochrane"))


def pmc_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles of PMC files: title and abstract are needed; address by PMC id, DOI column by PMID, else PMC id."""
    rows = spark.read.format("xml").option("rowTag", "article").option("mode", "PERMISSIVE").schema(PMC_ARTICLE).load(path)
    m = F.col("front")["article-meta"]
    abstract = strip(F.coalesce(F.nullif(F.array_join(m["abstract"]["p"], " "), F.lit("")), m["abstract"]["_VALUE"], F.lit("")))
    of = lambda kind: F.get(F.transform(F.filter(m["article-id"], lambda i: i["_pub-id-type"] == kind), lambda i: F.trim(i["_VALUE"])), F.lit(0))
    pmc, pmid = of("pmc"), of("pmid")
    url = F.when(pmc.isNotNull(), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), pmc, F.lit("/")))
    doi = F.when(pmid.isNotNull(), F.concat(F.lit("PMID:"), pmid)).when(pmc.isNotNull(), F.concat(F.lit("PMC:"), pmc))
    found = shaped(rows, title=strip(F.coalesce(m["title-group"]["article-title"], F.lit(""))), abstract=abstract, content=abstract, year=_first_year(F.get(m["pub-date"], F.lit(0))["year"]), url=url, doi=doi, pmid=pmid, source_type=F.lit("statpearls"))
    return found.where("title <> '' and content <> ''").withColumn("doc_id", document_key(F.col("pmid"), F.col("doi"), F.col("url"), F.col("title"), F.col("content")))


def who_items(spark: SparkSession, path: str) -> DataFrame:
    """Items with a list of key and value pairs: keys become lists, with their alternatives for title and text."""
    rows = spark.read.schema(WHO_ITEM).json(path)
    of = lambda key: F.filter(F.transform(F.filter("metadata", lambda m: (m["key"] == key) & (m["value"] != "")), lambda m: m["value"]), lambda v: v.isNotNull())
    one = lambda *keys: F.coalesce(*[F.get(of(k), F.lit(0)) for k in keys])
    title = strip(F.coalesce(one("dc.title", "dc.title.alternative"), F.col("name"), F.lit("")))
    own = of("dc.description.abstract")
    text = strip(F.array_join(F.when(F.size(own) > 0, own).otherwise(F.coalesce(of("dc.description"), F.array().cast("array<string>"))), " "))
    url = F.when(F.coalesce("handle", F.lit("")) != "", F.concat(F.lit("https://iris.who.int/handle/"), "handle"))
    found = shaped(rows, title=title, abstract=text, content=text, url=url, year=_first_year(one("dc.date.issued", "dc.date")), doi=F.trim(one("dc.identifier.doi")), journal=F.lit("WHO Guidelines"), source_type=F.lit("who"))
    found = found.where("title <> '' and content <> ''")
    return found.withColumn("doc_id", document_key(F.col("pmid"), F.col("doi"), F.col("url"), F.col("title"), F.col("content")))


def cdc_items(spark: SparkSession, path: str) -> DataFrame:
    """Media items: title and description are needed, the year is taken from the date."""
    rows = spark.read.schema(CDC_ITEM).json(path)
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    found = shaped(rows, title=text("title"), content=text("description"), abstract=text("description"), url=F.nullif(text("sourceUrl"), F.lit("")), year=_first_year(F.col("datePublished")), journal=F.lit("CDC Health Guidelines"), source_type=F.lit("cdc"))
    found = found.where("title <> '' and content <> ''")
    return found.withColumn("doc_id", document_key(F.col("pmid"), F.col("doi"), F.col("url"), F.col("title"), F.col("content")))


def tei(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Documents of TEI text in a column: title, abstract, year, journal, and the text of its divisions under their heads."""
    body = F.regexp_replace(xml, r'\sxmlns="[^"]*"', "")
    path = lambda p: F.xpath_string(body, F.lit(p))
    bare = lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))
    divisions = F.regexp_extract_all(F.regexp_extract(body, r"(?s)<body[^>]*>(.*)</body>", 1), F.lit(r"(?s)<div\b[^>]*>(.*?)</div>"), 1)
    rows = df.select("*", strip(path("//titleStmt/title")).alias("_title"), strip(path("//profileDesc/abstract")).alias("_abstract"), path("//publicationStmt/date/@when").alias("_date"), path("//monogr/title").alias("_journal"), divisions.alias("_divisions"))
    head, no_tables = r"(?s)<head[^>]*>(.*?)</head>", F.array().cast("array<struct<caption:string,headers:array<string>,rows:array<array<string>>>>")
    made = lambda d, i: F.struct(bare(F.regexp_extract(d, head, 1)).alias("title"), bare(F.regexp_replace(d, head, "")).alias("text"), i.alias("section_index"), F.lit(False).alias("has_table"), no_tables.alias("tables"))
    sections = F.transform("_divisions", made)
    content = F.array_join(F.concat(F.when(F.col("_abstract") != "", F.array(F.concat(F.lit("Abstract\n"), "_abstract"))).otherwise(F.array().cast("array<string>")), F.transform(sections, lambda s: F.concat(s["title"], F.lit("\n"), s["text"]))), "\n\n")
    found = shaped(rows, title=F.col("_title"), abstract=F.col("_abstract"), content=content, year=_first_year(F.col("_date")), journal=F.col("_journal"), sections=sections, source_type=F.lit("tei"))
    return found.where("title <> '' or content <> ''").withColumn("doc_id", document_key(F.col("pmid"), F.col("doi"), F.col("url"), F.col("title"), F.col("content")))


def is_scanned(pages: Column) -> Column:
    """Whether none of the first five pages holds more than 50 characters of text."""
    return ~F.exists(F.slice(pages, 1, 5), lambda p: F.length(strip(F.coalesce(p, F.lit("")))) > 50)


def kept_pages(pages: Column) -> Column:
    """Pages of more than 30 characters, joined."""
    return F.array_join(F.filter(F.transform(pages, lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: F.length(p) > 30), "\n\n")


def coerced_sections(sections: Column, content: Column) -> Column:
    """Sections given with a document, indexes by position where missing; without any, those found in its content."""
    from evidex.operators.chunking import split_sections

    given = F.transform(sections, lambda s, i: F.struct(F.coalesce(s["title"], F.lit("")).alias("title"), F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["section_index"], i).alias("section_index")))
    found = F.transform(split_sections(content), lambda s, i: F.struct(s["title"].alias("title"), s["text"].alias("text"), i.alias("section_index")))
    return F.when(F.size(sections) > 0, given).otherwise(found)
