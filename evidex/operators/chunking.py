"""Sections, sentence windows and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import lexicons as L
from evidex.functions.text import length_tokens, sentences, strip


#: Where a text breaks into lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_SECTIONS = "array<struct<title:string,text:string>>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is taken once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def split_sections(text: Column) -> Column:
    """Array of (title, text): sections by academic headers on lines of their own; text before the first is Main.

    Headers are found by position and each section is sliced out once, so that the work grows with
    the length of the text. Runs of blank lines become one; empty sections are left out.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), strip)

    def of(ls: Column, heads: Column) -> Column:
        def one(head: Column, i: Column) -> Column:
            end = F.coalesce(F.get(heads, i + 1), F.size(ls))
            body = F.slice(ls, head + 2, end - head - 1)
            kept = F.filter(body, lambda x, j: (x != "") | ((j > 0) & (F.get(body, j - 1) != "")))
            title = F.when(head < 0, F.lit("Main")).otherwise(F.get(ls, head))
            return F.struct(title.alias("title"), strip(F.array_join(kept, "\n")).alias("text"))

        return F.filter(F.transform(heads, one), lambda s: s["text"] != "").cast(_SECTIONS)

    found = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(F.lower(x).rlike(L.HEADER), i)), lambda i: i.isNotNull())
    return _bound(lines, lambda ls: _bound(F.concat(F.array(F.lit(-1)), found(ls)), lambda heads: of(ls, heads)))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, title, text), a row per section."""
    return df.select(key, F.posexplode(split_sections(F.col(text))).alias("section_index", "s")).select(key, "section_index", "s.title", "s.text")


def sentence_windows(sents: Column, most: int = L.MOST_TOKENS, overlap: int = L.OVERLAP_TOKENS) -> Column:
    """Sentences filled into windows of at most ``most`` tokens; each begins with the last sentences of the one before, up to ``overlap`` tokens.

    A sentence above the limit is a window of its own where none is open. A fold over the sentences of one text.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), F.lit(0).alias("tokens"), none.alias("done"))

    def tail(opened):
        t0 = F.struct(none.alias("kept"), F.lit(0).alias("tokens"), F.lit(False).alias("full"))

        def back(s, sentence):
            n = length_tokens(sentence)
            stop = s["full"] | (s["tokens"] + n > overlap)
            return F.when(stop, F.struct(s["kept"].alias("kept"), s["tokens"].alias("tokens"), F.lit(True).alias("full"))).otherwise(
                F.struct(F.concat(F.array(sentence), s["kept"]).alias("kept"), (s["tokens"] + n).alias("tokens"), F.lit(False).alias("full"))
            )

        return F.aggregate(F.reverse(opened), t0, back)

    def step(s, sentence):
        n = length_tokens(sentence)
        t = tail(s["open"])
        fits = s["tokens"] + n <= most
        window = F.concat(s["done"], F.array(F.array_join(s["open"], " ")))
        return (
            F.when(fits, F.struct(F.concat(s["open"], F.array(sentence)).alias("open"), (s["tokens"] + n).alias("tokens"), s["done"].alias("done")))
            .when(F.size(s["open"]) > 0, F.struct(F.concat(t["kept"], F.array(sentence)).alias("open"), (t["tokens"] + n).alias("tokens"), window.alias("done")))
            .otherwise(F.struct(none.alias("open"), F.lit(0).alias("tokens"), F.concat(s["done"], F.array(sentence)).alias("done")))
        )

    return F.aggregate(sents, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], " ")))).otherwise(s["done"]))


def table_text(rows: Column, headers: Column, caption: Column | None = None) -> Column:
    """The caption, then table rows as lines of ``header: value`` pairs; at most twenty rows."""
    head = lambda i: F.coalesce(F.nullif(strip(F.get(headers, i)), F.lit("")), F.concat(F.lit("Col"), (i + 1).cast("string")))
    line = lambda row: F.array_join(F.transform(row, lambda v, i: F.concat(head(i), F.lit(": "), strip(F.coalesce(v, F.lit(""))))), " | ")
    lines = F.filter(F.transform(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, L.ROWS_MOST), line), lambda x: x != "")
    first = F.array(strip(F.coalesce(caption, F.lit("")))) if caption is not None else F.array().cast("array<string>")
    return strip(F.array_join(F.concat(F.filter(first, lambda c: c != ""), lines), "\n"))


def pipe_table(rows: Column) -> Column:
    """Table rows as aligned text between bars, the first underlined; empty for fewer than two rows or four filled cells."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))

    def of(t: Column) -> Column:
        columns = F.array_max(F.transform(t, lambda r: F.size(r)))
        width = lambda i: F.greatest(F.lit(4), F.array_max(F.transform(t, lambda r: F.length(F.coalesce(F.get(r, i), F.lit(""))))))
        filled = F.size(F.filter(F.flatten(t), lambda c: c != ""))
        widths = F.transform(F.sequence(F.lit(0), F.greatest(columns - 1, F.lit(0))), width)
        line = lambda r, w: F.array_join(F.transform(w, lambda n, i: F.rpad(F.coalesce(F.get(r, i), F.lit("")), n, F.lit(" "))), " | ")
        made = lambda w: F.array_join(F.flatten(F.transform(t, lambda r, i: F.when(i == 0, F.array(line(r, w), F.array_join(F.transform(w, lambda n: F.repeat(F.lit("-"), n)), "-+-"))).otherwise(F.array(line(r, w))))), "\n")
        return F.when((F.size(t) < 2) | (filled < 4), F.lit("")).otherwise(_bound(widths, made))

    return F.coalesce(_bound(clean, of), F.lit(""))


def contextual_text(source: Column, kind: Column, title: Column, section: Column, text: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Source: "), part(source), F.lit("\nDocument type: "), part(kind), F.lit("\nTitle: "), part(title), F.lit("\nSection: "), part(section), F.lit("\n\n"), part(text))


_CHUNK = "array<struct<chunk_type:string,section_title:string,text:string>>"


def _made(kind: str, title: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("chunk_type"), title.alias("section_title"), text.alias("text"))


def _paragraphs(title: Column, text: Column, keep_tail: bool) -> Column:
    """The chunks of a section's text: whole up to 350 tokens, else in sentence windows of at least 80."""
    whole = F.array(_made("paragraph", title, text)).cast(_CHUNK)
    windows = F.filter(F.transform(sentence_windows(sentences(text)), strip), lambda w: F.lit(keep_tail) | (length_tokens(w) >= L.LEAST_TOKENS))
    split = F.transform(windows, lambda w: _made("paragraph", title, w)).cast(_CHUNK)
    return F.when(text == "", F.array().cast(_CHUNK)).when(length_tokens(text) <= L.TARGET_TOKENS, whole).otherwise(split)


def _given(section: Column, i: Column, keep_tail: bool) -> Column:
    """The chunks of a section that came with the document: its tables, then its text."""
    title = F.coalesce(F.nullif(section["title"], F.lit("")), F.concat(F.lit("Section "), (F.coalesce(section["section_index"], i) + 1).cast("string")))
    named = lambda t, j: _made("table", F.concat(title, F.lit(" - Table "), (j + 1).cast("string")), table_text(t["rows"], t["headers"], t["caption"]))
    tables = F.filter(F.transform(F.slice(section["tables"], 1, L.ROWS_MOST), named).cast(_CHUNK), lambda c: c["text"] != "")
    held = F.when(F.coalesce(section["has_table"], F.lit(False)) & section["tables"].isNotNull(), tables).otherwise(F.array().cast(_CHUNK))
    return F.concat(held, _paragraphs(title, strip(F.coalesce(section["text"], F.lit(""))), keep_tail))


def chunk_documents(df: DataFrame, keep_tail: bool = False) -> DataFrame:
    """(doc_id, chunk_id, chunk_index, total_chunks, chunk_type, section_title, text, contextual_text, char_count, token_estimate) of ``df``.

    ``df`` has (doc_id, title, content) and, where known, (abstract, mesh_terms, keywords, sections,
    source_type, doc_type) as in schemas.DOCUMENT. A summary of title, abstract, MeSH terms and
    keywords comes first, then the sections given, each with up to twenty tables, or those found in
    the content: whole up to 350 tokens, else in sentence windows, of which those under 80 tokens are
    dropped unless ``keep_tail``. Documents of which all of that is null or blank have no chunks;
    repeated ids give repeated chunks; other columns are not read.
    """
    has = lambda c: c in df.columns
    part = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) if has(c) else F.lit("")
    listed = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), strip), lambda x: x != "") if has(c) else F.array().cast("array<string>")
    marked = lambda c, lead: F.when(F.size(listed(c)) > 0, F.concat(F.lit(lead), F.array_join(listed(c), ", "))).otherwise("")
    parts = F.filter(F.array(part("title"), part("abstract"), marked("mesh_terms", "MeSH: "), marked("keywords", "Keywords: ")), lambda p: p != "")
    summary = F.when(F.size(parts) == 0, F.array().cast(_CHUNK)).otherwise(F.array(_made("doc_summary", F.lit("Document Summary"), F.array_join(parts, "\n\n"))).cast(_CHUNK))
    body = F.flatten(F.transform(split_sections(F.col("content")), lambda s: _paragraphs(s["title"], s["text"], keep_tail)))
    if has("sections"):
        body = F.when(F.size("sections") > 0, F.flatten(F.transform("sections", lambda s, i: _given(s, i, keep_tail)))).otherwise(body)
    origin = [F.coalesce(F.col(c), F.lit("unknown")) if has(c) else F.lit("unknown") for c in ("source_type", "doc_type")]
    rows = df.select("doc_id", F.coalesce("title", F.lit("")).alias("_t"), *[c.alias(n) for c, n in zip(origin, ("_s", "_k"))], F.concat(summary, body).alias("_c"))
    rows = rows.select("doc_id", "_t", "_s", "_k", F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "c"))
    text = F.col("c.text")
    return rows.select(
        "doc_id", F.concat_ws("_c", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", "total_chunks", "c.*",
        contextual_text(F.col("_s"), F.col("_k"), F.col("_t"), F.col("c.section_title"), text).alias("contextual_text"), F.length(text).alias("char_count"), length_tokens(text).alias("token_estimate"),
    )
