"""Queries of duplicates, change detection, upserts and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import classify as C
from evidex.functions import lexicons as L
from evidex.functions import text
from evidex.operators import chunking, merge
from evidex.plans import sql as S
from evidex.plans.expressions import _CHUNKS, _DOCS, chunks, documents
from evidex.runtime import table


def dedupe_exact(spark, d):
    """Records with the first of the same normalised content."""
    rows = table(spark, d, "doc_records").select("record_id", "content")
    return merge.exact_duplicates(rows, "record_id", "content").select("record_id", "duplicate_of")


def doi_matches(spark, d):
    """Records whose DOI an earlier record has: a semi-join against the first record of each DOI."""
    rows = table(spark, d, "doc_records").where("doi is not null and trim(doi) <> ''").select("record_id", F.lower(F.trim("doi")).alias("doi"))
    first = rows.groupBy("doi").agg(F.min("record_id").alias("first"))
    return rows.join(first, "doi").where("record_id > first").select("record_id", "first")


def title_dupes(spark, d):
    """Pairs of distinct titles of a source that are nearly equal."""
    found = merge.title_duplicates(table(spark, d, "doc_records").select("source_type", "title"), 0.8)
    return found.withColumn("similarity", F.round("similarity", 6))


_TITLES = f"""with t as (select distinct source_type, t, [substr(t, i, 3) for i in range(1, length(t) - 1)] as a from (select source_type, {S.title_norm('title')} as t from doc_records)
  where length(t) >= 3 and source_type is not null),
 g as (select *, list_distinct(a) as g from t)
 select x.source_type, x.t as title_a, y.t as title_b, round(len(list_intersect(x.g, y.g))::double / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 6) as similarity
 from g x join g y on x.source_type = y.source_type and x.t < y.t and len(x.g) >= 0.8 * len(y.g) and len(y.g) >= 0.8 * len(x.g)
 where len(list_intersect(x.g, y.g))::double / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) >= 0.8"""


def chunk_dedupe(spark, d):
    """Chunks, the first of each id."""
    return chunks(spark, d, "doc_id", "chunk_index").select("chunk_id", "doc_id", "chunk_index")


def chunk_text_dedupe(spark, d):
    """Chunks of a document, the first of each text."""
    rows = chunks(spark, d, "doc_id", "chunk_index", "text").withColumn("h", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 12))
    return merge.first_by(rows, ["doc_id", "h"], "chunk_index", "chunk_id").select("chunk_id", "h")


def incremental_dedupe(spark, d):
    """The newest record of each document against the one before: new, changed or unchanged."""
    from pyspark.sql.window import Window as W

    rows = table(spark, d, "doc_records").select("doc_id", "record_id", text.short_hash(F.col("title"), F.col("content")).alias("hash"))
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("record_id").desc())))
    return merge.change_status(ranked.where("n = 2"), ranked.where("n = 1"))


_HASH = f"substr(sha256(array_to_string(list_filter([{S.strip(S.or_empty('title'))}, {S.strip(S.or_empty('content'))}], lambda p: p <> ''), '|')), 1, 16)"


def chunk_exists(spark, d):
    """Index points whose chunk is stored."""
    points = table(spark, d, "vector_points").select("point_id", F.col("payload")["chunk_id"].alias("chunk_id")).distinct()
    return points.join(table(spark, d, "chunks").select("chunk_id"), "chunk_id", "left_semi").select("point_id", "chunk_id")


def upsert_latest(spark, d):
    """The index after all upserts: the last row of each point."""
    return merge.latest(table(spark, d, "vector_points").select("point_id", "upserted_at"), "point_id", "upserted_at").select("point_id", F.unix_micros(F.col("upserted_at").cast("timestamp")).alias("at"))


def upsert_orders(spark, d):
    """An upsert of later orders of each customer into the table of first ones."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    first = merge.first_by(orders, ["o_custkey"], "o_orderdate", "o_orderkey")
    late = orders.where("o_orderdate >= '1997-01-01'")
    return merge.upsert(first, late, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


_ORDERS = """with first as (select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice, o_orderdate, 0 as n from orders order by o_custkey, o_orderdate, o_orderkey),
 late as (select o_custkey, o_orderkey, o_totalprice, o_orderdate, 1 as n from orders where o_orderdate >= date '1997-01-01')
 select distinct on (o_custkey) o_custkey, o_orderkey, round(o_totalprice, 2) as o_totalprice from (select * from first union all select * from late) order by o_custkey, n desc, o_orderdate desc, o_orderkey desc"""


def chunk_metadata(spark, d):
    """Chunks with position, count and metadata of their document."""
    docs = table(spark, d, "doc_records").groupBy("doc_id").agg(F.max_by(F.struct("source_type", "journal", "year"), "record_id").alias("r"))
    rows = chunks(spark, d, "doc_id", "chunk_index", "text")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return rows.join(docs, "doc_id", "left").join(counts, "doc_id").select("chunk_id", "chunk_index", "n_chunks", "r.source_type", "r.journal", F.coalesce("r.year", F.lit(0)).cast("bigint").alias("year"), text.length_tokens(F.col("text")).cast("bigint").alias("tokens"))


_META = f"""with r as (select doc_id, arg_max({{'source_type': source_type, 'journal': journal, 'year': year}}, record_id) as r from doc_records group by doc_id), c as {_CHUNKS}
 select chunk_id, chunk_index, count(*) over (partition by doc_id) as n_chunks, r.source_type as source_type, r.journal as journal, coalesce(r.year, 0)::bigint as year, {S.length_tokens('text')} as tokens from c left join r using (doc_id)"""


def sections(spark, d):
    """Sections of contents, with the hash of each text."""
    rows = table(spark, d, "doc_records").select("record_id", "content")
    return chunking.sections(rows, "record_id", "content").select("record_id", F.col("section_index").cast("bigint").alias("section_index"), "title", F.length("text").cast("bigint").alias("n_chars"))


_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_SECTIONS = f"""with l as (select record_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as line from (select record_id, list_transform(regexp_split_to_array(coalesce(content, ''), {S.text(_LINE_END)}), lambda s: {S.strip('s')}) as a from doc_records)),
 h as (select *, regexp_matches(lower(line), '^(?:\\d+\\.\\s*)?(abstract|introduction|background|methods?|materials and methods|results|discussion|conclusion|conclusions)\\s*$') as head from l),
 s as (select *, sum(head::int) over (partition by record_id order by i) as n, lag(line) over (partition by record_id order by i) as before from h),
 t as (select record_id, n, coalesce(max(case when head then line end), 'Main') as title,
   regexp_replace(coalesce(string_agg(case when not head and (line <> '' or before <> '') then line end, chr(10) order by i), ''), '^[{S.BLANK}]+|[{S.BLANK}]+$', '', 'g') as text from s group by record_id, n)
 select record_id, (row_number() over (partition by record_id order by n) - 1)::bigint as section_index, title, length(text)::bigint as n_chars from t where text <> ''"""


def sentences(spark, d):
    """Number and hash of the sentences of contents."""
    found = text.sentences(F.coalesce("content", F.lit("")))
    return table(spark, d, "doc_records").select("record_id", F.size(found).cast("bigint").alias("n"), F.md5(F.array_join(found, "|")).alias("joined"))


def _sentences_sql() -> str:
    return f"select record_id, len(x)::bigint as n, md5(array_to_string(x, '|')) as joined from (select record_id, {_split_sentences("coalesce(content, '')")} as x from doc_records)"


def chunk_documents(spark, d):
    """Chunks made of the newest record of each document; its tags stand for MeSH terms and keywords."""
    rows = documents(spark, d).select("doc_id", "record_id", "title", "content", "source_type", C.doc_type(F.col("t")).alias("doc_type"), F.col("specialty_tags").alias("mesh_terms"), F.col("condition_tags").alias("keywords"))
    found = chunking.chunk_documents(merge.latest(rows, "doc_id", "record_id"))
    whole = [F.col(c).cast("bigint").alias(c) for c in ("chunk_index", "total_chunks", "char_count", "token_estimate")]
    return found.select("doc_id", "chunk_id", "chunk_type", "section_title", "text", F.md5("contextual_text").alias("contextual"), *whole)


def _split_sentences(c: str) -> str:
    """List of the sentences of a text, short forms restored in lower case."""
    r = "s"
    for i, form in enumerate(L.SHORT_FORMS):
        mark = f"chr(1) || chr({97 + i}) || chr(2)"
        c = f"regexp_replace({c}, {S.text('(?i)' + form.replace('.', chr(92) + '.'))}, {mark}, 'g')"
        r = f"replace({r}, {mark}, {S.text(form)})"
    split = f"string_split(regexp_replace({c}, '([.!?])[{S.BLANK}]+([A-Z])', '\\1' || chr(3) || '\\2', 'g'), chr(3))"
    return f"list_transform(list_filter(list_transform({split}, lambda s: {S.strip('s')}), lambda s: s <> ''), lambda s: {r})"


def _windows_sql(source: str) -> str:
    """Recursive part: of ``source`` (k, s) the windows (k, w) of its sentence lists, as pairs of first and last position, one sentence a step."""
    z = "greatest(1, length(s[i]) // 4)"
    tail = "list_filter(range(lo, i + 1), lambda j: coalesce(list_sum(list_transform(s[j:i - 1], lambda x: greatest(1, length(x) // 4))), 0) <= 50)[1]"
    held = "coalesce(list_sum(list_transform(s[t:i - 1], lambda x: greatest(1, length(x) // 4))), 0)"
    return f"""f(k, s, i, lo, n, w) as (select k, s, 1::bigint, 1::bigint, 0::bigint, []::bigint[][] from {source} union all
   select k, s, i + 1, case when n + z <= 500 then lo when lo < i then t else i + 1 end, case when n + z <= 500 then n + z when lo < i then {held} + z else 0 end,
     case when n + z <= 500 then w when lo < i then list_append(w, [lo, i - 1]) else list_append(w, [i, i]) end
   from (select *, {z} as z, {tail} as t from f where i <= len(s))),
 win as (select k, s, case when lo <= len(s) then list_append(w, [lo, len(s)]) else w end as w from f where i = len(s) + 1)"""


def _chunks_sql() -> str:
    line = "^(?:\\d+\\.\\s*)?(abstract|introduction|background|methods?|materials and methods|results|discussion|conclusion|conclusions)\\s*$"
    listed = lambda c, lead: f"case when len({c}) > 0 then '{lead}' || array_to_string({c}, ', ') else '' end"
    clean = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {S.strip('x')}), lambda x: x <> '')"
    return f"""with recursive d as (select doc_id, arg_max({{'title': title, 'content': content, 'source': source_type, 'kind': {S.doc_type('t')}, 'mesh': {clean('specialty_tags')}, 'keys': {clean('condition_tags')}}}, record_id) as r from {_DOCS} group by doc_id),
 l as (select doc_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as line from (select doc_id, list_transform(regexp_split_to_array(coalesce(r.content, ''), {S.text(_LINE_END)}), lambda s: {S.strip('s')}) as a from d)),
 h as (select *, regexp_matches(lower(line), '{line}') as head from l),
 b as (select *, sum(head::int) over (partition by doc_id order by i) as n, lag(line) over (partition by doc_id order by i) as before from h),
 sec as (select doc_id, n, coalesce(max(case when head then line end), 'Main') as title, {S.strip("coalesce(string_agg(case when not head and (line <> '' or before <> '') then line end, chr(10) order by i), '')")} as text from b group by doc_id, n),
 long as (select {{'d': doc_id, 'n': n}} as k, {_split_sentences('text')} as s from sec where length(text) // 4 > 350),
 {_windows_sql('long')},
 c as (select doc_id, -1 as n, 0 as j, 'doc_summary' as chunk_type, 'Document Summary' as section_title, array_to_string(list_filter([{S.strip("coalesce(r.title, '')")}, {listed('r.mesh', 'MeSH: ')}, {listed('r.keys', 'Keywords: ')}], lambda x: x <> ''), chr(10) || chr(10)) as text from d
  union all select doc_id, n, 0, 'paragraph', title, text from sec where length(text) // 4 <= 350
  union all select doc_id, n, j, 'paragraph', title, x from (select k.d as doc_id, k.n as n, unnest(range(len(w))) as j, unnest(list_transform(w, lambda y: {S.strip("array_to_string(s[y[1]:y[2]], ' ')")})) as x from win) join sec using (doc_id, n) where length(x) // 4 >= 80),
 o as (select *, row_number() over (partition by doc_id order by n, j) - 1 as chunk_index, count(*) over (partition by doc_id) as total_chunks from c where text <> '')
 select doc_id, doc_id || '_c' || chunk_index as chunk_id, chunk_index, total_chunks, chunk_type, section_title, text, length(text) as char_count, greatest(1, length(text) // 4) as token_estimate,
  md5('Source: ' || coalesce(r.source, 'unknown') || chr(10) || 'Document type: ' || r.kind || chr(10) || 'Title: ' || coalesce(r.title, '') || chr(10) || 'Section: ' || section_title || chr(10) || chr(10) || text) as contextual
 from o join d using (doc_id)"""


def sentence_windows(spark, d):
    """Windows of the sentences of each content."""
    rows = table(spark, d, "doc_records").select("record_id", F.posexplode(chunking.sentence_windows(text.sentences(F.coalesce("content", F.lit(""))))).alias("window", "text"))
    return rows.select("record_id", F.col("window").cast("bigint").alias("window"), "text", text.length_tokens(F.col("text")).cast("bigint").alias("tokens"))


def _sentence_windows_sql() -> str:
    return f"""with recursive r as (select record_id as k, {_split_sentences("coalesce(content, '')")} as s from doc_records), {_windows_sql('r')}
 select k as record_id, j as "window", x as text, greatest(1, length(x) // 4) as tokens from (select k, unnest(range(len(w))) as j, unnest(list_transform(w, lambda y: array_to_string(s[y[1]:y[2]], ' '))) as x from win)"""


QUERIES = {
    "dedupe_exact": (dedupe_exact, f"select record_id, case when h is not null and record_id > min(record_id) over (partition by h) then min(record_id) over (partition by h) end as duplicate_of from (select record_id, case when trim(coalesce(content, '')) <> '' then {S.normal('content')} end as h from doc_records)"),
    "doi_matches": (doi_matches, "select record_id, first from (select record_id, min(record_id) over (partition by lower(trim(doi))) as first from doc_records where trim(doi) <> '') where record_id > first"),
    "title_dupes": (title_dupes, _TITLES),
    "chunk_dedupe": (chunk_dedupe, f"select chunk_id, doc_id, chunk_index from {_CHUNKS}"),
    "chunk_text_dedupe": (chunk_text_dedupe, f"select chunk_id, h from (select chunk_id, substr(md5(coalesce(text, '')), 1, 12) as h, row_number() over (partition by doc_id, substr(md5(coalesce(text, '')), 1, 12) order by chunk_index, chunk_id) as n from {_CHUNKS}) where n = 1"),
    "incremental_dedupe": (incremental_dedupe, f"with r as (select doc_id, {_HASH} as hash, row_number() over (partition by doc_id order by record_id desc) as n from doc_records) select a.doc_id, case when b.doc_id is null then 'new' when a.hash is not distinct from b.hash then 'unchanged' else 'changed' end as status from (select * from r where n = 1) a left join (select * from r where n = 2) b using (doc_id)"),
    "chunk_exists": (chunk_exists, "select distinct point_id, payload['chunk_id'] as chunk_id from vector_points where payload['chunk_id'] in (select chunk_id from chunks)"),
    "upsert_latest": (upsert_latest, "select point_id, epoch_us(max(upserted_at)) as at from vector_points where point_id is not null group by point_id"),
    "upsert_orders": (upsert_orders, _ORDERS),
    "chunk_metadata": (chunk_metadata, _META),
    "sections": (sections, _SECTIONS),
    "sentences": (sentences, _sentences_sql()),
    "chunk_documents": (chunk_documents, _chunks_sql()),
    "sentence_windows": (sentence_windows, _sentence_windows_sql()),
}
