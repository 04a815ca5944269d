"""Queries of scalar expressions, filters and row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import classify as C
from evidex.functions import lexicons as L
from evidex.functions import scoring, text, vectors
from evidex.operators.merge import latest
from evidex.operators.payload import payload
from evidex.operators.retrieve import conditions
from evidex.operators.validate import clean_lines, validate_chunks, validate_documents
from evidex.plans import sql as S
from evidex.runtime import parallel, table
from evidex.sources.records import document_key

_CHUNKS = "(select distinct on (chunk_id) chunk_id, doc_id, chunk_type, section_title, text, contextual_text, token_estimate, chunk_index, total_chunks from chunks)"


def chunks(spark, d, *columns):
    """Chunks once each, of their columns those asked for alone; a replayed row equals the first."""
    return latest(table(spark, d, "chunks").select("chunk_id", *columns), "chunk_id")


def documents(spark, d):
    """Records with their lower-case plain text: title and content."""
    rows = parallel(table(spark, d, "doc_records"))
    return rows.withColumn("t", F.lower(F.concat(text.plain(F.col("title")), F.lit(" "), text.plain(F.col("content")))))


_DOCS = f"(select *, lower({S.plain('title')} || ' ' || {S.plain('content')}) as t from doc_records)"


def token_estimates(spark, d):
    """Two estimates of a chunk's tokens."""
    return chunks(spark, d, "text").select("chunk_id", text.length_tokens(F.col("text")).cast("bigint").alias("by_length"), text.word_tokens(F.col("text")).cast("bigint").alias("by_words"))


def content_hash(spark, d):
    """Hash of normalised content."""
    return table(spark, d, "doc_records").select("record_id", text.content_hash(F.col("content")).alias("hash"))


def content_hash_short(spark, d):
    """Change-detection hash of title and content."""
    return table(spark, d, "doc_records").select("record_id", text.short_hash(F.col("title"), F.col("content")).alias("hash"))


def title_norm(spark, d):
    return table(spark, d, "doc_records").select("record_id", text.title_norm(F.col("title")).alias("title_norm"))


def garble_score(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.garble(F.col("text")), 6).alias("garble"))


def filter_conj(spark, d):
    """Conjunction of conditions on records, on bare columns so that all reach the scan; null fails as the defaults 0 and 5 would."""
    return table(spark, d, "doc_records").where(conditions([("year", "gte", 2010), ("source_type", "in", ["pubmed", "who", "icmr"]), ("evidence_level", "lt", 4)])).select("record_id", "source_type")


def boosts(spark, d):
    """Type, level and boosts of records."""
    kind = C.doc_type(F.col("t"))
    level = C.evidence_level(kind)
    year = F.coalesce("year", F.lit(0))
    return documents(spark, d).select("record_id", kind.alias("doc_type"), level.alias("level"), C.evidence_boost(level).cast("double").alias("evidence_boost"), C.recency_boost(year).cast("double").alias("recency_boost"))


def extract_year(spark, d):
    return table(spark, d, "doc_records").select("record_id", text.max_year(F.col("content")).cast("bigint").alias("max_year"))


def evidence_numeric(spark, d):
    """Levels in their string forms as numbers."""
    level = C.evidence_level(C.doc_type(F.col("t")))
    return documents(spark, d).select("record_id", C.evidence_number(level).cast("bigint").alias("of_type"), C.evidence_number(F.col("evidence_level")).cast("bigint").alias("of_record"))


def doc_type(spark, d):
    return documents(spark, d).select("record_id", C.doc_type(F.col("t")).alias("doc_type"))


def study_type(spark, d):
    s = C.study_type(F.col("title"), F.col("content"))
    return table(spark, d, "doc_records").select("record_id", s["study_type"].alias("study_type"), s["level"].cast("bigint").alias("level"))


_STUDY = f"lower({S.plain('title')} || ' ' || substr({S.plain('content')}, 1, 500))"


def _study_sql(field: int) -> str:
    lit = lambda v: S.text(v) if isinstance(v, str) else str(v)
    return "case " + " ".join(f"when regexp_matches(b, {S.text(row[0])}) then {lit(row[field])}" for row in L.STUDY_TYPES) + f" else {lit(['unknown', 5][field - 1])} end"


def content_type(spark, d):
    """Content type of chunks, by section and text."""
    lower = F.lower(text.plain(F.col("text")))
    kind = C.content_type(lower, F.col("section_title"))
    return chunks(spark, d, "text", "section_title").select("chunk_id", kind.alias("content_type"), C.content_weight(kind).cast("double").alias("weight"))


_CONTENT = f"""case when {S.hits('l', L.NOISE_SIGNS)} >= 2 then 'noise' when {S.any_of('s', L.SECTION_NOISE)} then 'noise' when {S.any_of('s', L.SECTION_BACKGROUND)} then 'background'
 when {S.any_of('s', L.SECTION_PRECLINICAL)} then 'preclinical' when {S.any_of('s', L.SECTION_CLINICAL)} then 'clinical' when {S.hits('l', L.PRECLINICAL_SIGNS)} >= 2 then 'preclinical'
 when {S.hits('l', L.CLINICAL_SIGNS)} >= 1 then 'clinical' else 'background' end"""
_TYPED = f"(select *, {_CONTENT} as content_type from (select *, lower({S.plain('text')}) as l, lower({S.plain('section_title')}) as s from {_CHUNKS}))"


def specialties(spark, d):
    return documents(spark, d).select("record_id", F.array_join(C.specialties(F.col("t")), ",").alias("specialties"))


_SPECIALTIES = "array_to_string(list_slice(list_filter([" + ", ".join(f"case when {S.any_of('t', w)} then {S.text(n)} end" for n, w in L.SPECIALTIES.items()) + "], lambda x: x is not null), 1, 5), ',')"


def relevance_flags(spark, d):
    found = C.flags(F.col("t"), F.col("source_type"), F.col("journal"))
    return documents(spark, d).select("record_id", *[c.alias(n) for n, c in found.items()])


_JOURNAL = S.or_empty("journal")
_FLAGS = {
    "india_relevant": S.any_of("t", L.INDIA_WORDS),
    "has_indian_data": S.any_of("t", L.INDIA_DATA),
    "indian_source": f"(list_contains({S.listed(L.INDIA_SOURCES)}, lower(coalesce(source_type, ''))) or {S.any_of(f'lower({_JOURNAL})', L.INDIA_JOURNALS)})",
    "has_drug_dosing": S.any_of("t", L.DOSING),
    "has_lab_values": S.any_of("t", L.LABS),
}


def entities(spark, d):
    """Entities of records, as joined lists."""
    found = C.entities(F.col("t"))
    lists = [F.array_join(found[n], "|").alias(n) for n in ("diseases", "drugs", "dosages", "populations", "outcomes")]
    return documents(spark, d).select("record_id", *lists, found["has_safety_flag"].alias("has_safety_flag"))


_DOSAGES = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(t, {S.text('(' + p + ')')}, 1), lambda s: {S.strip('s')})" for p in L.DOSAGES) + ")"


def quality_score(spark, d):
    """Quality of chunks from their text, entities and evidence level of their source."""
    return _scored(spark, d).select("chunk_id", "quality")


def _scored(spark, d):
    rows = chunks(spark, d, "text", "section_title").withColumn("l", F.lower(text.plain(F.col("text"))))
    found = C.entities(F.col("l"))
    rows = rows.withColumn("content_type", C.content_type(F.col("l"), F.col("section_title"))).withColumn("entities", F.size(found["diseases"]) + F.size(found["drugs"]) + F.size(found["dosages"]))
    tokens = F.greatest(F.lit(1), text.word_count(F.col("l")))
    return rows.withColumn("quality", scoring.quality(F.col("l"), F.col("content_type"), C.study_type(F.lit(""), F.col("text"))["level"], tokens, F.col("entities"), found["has_safety_flag"]))


def _quality_sql() -> str:
    level = "case " + " ".join(f"when regexp_matches(b, {S.text(p)}) then {n}" for p, _, n in L.STUDY_TYPES) + " else 5 end"
    size = lambda c: f"len({c})"
    dosages = _DOSAGES.replace("regexp_extract_all(t,", "regexp_extract_all(l,")
    n = f"({size(S.entity_list('l', L.DISEASES, 10))} + {size(S.entity_list('l', L.DRUGS, 10))} + least(10, len(list_distinct({dosages}))))"
    length = "case when k between 50 and 300 then 0.10::double when k < 50 then k::double / 50 * 0.10::double else greatest(0.0::double, 0.10::double - (k - 300)::double / 600 * 0.10::double) end"
    raw = f"""({S.lookup('content_type', L.BASE_OF_CONTENT, L.BASE_UNKNOWN)})::double + {length} + least(0.10::double, {n} * 0.015::double) + ({S.lookup('v', L.BONUS_OF_LEVEL, 0.0)})::double
      + least(0.10::double, {S.hits('l', L.HIGH_VALUE)} * 0.02::double) + case when regexp_matches(l, {S.text(L.SAFETY)}) then 0.05::double else 0.0::double end - least(0.20::double, {S.hits('l', L.LOW_VALUE)} * 0.07::double)"""
    return f"""select chunk_id, round(greatest(0.0::double, least(1.0::double, {raw})), 4) as quality
      from (select *, {level} as v, greatest(1, {S.word_count('l')}) as k from (select *, lower(' ' || substr({S.plain('text')}, 1, 500)) as b from {_TYPED}))"""


def quality_gate(spark, d):
    """Chunks of sufficient quality."""
    return _scored(spark, d).where(F.col("quality") >= L.QUALITY_GATE).select("chunk_id", "quality")


def validate_documents_q(spark, d):
    return validate_documents(table(spark, d, "doc_records")).select("record_id", "ok", "reason")


def _garble(c: str) -> str:
    return f"case when length(coalesce({c}, '')) = 0 then 1.0::double else length(regexp_replace(coalesce({c}, ''), '[\\x20-\\x7F\\n\\t\\r]', '', 'g'))::double / length(coalesce({c}, '')) end"


_DOC_REASON = f"""case when x = '' then 'blank title' when length(x) < 5 then 'short title' when length(y) = 0 then 'blank content' when length(y) < 200 then 'short content' when length(y) > 2000000 then 'long content'
 when not list_contains({S.listed(L.SOURCE_TYPES)}, coalesce(source_type, '')) then 'unknown source' when {_garble('content')} > 0.25 then 'garbled' end"""
_CHUNK_REASON = f"""case when length(y) = 0 then 'blank' when length(y) < 80 then 'short' when length(y) > 8000 then 'long' when {_garble('text')} > 0.25 then 'garbled'
 when length(regexp_replace(y, '[^A-Za-z]', '', 'g'))::double / length(y) < 0.4 then 'few letters' end"""


_JUDGED = f"(select *, {_DOC_REASON} as reason from (select *, {S.strip(S.or_empty('title'))} as x, {S.strip(S.or_empty('content'))} as y from doc_records))"


def validate_chunks_q(spark, d):
    return validate_chunks(chunks(spark, d, "text")).select("chunk_id", "ok", "reason")


def rejected_chunks(spark, d):
    """Chunks that fail a rule, and why."""
    return validate_chunks(chunks(spark, d, "text")).where(~F.col("ok")).select("chunk_id", "reason")


def clean_lines_q(spark, d):
    """Contents with line noise removed, as hashes."""
    return table(spark, d, "doc_records").select("record_id", F.md5(clean_lines(F.col("content"))).alias("cleaned"))


_CLEAN = f"""select record_id, md5(coalesce({S.strip("array_to_string(list_filter(list_transform(regexp_split_to_array(c, '\\r\\n|\\n|\\r'), lambda s: " + S.strip("regexp_replace(s, '[" + S.BLANK + "]+', ' ', 'g')") + "), lambda s: s <> '' and not regexp_full_match(s, '\\p{Nd}+') and (length(s) >= 20 or regexp_matches(s, '[.!?;:]$'))), chr(10))")}, '')) as cleaned
 from (select record_id, coalesce(content, '') as c from doc_records)"""


def condition_tags(spark, d):
    return table(spark, d, "doc_records").select("record_id", F.array_join(C.condition_tags(F.col("title")), ",").alias("tags"))


def contextual_text(spark, d):
    """Chunk text under the four lines of its origin, as hashes."""
    from evidex.operators.chunking import contextual_text as built

    docs = documents(spark, d).groupBy("doc_id").agg(F.max_by(F.struct("source_type", "title", C.doc_type(F.col("t")).alias("kind")), "record_id").alias("r"))
    rows = chunks(spark, d, "doc_id", "section_title", "text").join(docs, "doc_id")
    return rows.select("chunk_id", F.md5(built(F.col("r.source_type"), F.col("r.kind"), F.col("r.title"), F.col("section_title"), F.col("text"))).alias("contextual"))


_CONTEXTUAL = f"""with r as (select doc_id, arg_max({{'source_type': source_type, 'title': title, 'kind': {S.doc_type('t')}}}, record_id) as r from {_DOCS} group by doc_id)
 select chunk_id, md5('Source: ' || coalesce(r.source_type, '') || chr(10) || 'Document type: ' || coalesce(r.kind, '') || chr(10) || 'Title: ' || coalesce(r.title, '') || chr(10) || 'Section: ' || coalesce(section_title, '') || chr(10) || chr(10) || coalesce(text, '')) as contextual
 from {_CHUNKS} join r using (doc_id)"""


def format_table(spark, d):
    """Table chunks of bar-separated rows as lines of header and value, as hashes."""
    from evidex.operators.chunking import pipe_table, table_text

    rows = F.transform(F.split(F.col("text"), r"\n"), lambda r: F.split(r, r"\|"))
    found = chunks(spark, d, "chunk_type", "section_title", "text").where("chunk_type = 'table' and text is not null")
    return found.select("chunk_id", F.md5(table_text(rows, F.array(F.lit("Site"), F.lit("Drug")), F.col("section_title"))).alias("formatted"), F.md5(pipe_table(rows)).alias("aligned"))


_TABLES = f"""with t as (select chunk_id, section_title, list_transform(string_split(text, chr(10)), lambda r: list_transform(string_split(r, '|'), lambda v: {S.strip('v')})) as r from {_CHUNKS} where chunk_type = 'table' and text is not null),
 w as (select *, len(list_filter(flatten(r), lambda c: c <> '')) as filled, list_transform(range(1, list_max(list_transform(r, lambda x: len(x))) + 1), lambda i: greatest(4, list_max(list_transform(r, lambda x: length(coalesce(x[i], '')))))) as ws from t),
 a as (select *, list_transform(r, lambda x: array_to_string(list_transform(ws, lambda n, i: rpad(coalesce(x[i], ''), n::int, ' ')), ' | ')) as lines from w)
 select chunk_id, md5({S.strip("""array_to_string(list_filter(list_concat([trim(coalesce(section_title, ''))], list_transform(list_slice(r, 1, 20), lambda x: array_to_string(list_transform(x, lambda v, i: case i when 1 then 'Site' when 2 then 'Drug' else 'Col' || i end || ': ' || v), ' | '))), lambda x: x <> ''), chr(10))""")}) as formatted,
  md5(case when len(r) < 2 or filled < 4 then '' else array_to_string(list_concat([lines[1], array_to_string(list_transform(ws, lambda n: repeat('-', n)), '-+-')], lines[2:]), chr(10)) end) as aligned from a"""


def cosine(spark, d):
    """Cosine of each vector with the next."""
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(after, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("b")), 8).alias("cosine"))


def sparse_roundtrip(spark, d):
    """Sparse maps taken apart, sorted, and put together again."""
    points = latest(table(spark, d, "vector_points").select("point_id", "upserted_at", "sparse_vector"), "point_id", "upserted_at")
    e = vectors.sparse_entries(F.col("sparse_vector"))
    back = vectors.sparse_of(F.transform(e, lambda x: x["key"]), F.transform(e, lambda x: x["value"]))
    total = F.aggregate(F.map_values(back), F.lit(0.0), lambda s, x: s + x)
    return points.select("point_id", F.size(e).cast("bigint").alias("n"), F.array_join(F.transform(e, lambda x: x["key"].cast("string")), ",").alias("indices"), F.round(total, 6).alias("total"))


_SPARSE = """select point_id, coalesce(len(map_keys(sparse_vector)), 0) as n, coalesce(array_to_string(list_sort(map_keys(sparse_vector)), ','), '') as indices, round(coalesce(list_sum(map_values(sparse_vector)), 0.0), 6) as total
 from (select point_id, first(sparse_vector order by upserted_at desc) as sparse_vector from vector_points where point_id is not null group by point_id)"""


def json_props(spark, d):
    """A field of JSON text; broken text gives null."""
    props = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(props["k"]).alias("parsed"), F.sum(props["k"]).cast("bigint").alias("total"))


def cache_keys(spark, d):
    """Cache keys of queries: the title of each record as a query."""
    part = F.concat_ws("|", F.lower(text.strip(F.coalesce("title", F.lit("")))), F.lit("{}"))
    return table(spark, d, "doc_records").select("record_id", F.concat(F.lit("search:v1:hits:"), F.substring(F.sha2(part, 256), 1, 16)).alias("cache_key"))


def point_lookup(spark, d):
    """One record by key."""
    return table(spark, d, "doc_records").where("record_id = 7").select("record_id", "doc_id", "title").limit(1)


def doc_ids_by_source(spark, d):
    """Distinct document keys of one source."""
    return table(spark, d, "doc_records").where("source_type = 'who'").select("doc_id").distinct()


def index_rows(spark, d):
    """Payloads of the index: every chunk with the metadata of the newest record of its document, lists joined."""
    docs = documents(spark, d).select("doc_id", "record_id", "source_type", "title", "year", "journal", "doi", "t")
    found = payload(chunks(spark, d, "doc_id", "chunk_type", "section_title", "chunk_index", "total_chunks"), latest(docs, "doc_id", "record_id"))
    lists = {n: F.array_join(n, "|") for n in ("authors", "specialty", "mesh_terms", "keywords")}
    whole = {n: F.col(n).cast("bigint") for n in ("year", "chunk_index", "total_chunks")}
    return found.withColumns({**lists, **whole, "evidence_boost": F.col("evidence_boost").cast("double")})


def _index_sql() -> str:
    level = S.lookup("kind", L.LEVEL_OF_TYPE, "unknown")
    return f"""with r as (select doc_id, arg_max({{'source_type': source_type, 'title': title, 'year': year, 'journal': journal, 'doi': doi, 't': t}}, record_id) as r from {_DOCS} group by doc_id),
 e as (select doc_id, r.source_type as source_type, r.title as title, r.year as year, r.journal as journal, r.doi as doi, r.t as t, {S.doc_type('r.t')} as kind from r)
 select c.doc_id as doc_id, c.chunk_id as chunk_id, coalesce(c.chunk_type, '') as chunk_type, coalesce(source_type, 'unknown') as source, kind as doc_type, {level} as evidence_level, ({S.evidence_boost('(' + level + ')')})::double as evidence_boost, {S.strip("coalesce(title, '')")} as title,
  coalesce(nullif(greatest(coalesce(year, 0), 0), 0), {_year('t')})::bigint as year, {S.strip("coalesce(journal, '')")} as journal, '' as authors, coalesce(doi, '') as doi, '' as pmid, {_SPECIALTIES.replace("','", "'|'")} as specialty, '' as mesh_terms, '' as keywords,
  coalesce(c.section_title, '') as section_title, c.chunk_index::bigint as chunk_index, c.total_chunks::bigint as total_chunks, coalesce(c.chunk_type, '') = 'table' as has_table, {', '.join(f'{x} as {n}' for n, x in _FLAGS.items())}
 from {_CHUNKS} c join e using (doc_id)"""


def normalize_docs(spark, d):
    """Document keys: by DOI, else by a hash of address, title and content; years that are no number are 0."""
    key = document_key(F.lit(None).cast("string"), F.col("doi"), F.col("url"), F.col("title"), F.col("content"))
    return table(spark, d, "doc_records").select("record_id", key.alias("key"), F.coalesce("year", F.lit(0)).cast("bigint").alias("year"))


_NORMAL = f"""select record_id, case when d <> '' then 'doi_' || replace(d, '/', '_') else 'doc_' || substr(sha1(coalesce(url, '') || '|' || coalesce(title, '') || '|' || coalesce(content, '')), 1, 12) end as key, coalesce(year, 0)::bigint as year
 from (select *, {S.strip("coalesce(doi, '')")} as d from doc_records)"""


def enrich(spark, d):
    """Everything derived of a record in one pass."""
    kind = C.doc_type(F.col("t"))
    found = C.flags(F.col("t"), F.col("source_type"), F.col("journal"))
    year = F.when(F.coalesce("year", F.lit(0)) > 0, F.col("year")).otherwise(text.max_year(F.col("t")))
    return documents(spark, d).select(
        "record_id", kind.alias("doc_type"), C.evidence_level(kind).alias("level"), C.evidence_boost(C.evidence_level(kind)).cast("double").alias("boost"),
        F.array_join(C.specialties(F.col("t")), ",").alias("specialties"), year.cast("bigint").alias("year"), *[c.alias(n) for n, c in found.items()],
    )


def _year(c: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({c}, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), lambda y: y::bigint)), 0)"


def _enrich_sql() -> str:
    level = S.lookup("doc_type", L.LEVEL_OF_TYPE, "unknown")
    flags = ", ".join(f"{c} as {n}" for n, c in _FLAGS.items())
    return f"""select record_id, doc_type, {level} as level, ({S.evidence_boost('(' + level + ')')})::double as boost, {_SPECIALTIES} as specialties,
      case when coalesce(year, 0) > 0 then year::bigint else {_year('t')} end as year, {flags} from (select *, {S.doc_type('t')} as doc_type from {_DOCS})"""


_LEVEL = S.lookup(f"({S.doc_type('t')})", L.LEVEL_OF_TYPE, "unknown")
_NUMBER = lambda c: f"case when regexp_full_match({c}, '-?\\d{{1,9}}') then greatest(1, least(5, try_cast({c} as bigint))) when regexp_matches({c}, '^[1-5]') then try_cast(substr({c}, 1, 1) as bigint) else 3 end"

QUERIES = {
    "token_estimates": (token_estimates, f"select chunk_id, {S.length_tokens('text')} as by_length, floor({S.word_count('text')} * 1.3::double)::bigint as by_words from {_CHUNKS}"),
    "content_hash": (content_hash, f"select record_id, sha256({S.normal('content')}) as hash from doc_records"),
    "content_hash_short": (content_hash_short, f"select record_id, substr(sha256(array_to_string(list_filter([{S.strip(S.or_empty('title'))}, {S.strip(S.or_empty('content'))}], lambda p: p <> ''), '|')), 1, 16) as hash from doc_records"),
    "title_norm": (title_norm, f"select record_id, {S.title_norm('title')} as title_norm from doc_records"),
    "garble_score": (garble_score, f"select doc_id, round({_garble('text')}, 6) as garble from documents"),
    "filter_conj": (filter_conj, "select record_id, source_type from doc_records where coalesce(year, 0) >= 2010 and source_type in ('pubmed', 'who', 'icmr') and coalesce(evidence_level, 5) < 4"),
    "boosts": (boosts, f"select record_id, {S.doc_type('t')} as doc_type, {_LEVEL} as level, ({S.evidence_boost('(' + _LEVEL + ')')})::double as evidence_boost, ({S.recency_boost('coalesce(year, 0)')})::double as recency_boost from {_DOCS}"),
    "extract_year": (extract_year, f"select record_id, {_year(S.plain('content'))} as max_year from doc_records"),
    "evidence_numeric": (evidence_numeric, f"select record_id, {_NUMBER('lv')} as of_type, {_NUMBER('rv')} as of_record from (select record_id, {_LEVEL} as lv, coalesce(evidence_level::varchar, '') as rv from {_DOCS})"),
    "doc_type": (doc_type, f"select record_id, {S.doc_type('t')} as doc_type from {_DOCS}"),
    "study_type": (study_type, f"select record_id, {_study_sql(1)} as study_type, ({_study_sql(2)})::bigint as level from (select record_id, {_STUDY} as b from doc_records)"),
    "content_type": (content_type, f"select chunk_id, content_type, ({S.lookup('content_type', L.WEIGHT_OF_CONTENT, 0.7)})::double as weight from {_TYPED}"),
    "specialties": (specialties, f"select record_id, {_SPECIALTIES} as specialties from {_DOCS}"),
    "relevance_flags": (relevance_flags, "select record_id, " + ", ".join(f"{c} as {n}" for n, c in _FLAGS.items()) + f" from {_DOCS}"),
    "entities": (entities, "select record_id, " + ", ".join(f"array_to_string({S.entity_list('t', p, 10)}, '|') as {n}" for n, p in (("diseases", L.DISEASES), ("drugs", L.DRUGS), ("populations", L.POPULATIONS), ("outcomes", L.OUTCOMES))) + f", array_to_string(list_slice(list_filter({_DOSAGES}, lambda s, i: list_position({_DOSAGES}, s) = i), 1, 10), '|') as dosages, regexp_matches(t, {S.text(L.SAFETY)}) as has_safety_flag from {_DOCS}"),
    "quality_score": (quality_score, _quality_sql()),
    "quality_gate": (quality_gate, f"select * from ({_quality_sql()}) where quality >= 0.3"),
    "validate_documents": (validate_documents_q, f"select record_id, reason is null as ok, reason from {_JUDGED}"),
    "validate_chunks": (validate_chunks_q, f"select chunk_id, reason is null as ok, reason from (select chunk_id, {_CHUNK_REASON} as reason from (select *, {S.strip(S.or_empty('text'))} as y from {_CHUNKS}))"),
    "rejected_chunks": (rejected_chunks, f"select chunk_id, reason from (select chunk_id, {_CHUNK_REASON} as reason from (select *, {S.strip(S.or_empty('text'))} as y from {_CHUNKS})) where reason is not null"),
    "clean_lines": (clean_lines_q, _CLEAN),
    "condition_tags": (condition_tags, f"select record_id, array_to_string(list_filter(w, lambda x, i: length(x) >= 4 and not list_contains({S.listed(L.TAG_NOISE)}, x) and list_position(w, x) = i), ',') as tags from (select record_id, regexp_extract_all(lower({S.plain('title')}), '[a-z0-9\\-]+') as w from doc_records)"),
    "contextual_text": (contextual_text, _CONTEXTUAL),
    "format_table": (format_table, _TABLES),
    "cosine": (cosine, "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 8) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"),
    "sparse_roundtrip": (sparse_roundtrip, _SPARSE),
    "json_props": (json_props, "select event_type, count(*) as n, count(try_cast(props->>'$.k' as bigint)) as parsed, sum(try_cast(props->>'$.k' as bigint))::bigint as total from events group by event_type"),
    "cache_keys": (cache_keys, f"select record_id, 'search:v1:hits:' || substr(sha256(lower({S.strip(S.or_empty('title'))}) || '|{{}}'), 1, 16) as cache_key from doc_records"),
    "point_lookup": (point_lookup, "select record_id, doc_id, title from doc_records where record_id = 7"),
    "doc_ids_by_source": (doc_ids_by_source, "select distinct doc_id from doc_records where source_type = 'who'"),
    "index_rows": (index_rows, _index_sql()),
    "normalize_docs": (normalize_docs, _NORMAL),
    "enrich": (enrich, _enrich_sql()),
}
