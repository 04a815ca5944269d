"""Queries of query understanding and retrieval. Questions are a fixed short list, in the queries named ``_titles`` the titles of the table; vectors are searched for every row whose id 50 divides."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from evidex.functions import classify as C
from evidex.functions import lexicons as L
from evidex.functions import text
from evidex.operators import retrieve as R
from evidex.operators import texts
from evidex.plans import sql as S
from evidex.plans.expressions import _DOCS, documents
from evidex.runtime import materialize, table

#: Questions of the kinds the operators tell apart.
QUESTIONS = [
    "What is the treatment of hypertension in adults with diabetes?",
    "latest guideline on metformin dose in India",
    "Symptoms of dengue and malaria or sepsis",
    "prognosis after stroke: survival and mortality risk of relapse",
    "warfarin vs aspirin interaction with other medication in atrial fibrillation",
    "side effects and contraindications of amlodipine",
    "Is it safe to combine insulin and losartan? Should I monitor creatinine and potassium? Can I stop one of them or reduce the dose?",
    "heart attack drug of choice",
    "tb treatment protocol 2024",
    "asthma in pregnant women and psoriasis and gout and epilepsy",
    "htn and dm with copd management",
    "platelet count reduction after rheumatoid arthritis trial",
]
_Q = "(values " + ", ".join(f"({i}::bigint, {S.text(q)})" for i, q in enumerate(QUESTIONS)) + ") as q(query_id, query)"


def questions(spark, d=None):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")


def titles(spark, d):
    """The title of each record as a question."""
    return table(spark, d, "doc_records").select(F.col("record_id").cast("bigint").alias("query_id"), F.coalesce("title", F.lit("")).alias("query"))


def searched_titles(spark, d):
    """Those of ids that 50 divides: the questions of searches."""
    return titles(spark, d).where("query_id % 50 = 0")


TITLES = "(select record_id::bigint, coalesce(title, '') from doc_records) as q(query_id, query)"
SEARCHED_TITLES = TITLES.replace(" from doc_records", " from doc_records where record_id % 50 = 0")


def over_titles(found: dict, row_wise: tuple, searches: tuple) -> dict:
    """The queries of those names once more, with the titles of the table in place of the short list.

    The SQL is that of the short list with this one relation replaced.
    """
    rows = {f"{n}_titles": (partial(found[n][0], asked=titles), found[n][1].replace(_Q, TITLES)) for n in row_wise}
    return rows | {f"{n}_titles": (partial(found[n][0], asked=searched_titles), found[n][1].replace(_Q, SEARCHED_TITLES)) for n in searches}


def _lower():
    return F.lower(F.trim("query"))


def query_intent(spark, d, asked=questions):
    return asked(spark, d).select("query_id", C.query_intent(_lower()).alias("intent"))


def query_expand(spark, d, asked=questions):
    return asked(spark, d).select("query_id", F.array_join(C.expansions(_lower()), "|").alias("terms"))


def infer_filters(spark, d, asked=questions):
    rows = asked(spark, d).select("query_id", F.explode(C.inferred_filters(_lower())).alias("f"))
    return rows.select("query_id", "f.field", "f.op", "f.value")


def query_entities(spark, d, asked=questions):
    """Named classes in a question, where no model tells them."""
    found = F.filter(F.array(*[F.when(_lower().contains(word), F.struct(F.lit(kind).alias("kind"), F.lit(word).alias("entity"))) for kind, word in L.QUERY_ENTITIES]), lambda x: x.isNotNull())
    return asked(spark, d).select("query_id", F.explode(found).alias("e")).select("query_id", "e.kind", "e.entity")


def query_rewrite(spark, d, asked=questions):
    return asked(spark, d).select("query_id", C.rewritten(F.col("query")).alias("rewritten"), text.first_of(F.lower("query"), L.REWRITE_INTENTS, "general").alias("intent"), F.array_join(C.search_terms(F.col("query")), "|").alias("terms"))


def _rewrite_sql() -> str:
    terms = [f"case when contains(lower(query), {S.text(short)}) then {S.text(full)} end" for short, full in L.ABBREVIATIONS.items()]
    inner = f"select query_id, query, query as r from {_Q}"
    for short, full in L.ABBREVIATIONS.items():
        inner = f"select query_id, query, if(contains(lower(query), {S.text(short)}), replace(r, {S.text(short)}, {S.text(full)}), r) as r from ({inner})"
    return f"select query_id, r as rewritten, {S.first_of('lower(query)', L.REWRITE_INTENTS, 'general')} as intent, array_to_string(list_filter([{', '.join(terms)}], lambda x: x is not null), '|') as terms from ({inner})"


def _expand_sql() -> str:
    parts = [f"case when contains(lower(trim(query)), {S.text(t)}) then {S.listed(w)} else [] end" for t, w in L.SYNONYMS.items()]
    flat = f"flatten([{', '.join(parts)}])"
    return f"select query_id, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), '|') as terms from (select query_id, {flat} as f from {_Q})"


def _filters_sql() -> str:
    l = "lower(trim(query))"  # noqa: E741
    intent = S.first_of(l, L.INTENTS, "general")
    return f"""select query_id, field, op, value from (
      select query_id, 'year' as field, 'gte' as op, '2020' as value, {S.any_of(l, L.RECENT)} as holds from {_Q}
      union all select query_id, 'doc_type', 'in', 'guideline,systematic_review,meta_analysis', {S.any_of(l, L.GUIDED)} from {_Q}
      union all select query_id, 'india_relevant', 'eq', 'true', {S.any_of(l, L.INDIAN)} from {_Q}
      union all select query_id, 'has_drug_dosing', 'eq', 'true', ({intent}) = 'therapeutic' and {S.any_of(l, L.DOSED)} from {_Q}) where holds"""


def tokenize(spark, d):
    """Terms of each record's content, as hashes of the list."""
    t = text.clinical_tokens(F.col("content"))
    return table(spark, d, "doc_records").select("record_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("terms"))


def term_freq(spark, d):
    """How often each term occurs in all contents, and in how many."""
    terms = table(spark, d, "doc_records").select("record_id", F.explode(text.clinical_tokens(F.col("content"))).alias("term"))
    per = terms.groupBy("record_id", "term").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").cast("bigint").alias("n"), F.count("*").alias("records"))


def sparse_vectors(spark, d):
    """Postings of the contents."""
    found = R.sparse_vectors(table(spark, d, "doc_records"), "record_id", "content")
    return found.select("record_id", F.col("idx").cast("bigint").alias("idx"), F.round("weight", 8).alias("weight"))


def _postings(source: str, key: str, c: str) -> str:
    return f"""(with tk as (select {key}, {S.tokens(c)} as t from {source}), tf as (select {key}, term, count(*) as n, max(total) as total from (select {key}, unnest(t) as term, len(t) as total from tk) group by {key}, term),
      tw as (select {key}, term, n::double / total * ({S.idf('term')})::double as w from tf) select {key}, {S.bucket('term', L.BUCKETS)} as idx, sum(w) as weight from tw where w > 0.001 group by 1, 2)"""


def legacy_sparse(spark, d):
    """Raw counts of ASCII words of the titles in two million buckets."""
    found = R.legacy_sparse(table(spark, d, "doc_records"), "record_id", "title")
    return found.select("record_id", F.col("idx").cast("bigint").alias("idx"), "weight")


_LEGACY = f"select record_id, {S.bucket('term', L.LEGACY_BUCKETS)} as idx, count(*)::double as weight from (select record_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{{2,}}')) as term from doc_records) group by 1, 2"


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), e


def dense_topk(spark, d):
    """The ten most similar vectors of every vector whose id 50 divides."""
    q, e = _vectors(spark, d)
    return R.dense_topk(q, e, 10).select("query_id", "id", F.round("score", 8).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense_topk_filtered(spark, d):
    """As dense_topk, among the vectors of some labels."""
    q, e = _vectors(spark, d)
    return R.dense_topk(q, e, 5, [("label", "in", [1, 3, 5])]).select("query_id", "id", F.round("score", 8).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _dense_sql(k: int, where: str = "true") -> str:
    return f"""select query_id, id, round(score, 8) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank from (
      select a.vec_id as query_id, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and {where})) where rank < {k}"""


def sparse_topk(spark, d, asked=questions):
    """The ten records that share most weight of terms with each question."""
    q = R.sparse_vectors(asked(spark, d), "query_id", "query")
    return R.sparse_topk(q, R.sparse_vectors(table(spark, d, "doc_records"), "record_id", "content").withColumnRenamed("record_id", "id"), 10).select("query_id", "id", F.round("score", 8).alias("score"))


def _sparse_topk_sql(k: int) -> str:
    return f"""select query_id, id, round(score, 8) as score from (select *, row_number() over (partition by query_id order by score desc, id) as n from (
      select query_id, p.record_id as id, round(sum(v.weight * p.weight), 9) as score from {_postings(_Q, 'query_id', 'query')} v join {_postings('doc_records', 'record_id', 'content')} p using (idx) group by 1, 2)) where n <= {k}"""


def _lists(spark, d, k):
    """Dense hits over vectors and sparse hits over documents that share ids with them."""
    q, e = _vectors(spark, d)
    dense = R.dense_topk(q, e, k)
    docs = table(spark, d, "documents").select("doc_id", "text")
    postings = materialize(R.sparse_vectors(docs, "doc_id", "text").withColumnRenamed("doc_id", "id"), "postings")
    asked = postings.join(q.select(F.col("query_id").alias("id")), "id", "left_semi").withColumnRenamed("id", "query_id")
    return dense, R.sparse_topk(asked, postings, k)


def rrf_plain(spark, d):
    """Dense and sparse lists of fifty fused by reciprocal ranks."""
    found = R.rrf(*_lists(spark, d, L.HITS_TOP))
    return found.select("query_id", "id", F.round("score", 8).alias("score"), "found_by")


def rrf_fuse(spark, d):
    """As rrf_plain, with boosts by evidence and year, the best twenty."""
    docs = table(spark, d, "documents")
    kind = C.doc_type(F.lower(F.concat(text.plain(F.col("title")), F.lit(" "), text.plain(F.col("text")))))
    levels = docs.select(F.col("doc_id").alias("id"), C.evidence_level(kind).alias("evidence_level"), "year")
    return R.fuse(*_lists(spark, d, L.HITS_TOP), levels).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"), "found_by")


def _rrf_sql() -> str:
    return f"""with p as materialized {_postings('documents', 'doc_id', 'text')}, dn as ({_dense_sql(L.HITS_TOP)}),
     sp as (select query_id, id, row_number() over (partition by query_id order by score desc, id) - 1 as rank from (select v.doc_id as query_id, p.doc_id as id, round(sum(v.weight * p.weight), 9) as score from p v join p using (idx)
       where v.doc_id in (select vec_id from embeddings where vec_id % 50 = 0) group by 1, 2) qualify rank < {L.HITS_TOP}),
     f as (select coalesce(dn.query_id, sp.query_id) as query_id, coalesce(dn.id, sp.id) as id, dn.rank as dr, sp.rank as sr, coalesce(1.0::double / ({L.RRF_K} + dn.rank + 1), 0) + coalesce(1.0::double / ({L.RRF_K} + sp.rank + 1), 0) as score,
       case when dn.rank is null then 'sparse' when sp.rank is null then 'dense' else 'both' end as found_by from dn full outer join sp on dn.query_id = sp.query_id and dn.id = sp.id)"""


def _fuse_sql() -> str:
    level = S.lookup(S.doc_type("t"), L.LEVEL_OF_TYPE, "unknown")
    return f"""{_rrf_sql()}, dd as (select doc_id as id, {level} as level, year from (select doc_id, year, lower({S.plain('title')} || ' ' || {S.plain('text')}) as t from documents)),
     b as (select query_id, f.id, dr, sr, found_by, round(score * ({S.evidence_boost("coalesce(level, '')")})::double * ({S.recency_boost('coalesce(year, 0)')})::double, 10) as score from f left join dd on f.id = dd.id)
     select query_id, id, score, row_number() over (partition by query_id order by score desc, dr nulls last, sr nulls last, id) - 1 as rank, found_by from b qualify rank < {L.FUSED_TOP}"""


def mmr(spark, d):
    """Six diverse of the twenty nearest of each vector whose id 50 divides."""
    q, e = _vectors(spark, d)
    hits = R.dense_topk(q, e, 20).join(e.select("id", "vector"), "id")
    return R.mmr(hits).select("query_id", F.col("pos").cast("bigint").alias("pos"), "id")


_MMR = f"""with recursive c as materialized ({_dense_sql(20)}), s as materialized (select a.query_id, a.id as x, b.id as y, list_cosine_similarity(v.embedding::double[], w.embedding::double[]) as sim
   from c a join c b using (query_id) join embeddings v on v.vec_id = a.id join embeddings w on w.vec_id = b.id),
 m(query_id, pos, id, chosen) as (select query_id, 0::bigint, id, [id] from c where rank = 0
  union all select query_id, pos, id, chosen from (select m.query_id, m.pos + 1 as pos, c.id, list_append(m.chosen, c.id) as chosen,
    row_number() over (partition by m.query_id order by 0.7::double * c.score - (1 - 0.7::double) * (select max(sim) from s where s.query_id = c.query_id and s.x = c.id and list_contains(m.chosen, s.y)) desc, c.score desc, c.id) as n
    from m join c on c.query_id = m.query_id and not list_contains(m.chosen, c.id) where m.pos < 5) where n = 1)
 select query_id, pos, id from m"""


def _hits(spark, d, asked=questions):
    """The twenty records that share most weight of terms with each question."""
    records = table(spark, d, "doc_records").select(F.col("record_id").alias("id"), F.col("content").alias("text"))
    return texts.search(asked(spark, d), records, 20).drop("of")


def _context(spark, d, asked=questions):
    """Chunks of the records found for each question, in order of rank."""
    hits = _hits(spark, d, asked)
    docs = documents(spark, d).withColumn("kind", C.doc_type(F.col("t"))).withColumn("level", C.evidence_level(F.col("kind"))).withColumn("india", text.contains_any(F.col("t"), L.INDIA_WORDS))
    return hits.join(docs.withColumnRenamed("record_id", "id"), "id")


def context_prefix(spark, d, asked=questions):
    """Numbered blocks within the character budget of each question."""
    rows = _context(spark, d, asked)
    block = R.context_block(F.col("rank") + 1, F.col("title"), F.coalesce("year", F.lit(0)), F.col("journal"), F.col("level"), F.col("kind"), F.col("india"), F.col("content"))
    found = R.context_prefix(rows.select("query_id", F.col("rank").alias("pos"), "id", block.alias("block")))
    return found.select("query_id", F.col("pos").cast("bigint").alias("pos"), "id", F.md5("block").alias("block"))


def _context_sql() -> str:
    label = S.lookup("level", L.LABEL_OF_LEVEL, L.NO_LABEL)
    kind = "array_to_string(list_transform(string_split(replace(kind, '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
    return f"""with h as (select query_id, id, row_number() over (partition by query_id order by score desc, id) - 1 as pos from ({_sparse_topk_sql(20).replace('round(score, 8) as score', 'score')})),
      x as (select *, {S.lookup('kind', L.LEVEL_OF_TYPE, 'unknown')} as level from (select *, {S.doc_type('t')} as kind, {S.any_of('t', L.INDIA_WORDS)} as india from {_DOCS})),
      b as (select query_id, pos, id, '[' || (pos + 1) || '] ' || coalesce(title, 'Untitled') || ' (' || coalesce(year, 0) || ', ' || coalesce(journal, '') || ')' || chr(10) || 'Evidence: ' || {label} || ' | ' || {kind} || case when india then ' India-relevant' else '' end || chr(10) || coalesce(content, '') as block
        from h join x on h.id = x.record_id)
      select query_id, pos, id, md5(block) as block from (select *, sum(length(block)) over (partition by query_id order by pos) as upto from b) where upto <= {L.CONTEXT_CHARS}"""


def citations(spark, d, asked=questions):
    """Numbered citations of the hits of each question."""
    rows = _context(spark, d, asked)
    pmid = F.regexp_extract("doc_id", r"^pmid_(\d+)$", 1)
    url = F.when(pmid == "", "").otherwise(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid))
    return rows.select("query_id", (F.col("rank") + 1).cast("bigint").alias("number"), "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("doi", F.lit("")).alias("doi"), "level", url.alias("source_url"))


_CITATIONS = f"""with h as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as number from ({_sparse_topk_sql(20).replace('round(score, 8) as score', 'score')}))
 select query_id, number, id, coalesce(title, '') as title, coalesce(doi, '') as doi, {S.lookup(S.doc_type('t'), L.LEVEL_OF_TYPE, 'unknown')} as level,
 case when regexp_full_match(doc_id, 'pmid_\\d+') then 'https://pubmed.ncbi.nlm.nih.gov/' || substr(doc_id, 6) else '' end as source_url from h join {_DOCS} x on h.id = x.record_id"""


def rerank_topk(spark, d, asked=questions):
    """The best eight of the hits of each question by a lexical stand-in for the reranking model: shared terms in the first 512 characters."""
    rows = _context(spark, d, asked).join(asked(spark, d), "query_id")
    asked, held = F.array_distinct(text.clinical_tokens(F.col("query"))), F.array_distinct(text.clinical_tokens(F.substring("content", 1, 512)))
    scored = rows.select("query_id", "id", F.size(F.array_intersect(asked, held)).cast("double").alias("score"))
    return R._best(scored, L.RERANK_TOP, "query_id").select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


_RERANK = f"""with h as (select query_id, id from ({_sparse_topk_sql(20)})), s as (select query_id, h.id, len(list_distinct(list_intersect({S.tokens('q.query')}, {S.tokens("substr(coalesce(content, ''), 1, 512)")})))::double as score
   from h join {_Q} using (query_id) join doc_records x on x.record_id = h.id)
 select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 as rank from s qualify rank < {L.RERANK_TOP}"""

QUERIES = {
    "query_intent": (query_intent, f"select query_id, {S.first_of('lower(trim(query))', L.INTENTS, 'general')} as intent from {_Q}"),
    "query_expand": (query_expand, _expand_sql()),
    "infer_filters": (infer_filters, _filters_sql()),
    "query_entities": (query_entities, " union all ".join(f"select query_id, {S.text(k)} as kind, {S.text(w)} as entity from {_Q} where contains(lower(trim(query)), {S.text(w)})" for k, w in L.QUERY_ENTITIES)),
    "query_rewrite": (query_rewrite, _rewrite_sql()),
    "tokenize": (tokenize, f"select record_id, len(t)::bigint as n, md5(array_to_string(t, ' ')) as terms from (select record_id, {S.tokens('content')} as t from doc_records)"),
    "term_freq": (term_freq, f"select term, sum(n)::bigint as n, count(*) as records from (select record_id, term, count(*) as n from (select record_id, unnest({S.tokens('content')}) as term from doc_records) group by 1, 2) group by term"),
    "sparse_vectors": (sparse_vectors, f"select record_id, idx, round(weight, 8) as weight from {_postings('doc_records', 'record_id', 'content')}"),
    "legacy_sparse": (legacy_sparse, _LEGACY),
    "dense_topk": (dense_topk, _dense_sql(10)),
    "dense_topk_filtered": (dense_topk_filtered, _dense_sql(5, "b.label in (1, 3, 5)")),
    "sparse_topk": (sparse_topk, _sparse_topk_sql(10)),
    "rrf_plain": (rrf_plain, _rrf_sql() + " select query_id, id, round(score, 8) as score, found_by from f"),
    "rrf_fuse": (rrf_fuse, _fuse_sql()),
    "mmr": (mmr, _MMR),
    "context_prefix": (context_prefix, _context_sql()),
    "citations": (citations, _CITATIONS),
    "rerank_topk": (rerank_topk, _RERANK),
}
ROW_WISE, SEARCHES = ("query_intent", "query_expand", "infer_filters", "query_entities", "query_rewrite"), ("sparse_topk", "context_prefix", "citations", "rerank_topk")
QUERIES |= over_titles(QUERIES, ROW_WISE, SEARCHES)
