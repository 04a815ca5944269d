"""Queries of routing, decomposition, contradictions, checks of answers, and monitoring.

Answers under check: the first section of text of each chunk stands for an answer, its document's
content for the evidence, so that every chunk of the table is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidex.functions import classify as C
from evidex.functions import lexicons as L
from evidex.functions import scoring, text
from evidex.operators import answers, checks, monitoring, texts, understand
from evidex.operators import retrieve as R
from evidex.plans import sql as S
from evidex.operators.validate import validate_documents
from evidex.plans.expressions import _CHUNKS, _DOCS, _JUDGED, chunks
from evidex.plans.retrieval import _Q, _context, _dense_sql, _hits, _lower, _postings, _sparse_topk_sql, _vectors, over_titles, questions
from evidex.runtime import materialize, table

NOW = 2026  # the year citations are aged against


def route(spark, d, asked=questions):
    """How complex each question is, and the aspects to search for."""
    found = C.route(_lower())
    cols = {n: F.array_join(c, ",") if n in ("aspects", "diseases", "drugs") else c.cast("bigint") if n in ("patterns", "entities") else c.cast("double") if n in ("structure", "confidence") else c for n, c in found.items()}
    return asked(spark, d).select("query_id", *[c.alias(n) for n, c in cols.items()])


def _route_sql() -> str:
    extra = "case when complexity = 'complex' then ['safety', 'interactions', 'contraindications'] else [] end"
    base = "case intent " + " ".join(f"when {S.text(n)} then {S.listed(a)}" for n, a in L.ROUTE_ASPECTS.items()) + " else [] end"
    compare = f"case when {S.hits('q', [L.ROUTE_PATTERNS[i] for i in L.ROUTE_COMPARING])} > 0 then ['comparison'] else [] end"
    decide = lambda a: f"""case when p >= 2 then {a[0]} when p = 1 and (e >= 3 or s > 0.5) then {a[1]} when p = 1 and e >= 2 then {a[2]} when p = 1 then {a[3]} when e >= 4 then {a[4]} when e >= 3 and s > 0.4 then {a[5]}
      when e >= 3 then {a[6]} when e >= 2 and s > 0.5 then {a[7]} when e >= 2 then {a[8]} else {a[9]} end"""  # noqa: E731
    kinds = decide(["'complex'", "'complex'", "'medium'", "'medium'", "'complex'", "'complex'", "'medium'", "'medium'", "'simple'", "'simple'"])
    sure = decide(["0.95", "0.90", "0.70", "0.65", "0.85", "0.80", "0.65", "0.60", "0.80", "0.75"])
    score = f"""least(1.0::double, (case when w > 20 then 0.3 else 0 end)::double + (case when w > 40 then 0.2 else 0 end)::double + (case when len(regexp_extract_all(q, '\\?')) > 1 then 0.4 else 0 end)::double
      + (case when contains(q, ' or ') then 0.2 else 0 end)::double + (case when {S.any_of('q', L.ROUTE_ADVICE)} then 0.3 else 0 end)::double)"""
    return f"""with a as (select query_id, lower(trim(query)) as q from {_Q}), b as (select *, {S.hits('q', L.ROUTE_PATTERNS)} as p, len({S.present('q', L.ROUTE_TERMS)}) + len(regexp_extract_all(q, ' and ')) as e, len(regexp_extract_all(q, '\\S+')) as w from a),
      c as (select *, {score} as s from b), f as (select *, {kinds} as complexity, ({sure})::double as confidence, {S.first_of('q', L.ROUTE_INTENTS, 'general')} as intent from c), g as (select *, list_concat({base}, {extra}, {compare}) as x from f)
      select query_id, p::bigint as patterns, e::bigint as entities, round(s, 6) as structure, complexity, confidence, intent, array_to_string(list_slice(list_filter(x, lambda y, i: list_position(x, y) = i), 1, 6), ',') as aspects,
        array_to_string({S.present('q', L.ROUTE_DISEASES)}, ',') as diseases, array_to_string({S.present('q', L.ROUTE_DRUGS)}, ',') as drugs from g"""


def decompose(spark, d, asked=questions):
    """Sub-queries of each question by rule."""
    return understand.decompose(asked(spark, d)).withColumn("priority", F.col("priority").cast("bigint"))


def _decompose_sql() -> str:
    parts = []
    for name, lead, focus, priority, source, words in L.SUB_QUERIES:
        test = S.any_of("lower(query)", words) if words else "true"
        if focus in ("treatment", "dosage"):
            test = f"({test} or ({S.first_of('lower(query)', L.INTENTS, 'general')}) = 'therapeutic')"
        parts.append(f"select query_id, {S.text(name)} as sub_id, {S.text(lead)} || query as sub_query, {S.text(focus)} as focus, {priority}::bigint as priority, {S.text(source) if source else 'null'} as source_filter from {_Q} where {test}")
    return " union all ".join(parts)


def _subquery_hits(spark, d, asked):
    subs = understand.decompose(asked(spark, d)).withColumn("key", F.concat_ws("/", F.col("query_id").cast("string"), "sub_id"))
    keyed = subs.select(F.col("key").alias("query_id"), F.col("sub_query").alias("query"))
    hits = texts.search(keyed, table(spark, d, "doc_records").select(F.col("record_id").alias("id"), F.col("content").alias("text")), 5, 5)
    found = answers.lists_in_turn(hits, 5, "query_id")
    return found.select(F.split("query_id", "/")[0].cast("bigint").alias("query_id"), F.split("query_id", "/")[1].alias("sub_id"), "id", F.col("rank").cast("bigint").alias("rank"))


def subquery_merge(spark, d, asked=questions):
    """Hits of the sub-queries of each question: the dense list first, then the sparse one, a record once, the best five."""
    return _subquery_hits(spark, d, asked)


def _merge_sql() -> str:
    vec = lambda source, key: f"(select {key}, list_transform(range(64), lambda i: coalesce(m[i], 0.0)) as v from (select {key}, map(list(i), list(w)) as m from (select {key}, idx % 64 as i, round(sum(weight), 6) as w from {source} group by 1, 2) group by 1))"
    return f"""with s as (select query_id::varchar || '/' || sub_id as query_id, sub_query as query from ({_decompose_sql()})), sq as materialized {_postings('s', 'query_id', 'query')}, rp as materialized {_postings('doc_records', 'record_id', 'content')},
      dn as (select query_id, id, row_number() over (partition by query_id order by score desc, id) - 1 as rank, 0 as o from (select a.query_id, b.record_id as id, round(list_cosine_similarity(a.v, b.v), 9) as score from {vec('sq', 'query_id')} a, {vec('rp', 'record_id')} b) qualify rank < 5),
      sp as (select query_id, id, row_number() over (partition by query_id order by score desc, id) - 1 as rank, 1 as o from (select query_id, record_id as id, round(sum(sq.weight * rp.weight), 9) as score from sq join rp using (idx) group by 1, 2) qualify rank < 5),
      u as (select query_id, id, o, rank from (select * from dn union all select * from sp) qualify row_number() over (partition by query_id, id order by o, rank) = 1)
      select split_part(query_id, '/', 1)::bigint as query_id, split_part(query_id, '/', 2) as sub_id, id, row_number() over (partition by query_id order by o, u.rank, id) - 1 as rank from u qualify row_number() over (partition by query_id order by o, u.rank, id) <= 5"""


def deep_confidence(spark, d, asked=questions):
    """Confidence over the sub-queries of a question: share with hits, mean hits, contradictions."""
    return answers.deep_confidence(understand.decompose(asked(spark, d)), subquery_merge(spark, d, asked), contradictions(spark, d, asked))


def _deep_sql() -> str:
    return f"""with a as (select query_id, count(*) as subs from ({_decompose_sql()}) group by 1), b as (select query_id, count(distinct sub_id) as good, count(*) as hits from ({_merge_sql()}) group by 1), c as (select query_id, count(*) as against from ({_contradictions_sql()}) group by 1)
      select query_id, round(greatest(0.0::double, least(1.0::double, coalesce(good, 0)::double / subs * 0.4::double + least(1.0::double, coalesce(hits, 0)::double / subs / 5) * 0.6::double - least(0.3::double, 0.1::double * coalesce(against, 0)))), 6) as confidence
      from a left join b using (query_id) left join c using (query_id)"""


def contradictions(spark, d, asked=questions):
    """Opposed words in the hits of a question that share a topic."""
    stances = checks.stance(F.col("title"), F.col("content"))
    records = table(spark, d, "doc_records").select(F.col("record_id").alias("id"), *[c.alias(n) for n, c in stances.items()]).where("z <> 0")
    return checks.opposed(_hits(spark, d, asked).select("query_id", "id").join(records, "id"))


def _contradictions_sql() -> str:
    parts = " union all ".join(
        f"select query_id, a, b, {S.text(kind)} as kind, {S.text(f'{x} vs {y}')} as evidence from p where (contains(ta, {S.text(x)}) and contains(tb, {S.text(y)})) or (contains(ta, {S.text(y)}) and contains(tb, {S.text(x)}))" for kind, x, y in L.OPPOSITES
    )
    return f"""with h as (select query_id, id from ({_sparse_topk_sql(20)})), r as (select query_id, id, lower(coalesce(content, '')) as t, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[{S.BLANK}]+'), lambda w: length(w) > 4) as w from h join doc_records x on x.record_id = h.id),
      p as (select x.query_id, x.id as a, y.id as b, x.t as ta, y.t as tb from r x join r y on x.query_id = y.query_id and x.id < y.id and list_has_any(x.w, y.w)) {parts}"""


def max_sim_grounding(spark, d):
    """The greatest cosine of each vector whose id 50 divides to any other."""
    q, e = _vectors(spark, d)
    best = R.dense_topk(q, e, 2).where("query_id <> id").groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select("query_id", F.round("best", 8).alias("best"), (F.col("best") < 0.45).alias("weak"))


def _answers(spark, d):
    """Sentences of chunks with the names and numbers of their document."""
    docs = table(spark, d, "doc_records").groupBy("doc_id").agg(F.max_by("content", "record_id").alias("content"))
    docs = docs.withColumn("content", text.plain(F.col("content"))).select("doc_id", checks.named(F.col("content")).alias("en"), checks.numbers(F.lower("content")).alias("ek"))
    rows = chunks(spark, d, "doc_id", "text").where("text is not null").join(docs, "doc_id").select("chunk_id", "en", "ek", text.answer_sentences(text.plain(F.col("text"))).alias("s"))
    return rows.select("chunk_id", "en", "ek", F.posexplode("s").alias("pos", "sentence"))


def ungrounded_terms(spark, d):
    """Names and numbers in the sentences of chunks that the newest record of the document lacks."""
    rows = _answers(spark, d)
    found = checks.ungrounded(F.col("sentence"), F.col("en"), F.col("ek"))
    rows = rows.select("chunk_id", F.col("pos").cast("bigint").alias("pos"), F.array_join(found["names"], "|").alias("names"), F.array_join(found["numbers"], "|").alias("numbers"))
    return rows.where("names <> '' or numbers <> ''")


def _named(c: str) -> str:
    ends = "(" + " or ".join(f"ends_with(lower(w), {S.text(e)})" for e in L.DRUG_ENDINGS) + ")"
    return f"list_transform(list_filter(regexp_extract_all({c}, '\\b([A-Za-z][a-z]{{3,}})\\b', 1), lambda w: {ends} or (regexp_matches(w, '^[A-Z]') and length(w) > 4)), lambda w: lower(w))"


def _numbers(c: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({c}, {S.text(p)}, 1)" for p in (L.DOSE_NUMBER, L.PERCENT_NUMBER, L.TIME_NUMBER)) + ")"


def _split_answer(column: str) -> str:
    c = f"coalesce({column}, '')"
    for form in L.ANSWER_SHORT_FORMS:
        c = f"replace({c}, {S.text(form)}, {S.text(form[:-1])} || chr(1))"
    split = f"string_split(regexp_replace({c}, '([.!?])[{S.BLANK}]+', '\\1' || chr(3), 'g'), chr(3))"
    kept = f"list_filter(list_transform({split}, lambda s: {S.strip('replace(s, chr(1), ' + S.text('.') + ')')}), lambda s: length(s) > 10)"
    return kept


def _answers_sql() -> str:
    return f"""select chunk_id, content, unnest(s) as sentence, (generate_subscripts(s, 1) - 1)::bigint as pos from (select chunk_id, {S.plain('content')} as content, {_split_answer(S.plain('text'))} as s from {_CHUNKS} join (select doc_id, arg_max(content, record_id) as content from doc_records group by doc_id) using (doc_id) where text is not null)"""


_GROUND = f"""with a as ({_answers_sql()}), e as (select content, {_named('content')} as en, {_numbers('lower(content)')} as ek from (select distinct content from a)),
 x as (select chunk_id, pos, sentence, list_sort(list_distinct(list_filter({_named('sentence')}, lambda y: not list_contains(en, y)))) as names, list_sort(list_distinct(list_filter({_numbers('lower(sentence)')}, lambda y: not list_contains(ek, y)))) as numbers from a join e using (content))"""


def grounding_score(spark, d):
    """Doubt of each chunk by the weights of its sentences, the lexical part."""
    rows = _answers(spark, d)
    found = checks.ungrounded(F.col("sentence"), F.col("en"), F.col("ek"))
    weighed = rows.select("chunk_id", checks.flag_weight(F.col("sentence"), found["names"], found["numbers"]).alias("w"))
    return weighed.groupBy("chunk_id").agg(F.count("*").alias("sentences"), F.round(F.least(F.lit(1.0), F.sum("w") / F.count("*")), 6).alias("risk"))


def safety_check(spark, d):
    """Warnings in chunks, and what follows from them."""
    rows = chunks(spark, d, "text").select("chunk_id", F.lower(text.plain(F.col("text"))).alias("l")).select("chunk_id", checks.warnings(F.col("l")).alias("w"))
    found = checks.safety(F.col("w"))
    joined = F.array_join(F.array_sort(F.transform("w", lambda w: F.concat_ws(":", w["type"], w["severity"], w["message"]))), "|")
    return rows.select("chunk_id", joined.alias("warnings"), found["is_safe"].alias("is_safe"), found["needs_disclaimer"].alias("needs_disclaimer"))


def _safety_sql() -> str:
    kinds = [f"case when {S.hits('l', ps)} > 0 then {S.text(':'.join((k, s, 'Detected: ' + k.replace('_', ' ').lower())))} end" for k, s, ps in L.WARNINGS]
    pairs = [f"case when contains(l, {S.text(a)}) and contains(l, {S.text(b)}) then {S.text(f'DRUG_INTERACTION:HIGH:Potential interaction: {a} + {b}')} end" for a, b in L.DANGEROUS]
    drugs = [f"case when contains(l, {S.text(m)}) then {S.text(f'MONITORING_REQUIRED:MEDIUM:{m.title()}: monitoring')} end" for m in L.MONITORED]
    return f"""select chunk_id, array_to_string(list_sort(w), '|') as warnings, len(list_filter(w, lambda x: contains(x, ':HIGH:'))) = 0 as is_safe, len(list_filter(w, lambda x: starts_with(x, 'TREATMENT') or starts_with(x, 'DOSAGE'))) > 0 as needs_disclaimer
      from (select chunk_id, list_filter([{', '.join(kinds + pairs + drugs)}], lambda x: x is not null) as w from (select chunk_id, lower({S.plain('text')}) as l from {_CHUNKS}))"""


def _cited(spark, d):
    """Every record as a citation of its source: known if it has content, aged by its year."""
    year = F.coalesce(F.nullif("year", F.lit(0)), F.lit(NOW))
    return table(spark, d, "doc_records").select("record_id", "source_type", F.coalesce("evidence_level", F.lit(3)).alias("level"), checks.citation_issues(F.col("source_type"), F.col("evidence_level"), year, F.lit(NOW), F.col("content").isNotNull()).alias("issues"), F.col("content").isNotNull().alias("known"))


def citation_check(spark, d):
    """Issues of each citation."""
    return _cited(spark, d).select("record_id", F.explode("issues").alias("i")).select("record_id", "i.issue", "i.severity")


_ISSUES = f"""select record_id, 'NOT_FOUND' as issue, 'HIGH' as severity from doc_records where content is null
 union all select record_id, 'OUTDATED', 'LOW' from doc_records where content is not null and {NOW} - coalesce(nullif(year, 0), {NOW}) > {L.OLD_YEARS}
 union all select record_id, 'UNTRUSTED_SOURCE', 'MEDIUM' from doc_records where content is not null and not list_contains({S.listed(list(L.TRUSTED))}, lower(coalesce(source_type, '')))
 union all select record_id, 'LOW_EVIDENCE', 'LOW' from doc_records where content is not null and coalesce(evidence_level, 3) > 3"""


def citations_missing(spark, d):
    """Index points that cite a document of which no valid record is stored."""
    points = table(spark, d, "vector_points").select("point_id", F.col("payload")["doc_id"].alias("doc_id")).distinct()
    stored = validate_documents(table(spark, d, "doc_records")).where("ok").select("doc_id")
    return points.join(stored, "doc_id", "left_anti").select("point_id", "doc_id")


def evidence_distribution(spark, d):
    """Citations per evidence level and their mean, by source."""
    grades = [F.count_if(F.col("level") == n).alias(f"grade_{n}") for n in range(1, 6)]
    return _cited(spark, d).groupBy("source_type").agg(*grades, F.round(F.coalesce(F.avg("level"), F.lit(3.0)), 6).alias("average"))


def trusted_ratio(spark, d):
    """Share of trusted sources among the citations of each document key's records."""
    return table(spark, d, "doc_records").groupBy("doc_id").agg(F.round(F.avg(F.coalesce("source_type", F.lit("")).isin(list(L.TRUSTED)).cast("double")), 6).alias("trusted"))


def consistency(spark, d, asked=questions):
    """Agreement of the hits behind each question: distinct sources and variance of scores."""
    rows = _context(spark, d, asked).groupBy("query_id").agg(F.countDistinct("source_type").alias("sources"), F.var_pop("score").alias("variance"), F.count("*").alias("n"))
    return rows.select("query_id", F.round(scoring.consistency(F.col("sources"), F.col("variance"), F.col("n")), 6).alias("consistency"))


def _hit_rows() -> str:
    return f"(select h.query_id, h.score, x.* from ({_sparse_topk_sql(20).replace('round(score, 8) as score', 'score')}) h join {_DOCS} x on x.record_id = h.id)"


_CONSISTENCY = f"""select query_id, round(case when n < 2 then 0.8::double else 0.4::double * least(1.0::double, s::double / 3) + 0.6::double * greatest(0.0::double, 1 - 2 * v) end, 6) as consistency
 from (select query_id, count(distinct source_type) as s, var_pop(score) as v, count(*) as n from {_hit_rows()} group by query_id)"""


def answer_quality(spark, d, asked=questions):
    """Mean score of the hits behind each question, each held to [0, 1]."""
    return _context(spark, d, asked).groupBy("query_id").agg(F.round(F.avg(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))), 6).alias("quality"))


def _answered(spark, d, asked):
    """(answers, citations, chunks): an extract of the best hit of a question stands for an answer, the other hits for its evidence."""
    hits = materialize(_context(spark, d, asked), "hits")
    said = hits.where("rank = 0").select("query_id", F.substring("content", 1, 1500).alias("answer"))
    cited = hits.select("query_id", "source_type", "evidence_level", F.coalesce(F.nullif("year", F.lit(0)), F.lit(NOW)).alias("year"), F.col("content").isNotNull().alias("known"))
    behind = hits.where("rank > 0").select("query_id", "id", F.col("content").alias("text"), "score", F.lit(None).cast("double").alias("quality_score"), "source_type")
    return said, cited, behind


def _validated(spark, d, asked):
    return answers.validate_answers(*_answered(spark, d, asked), NOW)


def answer_grounding(spark, d, asked=questions):
    """Doubt of each sentence of an answer, by similarity, names and numbers."""
    said, _, behind = _answered(spark, d, asked)
    found = answers.grounding(said, behind)
    return found.select("query_id", F.col("pos").cast("bigint").alias("pos"), F.round("similarity", 6).alias("similarity"), F.round("weight", 6).alias("weight"), "reason")


def confidence(spark, d, asked=questions):
    """Confidence in an answer to each question."""
    return _validated(spark, d, asked).select("query_id", F.round("risk", 6).alias("risk"), "confidence")


def verdict(spark, d, asked=questions):
    """Verdict on an answer to each question."""
    return _validated(spark, d, asked).select("query_id", F.col("recommendation").alias("verdict"))


def response(spark, d, asked=questions):
    """What a response says of its answer."""
    found = _validated(spark, d, asked)
    warned = F.array_join(F.array_sort(F.transform("warnings", lambda w: F.concat_ws(":", w["type"], w["severity"]))), "|")
    whole = [F.col(c).cast("bigint").alias(c) for c in ("issues", "high_issues", "valid", "cited", *[f"grade_{g}" for g in range(1, 6)])]
    return found.select("query_id", F.round("risk", 6).alias("risk"), "confidence", "recommendation", "is_safe", "needs_disclaimer", F.size("unverified").cast("bigint").alias("unverified"), warned.alias("warnings"), *whole)


def _grounding_sql() -> str:
    count = lambda keys, c, source: f"(select *, sqrt(sum(n * n) over (partition by {keys})) as norm from (select {keys}, w, count(*) as n from (select {keys}, unnest(regexp_extract_all(lower({c}), '[a-z0-9]{{2,}}')) as w from {source}) group by all))"
    return f"""r as materialized (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) - 1 as rank, x.content, x.source_type, x.evidence_level, x.year from (select query_id, id, score from ({_sparse_topk_sql(20).replace('round(score, 8) as score', 'score')})) h join doc_records x on x.record_id = h.id),
      an as (select query_id, coalesce(substr(content, 1, 1500), '') as answer from r where rank = 0), ch as (select * from r where rank > 0),
      se as (select query_id, unnest(s) as sentence, unnest(range(len(s))) as pos from (select query_id, {_split_answer('answer')} as s from an)),
      kn as (select query_id, flatten(list({_named(S.plain('content'))})) as kn, flatten(list({_numbers('lower(' + S.plain('content') + ')')})) as kk from ch group by query_id),
      sim as (select query_id, pos, round(max(s), 9) as sim from (select a.query_id, pos, b.id, sum(a.n * b.n) / any_value(a.norm) / any_value(b.norm) as s from {count('query_id, pos', 'sentence', 'se')} a join {count('query_id, id', "coalesce(content, '')", 'ch')} b on a.query_id = b.query_id and a.w = b.w group by 1, 2, 3) group by 1, 2),
      g0 as (select se.*, coalesce(sim, 0.0::double) as sim, list_sort(list_distinct(list_filter({_named(S.plain('sentence'))}, lambda y: not list_contains(coalesce(kn, []), y)))) as names, list_sort(list_distinct(list_filter({_numbers('lower(' + S.plain('sentence') + ')')}, lambda y: not list_contains(coalesce(kk, []), y)))) as numbers
        from se left join kn using (query_id) left join sim using (query_id, pos)),
      g as (select *, case when length(sentence) < 20 or ends_with(sentence, ':') then 0.0::double else case when sim < 0.45 then 0.4::double else 0.0::double end + case when len(names) > 1 then 0.3::double else 0.0::double end + case when len(numbers) > 0 then 0.3::double else 0.0::double end end as weight from g0)"""


_ANSWER_GROUNDING = f"""with {_grounding_sql()} select query_id, pos, round(sim, 6) as similarity, round(weight, 6) as weight, case when weight = 0 then '' else array_to_string(list_filter([case when sim < 0.45 then 'Low semantic similarity (' || format('{{:.2f}}', sim) || ')' end,
  case when len(names) > 1 then 'Ungrounded entities: ' || array_to_string(names[1:3], ', ') end, case when len(numbers) > 0 then 'Unverified numbers: ' || array_to_string(numbers, ', ') end], lambda x: x is not null), '; ') end as reason from g"""


def _validated_sql() -> str:
    kinds = [f"case when {S.hits('l', ps)} > 0 then {S.text(f'{k}:{s}')} end" for k, s, ps in L.WARNINGS]
    pairs = [f"case when contains(l, {S.text(a)}) and contains(l, {S.text(b)}) then 'DRUG_INTERACTION:HIGH' end" for a, b in L.DANGEROUS]
    drugs = [f"case when contains(l, {S.text(m)}) then 'MONITORING_REQUIRED:MEDIUM' end" for m in L.MONITORED]
    steady = "case when n < 2 then 0.8::double else 0.4::double * least(1.0::double, s::double / 3) + 0.6::double * greatest(0.0::double, 1 - 2 * v) end"
    evidence = "case when a <= 0 then 0.5::double else greatest(0.0::double, least(1.0::double, (6 - a) / 5 + 0.1::double * grade_1)) end"
    penalty = "least(0.4::double, least(0.3::double, 0.05::double * len(w)) + case when not is_safe then 0.1::double else 0.0::double end)"
    raw = f"0.25::double + 0.15::double * least(1.0::double, cited::double / 8) + 0.15::double * ({evidence}) + 0.2::double * greatest(0.0::double, 1 - risk) + 0.15::double * q + 0.1::double * ({steady}) - {penalty}"
    grades = ", ".join(f"count_if(content is not null and coalesce(evidence_level, 3) = {g}) as grade_{g}" for g in range(1, 6))
    issue = {"old": f"content is not null and {NOW} - coalesce(nullif(year, 0), {NOW}) > {L.OLD_YEARS}", "bad": f"content is not null and not list_contains({S.listed(list(L.TRUSTED))}, lower(coalesce(source_type, '')))", "low": "content is not null and coalesce(evidence_level, 3) > 3"}
    return f"""with {_grounding_sql()},
      d as (select query_id, least(1.0::double, sum(weight) / count(*)) as doubt, count_if(weight > 0) as unverified from g group by 1),
      b as (select query_id, count(*) as n, avg(least(greatest(score, 0), 1)) as q, count(distinct coalesce(source_type, 'unknown')) as s, var_pop(score) as v from ch group by 1),
      c as (select query_id, count(*) as cited, count(content) as valid, coalesce(avg(case when content is not null then coalesce(evidence_level, 3) end), 3.0) as a, {grades}, sum((content is null)::int + {' + '.join(f'({i})::int' for i in issue.values())}) as issues, count_if(content is null) as high_issues from r group by 1),
      e as (select *, len(list_filter(w, lambda x: ends_with(x, ':HIGH'))) = 0 as safe, len(list_filter(w, lambda x: starts_with(x, 'TREATMENT') or starts_with(x, 'DOSAGE'))) > 0 as needs_disclaimer from (select query_id, answer, list_filter([{', '.join(kinds + pairs + drugs)}], lambda x: x is not null) as w from (select *, lower({S.plain('answer')}) as l from an))),
      j as (select e.query_id, answer, w, safe as is_safe, needs_disclaimer, coalesce(unverified, 0) as unverified, coalesce(n, 0) as n, coalesce(q, 0.5) as q, coalesce(s, 0) as s, coalesce(v, 0.0) as v, c.* exclude (query_id), case when answer = '' then 0.0::double when coalesce(n, 0) = 0 then 1.0::double else coalesce(doubt, 0.0::double) end as risk
        from e left join d using (query_id) left join b using (query_id) left join c using (query_id)),
      k as (select *, case when answer = '' then 0.0::double else round(greatest(0.0::double, least(1.0::double, {raw})), 3) end as confidence from j),
      z as (select * exclude (is_safe), is_safe and answer <> '' as is_safe, case when answer = '' or risk > 0.6 or not is_safe or (valid = 0 and cited > 0) then 'UNSAFE' when risk > 0.3 or needs_disclaimer or confidence < 0.5 or high_issues > 0 then 'NEEDS_REVIEW' else 'SAFE' end as verdict from k)"""


_RESPONSE = _validated_sql() + " select query_id, round(risk, 6) as risk, confidence, verdict as recommendation, is_safe, needs_disclaimer, unverified, array_to_string(list_sort(w), '|') as warnings, issues::bigint as issues, high_issues, valid, cited, " + ", ".join(f"grade_{g}" for g in range(1, 6)) + " from z"


def contradiction_report(spark, d, asked=questions):
    """How many contradictions the hits of each question hold."""
    return answers.contradiction_report(asked(spark, d), contradictions(spark, d, asked)).withColumn("pairs", F.col("pairs").cast("bigint"))


def synthesis_prompts(spark, d, asked=questions):
    """Prompts and citations of each question, as hashes."""
    hits = _context(spark, d, asked).select("query_id", F.col("rank").alias("pos"), "id", "title", "source_type", F.col("content").alias("text"), "score")
    found = answers.synthesis_prompt(asked(spark, d), hits)
    return found.select("query_id", F.md5("prompt").alias("prompt"), F.array_join(F.transform("citations", lambda c: c["id"]), ",").alias("cited"))


_PROMPTS = f"""with h as (select query_id, id, row_number() over (partition by query_id order by score desc, id) - 1 as pos from ({_sparse_topk_sql(20).replace('round(score, 8) as score', 'score')})),
 p as (select query_id, string_agg('[' || (pos + 1) || '] Source: ' || coalesce(source_type, 'unknown') || ', Title: ' || coalesce(title, 'Untitled') || chr(10) || substr(coalesce(content, ''), 1, 300), chr(10) || chr(10) order by pos) as e, string_agg(id::varchar, ',' order by pos) filter (pos < 10) as cited from h join doc_records x on x.record_id = h.id group by query_id)
 select query_id, md5('Answer the question from the numbered evidence alone, cite it by number, and name what contradicts.' || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(e, '') || chr(10) || chr(10) || 'Answer:') as prompt, coalesce(cited, '') as cited from {_Q} left join p using (query_id)"""


def storage_stats(spark, d):
    """What is stored per source and in all."""
    points = table(spark, d, "vector_points").groupBy("point_id").agg(F.first(F.col("payload")["source_type"]).alias("source_type"))
    docs = table(spark, d, "doc_records").select("source_type")
    meta = chunks(spark, d, "metadata").select(F.col("metadata")["source"].alias("source_type"))
    return monitoring.storage_stats(docs, meta, points)


_STORED = """select source_type, sum(documents)::bigint as documents, sum(chunks)::bigint as chunks, sum(embedded)::bigint as embedded, grouping(source_type)::bigint as level from (
 select source_type, 1 as documents, 0 as chunks, 0 as embedded from doc_records union all select metadata['source'], 0, 1, 0 from (select distinct on (chunk_id) chunk_id, metadata from chunks)
 union all select payload['source_type'], 0, 0, 1 from (select distinct on (point_id) point_id, payload from vector_points)) group by rollup(source_type)"""


def run_summary(spark, d):
    return monitoring.run_summary(table(spark, d, "ingest_runs"))


def recent_runs(spark, d):
    return monitoring.recent_runs(table(spark, d, "ingest_runs"), 5).select("run_id", "source_type", "status")


def run_alerts(spark, d):
    return monitoring.run_alerts(table(spark, d, "ingest_runs"))


_RUNS = "(select distinct * from ingest_runs)"


def event_windows(spark, d):
    """Events per hour and type, an extension: what the streaming query gives over the whole table."""
    rows = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.unix_micros(F.col("hour").cast("timestamp")).alias("hour"), "event_type", "n", "total")


def event_sessions(spark, d):
    """Sessions of users with at most half an hour between events, an extension."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = table(spark, d, "events").withColumn("starts", F.when(gap.isNull() | (gap > 1_800_000_000), 1).otherwise(0))
    numbered = rows.withColumn("session", F.sum("starts").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


QUERIES = {
    "route": (route, _route_sql()),
    "decompose": (decompose, _decompose_sql()),
    "subquery_merge": (subquery_merge, _merge_sql()),
    "deep_confidence": (deep_confidence, _deep_sql()),
    "contradictions": (contradictions, _contradictions_sql()),
    "max_sim_grounding": (max_sim_grounding, f"select query_id, round(max(score), 8) as best, max(score) < 0.45 as weak from ({_dense_sql(2)}) where query_id <> id group by query_id"),
    "ungrounded_terms": (ungrounded_terms, _GROUND + " select chunk_id, pos, array_to_string(names, '|') as names, array_to_string(numbers, '|') as numbers from x where len(names) > 0 or len(numbers) > 0"),
    "grounding_score": (grounding_score, _GROUND + " select chunk_id, count(*) as sentences, round(least(1.0::double, sum(case when length(sentence) < 20 or ends_with(sentence, ':') then 0.0::double else (case when len(names) > 1 then 0.3 else 0 end)::double + (case when len(numbers) > 0 then 0.3 else 0 end)::double end) / count(*)), 6) as risk from x group by chunk_id"),
    "safety_check": (safety_check, _safety_sql()),
    "citation_check": (citation_check, _ISSUES),
    "citations_missing": (citations_missing, f"select distinct point_id, payload['doc_id'] as doc_id from vector_points where payload['doc_id'] is null or payload['doc_id'] not in (select doc_id from {_JUDGED} where reason is null)"),
    "evidence_distribution": (evidence_distribution, "select source_type, " + ", ".join(f"count_if(coalesce(evidence_level, 3) = {n}) as grade_{n}" for n in range(1, 6)) + ", round(avg(coalesce(evidence_level, 3)), 6) as average from doc_records group by source_type"),
    "trusted_ratio": (trusted_ratio, f"select doc_id, round(avg(list_contains({S.listed(list(L.TRUSTED))}, coalesce(source_type, ''))::int), 6) as trusted from doc_records group by doc_id"),
    "consistency": (consistency, _CONSISTENCY),
    "answer_quality": (answer_quality, f"select query_id, round(avg(least(greatest(score, 0), 1)), 6) as quality from {_hit_rows()} group by query_id"),
    "answer_grounding": (answer_grounding, _ANSWER_GROUNDING),
    "confidence": (confidence, _validated_sql() + " select query_id, round(risk, 6) as risk, confidence from z"),
    "verdict": (verdict, _validated_sql() + " select query_id, verdict from z"),
    "response": (response, _RESPONSE),
    "contradiction_report": (contradiction_report, f"select query_id, n > 0 as has_contradictions, n as pairs, case when n > 0 then 'Found ' || n || ' potential contradiction(s) in retrieved evidence. Please verify before clinical use.' else '' end as summary from (select query_id, coalesce(n, 0) as n from {_Q} left join (select query_id, count(*) as n from ({_contradictions_sql()}) group by 1) using (query_id))"),
    "synthesis_prompts": (synthesis_prompts, _PROMPTS),
    "storage_stats": (storage_stats, _STORED),
    "run_summary": (run_summary, "select source_type, status, count(*) as runs, " + ", ".join(f"sum(coalesce({c}, 0))::bigint as {c}" for c in monitoring.COUNTERS) + f", round(sum(coalesce(duration_seconds, 0)), 1) as seconds, grouping_id(source_type, status)::bigint as level from {_RUNS} group by rollup(source_type, status)"),
    "recent_runs": (recent_runs, f"select run_id, source_type, status from {_RUNS} order by started_at desc nulls last, run_id limit 5"),
    "run_alerts": (run_alerts, f"select run_id, 'failed' as alert from {_RUNS} where status = 'failed' union all select run_id, 'embedding errors' from {_RUNS} where coalesce(embedding_errors, 0) > 0 union all select run_id, 'unfinished' from {_RUNS} where finished_at is null"),
    "event_windows": (event_windows, "select epoch_us(date_trunc('hour', ts)) as hour, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"),
    "event_sessions": (event_sessions, "select user_id, session, count(*) as n, round(sum(value), 2) as total from (select *, sum(starts) over (partition by user_id order by ts, event_id) as session from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) <= 1800000000 then 0 else 1 end as starts from events)) group by 1, 2"),
}
ROW_WISE, SEARCHES = ("route", "decompose"), ("subquery_merge", "deep_confidence", "contradictions", "consistency", "answer_quality", "answer_grounding", "confidence", "verdict", "response", "contradiction_report")
QUERIES |= over_titles(QUERIES, ROW_WISE, SEARCHES)
