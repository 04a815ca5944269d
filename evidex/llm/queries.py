"""The registered queries of the operators of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.bpe import encode_corpus
from evidex.llm.history import HistoryIndex, repeats_by_batches
from evidex.llm.mixing import mix
from evidex.llm.near_duplicates import expand_pairs, near_duplicate_groups, near_duplicates
from evidex.llm.neighbours import nearest
from evidex.llm.scanned import findings, repaired
from evidex.llm.sentences import sentence_ends
from evidex.llm.splitting import split_oversized
from evidex.llm.truncation import truncated, truncation_rates
from evidex.runtime import shared_folder, table


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "doc_records").select(F.col("record_id").alias("id"), F.col("content").alias("text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose contents have similarity of at least 0.6."""
    pairs, members = near_duplicates(_contents(spark, folder), minimum=0.6)
    return expand_pairs(pairs, members)


def p5_found(spark: SparkSession, folder: str, days: int = 2) -> DataFrame:
    """Records that repeat an accepted earlier one, in order of ingestion.

    The history index takes all but the last ``days`` days as its first batch, then each of these days.
    """
    rows = table(spark, folder, "doc_records").select(F.col("record_id").alias("id"), F.col("ingested_at").alias("at"), F.col("content").alias("text"))
    last = rows.agg(F.date_trunc("day", F.max("at")).cast("timestamp_ntz")).first()[0]
    bounds = [] if last is None else [last - timedelta(i) for i in reversed(range(days))]
    index = HistoryIndex(spark, f"{shared_folder(spark)}/evidex/history-{uuid4().hex}", buckets=16, texts=rows.select("id", "text"))
    return repeats_by_batches(rows, index, bounds).select(F.col("id").alias("record_id"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every record, and how many different texts its own is linked to."""
    found = near_duplicate_groups(_contents(spark, folder), minimum=0.6)
    return found.select(F.col("id").alias("record_id"), F.col("group").alias("group_id"), "links")


def _scanned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, folder, "doc_records")
    return records.where("parser_version = 'v2'"), records.where("parser_version is distinct from 'v2'")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of scanned contents that are furniture, end in a broken word or hold a misread character."""
    return findings(*_scanned(spark, folder)).select("record_id", "line_no", "kind").distinct()


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned contents as continuous paragraphs."""
    return repaired(*_scanned(spark, folder))


def p3_found(spark: SparkSession, folder: str, **settings) -> DataFrame:
    """Pairs of points of cosine of at least 0.80, one among the ten most similar of the other."""
    points = table(spark, folder, "vector_points").select(F.col("point_id").alias("id"), F.col("upserted_at").alias("at"), F.col("dense_vector").alias("vec"))
    found = nearest(points, k=10, minimum=0.8, **settings)
    return found.select(F.least("q", "x").alias("point_a"), F.greatest("q", "x").alias("point_b")).distinct()


def p3_exact(spark: SparkSession, folder: str) -> DataFrame:
    """As p3_found with a factor of one, by which nothing is lost."""
    return p3_found(spark, folder, factor=1.0)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Contents as items; one of under 40 characters but for the blanks around it is no case."""
    blanks = F.lit(" \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\u00a0\u2002\u2003\u2009\u200a\u2028\u2029\u202f\u3000")
    rows = table(spark, folder, "doc_records").where(F.length("content") >= 40).where(F.length(F.btrim("content", blanks)) >= 40)
    return rows.select(F.lit("record").alias("item_kind"), F.col("record_id").cast("string").alias("item_id"), F.col("content").alias("text"), "parser_version")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text", "chunk_type")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """End of every sentence of the chunks of prose and the records not scanned."""
    records = _records(spark, folder).where("parser_version = 'v1'")
    chunks = _chunks(spark, folder).where("chunk_type in ('summary', 'section')")
    return sentence_ends(records).unionByName(sentence_ends(chunks, unique=True))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the items above the limit: 2,000 tokens for records, 500 for chunks."""
    records = _records(spark, folder).withColumn("limit", F.lit(2000))
    chunks = _chunks(spark, folder).withColumn("limit", F.lit(500))
    return split_oversized(records.drop("parser_version").unionByName(chunks.drop("chunk_type")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that had to be cut: those of more than one piece."""
    return p6_pieces(spark, folder).where("piece = 1").select("item_kind", "item_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot reach their target share."""
    _, report = mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return report.where("short").select("source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target shares and those reached."""
    _, report = mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    return report


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(table(spark, folder, "documents"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source, how many of its documents were cut off."""
    return truncation_rates(table(spark, folder, "documents"))


def queries() -> dict:
    return {q.__name__: q for q in (p1_found, p1_groups, p2_found, p2_texts, p3_found, p3_exact, p4_found, p5_found, p6_found, p6_pieces, p7_ids, p8_found, p8_shares, p9_found, p9_rates)}


#: All similar pairs by brute force over the substrings of 20 characters.
_PAIRS = """n as (select record_id, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) as t from doc_records where length(trim(content)) >= 40),
 u as (select t, min(record_id) as rep from n group by t),
 g as (select rep, unnest(list_distinct(list_transform(range(1, greatest(length(t) - 19, 1) + 1), lambda i: substr(t, i, 20)))) as g from u),
 k as (select rep, count(*) as k from g group by rep),
 s as (select a.rep as a, b.rep as b, count(*) as i from g a join g b on a.g = b.g and a.rep < b.rep group by 1, 2),
 p as (select a, b from s join k x on x.rep = a join k y on y.rep = b where i >= 0.6 * (x.k + y.k - i) union all select rep, rep from u),
 m as (select record_id, rep from n join u using (t)),
 f as (select least(x.record_id, y.record_id) as record_a, greatest(x.record_id, y.record_id) as record_b from p join m x on x.rep = p.a join m y on y.rep = p.b where p.a <> p.b or x.record_id < y.record_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_PAIRS} select record_a, record_b from f",
        "p1_groups": f"""with recursive {_PAIRS},
 d as (select a, b from p where a <> b union select b, a from p where a <> b),
 c(a, b) as (select a, b from d union select c.a, d.b from c join d on c.b = d.a)
 select m.record_id, least(m.rep, coalesce((select min(b) from c where c.a = m.rep), m.rep)) as group_id, (select count(*) from d where d.a = m.rep) as links from m""",
        "p3_exact": """with v as (select point_id as id, dense_vector::double[] as v from vector_points where point_id is not null qualify row_number() over (partition by point_id order by upserted_at desc) = 1),
 u as (select id, v from v where len(v) = 96 and not list_contains(list_transform(v, lambda x: isfinite(x)), false) and list_dot_product(v, v) > 0),
 c as (select a.id as q, b.id as x, list_cosine_similarity(a.v, b.v) as c from u a join u b on a.id <> b.id),
 k as (select q, x from c where c >= 0.8 qualify row_number() over (partition by q order by c desc, x) <= 10)
 select distinct least(q, x) as point_a, greatest(q, x) as point_b from k""",
        "p5_found": f"""with recursive {_PAIRS},
 o as (select record_id, row_number() over (order by ingested_at, record_id) as i from doc_records where ingested_at is not null and record_id in (select record_a from f union select record_b from f)),
 e as (select least(x.i, y.i) as early, greatest(x.i, y.i) as late from f join o x on x.record_id = record_a join o y on y.record_id = record_b),
 r(i, accepted, cases) as (select 0::bigint, []::bigint[], []::bigint[] union all
   select i + 1, case when hit then accepted else list_append(accepted, i + 1) end, case when hit then list_append(cases, i + 1) else cases end
   from (select *, exists (select 1 from e where late = r.i + 1 and list_contains(r.accepted, early)) as hit from r where i < (select max(i) from o)))
 select record_id from o where list_contains((select cases from r order by i desc limit 1), i)""",
        "p6_found": """
            select distinct 'record' as item_kind, cast(record_id as varchar) as item_id from doc_records
            where floor(length(content) / 4) > 2000 and length(trim(content)) >= 40
            union all
            select distinct 'chunk', chunk_id from chunks where floor(length(text) / 4) > 500""",
    }
