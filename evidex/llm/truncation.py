"""Texts cut off by field limits, found in SQL from word trigrams inside texts and at ends.

The last words of a text that ends without a final mark are looked up among all texts: how often do
they stand inside a sentence, and how often at the end of one. Trigrams back off to pairs and single
words, a pair not seen to the word as far as its first word goes on in many ways; words seen nowhere
else are taken for broken off. A text's own copies do not speak for it.
Lines of another kind (keywords, signatures, table rows) are known by their first word: lines that
begin with it mostly end without a mark. They are held cut only if their end is seen nowhere else
although what precedes it goes on in few ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidex.runtime import materialize, parallel

#: Short forms whose full stop ends no sentence; fixed values.
SHORT = "Dr Prof Sra Sr Dra Mme Pr Abb Tab Fig Vgl env aprox Approx al vs bzw ca z med No sect fig cf M д-р Проф рис см ок डॉ ग्रा د".split()
#: What systems leave where a text was cut: an ellipsis, a bracketed one, a broken character.
MARKS = r"(?:…|\[\.\.\.\]|\[…\]|�|(?<!\.)\.\.\.)"
#: Rests of markup behind the last words.
MARKUP = r"(?:</?[A-Za-z][^<>]{0,20}>?|&[a-z#]{0,6};?)"
#: What the last characters of a text hold where one of these ends it.
FOLLOWS = r"[…\]�<&]|\.\.\."
BLANKS = " \t\n\r\x0b\f\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u200a\u200b\u2028\u2029\u202f\u3000\ufeff"
#: The last words are looked for in so many characters first, and in the whole text where these hold too few.
TAIL = 400
THAI = r"[\x{0e01}-\x{0e4e}]"
END = (
    r"[!?。！？।؟]+[\x{22}”»“’)」』]*"
    r"|\.(?<!(?<![\p{L}\p{N}-])(?:" + "|".join(SHORT) + r"|\p{Lu})\.)[\x{22}”»“’)」』]*(?=\s+[^\p{Ll}\p{N}(]|\s*$)"
    r"|[\r\n]+| +(?=" + THAI + ")(?<=" + THAI + " {1,9})"
)
WORD = r"[\x{0e01}-\x{0e4e}\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]\p{M}*|0|[a-zA-Z0-9\p{L}\p{M}\p{N}]+(?:[-''’.,][a-zA-Z0-9\p{L}\p{M}\p{N}]+)*|[)\],|]"
#: A text is cut if its end is final with at most this probability; of a line of another kind, ODD_LIMIT.
LIMIT, ODD_LIMIT = 0.012, 0.0015
#: Probability that a word seen nowhere else is a whole last word.
UNSEEN = 0.001

# lateral views of one row keep an expression that is used several times from being evaluated each time;
# what follows a cut ends with a sign that its last characters show, so that few texts are searched for it
_BODIES = """
select doc_id, source, body, xxhash64(body) as digest, right(trim(trailing '"”»“’)」』' from body), 1) in ('.', '!', '?', '。', '！', '？', '।', '؟') as closed, length(stripped) > length(body) and right(stripped, 40) rlike concat(:marks, '$') as marked
from (select doc_id, source, trim(trailing :blanks from text) as s from {documents} where text is not null)
  lateral view explode(array(s)) x as stripped
  lateral view explode(array(if(right(stripped, 30) rlike :follows,
    trim(trailing :blanks from regexp_replace(stripped, concat('(?:[', :blanks, ']*(?:', :marks, '|', :markup, '))+$'), '')), stripped))) z as body
where body <> ''"""

# the words of a text: digits alike, every end of a sentence or line as one sign
_WORDS = """transform(regexp_extract_all(regexp_replace({text}, '[0-9０-９]+(?:[.,][0-9]+)*', '0'), concat('(?:', :word, ')|(?:', :end, ')'), 0),
  x -> if(substring(x, 1, 1) in ('.', '!', '?', '。', '！', '？', '।', '؟', ' ', '\\n', '\\r'), '.', lower(x)))"""

_ENDS = """
select doc_id, marked, first, digest, w[n - 1] as last, if(n > 1, w[n - 2], '') as u, xxhash64(1, w[n - 1]) as h1,
       xxhash64(2, if(n > 1, w[n - 2], ''), w[n - 1]) as h2, xxhash64(3, if(n > 2, w[n - 3], ''), if(n > 1, w[n - 2], ''), w[n - 1]) as h3, xxhash64(1, if(n > 1, w[n - 2], '')) as hu
from (select *, size(w) as n from (
  select doc_id, marked, """ + _WORDS.format(text="right(body, :tail)") + """ as ts, body, digest, lower(regexp_extract(substring_index(replace(body, '\\r', '\\n'), '\\n', -1), :opener, 1)) as first
  from {bodies} where not closed or right(trim(trailing '"”»“’)」』' from body), 40) rlike :short) lateral view explode(array(ts)) y as us
  lateral view explode(array(if(size(us) > 3 or length(body) <= :tail, us, """ + _WORDS.format(text="body") + """))) x as w)
where n > 0 and w[n - 1] <> '.'"""

_OPENERS = """
select first, count(*) as lines, count_if(bare) as bare
from (select lower(regexp_extract(line, :opener, 1)) as first, right(trim(trailing '"”»“’)」』' from trim(trailing ' \\t' from line)), 1) not in ('.', '!', '?', '。', '！', '？', '।', '؟', ':') as bare
  from (select explode(split(body, '[\\\\r\\\\n]+')) as line from {bodies}))
where first <> '' and not first rlike '^[0-9]'
group by first having count(*) >= 4 and count_if(bare) > 0.5 * count(*)"""

_COUNTS = """
select g.h, count(*) as n, count_if(g.final) as t, approx_count_distinct(g.next) as ways
from (select stack(3, xxhash64(1, t), coalesce(nx = '.', odd), xxhash64(nx), xxhash64(2, p1, t), coalesce(nx = '.', odd), cast(null as bigint),
                   xxhash64(3, p2, p1, t), coalesce(nx = '.', odd), cast(null as bigint)) as (h, final, next)
      from (select odd, inline(arrays_zip(w, concat(array(''), slice(w, 1, greatest(size(w) - 1, 0))), concat(array('', ''), slice(w, 1, greatest(size(w) - 2, 0))),
                                          concat(slice(w, 2, size(w)), array(cast(null as string))))) as (t, p1, p2, nx)
            from (select """ + _WORDS.format(text="body") + """ as ws, o.first is not null as odd
                  from (select body, lower(regexp_extract(substring_index(replace(body, '\\r', '\\n'), '\\n', -1), :opener, 1)) as first from {bodies}) b
                  left join {openers} o on b.first = o.first) lateral view explode(array(ws)) x as w
            where size(w) > 0) left semi join {keys} k on xxhash64(1, t) = k.h
      where t <> '.') g
left semi join {keys} k on g.h = k.h
group by g.h"""

# copies of a text are counted by aggregation, so that no task holds them all
_COPIES = "select digest, count(*) as copies from {bodies} left semi join {ends} using (digest) group by digest"

_KEYS = "select distinct explode(array(h1, h2, h3, hu)) as h from {ends}"

# counts without the text's own copies; p1 to p3: final with this probability, by word, pair and trigram
_SCORES = """
select doc_id, marked, odd, n1, n2, ways, known,
  (if(n3 > 0, greatest(t3, 0), 0) + p2) / (n3 + 1) as p3
from (select *, if(n2 = 0 and known >= 20, least(1, 3 * ways / known), 1.0) * (if(n2 > 0, greatest(t2, 0), 0) + p1) / (n2 + 1) as p2
from (select *, (if(n1 > 0, greatest(t1, 0), 0) + :unseen) / (n1 + 1) as p1
from (select e.doc_id, e.marked, o.first is not null as odd,
             greatest(coalesce(c1.n, 0) - copies, 0) as n1, coalesce(c1.t, 0) - if(o.first is null, 0, copies) as t1,
             greatest(coalesce(c2.n, 0) - copies, 0) as n2, coalesce(c2.t, 0) - if(o.first is null, 0, copies) as t2,
             greatest(coalesce(c3.n, 0) - copies, 0) as n3, coalesce(c3.t, 0) - if(o.first is null, 0, copies) as t3,
             coalesce(cu.ways, 0) as ways, coalesce(cu.n, 0) as known
      from (select e.*, d.copies from {ends} e join {copies} d on e.digest = d.digest) e left join {openers} o on e.first = o.first
      left join {counts} c1 on e.h1 = c1.h left join {counts} c2 on e.h2 = c2.h
      left join {counts} c3 on e.h3 = c3.h left join {counts} cu on e.hu = cu.h)))"""

_CUT = """
select doc_id from {scores}
where marked or p3 <= if(odd, :odd_limit, :limit) or (odd and (n1 = 0 or (n2 = 0 and ways <= 8 and ways < 0.05 * known)))"""


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the rows of ``documents`` (doc_id, source, text) whose text was cut off.

    Null, empty and blank texts are no case; repeated texts are judged alike, each under its own id;
    a text that closes with a final mark is no case, unless the mark belongs to a short form. Other
    columns are not read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    settings = {"marks": MARKS, "markup": MARKUP, "blanks": BLANKS, "tail": TAIL, "end": END, "word": WORD, "short": r"(?<![\p{L}\p{N}-])(?:" + "|".join(SHORT) + r"|\p{Lu})\.$", "follows": FOLLOWS, "opener": r"^[^\p{L}\p{N}|]*([\p{L}\p{N}]+|\|)"}

    def sql(query: str, name: str, write: bool = True, more: dict | None = None, **views: DataFrame) -> DataFrame:
        used = {k: v for k, v in {**settings, **(more or {})}.items() if f":{k}" in query}
        found = spark.sql(query, args=used, **views)
        return materialize(found, name) if write else found

    rows = parallel(documents.select("doc_id", "source", "text"))
    bodies = sql(_BODIES, "bodies", documents=rows)
    ends = sql(_ENDS, "ends", bodies=bodies)
    copies = sql(_COPIES, "copies", bodies=bodies, ends=ends)
    openers = sql(_OPENERS, "openers", bodies=bodies)
    keys = sql(_KEYS, "keys", ends=ends)
    counts = sql(_COUNTS, "counts", bodies=bodies, openers=openers, keys=keys)
    scores = sql(_SCORES, "scores", False, {"unseen": UNSEEN}, ends=ends, copies=copies, openers=openers, counts=counts)
    return sql(_CUT, "cut", False, {"limit": LIMIT, "odd_limit": ODD_LIMIT}, scores=scores)


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share): how often each source truncates, of its texts that are not null; null sources are one group."""
    cut = truncated(documents)
    query = """
        select d.source, count(*) as documents, count(c.doc_id) as cut, round(count(c.doc_id) / count(*), 6) as share
        from {documents} d left join {cut} c on d.doc_id = c.doc_id where d.text is not null group by d.source"""
    return documents.sparkSession.sql(query, documents=documents.select("doc_id", "source", "text"), cut=cut)
