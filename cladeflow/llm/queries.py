"""Queries p2, p5, p7, p8 and p9, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeflow.llm.frequencies import mutation_frequencies, term_frequencies
from cladeflow.llm.leaks import leaked_passages, proximity_matches
from cladeflow.llm.mixing import mix_sources
from cladeflow.llm.near_duplicates import all_pairs, near_duplicates
from cladeflow.llm.sentences import sentence_units
from cladeflow.runtime import read


def p2_found(spark, sf_dir):
    links, members = near_duplicates(read(spark, sf_dir, "aln"), "aln_id", "seq")
    return all_pairs(links, members).select(F.col("id_1").alias("aln_id_1"), F.col("id_2").alias("aln_id_2"))


def _copies(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "aln"), "aln_id", "seq")


def p2_links(spark, sf_dir):
    """Links between the representatives of classes of equal rows, and their similarity."""
    return _copies(spark, sf_dir)[0]


def p2_members(spark, sf_dir):
    """The class of every row and how many links its representative has."""
    links, members = _copies(spark, sf_dir)
    ends = links.select(F.explode(F.array("id_1", "id_2")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "class_id", "left").fillna(0, ["n_links"]).select("id", "class_id", "n_links")


def p5_found(spark, sf_dir):
    found = mutation_frequencies(read(spark, sf_dir, "mutations")).where("mark is not null")
    return found.select("pos", "a", "d", "mark")


def p5_frequencies(spark, sf_dir):
    return mutation_frequencies(read(spark, sf_dir, "mutations"))


def p5_terms(spark, sf_dir):
    return term_frequencies(read(spark, sf_dir, "documents"), "doc_id", "text")


def p7_found(spark, sf_dir):
    return leaked_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_proximity(spark, sf_dir):
    return proximity_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_mix(spark, sf_dir):
    return mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir):
    return mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark, sf_dir):
    return sentence_units(read(spark, sf_dir, "documents"))


# all pairs of rows that share a substring
_P2 = """
with c as (
  select aln_id, translate(regexp_replace(upper(seq), '[^A-Z]', '', 'g'), 'U', 'T') as s from aln
), g as (select distinct aln_id, s[i:i + 11] as gram from (select aln_id, s, unnest(range(1, length(s) - 10)) as i from c where length(s) >= 100)),
n as (select aln_id, count(*) as n, md5(string_agg(gram, '' order by gram)) as same from g group by aln_id),
k as (select a.aln_id as i, b.aln_id as j, count(*) as k from g a join g b on a.gram = b.gram and a.aln_id < b.aln_id group by 1, 2),
p as (select i, j, k / (x.n + y.n - k) as similarity, x.same as s1, y.same as s2 from k join n x on x.aln_id = i join n y on y.aln_id = j where 2 * k >= x.n + y.n - k),
m as (select aln_id as id, min(aln_id) over (partition by same) as class_id from n),
l as (select i, j, similarity from p join m x on x.id = i and x.class_id = i join m y on y.id = j and y.class_id = j)
"""
# fixed values: wide forms and their plain ones; the format characters are those of RE2's Cf
_P7 = """
with recursive norm as (
  select doc_id, lower(regexp_replace(translate(nfc_normalize(text), '{wide}', '{plain}'), '\\p{{Cf}}', '', 'g')) as t from documents where length(text) > 0
), item as (
  select item_id, lang in ('zh', 'ja') as dense, lower(regexp_replace(translate(nfc_normalize(text), '{wide}', '{plain}'), '\\p{{Cf}}', '', 'g')) as t from eval_items where length(text) > 0
), iw as (select item_id, dense, t, case when dense then string_split(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') else regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') end as w from item),
ig as (select item_id, dense, array_to_string(w[i:i + (case when dense then 23 else 11 end)], ' ') as gram from (select item_id, dense, w, unnest(range(1, len(w) - (case when dense then 22 else 10 end))) as i from iw)),
dw as (
  select doc_id, false as dense, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') as w from norm
  union all select doc_id, true, string_split(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') from norm
), dg as (select doc_id, dense, array_to_string(w[i:i + (case when dense then 23 else 11 end)], ' ') as gram from (select doc_id, dense, w, unnest(range(1, len(w) - (case when dense then 22 else 10 end))) as i from dw))
""".format(wide="".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])), plain="0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_P5 = """
with m as (select node_id, pos, upper(trim(a, ' ')) as a, upper(trim(d, ' ')) as d from mutations),
g as (
  select pos, a, d, count(*) as n_rows, count(distinct node_id) as n_records,
    (select count(distinct node_id) from mutations) as t
  from m where pos is not null and a is not null and d is not null group by pos, a, d
), k as (select pos, a, d, n_rows, n_records, case when n_records <= 2 then 'rare' when n_records > t / 100.0 then 'common' end as mark from g)
"""
SQL = {
    "p2_found": _P2 + "select i as aln_id_1, j as aln_id_2 from p",
    "p2_links": _P2 + "select i as id_1, j as id_2, similarity from l",
    "p2_members": _P2 + """, e as (select class_id, count(*) as n_links from (select unnest([i, j]) as class_id from l) group by 1)
select id, class_id, coalesce(n_links, 0) as n_links from m left join e using (class_id)""",
    "p7_found": _P7 + "select distinct doc_id, item_id from dg join ig using (dense, gram)",
    # every shift that puts a term of the item within 4 places of one of the document's
    "p7_proximity": _P7 + """, it as (
  select item_id, dense, unnest(terms) as term, unnest(range(len(terms)))::int as k, len(terms) as n, case when dense then 21 else 12 end as size, case when dense then 17 else 10 end as need
  from (select item_id, dense, case when dense then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], '')) else w end as terms from iw)
), dt as (
  select doc_id, dense, unnest(terms) as term, unnest(range(len(terms)))::int as p
  from (select doc_id, dense, case when dense then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], '')) else w end as terms from dw)
), h as (
  select distinct doc_id, item_id, k, n, size, need, p - k + o.o as s from it join dt using (dense, term), (select unnest(range(-4, 5))::int as o) o where n >= size
), r as (
  select doc_id, item_id, n, size, need, k, count(*) over (partition by doc_id, item_id, s order by k range between current row and 20 following) as a20, count(*) over (partition by doc_id, item_id, s order by k range between 20 preceding and current row) as b20,
    count(*) over (partition by doc_id, item_id, s order by k range between current row and 11 following) as a11, count(*) over (partition by doc_id, item_id, s order by k range between 11 preceding and current row) as b11 from h
)
select doc_id, item_id, max(c)::int as n_terms from (
  select doc_id, item_id, need, greatest(case when k <= n - size then case when size = 21 then a20 else a11 end else 0 end, case when k >= size - 1 then case when size = 21 then b20 else b11 end else 0 end) as c from r)
where c >= need group by 1, 2""",
    "p5_found": _P5 + "select pos, a, d, mark from k where mark is not null",
    "p5_terms": """with d as (select doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{M}\\p{N}]+)', 1)) as term from documents),
g as (select term, count(*) as n_rows, count(distinct doc_id) as n_records, (select count(distinct doc_id) from documents) as t from d group by term)
select term, n_rows, n_records, case when n_records < 3 then 'rare' when n_records > t * 0.1 then 'common' end as mark from g""",
    "p5_frequencies": _P5 + "select pos, a, d, n_rows, n_records, mark from k",
}
QUERIES = {
    f.__name__: f for f in (p2_found, p2_links, p2_members, p5_found, p5_frequencies, p5_terms, p7_found, p7_proximity, p8_mix, p8_shares, p9_found)
}
