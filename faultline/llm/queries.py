"""The registered query of each operator, applied with production parameters to its whole table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, licenses, linededup, mixing, neardup, pii, quality, repeats, urls
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=4)


def recrawled(pages: DataFrame) -> DataFrame:
    """The list of the URL filter's query. The tables have no list of blocked URLs, so URLs whose canonical URL more than one
    page has stand for one: every page of such a URL is blocked, the first included. urls.judge() takes any list."""
    name = urls.canonical(urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    return pages.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n > 1 and name is not null").select("url")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, recrawled(pages))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", "text")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.train(documents))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_sources,
    op2_near_dedup,
    op3_url_filter,
    op4_decontaminate,
    op5_license_scan,
    op6_quality_rules,
    op7_line_dedup,
    op8_pii,
    op9_language_id,
    op10_suffix_dedup,
)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def mix_sql(relation: str) -> str:
    """SQL for mixing.mix() of a relation with doc_id, source and text."""
    return f"""
with sizes as (
  select doc_id, source, len({_WORDS})::bigint as size, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h from {relation}),
sums as (select source, sum(size)::bigint as source_size from sizes group by source),
ranked as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as w, source_size * 2.0::double as most from sums),
filled as (
  select *, most * sum(w) over (o rows between current row and unbounded following)
    <= w * ((select sum(source_size) * 1.5::double from sums) - coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0)) as sat
  from ranked window o as (order by most / w, source)),
targets as (
  select source, source_size, case when sat then most else w * ((select sum(source_size) * 1.5::double from sums) - coalesce((select sum(most) from filled where sat), 0.0)) / (select sum(w) from filled where not sat) end::double as target
  from filled),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as passes,
    target - case when source_size > 0 then floor(target / source_size) else 0 end * source_size as budget from targets),
runs as (
  select s.source, h, sum(s.size) as own, sum(sum(s.size)) over (partition by s.source order by h) as run from sizes s group by s.source, h),
edges as (
  select b.source, min_by(h, h) as threshold, min_by((budget - (run - own)) * 2 >= own, h) as partial
  from runs r join budgets b on r.source is not distinct from b.source where budget > 0 and run > budget group by b.source)
select s.doc_id, s.source, s.size, b.source_size, b.target,
  (s.size * (passes + (case when budget > 0 and (threshold is null or h < threshold or (h = threshold and partial)) then 1 else 0 end)))::bigint as taken
from sizes s join budgets b on s.source is not distinct from b.source left join edges e on s.source is not distinct from e.source
"""


def near_sql(relation: str, n: int) -> str:
    """SQL for neardup.near_duplicates() of a relation with unique doc_ids and texts."""
    return f"""
with recursive w as (select doc_id, {_FOLDED} as words from {relation}),
g as (
  select distinct doc_id, case when len(words) < {n} then array_to_string(words, ' ') else array_to_string(words[i:i + {n - 1}], ' ') end as s
  from (select doc_id, words, unnest(range(1, greatest(1, len(words) - {n - 1}) + 1)) as i from w where len(words) > 0)),
c as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
r(a, b) as (select doc_id, doc_id from {relation} union select r.a, l.b from r join l on r.b = l.a),
m as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(c.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from {relation} d join m on m.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""


def line_sql(relation: str) -> str:
    """SQL for linededup.dedup_lines() at the depth of two lines, of a relation with unique doc_ids and texts.

    Repeated runs are followed line by line: `most` is the longest from each line on that occurs elsewhere too.
    """
    return rf"""
with recursive lines as (
  select doc_id, i, x, case when regexp_matches(x, '[^\x20\x09-\x0D]') then row_number() over (partition by doc_id, regexp_matches(x, '[^\x20\x09-\x0D]') order by i) end as k
  from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from {relation} where text is not null)),
runs as (select doc_id, k, x as a, lead(x) over (partition by doc_id order by k) as b from lines where k is not null),
firsts as (select a, b, min((doc_id, k)) as spot from runs where b is not null group by a, b having count(*) > 1),
later as (select doc_id, k from runs join firsts using (a, b) where (doc_id, k) > spot),
gone as (select doc_id, k from later union select doc_id, k + 1 from later),
texts as (
  select doc_id, count(*) as n_lines, count(g.k) as n_deleted, coalesce(string_agg(x, chr(10) order by i) filter (where g.k is null), '') as text
  from lines left join gone g using (doc_id, k) group by doc_id),
longer(doc_id, k, w, h) as (
  select doc_id, k, 1, h from (select doc_id, k, md5(a) as h, count(*) over (partition by a) as n from runs) where n > 1
  union all
  select doc_id, k, w, h from (
    select r.doc_id, r.k, r.w + 1 as w, md5(r.h || l.a) as h, count(*) over (partition by md5(r.h || l.a)) as n
    from longer r join runs l on l.doc_id = r.doc_id and l.k = r.k + r.w) where n > 1),
most as (select doc_id, k, max(w) as m from longer group by doc_id, k),
beside as (select *, lag(k) over o as k0, lag(m) over o as m0 from most window o as (partition by doc_id order by k)),
found as (select doc_id, count(*) as n_runs, max(m) as longest_run from beside where m >= 2 and not coalesce(k0 = k - 1 and m0 > m, false) group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_deleted, 0)::bigint as n_deleted,
  coalesce(n_runs, 0)::bigint as n_runs, coalesce(longest_run, 0)::bigint as longest_run, t.text
from {relation} d left join texts t using (doc_id) left join found using (doc_id)
"""


ORACLE = {
    "op1_mix_sources": mix_sql("documents"),
    "op2_near_dedup": near_sql("documents", 4),
    "op3_url_filter": r"""
with u as (
  select page_id, url,
    case when strpos(url, '://') > 0 then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
c as (select *, case when host <> '' then regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') end as name from u),
l as (select name from c where name is not null group by name having count(*) > 1),
rules(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select url, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
  from (select distinct url, host, path from u where url is not null) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by url)
select page_id, host, path, rule, coalesce(v, case when l.name is not null then 'block' else 'allow' end) as verdict, l.name is not null as listed
from c left join best using (url) left join l using (name)
""",
    "op7_line_dedup": line_sql("documents"),
    "op10_suffix_dedup": f"""
with w as (select doc_id, {_FOLDED} as words from documents),
g as (select doc_id, i, array_to_string(words[i:i + 49], ' ') as s from (select doc_id, words, unnest(range(1, len(words) - 49 + 1)) as i from w where len(words) >= 50)),
d as (select doc_id, i - 1 as i from g where s in (select s from g group by s having count(*) > 1)),
b as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from d),
n as (select *, sum(new) over (partition by doc_id order by i) as span from b)
select doc_id, min(i)::bigint as start, (max(i) + 50 - min(i))::bigint as n_words from n group by doc_id, span
""",
}
