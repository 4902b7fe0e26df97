"""Queries p1, p3, p4 and p6 over the record tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeflow.operators.bad_rows import split_records
from cladeflow.operators.nested import flatten_records, record_items
from cladeflow.operators.references import name_orphans
from cladeflow.operators.times import normalise_times, order_evidence
from cladeflow.runtime import read

TIME_FIELDS = ["date_str", "raw_date_constraint"]


def p1_found(spark, sf_dir):
    return record_items(read(spark, sf_dir, "auspice"))


def p1_nodes(spark, sf_dir):
    return flatten_records(read(spark, sf_dir, "auspice"))["nodes"].drop("node_attrs")


def p1_mutations(spark, sf_dir):
    return flatten_records(read(spark, sf_dir, "auspice"))["mutations"]


def p3_found(spark, sf_dir):
    return split_records(read(spark, sf_dir, "metadata_raw"))[1].select("line_id", "reason")


def p3_loaded(spark, sf_dir):
    return split_records(read(spark, sf_dir, "metadata_raw"))[0].select("line_id", "file_name", "name", "date")


def _times(spark, sf_dir):
    return normalise_times(read(spark, sf_dir, "metadata"), read(spark, sf_dir, "labs"), "meta_id", "lab_id", TIME_FIELDS)


def p4_found(spark, sf_dir):
    return _times(spark, sf_dir).where("status = 'ok'").select("meta_id", "field_name", "start_s")


def p4_times(spark, sf_dir):
    """Every value with its reading, bounds as written, posterior and status."""
    t = _times(spark, sf_dir)
    return t.select("meta_id", "field_name", F.coalesce("start_s", F.lit(-1)).alias("start_s"), F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), (F.col("status") == "ok").alias("is_ok"))


def p4_orders(spark, sf_dir):
    """What the values of each lab say about its order of day and month, with none declared."""
    return order_evidence(read(spark, sf_dir, "metadata"), read(spark, sf_dir, "labs"), "meta_id", "lab_id", TIME_FIELDS)


def _orphans(spark, sf_dir, match):
    return name_orphans(read(spark, sf_dir, "metadata"), read(spark, sf_dir, "sequence_names"), read(spark, sf_dir, "nodes"), match)


def p6_found(spark, sf_dir):
    return _orphans(spark, sf_dir, "simple")


def p6_partial(spark, sf_dir):
    """A reference without a name refers to any tip of its tree."""
    return _orphans(spark, sf_dir, "partial")


def p6_full(spark, sf_dir):
    """A reference that is partly null is an orphan."""
    return _orphans(spark, sf_dir, "full")


def _p6_sql(agree: str, counts: str, incomplete: str = "false") -> str:
    return f"""
with t as (
  select tree_id, lower(trim(name, ' ''"')) as n, loaded_at, deleted_at from nodes where is_tip
), r as (
  select 'metadata' as table_name, meta_id as row_id, tree_id, lower(trim(name, ' ''"')) as n, received_at as seen from metadata
  union all
  select 'sequence_names', entry_id, tree_id, lower(trim(name, ' ''"')), added_at from sequence_names
)
select table_name, row_id,
  case when {incomplete} then 'incomplete' when count(t.loaded_at) = 0 then 'missing' when min(t.loaded_at) <= seen then 'deleted' else 'late' end as reason,
  strftime(seen, '%Y-%m') as ref_month
from r left join t on {agree}
where {counts}
group by table_name, row_id, seen, r.tree_id, r.n
having not coalesce(bool_or(t.loaded_at <= seen and (t.deleted_at is null or seen < t.deleted_at)), false)
"""


_BOTH = "r.tree_id = t.tree_id and r.n = t.n"
# nodes of the records, from the roots down, and their mutations
_P1 = """
with recursive doc as (
  select record_id, json_extract(auspice_json::json, '$.tree') as t from auspice where json_valid(auspice_json)
), lev as (
  select record_id, parent_path, path, node from (
    select record_id, '' as parent_path, unnest(range(len(k)))::varchar as path, unnest(k) as node
    from (select record_id, case when json_type(t) = 'ARRAY' then json_extract(t, '$[*]') else [t] end as k from doc)
  ) where json_type(node) = 'OBJECT'
  union all
  select record_id, parent_path, path, node from (
    select record_id, path as parent_path, path || '.' || unnest(range(len(k)))::varchar as path, unnest(k) as node
    from (select record_id, path, case when json_type(c) = 'ARRAY' then json_extract(c, '$[*]') else [c] end as k
      from (select record_id, path, json_extract(node, '$.children') as c from lev) where c is not null)
  ) where json_type(node) = 'OBJECT'
), muts as (
  select distinct record_id, path, gene, json_extract_string(m, '$') as mutation from (
    select record_id, path, gene, unnest(case when json_type(x) = 'ARRAY' then json_extract(x, '$[*]') else [x] end) as m
    from (select record_id, path, gene, json_extract(g, '$."' || gene || '"') as x
      from (select record_id, path, json_extract(node, '$.branch_attrs.mutations') as g, unnest(json_keys(json_extract(node, '$.branch_attrs.mutations'))) as gene from lev
        where json_type(json_extract(node, '$.branch_attrs.mutations')) = 'OBJECT'))
  ) where json_type(m) <> 'NULL'
), texts as (
  select record_id, 'site' as kind, 'state' as field, sequences::json as j from auspice where json_valid(sequences)
  union all select record_id, 'insertion', 'bases', insertions::json from auspice where json_valid(insertions)
), taxa as (
  select record_id, kind, field, taxon, json_extract(j, '$."' || taxon || '"') as x from (select *, unnest(json_keys(j)) as taxon from texts where json_type(j) = 'OBJECT' and json_extract(j, '$.taxon') is null)
), listed as (
  select record_id, kind, field, json_extract_string(e, '$.taxon') as taxon, unnest(case when json_type(s) = 'ARRAY' then json_extract(s, '$[*]') else [s] end) as s
  from (select record_id, kind, field, e, json_extract(e, '$.sites') as s from (
    select record_id, kind, field, unnest(case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [j] end) as e from texts where json_type(j) = 'ARRAY' or json_extract(j, '$.taxon') is not null))
), items as (
  select record_id, kind, taxon, pos, json_extract_string(x, '$."' || pos || '"') as value from (select *, unnest(json_keys(x)) as pos from taxa where json_type(x) = 'OBJECT')
  union all
  select record_id, kind, taxon, json_extract_string(p, '$[0]'), json_extract_string(p, '$[1]') from (select *, unnest(json_extract(x, '$[*]')) as p from taxa where json_type(x) = 'ARRAY')
  union all
  select record_id, kind, taxon, json_extract_string(s, '$.pos'), json_extract_string(s, '$.' || field) from listed
)
"""
# fixed values: what the labs' zones mean by the abbreviations in use, in minutes east of UTC
_P4 = r"""
with ab(tz, ab, east) as (values
  (null, 'UTC', 0), (null, 'GMT', 0), ('Europe/London', 'BST', 60), ('Europe/Berlin', 'CET', 60), ('Europe/Berlin', 'CEST', 120), ('Africa/Lagos', 'WAT', 60),
  ('America/New_York', 'EST', -300), ('America/New_York', 'EDT', -240), ('America/Chicago', 'CST', -360), ('America/Chicago', 'CDT', -300),
  ('Asia/Kolkata', 'IST', 330), ('Asia/Tokyo', 'JST', 540), ('Australia/Sydney', 'AEST', 600), ('Australia/Sydney', 'AEDT', 660), ('Pacific/Auckland', 'NZST', 720), ('Pacific/Auckland', 'NZDT', 780)
), v as (
  select meta_id, field_name, trim(t) as t, tz, date_order from (
    select meta_id, 'date_str' as field_name, date_str as t, tz, date_order from metadata left join labs using (lab_id)
    union all select meta_id, 'raw_date_constraint', raw_date_constraint, tz, date_order from metadata left join labs using (lab_id)
  ) where t is not null
), s as (
  select *,
    regexp_extract(t, '^(\d{4})-(\d\d)-(\d\d)(?:(?:[Tt]|\s+)(.*))?$', ['y', 'm', 'd', 'c']) as iso,
    regexp_extract(t, '^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?:\s+(.*))?$', ['y', 'm', 'd', 'c']) as sla,
    regexp_extract(t, '^(\d{4})(\d\d)(\d\d)(?:[Tt](\d{6}))?$', ['y', 'm', 'd', 'c']) as com,
    regexp_extract(t, '^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?:\s+(.*))?$', ['m', 'd', 'y', 'c']) as mfi,
    regexp_extract(t, '^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})(?:\s+(.*))?$', ['d', 'm', 'y', 'c']) as dfi,
    regexp_extract(t, '^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:\s+(.*))?$', ['a', 'b', 'y', 'c']) as num,
    regexp_extract(t, '^(\d{4})-(\d\d)-XX$', ['y', 'm']) as mon
  from v
), f as (
  select meta_id, field_name, t, tz,
    case when iso.y <> '' then iso.y when sla.y <> '' then sla.y when com.y <> '' then com.y when mfi.y <> '' then mfi.y when dfi.y <> '' then dfi.y when num.y <> '' then num.y
      when mon.y <> '' then mon.y when regexp_full_match(t, '\d{4}(-XX-XX)?') then t[1:4] end as y,
    case when iso.y <> '' then iso.m when sla.y <> '' then sla.m when com.y <> '' then com.m
      when mfi.y <> '' then month(coalesce(try_strptime(mfi.m, '%b'), try_strptime(mfi.m, '%B')))::varchar
      when dfi.y <> '' then month(coalesce(try_strptime(dfi.m, '%b'), try_strptime(dfi.m, '%B')))::varchar
      when num.y <> '' then (case when date_order = 'mdy' then num.a else num.b end) when mon.y <> '' then mon.m else '1' end as m,
    case when iso.y <> '' then iso.d when sla.y <> '' then sla.d when com.y <> '' then com.d when mfi.y <> '' then mfi.d when dfi.y <> '' then dfi.d
      when num.y <> '' then (case when date_order = 'mdy' then num.b else num.a end) else '1' end as d,
    case when iso.y <> '' then iso.c when sla.y <> '' then sla.c when com.y <> '' and com.c <> '' then com.c[1:2] || ':' || com.c[3:4] || ':' || com.c[5:6]
      when mfi.y <> '' then mfi.c when dfi.y <> '' then dfi.c when num.y <> '' then num.c else '' end as c,
    case when mon.y <> '' then 'month' when regexp_full_match(t, '\d{4}-XX-XX') then 'year' when regexp_full_match(t, '\d{4}') then 'number' else 'day' end as covers
  from s where not regexp_full_match(t, '\d{10}|\d{13}')
), g as (
  select *, try_cast(lpad(y, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') as date) as day,
    regexp_extract(c, '^(\d{1,2}):(\d\d)(?::(\d\d))?(?:[.,]\d+)?\s*(?:([AaPp])[Mm]\b)?\s*(.*)$', ['h', 'mi', 's', 'ap', 'z']) as k
  from f where y is not null
), h as (
  select *, case when c = '' then day::timestamp else day::timestamp + to_seconds(
      ((k.h::int % (case when k.ap <> '' then 12 else 24 end)) + (case when upper(k.ap) = 'P' then 12 else 0 end)) * 3600 + k.mi::int * 60 + coalesce(nullif(k.s, ''), '0')::int) end as loc, k.z as z
  from g where day is not null and (c = '' or (k.h <> '' and k.h::int < 24 and k.mi::int < 60))
), o as (
  select h.*, case when z in ('Z', 'z') then 0 when regexp_full_match(z, '[+-]\d\d(:?\d\d)?') then
      (case when z[1] = '-' then -1 else 1 end) * (z[2:3]::int * 60 + coalesce(nullif(regexp_extract(z, '(\d\d)$', 1), ''), '0')::int * (case when length(z) > 3 then 1 else 0 end)) else ab.east end as east,
    case when z = '' then coalesce(h.tz, 'UTC') when z like '%/%' or z like '[%' then trim(z, '[]') end as inzone
  from h left join ab on ab.ab = z and (ab.tz is null or ab.tz = h.tz)
), p as (
  select *, case when east is not null then loc - to_minutes(east::int) when inzone is not null then timezone('UTC', timezone(inzone, loc)) end as u from o
), q as (
  -- the first of two equal local times; a local time that never comes is none, but a day begins at its first moment
  select *, case when east is not null then u when timezone(inzone, timezone('UTC', u - interval 1 hour)) = loc then u - interval 1 hour
    when timezone(inzone, timezone('UTC', u)) = loc or c = '' then u end as start from p
), e as (
  select meta_id, field_name, t, case when length(t) = 10 then t::bigint else t::bigint // 1000 end as start_s from v where regexp_full_match(t, '\d{10}|\d{13}')
), n as (
  select meta_id, field_name, t, regexp_extract(t, '(\d{4}(?:\.\d+)?)', 1) as a, regexp_extract(t, '\d{4}(?:\.\d+)?\s*[:,-]\s*(\d{4}(?:\.\d+)?)', 1) as b from v
  where regexp_full_match(t, '\d{4}\.\d+|\[\s*\d{4}(\.\d+)?\s*[:,]\s*\d{4}(\.\d+)?\s*\]|\d{4}\.\d+\s*-\s*\d{4}(\.\d+)?')
), moments as (
  select meta_id, field_name, epoch(start)::bigint as start_s, day as d1,
    case covers when 'year' then make_date(year(day), 12, 31) when 'month' then (case when month(day) = 2 then make_date(year(day), 2, 28) else last_day(day) end) else day end as d2,
    case when covers = 'number' then y::double end as n1, case when covers = 'number' then y::double end as n2
  from q where start is not null
  union all select meta_id, field_name, start_s, (timestamp '1970-01-01' + to_seconds(start_s))::date, (timestamp '1970-01-01' + to_seconds(start_s))::date, null, null from e
  union all select meta_id, field_name,
    epoch(make_date(a[1:4]::int, 1, 1) + to_days(floor(((a::double % 1) + 1e-10) * (case when dayofyear(make_date(a[1:4]::int, 12, 31)) = 366 then 366 else 365 end))::int))::bigint,
    null, null, least(a::double, coalesce(nullif(b, ''), a)::double), greatest(a::double, coalesce(nullif(b, ''), a)::double) from n
), times as (
  select meta_id, field_name, start_s, coalesce(n1, year(d1) + (dayofyear(d1) - 0.5) / (case when dayofyear(make_date(year(d1), 12, 31)) = 366 then 366 else 365 end)) as lo,
    coalesce(n2, year(d2) + (dayofyear(d2) - 0.5) / (case when dayofyear(make_date(year(d2), 12, 31)) = 366 then 366 else 365 end)) as hi from moments
)"""
_P3 = r"""
with lines as (
  select line_id, file_name, line_no, case when lower(file_name) like '%.tsv' then chr(9) else ',' end as sep, regexp_replace(coalesce(raw_line, ''), '\r$', '') as rec from metadata_raw
), cut as (
  select *, regexp_full_match(rec, case when sep = ',' then '(?s)( *"([^"]|"")*" *|[^",]*)(,( *"([^"]|"")*" *|[^",]*))*' else '(?s)( *"([^"]|"")*" *|[^"\t]*)(\t( *"([^"]|"")*" *|[^"\t]*))*' end) as sound,
    string_split(regexp_replace(rec, '(?s)"([^"]|"")*"', chr(57344), 'g'), sep) as parts, regexp_extract_all(rec, '(?s)"((?:[^"]|"")*)"', 1) as quoted from lines
), split as (
  select line_id, file_name, line_no, sound,
    list_transform(range(1, len(parts) + 1), lambda i: trim(case when trim(parts[i]) = chr(57344) then replace(quoted[len(list_filter(parts[1:i], lambda p: trim(p) = chr(57344)))], '""', '"') else parts[i] end)) as f from cut
), head as (
  select file_name, f as cols, list_transform(f, lambda c: lower(ltrim(c, chr(65279)))) as low from split where line_no = 1
), body as (
  select b.*, h.cols, list_position(list_transform(h.low, lambda c: c in ('name', 'strain', 'accession')), true) as at_name, list_position(list_transform(h.low, lambda c: contains(c, 'date')), true) as at_date
  from split b left join head h using (file_name) where b.line_no <> 1
), val as (select *, f[at_name] as name, coalesce(f[at_date], '') as date from body
), judged as (
  select *, case when not sound then 'quoting' when cols is null or len(f) <> len(cols) then 'columns'
    when coalesce(name, '') = '' or regexp_matches(name, '[\x00-\x20\x7f-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{fffd}()\[\],:;'']') then 'name'
    when not (date = '' or (regexp_full_match(date, '\d{4}(\.\d+)?') and try_cast(date as double) between 1900 and 2100)
      or (regexp_full_match(date, '\[\d{4}(\.\d+)?:\d{4}(\.\d+)?\]') and try_cast(string_split(trim(date, '[]'), ':')[1] as double) >= 1900
        and try_cast(string_split(trim(date, '[]'), ':')[1] as double) <= try_cast(string_split(trim(date, '[]'), ':')[2] as double) and try_cast(string_split(trim(date, '[]'), ':')[2] as double) <= 2100)
      or (regexp_full_match(date, '(19\d\d|20\d\d|2100)-(\d\d-\d\d|\d\d-XX|XX-XX)')
        and try_cast(replace(replace(date, 'XX-XX', '01-01'), 'XX', '01') as date) is not null)) then 'date' end as reason from val
)
"""
QUERIES = {
    f.__name__: f for f in (p1_found, p1_nodes, p1_mutations, p3_found, p3_loaded, p4_found, p4_times, p4_orders, p6_found, p6_partial, p6_full)
}
SQL = {
    "p1_found": _P1 + """select record_id, 'node' as kind, parent_path as owner_key, path as item_key from lev
        union all select record_id, 'mutation', path, gene || ':' || mutation from muts
        union all select record_id, kind, taxon, pos || ':' || value from items where taxon is not null and pos is not null and value is not null""",
    "p1_nodes": _P1 + "select record_id, parent_path, path, json_extract_string(node, '$.name') as name from lev",
    "p1_mutations": _P1 + "select record_id, path, gene, mutation from muts",
    "p3_found": _P3 + "select line_id, reason from judged where reason is not null",
    "p3_loaded": _P3 + "select line_id, file_name, name, nullif(date, '') as date from judged where reason is null",
    "p4_found": _P4 + " select meta_id, field_name, start_s from times",
    "p4_times": _P4 + " select meta_id, field_name, coalesce(start_s, -1) as start_s, round(lo, 9) as lo, round(hi, 9) as hi, start_s is not null as is_ok from v left join times using (meta_id, field_name)",
    "p6_found": _p6_sql(_BOTH, "r.tree_id is not null and r.n is not null"),
    "p6_partial": _p6_sql("(r.tree_id = t.tree_id or (r.tree_id is null and r.n is not null)) and (r.n = t.n or (r.n is null and r.tree_id is not null))", "r.tree_id is not null or r.n is not null"),
    "p6_full": _p6_sql(_BOTH, "r.tree_id is not null or r.n is not null", "r.tree_id is null or r.n is null"),
}
