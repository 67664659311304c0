"""Queries p1_ to p4_ over the capture tables, and SQL for those that SQL can state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prismgrid.operators import drift, orphans, shred, snapshots
from prismgrid.session import shared_folder
from prismgrid.sources.tables import table


def p1_found(spark, sf):
    changes = drift.schema_changes(table(spark, sf, "crawl_files"))
    return changes.select("feed", "file_no", "field_path", "change_kind", "new_path")


def p1_lifespans(spark, sf):
    return drift.lifespans(drift.file_footers(table(spark, sf, "crawl_files")))


def p1_records(spark, sf):
    return drift.unified_records(table(spark, sf, "crawl_files"))


def _captures(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def p2_found(spark, sf):
    return orphans.find_orphans(*_captures(spark, sf, "elements", "page_nodes", "nav_edges"))


def p2_report(spark, sf):
    return orphans.orphan_report(*_captures(spark, sf, "elements", "page_nodes", "nav_edges"))


def p2_incremental(spark, sf):
    """p2_found out of a log that took the deliveries in three parts by arrival."""
    tables = _captures(spark, sf, "elements", "page_nodes", "nav_edges")
    log = orphans.OrphanLog(spark, f"{shared_folder(spark)}/orphans-{uuid.uuid4().hex}")
    first, last = tables[1].agg(F.min("arrived_at"), F.max("arrived_at")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)] if first else []
    at = F.coalesce(F.col("arrived_at"), F.lit(first))
    part = sum([(at >= c).cast("int") for c in cuts], F.lit(0))
    for k in range(len(cuts) + 1):
        log.append(orphans.deliveries(*[t.where(part == k) for t in tables]))
    return log.orphans().drop("resolved")


def p3_found(spark, sf):
    changes = snapshots.snapshot_changes(*_captures(spark, sf, "crawls", "page_nodes", "elements"))
    return changes.drop("changed_fields")


def p3_counts(spark, sf):
    changes = snapshots.snapshot_changes(*_captures(spark, sf, "crawls", "page_nodes", "elements"))
    return changes.groupBy("prev_crawl_id", "crawl_id", "record_type", "change_kind").count().withColumnRenamed("count", "n")


def p4_found(spark, sf):
    return shred.capture_records(table(spark, sf, "raw_captures"))


def p4_unread(spark, sf):
    return shred.unread_bodies(table(spark, sf, "raw_captures"))


def _shredded(name):
    return lambda spark, sf: shred.capture_table(table(spark, sf, "raw_captures"), name)


QUERIES = {
    "p1_found": p1_found,
    "p1_lifespans": p1_lifespans,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_incremental": p2_incremental,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_unread": p4_unread,
    **{f"p4_{name}": _shredded(name) for name in shred.TABLE_SCHEMA},
}

_SLASH = r"'^((?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)?/[^?]*)/(\?.*)?$'"
_HOST = r"'^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)(\?.*)?$'"
_WS = r"'[\s\p{Z}]+'"


def page_sql(url: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({url}, '#.*$', '', 's'), {_SLASH}, '\1\2'), {_HOST}, '\1/\2')"


def _latest_sql(source: str, key: str, cells: str) -> str:
    return f"(select {key}, min(arrived_at) as first_at, arg_max(struct_pack({cells}), arrived_at) as c from {source} where {key} is not null group by {key})"


_E = _latest_sql(
    "elements",
    "element_id",
    f"crawl_id := coalesce(crawl_id, '~'), url := coalesce({page_sql('url')}, '~'), frame := coalesce(frame, ''), "
    f"dom_path := regexp_replace(dom_path, {_WS}, '', 'g'), name := accessible_name, controls := controls, "
    "owner_form := owner_form, deleted_at := deleted_at",
)
_P = _latest_sql("page_nodes", "page_id", f"crawl_id := coalesce(crawl_id, '~'), url := coalesce({page_sql('url')}, '~'), deleted_at := deleted_at")
_N = _latest_sql("nav_edges", "edge_id", "crawl_id := coalesce(crawl_id, '~'), target := target")

_ORPHANS = f"""
with e as materialized {_E}, p as materialized {_P}, n as {_N},
r as (
  select distinct 'elements' as ref_table, ref_field, ref_id, k1, k2, k3, target as missing_target, first_at,
         date_trunc('month', first_at) + interval 1 month as month_end
  from (select 'controls' as ref_field, element_id as ref_id, c.crawl_id as k1, c.url as k2, c.frame as k3, first_at,
               regexp_replace(unnest(c.controls), {_WS}, '', 'g') as target from e
        union all
        select 'owner_form', element_id, c.crawl_id, c.url, c.frame, first_at, regexp_replace(c.owner_form, {_WS}, '', 'g') from e)
  where target <> ''
  union all
  select 'nav_edges', 'target', edge_id, c.crawl_id, '', '', {page_sql('c.target')}, first_at,
         date_trunc('month', first_at) + interval 1 month
  from n where regexp_replace(c.target, {_WS}, '', 'g') <> ''),
t as (
  select 'elements' as ref_table, c.crawl_id as k1, c.url as k2, c.frame as k3, c.dom_path as target, first_at, c.deleted_at as deleted_at from e
  union all
  select 'nav_edges', c.crawl_id, '', '', c.url, first_at, c.deleted_at from p),
o as (
  select r.* from r where not exists (
    select 1 from t where t.ref_table = r.ref_table and t.k1 = r.k1 and t.k2 = r.k2 and t.k3 = r.k3
      and t.target = r.missing_target and t.first_at < r.month_end and (t.deleted_at is null or t.deleted_at >= r.month_end)))
"""

SQL = {
    "p2_found": _ORPHANS
    + "select distinct ref_table, ref_field, ref_id, missing_target, strftime(first_at, '%Y-%m') as period from o",
    "p2_report": _ORPHANS
    + """
select ref_table, ref_field, strftime(first_at, '%Y-%m') as period, count(*) as new_orphans,
       count(*) filter (where later) as resolved, count(*) filter (where not later) as open_at_end
from (select o.*, exists (select 1 from t where t.ref_table = o.ref_table and t.k1 = o.k1 and t.k2 = o.k2 and t.k3 = o.k3
        and t.target = o.missing_target and t.deleted_at is null) as later from o)
group by all""",
}

_CHANGES = rf"""
with e as {_E}, p as {_P},
d as (select crawl_id, arg_max(struct_pack(site := site, config_file := config_file, started_at := started_at, finished_at := finished_at), arrived_at) as c
      from crawls where crawl_id is not null group by crawl_id),
pr as (select * from (
         select crawl_id, lag(crawl_id) over (partition by c.site, c.config_file order by c.started_at, c.finished_at, crawl_id) as prev_crawl_id
         from d where c.finished_at is not null and c.started_at is not null) where prev_crawl_id is not null),
k as (select distinct c.crawl_id as crawl_id, 'page' as record_type, c.url as url, '' as frame, '' as dom_path, '' as name from p
      union all
      select distinct c.crawl_id, 'element', c.url, c.frame, coalesce(c.dom_path, ''),
             lower(trim(regexp_replace(coalesce(c.name, ''), {_WS}, ' ', 'g'))) from e),
nw as (select pr.prev_crawl_id, k.* from pr join k using (crawl_id)),
od as (select pr.prev_crawl_id, pr.crawl_id, k.* exclude (crawl_id) from pr join k on k.crawl_id = pr.prev_crawl_id),
ch as (
  select prev_crawl_id, crawl_id, record_type, url, frame, dom_path,
         case when o.name is null then 'added' when n.name is null then 'removed' else 'changed' end as change_kind
  from nw n full join od o using (prev_crawl_id, crawl_id, record_type, url, frame, dom_path)
  where o.name is null or n.name is null or o.name <> n.name)
"""
SQL["p2_incremental"] = SQL["p2_found"]
SQL["p3_found"] = _CHANGES + "select distinct * from ch"
SQL["p3_counts"] = (
    _CHANGES
    + "select prev_crawl_id, crawl_id, record_type, change_kind, count(*) as n from (select distinct * from ch) group by all"
)
SQL["p4_unread"] = r"""
with b as (select capture_id, body, regexp_replace(body, '^\x{FEFF}', '') as t from raw_captures),
o as (select *, case when json_valid(t) and json_type(t::json) = 'VARCHAR' then t::json->>'$' else t end as u from b)
select distinct capture_id, case when body is null or regexp_full_match(body, '\s*') then 'blank' when not json_valid(u) then 'unreadable' else 'no object' end as reason
from o where body is null or not json_valid(u) or json_type(case when json_valid(u) then u end::json) <> 'OBJECT'
"""
SQL["p1_lifespans"] = r"""
with r as (select feed, file_no, regexp_replace(record, '^\x{FEFF}', '') as t from crawl_files where feed is not null and file_no is not null and record is not null),
o as (select feed, file_no, case when json_valid(t) then case when json_type(t::json) = 'VARCHAR' then t::json->>'$' else t end end as u from r),
d as (select feed, file_no, u::json as u from o where json_valid(u) and json_type(u::json) = 'OBJECT'),
x as (select feed, file_no, regexp_replace(substr(t.fullkey, 3), '\[[0-9]+\]', '[]', 'g') as path, t.type as type from d, json_tree(d.u) t where t.fullkey <> '$'),
k as (select feed, file_no, path, coalesce(string_agg(distinct kind, '|' order by kind), '') as kind from (
  select feed, file_no, path, case when type = 'NULL' then null when type = 'VARCHAR' then 'string' when type = 'BOOLEAN' then 'boolean' when type = 'OBJECT' then 'object'
    when type = 'ARRAY' then 'array' else 'number' end as kind from x where not (ends_with(path, '[]') and type <> 'ARRAY')) group by all),
f as (select feed, file_no, row_number() over (partition by feed order by file_no) as seq, count(*) over (partition by feed) as files from (select distinct feed, file_no from k)),
g as (select k.*, seq, files, seq - row_number() over (partition by feed, path, kind order by seq) as island from k join f using (feed, file_no))
select feed, path, kind, min(file_no) as first_file, max(file_no) as last_file, count(*) as n_files, min(seq) > 1 as starts, max(seq) < any_value(files) as ends
from g group by feed, path, kind, island
"""
