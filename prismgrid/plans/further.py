"""Queries on crawling, relations as counters, runs and the steps of scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismgrid.operators import generation, navigation, relations, runs
from prismgrid.operators.capture import current
from prismgrid.plans.reference import _CTL, _ENDPOINT, _HOST, CR, ED, FP, LABELS, PG, SQL as REFERENCE, _requests, edges, elements, labels, pages, strip_sql
from prismgrid.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _round(k: int) -> str:
    """SQL of one round of a capture with a budget of five pages."""
    return f"""c{k} as (select * from (
  select f.crawl_id, f.url, {k} as clicks, used + row_number() over (partition by f.crawl_id order by f.edge_id, f.url) as turn
  from (select e.crawl_id, e.target as url, min(e.edge_id) as edge_id from c{k - 1} c join e on e.crawl_id = c.crawl_id and e.source = c.url
        where not exists (select 1 from s{k - 1} s where s.crawl_id = e.crawl_id and s.url = e.target) group by 1, 2) f
  join (select crawl_id, max(turn) as used from s{k - 1} group by 1) u on u.crawl_id = f.crawl_id) where turn <= 5),
s{k} as (select * from s{k - 1} union all select * from c{k})"""


@query(
    "crawl_frontier",
    f"""with {ED}, {PG}, e as (select crawl_id, source, target, min(edge_id) as edge_id from ed where source <> target
  and exists (select 1 from pg where pg.crawl_id = ed.crawl_id and pg.url = ed.target) group by all),
c0 as (select * from (select crawl_id, url, 0 as clicks, row_number() over (partition by crawl_id order by url) as turn from pg where depth = 0) where turn <= 5),
s0 as (select * from c0), {_round(1)}, {_round(2)}, {_round(3)} select * from s3""",
)
def crawl_frontier(s, d):
    return navigation.crawl_frontier(pages(s, d), edges(s, d), max_pages=5)


@query(
    "relation_stats",
    f"""with sc as (with {PG} select crawl_id, 'screens' as counter, count(*) as n from pg group by 1),
ne as (with {ED} select crawl_id, 'navigation_edges', count(*) from ed group by 1),
le as (with {ED} select crawl_id, 'labelled_edges', count(*) from ed where label <> '' group by 1),
el_ as (select crawl_id, 'element_links', count(*) from ({REFERENCE["element_links"]}) group by 1),
fm as (select crawl_id, 'forms', count(*) from ({REFERENCE["forms"]}) group by 1),
ff as (select crawl_id, 'form_fields', sum(fields)::bigint from ({REFERENCE["forms"]}) group by 1),
tb as (select crawl_id, 'tables', count(*) from ({REFERENCE["tables"]}) group by 1),
os as (select crawl_id, 'orphan_screens', count(*) from ({REFERENCE["orphan_screens"]}) group by 1)
select * from sc union all select * from ne union all select * from le union all select * from el_ union all select * from fm
union all select * from ff union all select * from tb union all select * from os""",
)
def relation_stats(s, d):
    return relations.relation_stats(pages(s, d), edges(s, d), elements(s, d))


@query(
    "top_endpoints",
    rf"""with r as (select 'https://api.example/' || event_type || '/' || coalesce(json_extract_string(props, '$.k'), 'none') || case when event_type = 'view' then '/graphql' else '' end as url
  from events where event_type <> 'scroll')
select endpoint, count(*) as calls from (select {_ENDPOINT} as endpoint from r) where endpoint <> '' group by 1 order by calls desc, endpoint limit 5""",
)
def top_endpoints(s, d):
    return navigation.top_endpoints(_requests(table(s, d, "events")), limit=5)


@query("event_sequence", "select user_id as run_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events")
def event_sequence(s, d):
    return runs.numbered(table(s, d, "events"))


@query(
    "run_index",
    f"""with {CR} select coalesce(run_id, crawl_id) as run_id, arg_max(crawl_id, (coalesce(finished_at, timestamp '1900-01-01'), crawl_id)) as crawl_id,
  max(coalesce(finished_at, timestamp '1900-01-01')) as "at",
  arg_max(case when finished_at is null then 'failed' when pages_failed > 0 then 'partial' else 'ok' end, (coalesce(finished_at, timestamp '1900-01-01'), crawl_id)) as outcome,
  arg_max(coalesce(pages_crawled, 0), (coalesce(finished_at, timestamp '1900-01-01'), crawl_id)) as pages, count(*) as finishes from cr group by 1""",
)
def run_index(s, d):
    crawls = table(s, d, "crawls")
    ends = current(crawls, "crawl_id", ["finished_at"], ["run_id", "site"])
    finished = F.coalesce("finished_at", F.lit("1900-01-01 00:00:00").cast("timestamp_ntz"))
    return runs.run_index(runs.run_outcomes(crawls).join(ends, "crawl_id"), finished)


_FORM = "label in ('form_input', 'filter')"
_SMOKE = "['primary_action', 'navigation', 'data_display', 'filter', 'form_input', 'secondary_action']"


@query(
    "scenario_steps",
    f"""with {FP}, {LABELS}, {PG}, {ED}, {_CTL}, pt as (select crawl_id, url, nullif(title, '') as title from pg),
kn as (select *, row_number() over (partition by crawl_id, url order by o) as i from (
  select crawl_id, url, accessible_name as name, min((list_position({_SMOKE}, label), rk)) as o from ct where rk <= 2 and list_contains({_SMOKE}, label) group by 1, 2, 3)),
ff as (select crawl_id, url, accessible_name as name, row_number() over (partition by crawl_id, url order by label = 'filter', rk) as i from ct where {_FORM}),
dg as (select crawl_id, url, accessible_name as name, rk as i from ct where label = 'destructive'),
rl as (select crawl_id, source, target, edge_id, {strip_sql("label")} as l from ed where regexp_matches(target, '^(https?|file):') and lower({_HOST % "target"}) = lower({_HOST % "source"})
  qualify row_number() over (partition by crawl_id, source, target order by edge_id) = 1),
lk as (select crawl_id, source as url, l as name, target, row_number() over (partition by crawl_id, source order by edge_id, l) as i from (
  select * from rl where l <> '' and source <> target and exists (select 1 from pg where pg.crawl_id = rl.crawl_id and pg.url = rl.target)
  qualify row_number() over (partition by crawl_id, source, l order by edge_id, target) = 1)
  where exists (select 1 from pg where pg.crawl_id = crawl_id and pg.url = source)),
l3 as (select lk.* from lk join pt on pt.crawl_id = lk.crawl_id and pt.url = lk.url where i <= 3)
select crawl_id, url, 'smoke' as kind, 0 as number, 0 as step, 'navigate' as action, url as target, '' as note from pt
union all select crawl_id, url, 'smoke', 0, 1, 'assert_title', title, '' from pt where title is not null
union all select kn.crawl_id, kn.url, 'smoke', 0, i + (title is not null)::int, 'assert_visible', name, '' from kn join pt on pt.crawl_id = kn.crawl_id and pt.url = kn.url where i <= 6
union all select crawl_id, url, 'navigation', i - 1, 0, 'navigate', url, '' from l3
union all select crawl_id, url, 'navigation', i - 1, 1, 'click', name, '' from l3
union all select crawl_id, url, 'navigation', i - 1, 2, 'assert_url', target, '' from l3
union all select distinct crawl_id, url, 'form', 0, 0, 'navigate', url, '' from ff
union all select crawl_id, url, 'form', 0, i, 'fill', name, '' from ff where i <= 4
union all select crawl_id, url, 'form', 0, least(max(i), 4) + 1, 'guard_skip', 'submit', 'Do NOT auto-submit — needs test data & authorization.' from ff group by 1, 2
union all select distinct crawl_id, url, 'destructive_guard', 0, 0, 'navigate', url, '' from dg
union all select crawl_id, url, 'destructive_guard', 0, i, 'guard_skip', name, 'destructive — must never be automated' from dg""",
)
def scenario_steps(s, d):
    return generation.scenario_steps(pages(s, d), edges(s, d), labels(s, d))
