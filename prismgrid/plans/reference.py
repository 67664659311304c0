"""Queries over captures: one per analysis, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismgrid.functions import identity
from prismgrid.functions.text import EDGES
from prismgrid.operators import components, diff, generation, navigation, redaction, relations, runs, snapshots
from prismgrid.operators.capture import current_edges, current_elements, current_pages
from prismgrid.plans.problems import page_sql
from prismgrid.sources.tables import table

NOW, RETENTION = "2026-01-15 00:00:00", 90
INCLUDE, EXCLUDE = ["/", "/billing/**", "/queues/*", "/reports", "/vault?*"], ["/queues/export*", "/**/edit"]
MODULES = {"/billing": "Billing", "/queues": "Queues", "/queues/export-old": "Exports", "/reports": "Reports"}
NEVER_TOUCH = ["export", "#nav"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- SQL parts -------------------------------------------------------------------------


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '{EDGES}', '', 'g')"


def squeeze_sql(x: str) -> str:
    return rf"regexp_replace(lower({strip_sql(f'coalesce({x}, {chr(39)}{chr(39)})')}), '[\s\p{{Z}}]+', ' ', 'g')"


def case_sql(x: str, mapping: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"


def words_sql(x: str, words) -> str:
    from prismgrid.functions.text import any_word

    return f"regexp_matches({x}, '{any_word(words)}')"


EL = f"""el as (select * from (
  select * replace ({page_sql("url")} as url) from elements where element_id is not null
  qualify row_number() over (partition by element_id order by arrived_at desc, coalesce(accessible_name, '') desc, coalesce(text, '') desc) = 1)
  where crawl_id is not null and url is not null)"""
PG = f"""pg0 as (select * from (
  select * replace ({page_sql("url")} as url) from page_nodes where page_id is not null)
  qualify row_number() over (partition by page_id order by arrived_at desc, coalesce(title, '') desc, coalesce(url, '') desc) = 1),
pg as (select * from pg0 where crawl_id is not null and url is not null
  qualify row_number() over (partition by crawl_id, url order by coalesce(depth, 1073741824), page_id) = 1)"""
ED = f"""ed as (select edge_id, crawl_id, {page_sql("source")} as source, {page_sql("target")} as target, coalesce(label, '') as label,
  nullif(region, '') as region, coalesce(nullif(control, ''), 'link') as control from (
  select * from nav_edges where edge_id is not null
  qualify row_number() over (partition by edge_id order by arrived_at desc, coalesce(target, '') desc, coalesce(label, '') desc) = 1)
  where crawl_id is not null and source <> '' and target <> '')"""
CR = """cr as (select * from crawls where crawl_id is not null
  qualify row_number() over (partition by crawl_id order by arrived_at desc, coalesce(run_id, '') desc, coalesce(site, '') desc) = 1)"""


def _generated(v: str) -> str:
    s = strip_sql(v)
    tests = " or ".join(f"regexp_matches({s}, '{p}')" for p in identity.GENERATED)
    return f"({v} is null or {v} = '' or length({s}) > 40 or {tests})"


_STRUCT = (
    "array_to_string(list_filter(list_transform(string_split(coalesce(dom_path, ''), ' > '), "
    f"lambda s: regexp_replace({strip_sql('s')}, '#[^ >]+', '', 'g')), lambda s: s <> ''), ' > ')"
)
FP = f"""{EL},
f0 as (select *, coalesce(nullif(role, ''), tag, '') as r, attributes['data-testid'] as t, attributes['id'] as i, attributes['name'] as m,
         substr({squeeze_sql("coalesce(nullif(accessible_name, ''), text)")}, 1, 80) as nm, coalesce(landmark, '') as lm,
         {_STRUCT} as st, coalesce(category, '') as cat from el),
f1 as (select *, case when not {_generated("t")} then 'data-testid' when not {_generated("i")} then 'id' when not {_generated("m")} then 'name' else 'structural' end as strategy from f0),
fp as (select * exclude (r, t, i, m, nm, lm, st, cat),
         substr(sha1(url || '|' || cat || '|' || case strategy when 'data-testid' then 'testid=' || t when 'id' then 'id=' || i
           when 'name' then 'name=' || m || '|role=' || r else 'struct=' || st || '|role=' || r || '|name=' || nm || '|lm=' || lm end), 1, 16) as fingerprint,
         substr(sha1(cat || '|' || r || '|' || lm || '|' || regexp_replace(st, ':nth-of-type\\([0-9]+\\)', '', 'g')), 1, 12) as component_signature from f1)"""
_SAFE_WORDS = rf"regexp_replace(coalesce(%s, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')"


def safety_sql(x: str) -> str:
    w = squeeze_sql(_SAFE_WORDS % x)
    return f"case when {words_sql(w, identity.BLOCK_WORDS)} then 'BLOCK' when {words_sql(w, identity.CAUTION_WORDS)} then 'CAUTION' else 'SAFE' end"


def meaning_sql(part: int) -> str:
    """Label, confidence or rationale of an element."""
    role, land = "lower(coalesce(role, ''))", "coalesce(landmark, '')"
    name = f"lower({strip_sql(chr(99) + 'oalesce(accessible_name, ' + chr(39) * 2 + ')')})"
    field = "category in ('input', 'select', 'textarea')"
    rules = [
        (f"category = 'table' or {role} in ('table', 'grid')", "data_display", "high", "table/grid"),
        ("category = 'image'", "informational", "high", "image"),
        ("category = 'nav'", "navigation", "high", "nav landmark"),
        ("category = 'dialog'", "informational", "medium", "dialog container"),
        ("category = 'form'", "form_input", "medium", "form container"),
        (f"{field} and ({role} in ('searchbox', 'combobox') or regexp_matches({name}, '{'|'.join(identity.FILTER_HINTS)}') or {land} = 'search')", "filter", "medium", "search/filter control"),
        (field, "form_input", "high", "form field"),
        (f"category = 'link' and {land} = 'navigation'", "navigation", "high", "link in nav"),
        ("category = 'link'", "navigation", "medium", "content link"),
        (f"category = 'button' and {safety_sql('accessible_name')} = 'BLOCK'", "destructive", "high", "destructive label"),
        (f"category = 'button' and regexp_matches({name}, '{'|'.join(identity.PRIMARY_HINTS)}')", "primary_action", "high", "primary verb"),
        (f"category = 'button' and {safety_sql('accessible_name')} = 'CAUTION'", "secondary_action", "medium", "state-changing"),
        ("category = 'button'", "secondary_action", "medium", "button"),
    ]
    return "case " + " ".join(f"when {r[0]} then '{r[part]}'" for r in rules) + f" else '{('', 'informational', 'low', 'default')[part]}' end"


LABELS = f"lb as (select element_id, crawl_id, url, fingerprint, category, accessible_name, {meaning_sql(1)} as label, {meaning_sql(2)} as confidence, {meaning_sql(3)} as rationale from fp)"
CONTROL = (
    f"coalesce(nullif({strip_sql('accessible_name')}, ''), case when length({strip_sql('text')}) <= 60 then nullif({strip_sql('text')}, '') end, "
    "'(unnamed ' || coalesce(nullif(ui_type, ''), category, '') || ')')"
)
READING = (
    "row_number() over (partition by crawl_id, url order by (bounding_box is null), "
    "cast(round_even(bounding_box.y, 0) as bigint) nulls first, cast(round_even(bounding_box.x, 0) as bigint) nulls first, pos, element_id)"
)


# --- tables ----------------------------------------------------------------------------


def elements(s, d):
    return table(s, d, "elements")


def pages(s, d):
    return table(s, d, "page_nodes")


def edges(s, d):
    return table(s, d, "nav_edges")


def prints(s, d):
    return components.fingerprints(elements(s, d))


def labels(s, d):
    return components.semantic_labels(prints(s, d))


def pairs(s, d):
    return diff.crawl_pairs(snapshots.comparisons(table(s, d, "crawls")))


# --- URLs ------------------------------------------------------------------------------


def targets(s, d):
    return current_edges(edges(s, d)).select("edge_id", F.col("target").alias("url"))


_TG = f"with {ED}, tg as (select edge_id, target as url from ed)"
_PATH = r"coalesce(nullif(regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 3), ''), '/')"
_PATH0 = r"regexp_extract(url, '^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 3)"
_HOST = r"regexp_extract(%s, '^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 2)"


@query("url_normalize", f"select page_id, url, {page_sql('url')} as page_key from page_nodes where url is not null group by all")
def url_normalize(s, d):
    from prismgrid.functions.urls import page_key

    return pages(s, d).where("url is not null").select("page_id", "url", page_key(F.col("url")).alias("page_key")).distinct()


_NOISE = ", ".join(f"'{n}'" for n in [*navigation.NOISE, "page"])


@query(
    "url_dedupe_queries",
    rf"""with k as (select distinct page_id, url, {page_sql('url')} as k from page_nodes where url is not null),
q as (select *, array_to_string(list_sort(list_filter(string_split(regexp_extract(k, '\?(.*)$', 1), '&'),
  lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({_NOISE}))), '&') as q from k)
select page_id, url, regexp_replace(k, '\?.*$', '') || case when q = '' then '' else '?' || q end as page_key from q""",
)
def url_dedupe_queries(s, d):
    rows = pages(s, d).where("url is not null").select("page_id", "url").distinct()
    return rows.withColumn("page_key", navigation.without_noise(F.col("url"), ["page"]))


@query(
    "url_hash_routes",
    rf"select distinct page_id, url, {page_sql('url')} || regexp_extract(url, '(#/.*)$', 1) as page_key from page_nodes where url is not null",
)
def url_hash_routes(s, d):
    rows = pages(s, d).where("url is not null").select("page_id", "url").distinct()
    return rows.withColumn("page_key", navigation.with_hash_route(F.col("url")))


@query(
    "url_scope_filter",
    f"{_TG} select edge_id, url from tg where ("
    + " or ".join(f"regexp_matches({_PATH}, '{navigation.glob(p)}')" for p in INCLUDE)
    + ") and not ("
    + " or ".join(f"regexp_matches({_PATH}, '{navigation.glob(p)}')" for p in EXCLUDE)
    + ")",
)
def url_scope_filter(s, d):
    return targets(s, d).where(navigation.in_scope(F.col("url"), INCLUDE, EXCLUDE))


@query(
    "url_parts",
    f"{_TG} select edge_id, lower({_HOST % 'url'}) as host, {_PATH} as path, "
    + rf"""substr(coalesce(nullif(regexp_replace(regexp_replace(
  case when regexp_replace({_PATH0}, '^/+|/+$', '', 'g') = '' then coalesce(nullif({_HOST % 'url'}, ''), 'page')
       else coalesce(nullif({_HOST % 'url'}, ''), 'page') || '_' || regexp_replace({_PATH0}, '^/+|/+$', '', 'g') end,
  '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'page'), 1, 120) as slug from tg""",
)
def url_parts(s, d):
    u = F.col("url")
    return targets(s, d).select("edge_id", navigation.host_of(u).alias("host"), navigation.path_of(u).alias("path"), navigation.slug(u).alias("slug"))


_SECRET = "|".join([navigation.SECRET, "view", "id"])


@query(
    "url_redaction",
    rf"""{_TG} select edge_id, case when regexp_matches(url, '\?[^#]') then regexp_extract(url, '^([^?]*)', 1) || '?' ||
  array_to_string(list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
    lambda p: case when regexp_matches(split_part(p, '=', 1), '(?i){_SECRET}') then split_part(p, '=', 1) || '=REDACTED' else p end), '&')
  || regexp_extract(url, '(#.*)$', 1) else url end as url from tg""",
)
def url_redaction(s, d):
    return targets(s, d).select("edge_id", navigation.redact_query(F.col("url"), ["view", "id"]).alias("url"))


_ENDPOINT = rf"""coalesce(nullif({_HOST % 'url'} || array_to_string(list_transform(string_split({_PATH0}, '/'),
  lambda s: case when regexp_matches(s, '{navigation.ID_SEGMENT}') then ':id' else s end), '/'), ''), url)"""


@query("endpoint_patterns", f"{_TG} select {_ENDPOINT} as endpoint, count(*) as n from tg group by all")
def endpoint_patterns(s, d):
    return targets(s, d).groupBy(navigation.endpoint_pattern(F.col("url")).alias("endpoint")).agg(F.count("*").alias("n"))


@query(
    "module_assignment",
    f"with {PG}, p as (select crawl_id, url, regexp_replace({_PATH}, '/+$', '') as p from pg) select crawl_id, url, case "
    + " ".join(f"when p = '{k}' or starts_with(p, '{k}/') then '{v}'" for k, v in sorted(MODULES.items(), key=lambda kv: -len(kv[0])))
    + " else 'general' end as module from p",
)
def module_assignment(s, d):
    return navigation.modules(current_pages(pages(s, d)).select("crawl_id", "url"), MODULES)


# --- links and screens ------------------------------------------------------------------


@query(
    "resolve_labelled_links",
    f"""with {ED} select crawl_id, source, target, {strip_sql('label')} as label, coalesce(region, '') as region, control from ed
where regexp_matches(target, '^(https?|file):') and lower({_HOST % 'target'}) = lower({_HOST % 'source'})
qualify row_number() over (partition by crawl_id, source, target order by edge_id) = 1""",
)
def resolve_labelled_links(s, d):
    return navigation.resolved_links(edges(s, d))


@query(
    "discovered_not_captured",
    f"""with {ED}, {PG} select crawl_id, target, count(distinct source) as screens from ed
where not exists (select 1 from pg where pg.crawl_id = ed.crawl_id and pg.url = ed.target) group by all""",
)
def discovered_not_captured(s, d):
    return navigation.not_captured(pages(s, d), edges(s, d))


@query(
    "screen_adjacency",
    f"""with {ED}, {PG}, e as (select distinct crawl_id, source, target from ed where source <> target)
select crawl_id, url, (select count(*) from e where e.crawl_id = pg.crawl_id and e.target = pg.url) as inbound,
  (select count(*) from e where e.crawl_id = pg.crawl_id and e.source = pg.url) as outbound from pg""",
)
def screen_adjacency(s, d):
    return navigation.adjacency(pages(s, d), edges(s, d))


@query(
    "orphan_screens",
    f"""with {ED}, {PG}, q as (select crawl_id, url, depth, bool_or(depth = 0) over (partition by crawl_id) as has_root,
  row_number() over (partition by crawl_id order by depth nulls last, url) as rn from pg)
select crawl_id, url, depth from q where not case when coalesce(has_root, false) then coalesce(depth = 0, false) else rn = 1 end
and not exists (select 1 from ed where ed.crawl_id = q.crawl_id and ed.target = q.url and ed.source <> ed.target)""",
)
def orphan_screens(s, d):
    return navigation.orphan_screens(pages(s, d), edges(s, d))


@query(
    "bfs_depths",
    f"""with recursive {ED}, {PG}, e as (select distinct crawl_id, source, target from ed where source <> target),
b(crawl_id, url, clicks) using key (crawl_id, url) as (select crawl_id, url, 0 from pg where depth = 0
      union
      select e.crawl_id, e.target, min(b.clicks + 1) from b join e on e.crawl_id = b.crawl_id and e.source = b.url
      left join recurring.b as met on met.crawl_id = e.crawl_id and met.url = e.target where met.url is null group by 1, 2)
select * from b""",
)
def bfs_depths(s, d):
    return navigation.bfs_depths(pages(s, d), edges(s, d))


@query(
    "egress_ledger",
    f"""with {ED}, h as (select crawl_id, edge_id, lower({_HOST % 'source'}) as home, lower({_HOST % 'target'}) as host, target as url from ed),
hm as (select crawl_id, home from (select crawl_id, home, count(*) as n from h group by all)
       qualify row_number() over (partition by crawl_id order by n desc, home) = 1)
select h.crawl_id, host, count(*) as requests, arg_min({_PATH}, edge_id) as first_path, host = any_value(hm.home) as in_scope
from h join hm on hm.crawl_id = h.crawl_id where host <> '' group by h.crawl_id, host""",
)
def egress_ledger(s, d):
    return navigation.egress_ledger(edges(s, d))


@query(
    "controls_with_destinations",
    f"""with {ED}, {EL}, f as (select crawl_id, source, label, arg_min(target, edge_id) as leads_to from ed where label <> '' group by all),
l as (select element_id, crawl_id, url, {strip_sql("coalesce(nullif(accessible_name, ''), text)")} as label from el where category in ('link', 'button'))
select l.*, f.leads_to from l left join f on f.crawl_id = l.crawl_id and f.source = l.url and f.label = l.label where l.label <> ''""",
)
def controls_with_destinations(s, d):
    return navigation.link_destinations(elements(s, d), edges(s, d)).select("element_id", "crawl_id", "url", "label", "leads_to")


def _requests(events):
    """The event stream read as network requests."""
    n = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.when(kind == "purchase", "post").otherwise("get").alias("method"),
        F.concat(F.lit("https://api.example/"), kind, F.lit("/"), F.coalesce(n, F.lit("none")), F.when(kind == "view", "/graphql").otherwise("")).alias("url"),
        F.when(kind == "scroll", "image").otherwise("xhr").alias("resource_type"),
        (F.lit(200) + F.col("event_id") % 3).cast("int").alias("status"),
    )


@query(
    "api_endpoints",
    rf"""with r as (select event_id, case when event_type = 'purchase' then 'POST' else 'GET' end as method,
  'https://api.example/' || event_type || '/' || coalesce(json_extract_string(props, '$.k'), 'none') || case when event_type = 'view' then '/graphql' else '' end as url,
  event_type <> 'scroll' as api, 200 + event_id % 3 as status from events)
select method, {_ENDPOINT} as endpoint, count(*) as calls, arg_min(lower({_PATH0}) like '%graphql%' or (method = 'POST' and ends_with(lower({_PATH0}), '/gql')), event_id) as graphql,
  array_to_string(list_sort(list(distinct status)), ',') as statuses from r where api group by 1, 2""",
)
def api_endpoints(s, d):
    return navigation.api_endpoints(_requests(table(s, d, "events")))


# --- elements ---------------------------------------------------------------------------


@query("element_fingerprints", f"with {FP} select element_id, strategy, fingerprint, component_signature from fp")
def element_fingerprints(s, d):
    return prints(s, d).select("element_id", "strategy", "fingerprint", "component_signature")


_A = lambda k: f"attributes['{k}']"
_TAG = f"lower({strip_sql('coalesce(tag, ' + chr(39) * 2 + ')')})"
_ROLE = f"""coalesce(nullif(lower(split_part({strip_sql("coalesce(attributes['role'], '')")}, ' ', 1)), ''),
  case when {_TAG} = 'input' then coalesce({case_sql("lower(coalesce(attributes['type'], 'text'))", identity.INPUT_TYPES)}, 'textbox') end,
  {case_sql(_TAG, identity.TAG_TYPES)}, lower({strip_sql('role')}), '')"""
UI = f"""{EL},
u0 as (select *, {_ROLE} as rl, lower({strip_sql(_A('aria-roledescription'))}) as described,
  lower(coalesce(accessible_name, '') || ' ' || coalesce({_A('aria-label')}, '') || ' ' || coalesce({_A('class')}, '')) as words from el),
u1 as (select *, coalesce({case_sql('rl', identity.ROLE_TYPES)}, rl) as k from u0),
ui as (select * exclude (ui_type), case when described <> '' then substr(described, 1, 40)
  when k = 'navigation' and regexp_matches(words, 'breadcrumb|bread crumb') then 'breadcrumb'
  when k = 'navigation' and regexp_matches(words, 'pagination|pager|paging') then 'pagination'
  when k = 'dialog' and not coalesce({_A('aria-modal')} = 'true', false) then 'drawer'
  when k = 'link' and {_A('download')} is not null then 'download-link'
  when k = 'link' and {_A('target')} = '_blank' then 'external-link'
  when k = 'columnheader' and nullif({_A('aria-sort')}, '') is not null then 'sortable-column'
  when k in ({', '.join(f"'{t}'" for t in identity.UI_TYPES)}) then k
  when {_A('contenteditable')} in ('', 'true') then 'rich-text-editor'
  when nullif({_A('aria-sort')}, '') is not null then 'sortable-column'
  when {_A('aria-invalid')} = 'true' then 'validation-message'
  when nullif({_A('aria-live')}, '') is not null then 'live-region'
  when {_A('aria-expanded')} is not null then 'disclosure'
  when nullif({_A('aria-haspopup')}, '') is not null then 'menu' end as ui_type from u1)"""


@query("ui_types", f"with {UI} select element_id, ui_type from ui")
def ui_types(s, d):
    return current_elements(elements(s, d), *components.IDENTITY).select("element_id", identity.ui_type().alias("ui_type"))


@query(
    "ui_type_coverage",
    f"""with {UI}, f as (select ui_type, count(*) as n from ui where ui_type is not null group by 1),
c as (select unnest([{', '.join(f"'{t}'" for t in identity.UI_TYPES)}]) as ui_type)
select coalesce(f.ui_type, c.ui_type) as ui_type, coalesce(n, 0) as n,
  case when c.ui_type is null then 'app_declared' when n is null then 'absent' else 'found' end as bucket from f full join c on f.ui_type = c.ui_type""",
)
def ui_type_coverage(s, d):
    return components.type_coverage(elements(s, d))


@query("label_safety", f"with {EL} select element_id, {safety_sql('accessible_name')} as safety from el")
def label_safety(s, d):
    rows = current_elements(elements(s, d), "accessible_name")
    return rows.select("element_id", identity.safety_label(F.col("accessible_name")).alias("safety"))


_HAS = lambda k: f"coalesce(map_contains(attributes, '{k}'), false)"
_KIND = f"""case when lower(coalesce(role, '')) = 'tab' or {_HAS('aria-selected')} then 'tab'
  when {_TAG} = 'summary' or ({_HAS('open')} and {_TAG} = 'details') then 'disclosure'
  when {_HAS('aria-haspopup')} then 'menu' when {_HAS('aria-expanded')} then 'expander'
  when category = 'link' then 'navigation' when category = 'button' then 'button'
  when category in ('input', 'select', 'textarea', 'form') then 'form-control' else 'other' end"""
_NAME = "coalesce(nullif(accessible_name, ''), text, '')"
_BANNED = "case " + " ".join(f"when contains(lower({_NAME}), '{r}') or contains(lower(coalesce(dom_path, '')), '{r}') then '{r}'" for r in NEVER_TOUCH) + " end"


@query(
    "interaction_decisions",
    f"""with {EL}, k as (select *, {_KIND} as kind, {safety_sql(_NAME)} as safety, {_BANNED} as banned from el)
select element_id, kind, safety, case when not coalesce(visible, true) or not coalesce(enabled, true) then 'not visible/enabled'
  when banned is not null then 'matches never_touch rule ''' || banned || ''''
  when nullif(frame, '') is not null then 'inside an iframe (observed only)'
  when kind not in ('tab', 'expander', 'disclosure', 'menu') then 'type ''' || kind || ''' not on allow-list (observe only)'
  when safety <> 'SAFE' then 'label ' || safety || ' (observe only)' end as skipped_reason from k""",
)
def interaction_decisions(s, d):
    rows = current_elements(elements(s, d), *components.IDENTITY, "visible", "enabled", "frame")
    name = F.coalesce(F.nullif("accessible_name", F.lit("")), F.col("text"))
    rows = rows.withColumns({"kind": identity.interaction_type(), "safety": identity.safety_label(name)})
    return rows.select("element_id", "kind", "safety", identity.decision(F.col("kind"), F.col("safety"), NEVER_TOUCH).alias("skipped_reason"))


@query("semantic_labels", f"with {FP}, {LABELS} select element_id, label, confidence, rationale from lb")
def semantic_labels(s, d):
    return labels(s, d).select("element_id", "label", "confidence", "rationale")


@query("semantic_stats", f"with {FP}, {LABELS} select crawl_id, label, count(*) as n from lb group by all")
def semantic_stats(s, d):
    return labels(s, d).groupBy("crawl_id", "label").agg(F.count("*").alias("n"))


@query(
    "semantic_mock_refine",
    f"""with {FP}, {LABELS}, m as (select fingerprint, case when category = 'link' and lower(trim(accessible_name)) in ('view', 'open', 'details') then 'secondary_action' else label end as label from lb),
r as (select fingerprint, max(label) as label from m group by 1)
select element_id, r.label, 'high' as confidence, 'mock-refined' as rationale, 'provider' as source from lb join r using (fingerprint)""",
)
def semantic_mock_refine(s, d):
    found = labels(s, d)
    return components.refine_labels(found, components.mock_refinement(found)).select("element_id", "label", "confidence", "rationale", "source")


@query(
    "regions",
    f"""with {EL}, r as (select crawl_id, url, coalesce(nullif(landmark, ''), 'unlabeled') as region, category from el)
select crawl_id, url, region, category, count(*) as n, coalesce(nullif(list_position([{', '.join(f"'{r}'" for r in components.REGIONS)}], region), 0), 100) - 1 as place from r group by all""",
)
def regions(s, d):
    return components.regions(elements(s, d))


_SHARED = f"""sh as (select crawl_id, 'shared-' || substr(sha1(lm || '|' || rl || '|' || nm || '|' || cat), 1, 8) as component_id, 'shared' as kind,
  arg_min(component_signature, (url, pos, element_id)) as signature, rl as role, arg_min(accessible_name, (url, pos, element_id)) as label, lm as landmark, cat as category,
  count(distinct url) as page_count, count(*) as instance_count
  from (select *, coalesce(landmark, '') as lm, coalesce(role, '') as rl, lower({strip_sql('accessible_name')}) as nm, coalesce(category, '') as cat from fp where {strip_sql('accessible_name')} <> '')
  group by crawl_id, lm, rl, nm, cat having count(distinct url) >= 2)"""
_REPEATED = """rp as (select crawl_id, 'repeated-' || substr(sha1(component_signature), 1, 8) as component_id, 'repeated' as kind, component_signature as signature,
  arg_min(coalesce(role, ''), k) as role, arg_min(coalesce(nullif(accessible_name, ''), category), k) as label, arg_min(coalesce(landmark, ''), k) as landmark,
  arg_min(coalesce(category, ''), k) as category, count(distinct url) filter (where n >= 2) as page_count, count(*) filter (where n >= 2) as instance_count
  from (select *, (url, pos, element_id) as k, count(*) over (partition by crawl_id, component_signature, url) as n from fp)
  group by crawl_id, component_signature having count(*) filter (where n >= 2) > 0)"""


@query("shared_components", f"with {FP}, {_SHARED} select * from sh")
def shared_components(s, d):
    return components.shared_components(prints(s, d))


@query("repeated_components", f"with {FP}, {_REPEATED} select * from rp")
def repeated_components(s, d):
    return components.repeated_components(prints(s, d))


@query("components_all", f"with {FP}, {_SHARED}, {_REPEATED} select * from sh union all select * from rp")
def components_all(s, d):
    return components.components(prints(s, d))


@query(
    "navigation_menus",
    f"""with {EL}, m as (select crawl_id, url, coalesce(arg_min(coalesce(accessible_name, ''), (pos, element_id)) filter (where category = 'nav'), '') as label,
  string_agg(accessible_name, ' | ' order by pos, element_id) filter (where category = 'link' and landmark = 'navigation' and accessible_name <> '') as items from el group by 1, 2)
select crawl_id, label, items, count(*) as page_count, min(url) as first_page, regexp_matches(label, '(?i)breadcrumb') as is_breadcrumb from m where items is not null group by crawl_id, label, items""",
)
def navigation_menus(s, d):
    return components.navigation_menus(elements(s, d))


@query(
    "analysis_stats",
    f"""with {FP} select crawl_id, count(distinct url) as pages, count(*) as elements, count(distinct fingerprint) as unique_fingerprints,
  count(*) filter (where strategy = 'data-testid') as by_testid, count(*) filter (where strategy = 'id') as by_id,
  count(*) filter (where strategy = 'name') as by_name, count(*) filter (where strategy = 'structural') as by_structure from fp group by 1""",
)
def analysis_stats(s, d):
    return components.analysis_stats(prints(s, d))


@query(
    "page_element_counts",
    f"""with {EL} select crawl_id, url, counter, count(*) as n from (
  select crawl_id, url, coalesce(category, '') as counter from el union all
  select crawl_id, url, 'visible_elements' from el where visible union all select crawl_id, url, 'total_elements' from el union all
  select crawl_id, url, 'shadow_elements' from el where shadow_depth > 0 union all select crawl_id, url, 'iframe_elements' from el where frame <> '') group by all""",
)
def page_element_counts(s, d):
    return components.page_counts(elements(s, d))


@query(
    "inventory_screens",
    f"""with {EL}, {PG}, c as (select crawl_id, url, count(*) as t, count(*) filter (where visible) as v from el group by all)
select pg.crawl_id, pg.url, title, depth, coalesce(t, 0) as elements_total, coalesce(v, 0) as elements_visible, coalesce(len(out_links), 0) as out_links
from pg left join c on c.crawl_id = pg.crawl_id and c.url = pg.url""",
)
def inventory_screens(s, d):
    return components.inventory_screens(pages(s, d), elements(s, d))


@query(
    "inventory_totals",
    f"""with {EL}, {PG}, {ED} select pg.crawl_id, count(*) as screens, sum((select count(*) from el where el.crawl_id = pg.crawl_id and el.url = pg.url)) as elements,
  exists (select 1 from ed where ed.crawl_id = pg.crawl_id and not exists (select 1 from pg q where q.crawl_id = ed.crawl_id and q.url = ed.target)) as budget_exhausted
from pg group by pg.crawl_id""",
)
def inventory_totals(s, d):
    screens = components.inventory_screens(pages(s, d), elements(s, d))
    missed = navigation.not_captured(pages(s, d), edges(s, d)).select("crawl_id", F.lit(True).alias("missed")).distinct()
    totals = screens.groupBy("crawl_id").agg(F.count("*").alias("screens"), F.sum("elements_total").alias("elements"))
    return totals.join(missed, "crawl_id", "left").select("crawl_id", "screens", "elements", F.coalesce("missed", F.lit(False)).alias("budget_exhausted"))


@query(
    "unnamed_controls",
    f"""with {EL} select crawl_id, url, coalesce(nullif(ui_type, ''), category) as kind, count(*) as n from el
where category in ('button', 'link', 'tab', 'menu', 'disclosure', 'input', 'select', 'textarea')
and coalesce({strip_sql("coalesce(nullif(accessible_name, ''), text)")}, '') = '' group by all""",
)
def unnamed_controls(s, d):
    return components.unnamed_controls(elements(s, d))


@query(
    "actions_by_screen",
    f"""with {EL}, r as (select *, {READING} as place, {strip_sql("coalesce(nullif(accessible_name, ''), text)")} as label, coalesce(nullif(ui_type, ''), category) as kind, coalesce(landmark, '') as region,
  array_to_string(list_transform(list_filter(coalesce(options, [])[1:8], lambda o: o.label <> ''), lambda o: o.label), ' / ') as opts from el)
select crawl_id, url, label, kind, region, min(place) as place, arg_min(enabled, place) as enabled, arg_min(opts, place) as options, {safety_sql('label')} as safety
from r where category in ('button', 'tab', 'menu', 'disclosure') and not coalesce(ui_type in ('tabpanel', 'tablist', 'menubar'), false) and label <> '' group by crawl_id, url, label, kind, region""",
)
def actions_by_screen(s, d):
    return components.actions(elements(s, d))


_BYPATH = f"""bp as (select crawl_id, url, dom_path as target, arg_max(element_id, (pos, element_id)) as target_id, arg_max(label, (pos, element_id)) as target_label from lel where dom_path <> '' group by 1, 2, 3)"""
_LEL = f"lel as (select *, {CONTROL} as label from el)"


@query(
    "element_links",
    f"""with {EL}, {_LEL}, {_BYPATH}, o as (
  select crawl_id, url, element_id, dom_path, label, 'contains' as kind, parent_path as target from lel union all
  select crawl_id, url, element_id, dom_path, label, 'groups', owner_form from lel union all
  select crawl_id, url, element_id, dom_path, label, 'controls', unnest(controls) from lel)
select o.crawl_id, o.url, kind, case kind when 'controls' then dom_path else o.target end as source, case kind when 'controls' then o.target else dom_path end as target,
  case kind when 'controls' then label else target_label end as source_label, case kind when 'controls' then target_label else label end as target_label
from o join bp on bp.crawl_id = o.crawl_id and bp.url = o.url and bp.target = o.target where o.target <> '' and not (kind = 'controls' and target_id = element_id)""",
)
def element_links(s, d):
    return relations.element_links(elements(s, d))


_FIELDS = f"""{EL}, {_LEL}, {_BYPATH}, fl as (
  select lel.crawl_id, lel.url, {READING.replace('crawl_id, url', 'lel.crawl_id, lel.url')} as place, lel.* exclude (crawl_id, url), coalesce(nullif(ui_type, ''), category) as kind from lel),
ff as (select fl.*, case when bp.target is null then '(ungrouped inputs)' else owner_form end as form, case when kind = 'radio' then nullif(group_name, '') end as rg,
  array_to_string(list_transform(list_filter(coalesce(options, []), lambda o: o.label <> ''), lambda o: o.label), ' | ') as opts,
  case when ui_type in ('checkbox', 'radio') then case when states['checked'] = 'true' then 'checked' else 'unchecked' end
    else coalesce(nullif(value, ''), nullif(array_to_string(list_transform(list_filter(coalesce(options, []), lambda o: o.selected), lambda o: o.label), ', '), '')) end as dv
  from fl left join bp on bp.crawl_id = fl.crawl_id and bp.url = fl.url and bp.target = fl.owner_form
  where category in ('input', 'select', 'textarea') and not (category = 'input' and coalesce(attributes['type'] = 'hidden', false))),
fd as (select crawl_id, url, form, min(place) as place, coalesce(max(rg), arg_min(label, place)) as label, case when max(rg) is not null then 'radio-group' else arg_min(kind, place) end as kind,
  bool_or(coalesce(states['required'], '') = 'true') as required, case when max(rg) is not null then string_agg(label, ' | ' order by place) else arg_min(opts, place) end as options,
  case when max(rg) is not null then count(*) else coalesce(arg_min(option_count, place), 0) end as option_count,
  case when max(rg) is not null then arg_min(label, place) else arg_min_null(dv, place) end as default_value
  from ff group by crawl_id, url, form, coalesce('g:' || rg, 'p:' || place))"""


@query("form_fields", f"with {_FIELDS} select * from fd")
def form_fields(s, d):
    return relations.form_fields(elements(s, d))


@query(
    "forms",
    f"""with {_FIELDS}, c as (select crawl_id, url, form, count(*) as fields from fd group by all),
ow as (select crawl_id, url, dom_path as form, arg_max(case when coalesce(nullif({strip_sql('accessible_name')}, ''), nullif({strip_sql('text')}, '')) is not null then label else '(unnamed form)' end, (pos, element_id)) as name from lel where dom_path <> '' group by 1, 2, 3),
bt as (select crawl_id, url, owner_form as form, string_agg(label, ' | ' order by place) as actions from fl where category = 'button' and owner_form <> '' group by 1, 2, 3)
select c.crawl_id, c.url, c.form, coalesce(name, c.form) as name, fields, coalesce(actions, '') as actions from c
left join ow on ow.crawl_id = c.crawl_id and ow.url = c.url and ow.form = c.form left join bt on bt.crawl_id = c.crawl_id and bt.url = c.url and bt.form = c.form""",
)
def forms(s, d):
    return relations.forms(elements(s, d))


@query(
    "tables",
    f"""with recursive {EL}, {_LEL},
par as (select crawl_id, url, dom_path as path, arg_max(coalesce(parent_path, ''), (pos, element_id)) as up, bool_or(category = 'table') as is_table from lel where dom_path <> '' group by 1, 2, 3),
cl as (select lel.crawl_id, lel.url, label, pos, element_id, par.path, par.up, par.is_table from lel join par on par.crawl_id = lel.crawl_id and par.url = lel.url and par.path = lel.parent_path
       where category in ('button', 'link') and parent_path <> ''
       union
       select cl.crawl_id, cl.url, cl.label, cl.pos, cl.element_id, par.path, par.up, par.is_table from cl join par on par.crawl_id = cl.crawl_id and par.url = cl.url and par.path = cl.up
       where not cl.is_table and cl.up <> ''),
ac as (select crawl_id, url, path, label, min((pos, element_id)) as a0 from cl where is_table group by 1, 2, 3, 4),
ra as (select crawl_id, url, path, string_agg(label, ' | ' order by a0, label) as row_actions from ac group by 1, 2, 3)
select t.crawl_id, t.url, element_id, dom_path, case when coalesce(nullif({strip_sql('accessible_name')}, ''), nullif({strip_sql('text')}, '')) is not null then label else '(unnamed table)' end as name,
  coalesce(array_to_string(column_names, ' | '), '') as columns, coalesce(row_count, 0) as row_count, coalesce(row_actions, '') as row_actions
from lel t left join ra on ra.crawl_id = t.crawl_id and ra.url = t.url and ra.path = t.dom_path where category = 'table'""",
)
def tables(s, d):
    return relations.tables(elements(s, d))


# --- differences ------------------------------------------------------------------------

_PAIRS = f"""{CR}, prs as (select * from (select lag(crawl_id) over (partition by site, config_file order by started_at, finished_at, crawl_id) as prev_crawl_id, crawl_id as next_crawl_id
  from cr where finished_at is not null and started_at is not null) where prev_crawl_id is not null)"""
_DPAGES = """dp as (
  select prev_crawl_id, next_crawl_id, n.url, 'added' as change_kind from prs join pg n on n.crawl_id = next_crawl_id where not exists (select 1 from pg o where o.crawl_id = prev_crawl_id and o.url = n.url)
  union all
  select prev_crawl_id, next_crawl_id, o.url, 'removed' from prs join pg o on o.crawl_id = prev_crawl_id where not exists (select 1 from pg n where n.crawl_id = next_crawl_id and n.url = o.url))"""


@query("diff_pages", f"with {_PAIRS}, {PG}, {_DPAGES} select * from dp")
def diff_pages(s, d):
    return diff.diff_pages(current_pages(pages(s, d)), pairs(s, d))


_DELS = f"""kp as (select prev_crawl_id, next_crawl_id, o.url from prs join pg o on o.crawl_id = prev_crawl_id join pg n on n.crawl_id = next_crawl_id and n.url = o.url),
sd as (select kp.*, element_id, fingerprint, category, role, landmark, accessible_name, {_STRUCT} as st, lower({strip_sql("coalesce(accessible_name, '')")}) as nm, -1 as side, pos from kp join fp on fp.crawl_id = prev_crawl_id and fp.url = kp.url
  union all select kp.*, element_id, fingerprint, category, role, landmark, accessible_name, {_STRUCT}, lower({strip_sql("coalesce(accessible_name, '')")}), 1, pos from kp join fp on fp.crawl_id = next_crawl_id and fp.url = kp.url),
tn as (select *, row_number() over (partition by prev_crawl_id, next_crawl_id, url, fingerprint, side order by pos, element_id) as turn from sd),
o as (select * from tn where side < 0), n as (select * from tn where side > 0),
j as (select n.prev_crawl_id, n.next_crawl_id, n.url, n.element_id, n.accessible_name, o.accessible_name as previous_name, o.nm as onm, n.nm as nnm
  from n join o on o.prev_crawl_id = n.prev_crawl_id and o.next_crawl_id = n.next_crawl_id and o.url = n.url and o.fingerprint = n.fingerprint and o.turn = n.turn),
lf as (select *, concat_ws('|', category, coalesce(role, ''), coalesce(landmark, ''), st) as key from tn where not exists (select 1 from tn z where z.side = -tn.side and z.prev_crawl_id = tn.prev_crawl_id and z.next_crawl_id = tn.next_crawl_id and z.url = tn.url and z.fingerprint = tn.fingerprint and z.turn = tn.turn)),
gk as (select prev_crawl_id, next_crawl_id, url, key, max(element_id) filter (where side < 0) as oid, max(element_id) filter (where side > 0) as nid from lf group by 1, 2, 3, 4 having count(*) filter (where side < 0) = 1 and count(*) filter (where side > 0) = 1),
de as (select prev_crawl_id, next_crawl_id, url, 'renamed' as change_kind, 'fingerprint' as matched_by, element_id, accessible_name, previous_name from j where onm <> nnm
  union all select gk.prev_crawl_id, gk.next_crawl_id, gk.url, 'renamed', 'structural', b.element_id, b.accessible_name, a.accessible_name from gk
    join lf a on a.prev_crawl_id = gk.prev_crawl_id and a.next_crawl_id = gk.next_crawl_id and a.url = gk.url and a.key = gk.key and a.side < 0
    join lf b on b.prev_crawl_id = gk.prev_crawl_id and b.next_crawl_id = gk.next_crawl_id and b.url = gk.url and b.key = gk.key and b.side > 0 where a.nm <> b.nm
  union all select prev_crawl_id, next_crawl_id, url, case when side < 0 then 'removed' else 'added' end, null, element_id, accessible_name, null from lf
    where not exists (select 1 from gk where gk.prev_crawl_id = lf.prev_crawl_id and gk.next_crawl_id = lf.next_crawl_id and gk.url = lf.url and gk.key = lf.key))"""


@query("diff_elements", f"with {_PAIRS}, {PG}, {FP}, {_DELS} select * from de")
def diff_elements(s, d):
    return diff.diff_elements(prints(s, d), current_pages(pages(s, d)), pairs(s, d))


@query(
    "diff_components",
    f"""with {_PAIRS}, {FP}, {_SHARED}, {_REPEATED}, sg as (select distinct crawl_id, signature from (select crawl_id, signature from sh union all select crawl_id, signature from rp))
select prev_crawl_id, next_crawl_id, signature, 'added' as change_kind from prs join sg on sg.crawl_id = next_crawl_id where not exists (select 1 from sg o where o.crawl_id = prev_crawl_id and o.signature = sg.signature)
union all select prev_crawl_id, next_crawl_id, signature, 'removed' from prs join sg on sg.crawl_id = prev_crawl_id where not exists (select 1 from sg n where n.crawl_id = next_crawl_id and n.signature = sg.signature)""",
)
def diff_components(s, d):
    return diff.diff_components(components.components(prints(s, d)), pairs(s, d))


@query(
    "diff_stats",
    f"""with {_PAIRS}, {PG}, {FP}, {_DPAGES}, {_DELS} select prev_crawl_id, next_crawl_id, counter, count(*) as n from (
select prev_crawl_id, next_crawl_id, 'pages_' || change_kind as counter from dp union all select prev_crawl_id, next_crawl_id, 'elements_' || change_kind from de) group by all""",
)
def diff_stats(s, d):
    return diff.diff_stats(diff_pages(s, d), diff_elements(s, d))


# --- redaction --------------------------------------------------------------------------


def _texts(s, d):
    return current_elements(elements(s, d), "text").select("element_id", "text")


@query(
    "redact_email",
    rf"""with {EL} select element_id, regexp_replace(text, '{redaction.EMAIL}', '<EMAIL>', 'g') as redacted,
  coalesce(len(regexp_extract_all(text, '{redaction.EMAIL}')), 0) as n_email from el where text is not null""",
)
def redact_email(s, d):
    return redaction.redact(_texts(s, d).where("text is not null"), "text", ["EMAIL"]).select("element_id", "redacted", "n_email")


@query(
    "redact_national_id",
    rf"""with {EL}, m as (select element_id, text, regexp_extract_all(text, '{redaction.NATIONAL_ID}') as ms, regexp_split_to_array(text, '{redaction.NATIONAL_ID}') as ps from el where text is not null)
select element_id, array_to_string(list_transform(ps, lambda p, i: p || case when i > len(ms) then '' when regexp_matches(ms[i], '^(000|666|9..)') or substr(ms[i], 5, 2) = '00' or right(ms[i], 4) = '0000' then ms[i] else '****' end), '') as redacted,
  len(list_filter(ms, lambda m: not (regexp_matches(m, '^(000|666|9..)') or substr(m, 5, 2) = '00' or right(m, 4) = '0000'))) as n_national_id from m""",
)
def redact_national_id(s, d):
    return redaction.redact(_texts(s, d).where("text is not null"), "text", ["NATIONAL_ID"], style="mask").select("element_id", "redacted", "n_national_id")


@query("redact_elements")
def redact_elements(s, d):
    return redaction.redact(_texts(s, d), "text", names=["Jorpera Molmoor", "Dalika Pellova"]).drop("text")


@query(
    "mask_targets_narrowest",
    rf"""with {EL}, t as (select distinct coalesce(frame, '') as frame, dom_path from el where regexp_matches(text, '[0-9]') and dom_path <> '')
select * from t where not exists (select 1 from t u where u.frame = t.frame and starts_with(u.dom_path, t.dom_path || ' > '))""",
)
def mask_targets_narrowest(s, d):
    rows = current_elements(elements(s, d), "text", "frame", "dom_path")
    return redaction.narrowest_targets(rows.where(F.col("text").rlike("[0-9]")))


# --- runs -------------------------------------------------------------------------------


@query(
    "run_metrics",
    """with s as (select user_id as run_id, event_type as stage, count(*) as events, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as duration_ms from events group by 1, 2)
select run_id, stage, events, duration_ms, duration_ms::double / nullif(sum(duration_ms) over (partition by run_id), 0)::double as share,
  first_value(stage) over (partition by run_id order by duration_ms desc, stage desc) as slowest_stage from s""",
)
def run_metrics(s, d):
    return runs.run_metrics(table(s, d, "events"))


@query(
    "run_outcomes",
    f"""with {CR}, r as (select *, (epoch_us(finished_at) - epoch_us(started_at)) // 1000000 as seconds from cr)
select coalesce(run_id, crawl_id) as run_id, crawl_id, site, case when finished_at is null then 'failed' when pages_failed > 0 then 'partial' else 'ok' end as outcome, seconds, pages_crawled,
  case when pages_crawled > 0 and seconds > 0 then (seconds * 1000)::double / pages_crawled end as ms_per_page, coalesce(auth_used, false) as auth_used from r""",
)
def run_outcomes(s, d):
    return runs.run_outcomes(table(s, d, "crawls"))


@query(
    "retention_plan",
    f"""with {CR}, r as (select crawl_id, site, coalesce(finished_at, started_at) as a0 from cr),
a as (select *, round(greatest((epoch_us(timestamp '{NOW}') - epoch_us(a0)) / 86400000000.0::double, 0), 2) as age_days from r)
select crawl_id, site, age_days, case when a0 is null then 'undetermined' when age_days > {RETENTION} then 'expired' else 'kept' end as bucket from a""",
)
def retention_plan(s, d):
    return runs.retention_plan(table(s, d, "crawls"), NOW, RETENTION)


@query(
    "retention_totals",
    f"""with {CR}, a as (select round(greatest((epoch_us(timestamp '{NOW}') - epoch_us(coalesce(finished_at, started_at))) / 86400000000.0::double, 0), 2) as age_days, coalesce(finished_at, started_at) is null as undated from cr)
select case when undated then 'undetermined' when age_days > {RETENTION} then 'expired' else 'kept' end as bucket, count(*) as captures, max(age_days) as oldest_days from a group by 1""",
)
def retention_totals(s, d):
    return runs.retention_totals(retention_plan(s, d))


@query(
    "deep_links",
    f"""with {ED}, c as (select *, {squeeze_sql('label')} as lb from ed where control = 'deep-nav'),
f as (select * from c where lb <> '' and {safety_sql('label')} = 'SAFE' qualify row_number() over (partition by crawl_id, lb order by edge_id) = 1)
select * from (select crawl_id, lb as label, row_number() over (partition by crawl_id order by edge_id) as turn, source, target from f) where turn <= 40""",
)
def deep_links(s, d):
    return navigation.deep_links(edges(s, d))


@query("frame_counts", f"with {EL} select crawl_id, url, coalesce(frame, '') as frame, count(*) as elements, count(*) filter (where visible) as visible from el group by all")
def frame_counts(s, d):
    rows = current_elements(elements(s, d), "frame", "visible")
    return rows.groupBy("crawl_id", "url", F.coalesce("frame", F.lit("")).alias("frame")).agg(F.count("*").alias("elements"), F.count_if("visible").alias("visible"))


@query(
    "settle_detection",
    """with c as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as ch from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(ch) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from c)
select user_id, island, event_type, count(*) as polls, min(event_id) as first_event, count(*) >= 2 as settled from i group by 1, 2, 3""",
)
def settle_detection(s, d):
    return runs.settle_runs(table(s, d, "events"))


_SEG = "(?:^|/)(?:" + "|".join(sorted(runs.LOGIN_SEGMENTS, key=lambda x: (-len(x), x))) + ")(?:/|$)"
_CHECKS = f"""ck as (select pg.crawl_id, pg.url, case when c.pw then 'password-field'
  when regexp_matches({squeeze_sql(_PATH.replace("url,", "coalesce(nullif(final_url, ''), requested_url, ''),"))}, '{_SEG}') then 'login-url'
  when {words_sql(squeeze_sql('title'), runs.LOGIN_PHRASES)} then 'logged-out-title' when c.n is null then 'empty-page' end as signal
  from pg left join (select crawl_id, url, count(*) as n, bool_or(coalesce(lower(attributes['type']) = 'password', false) and visible) as pw from el group by 1, 2) c on c.crawl_id = pg.crawl_id and c.url = pg.url)"""


@query("auth_check", f"with {EL}, {PG}, {_CHECKS} select * from ck")
def auth_check(s, d):
    return runs.auth_checks(pages(s, d), elements(s, d))


@query(
    "auth_verdict",
    f"""with {EL}, {PG}, {CR}, {_CHECKS}, v as (select crawl_id, count(*) as pages, count(*) filter (where signal <> 'empty-page') as logged_out, count(*) filter (where signal = 'empty-page') as empty from ck group by 1)
select v.*, coalesce(auth_used, false) and (logged_out > 0 or (empty > 0 and 2 * empty >= pages)) as auth_expired from v join cr using (crawl_id)""",
)
def auth_verdict(s, d):
    return runs.auth_verdict(auth_check(s, d), table(s, d, "crawls"))


# --- generation -------------------------------------------------------------------------

_CTL = """ct as (select *, row_number() over (partition by crawl_id, url, label order by a0) as rk from (
  select crawl_id, url, label, accessible_name, min(element_id) as a0 from lb where accessible_name <> '' group by 1, 2, 3, 4))"""


@query(
    "qa_scenarios",
    f"""with {FP}, {LABELS}, {PG}, {ED}, {_CTL},
pp as (select crawl_id, url, count(*) filter (where label in ('form_input', 'filter')) as fields, count(*) filter (where label = 'destructive') as destr,
  least(count(distinct accessible_name) filter (where rk <= 2 and label in ('primary_action', 'navigation', 'data_display', 'filter', 'form_input', 'secondary_action')), 6) as names from ct group by 1, 2),
lk as (select crawl_id, source as url, least(count(distinct l), 3) as links from (
  select crawl_id, source, target, {strip_sql('label')} as l from ed where regexp_matches(target, '^(https?|file):') and lower({_HOST % 'target'}) = lower({_HOST % 'source'})
  qualify row_number() over (partition by crawl_id, source, target order by edge_id) = 1) q
  where l <> '' and source <> target and exists (select 1 from pg where pg.crawl_id = q.crawl_id and pg.url = q.target) group by 1, 2),
x as (select pg.crawl_id, pg.url, nullif(title, '') as title, coalesce(fields, 0) as fields, coalesce(destr, 0) as destr, coalesce(names, 0) as names, coalesce(links, 0) as links
  from pg left join pp on pp.crawl_id = pg.crawl_id and pp.url = pg.url left join lk on lk.crawl_id = pg.crawl_id and lk.url = pg.url)
select crawl_id, url, 'smoke' as kind, 'P1' as priority, true as automatable, 0 as number, 1 + (title is not null)::int + names as steps from x
union all select crawl_id, url, 'navigation', 'P2', true, n - 1, 3 from x, (values (1), (2), (3)) v(n) where n <= links
union all select crawl_id, url, 'form', 'P2', false, 0, 2 + least(fields, 4) from x where fields > 0
union all select crawl_id, url, 'destructive_guard', 'P1', false, 0, 1 + destr from x where destr > 0""",
)
def qa_scenarios(s, d):
    return generation.scenarios(pages(s, d), edges(s, d), labels(s, d))


@query(
    "doc_pages",
    f"""with {FP}, {LABELS}, {PG}, {_CTL},
f as (select crawl_id, url, string_agg(accessible_name, ', ' order by rk) filter (where label = 'primary_action' and rk <= 4) as prim, bool_or(label = 'data_display') as dat,
  bool_or(label in ('filter', 'form_input')) as inp, bool_or(label = 'destructive') as des from ct group by 1, 2),
p as (select pg.crawl_id, pg.url, 'The “' || coalesce(nullif(title, ''), 'untitled') || '” page' as base,
  concat_ws('; ', 'primary actions (' || prim || ')', case when dat then 'data tables' end, case when inp then 'input controls' end, case when des then 'destructive actions' end) as parts
  from pg left join f on f.crawl_id = pg.crawl_id and f.url = pg.url)
select crawl_id, url, case when parts <> '' then base || ' provides ' || parts || '.' else base || ' is primarily navigational or informational.' end as purpose from p""",
)
def doc_pages(s, d):
    return generation.page_records(pages(s, d), labels(s, d))
