"""Queries on states, source trees and parsed pages, and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismgrid.functions import identity
from prismgrid.operators import correlate, uistate
from prismgrid.operators.capture import current_elements
from prismgrid.plans.reference import _A, _DELS, _KIND, _NAME, _PAIRS, _requests, EL, FP, PG, elements, pages, pairs, safety_sql, strip_sql
from prismgrid.sources import code, html
from prismgrid.sources.tables import table
from prismgrid.streaming import events as log

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


#: A source tree in small: path -> text.
TREE = {
    "src/routes.js": 'export const routes = [\n  { path: "/", component: Home },\n  { path: "/billing/:id", component: Billing },\n  { path: "/queues/*", component: Queues },\n  { path: "/reports", component: Reports },\n];\n',
    "src/pages/Billing.jsx": 'export default function Billing() {\n  fetch(`/click/${id}`, { method: "POST" });\n  return <form><button data-testid="pay-now">Approve selected</button><a title="Show more">More</a></form>;\n}\n',
    "src/pages/Queues.jsx": 'export default function Queues() {\n  axios.get(`/view/${id}/graphql`);\n  return <div aria-label="Quick Filters"><button>Show more</button></div>;\n}\n',
    "src/components/layout/Shell.jsx": 'export const Shell = () => <nav title="Help"><a>Settings</a></nav>;\n',
}
#: Two pages in small.
PAGES = {
    "https://site.example/": "<nav aria-label=Primary><a href=/orders>Orders</a><a href=/help>Help</a></nav><main><h1>Start</h1><p>Text<p>More</main>",
    "https://site.example/orders": "<main><h2>Orders</h2><form id=new><label for=q>Quantity</label><input id=q type=number required>"
    "<label><input type=radio name=speed checked>Fast</label><label><input type=radio name=speed>Slow</label><button>Create order</button></form>"
    "<table><tr><th>Order<th>Status<tr><td>1<td><a href=/orders/1>View</a></table></main>",
}


def tree(s):
    return s.createDataFrame(list(TREE.items()), "path string, text string")


@query("html_elements")
def html_elements(s, d):
    return html.elements_of(s.createDataFrame(list(PAGES.items()), "url string, html string")).select("url", "pos", "category", "tag", "role", "accessible_name", "visible", "enabled", "dom_path", "landmark", "owner_form", "group_name")


@query("html_headings", "select * from (values ('https://site.example/', 0, 1, 'Start', 'main > h1'), ('https://site.example/orders', 0, 2, 'Orders', 'main > h2')) t(url, pos, level, text, dom_path)")
def html_headings(s, d):
    return html.headings_of(s.createDataFrame(list(PAGES.items()), "url string, html string"))


@query("source_components")
def source_components(s, d):
    return code.components(tree(s)).select("path", "name", "kind", "line", F.array_join("labels", " | ").alias("labels"), F.array_join("test_ids", " | ").alias("test_ids"))


@query("source_routes", "select * from (values ('/', 'Home', 2), ('/billing/:id', 'Billing', 3), ('/queues/*', 'Queues', 4), ('/reports', 'Reports', 5)) t(route, component, line)")
def source_routes(s, d):
    return code.routes(tree(s)).select("route", "component", "line")


@query("source_endpoints")
def source_endpoints(s, d):
    return code.endpoints(tree(s))


@query("correlate_elements")
def correlate_elements(s, d):
    return correlate.correlate_elements(elements(s, d), code.components(tree(s)))


@query("correlate_routes")
def correlate_routes(s, d):
    return correlate.correlate_routes(pages(s, d), code.routes(tree(s)))


@query("correlate_endpoints")
def correlate_endpoints(s, d):
    return correlate.correlate_endpoints(_requests(table(s, d, "events")), code.endpoints(tree(s)))


_SHORT = (
    f"coalesce(substr(nullif({strip_sql('accessible_name')}, ''), 1, 60), case when length({strip_sql('''regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')''')}) <= 60 "
    f"then {strip_sql('''regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g')''')} end, '')"
)
_DEPTH = "(length(dom_path) - length(replace(dom_path, '>', '')) + len(regexp_extract_all(dom_path, '>>>')))"
_RANK = "case ui_type " + " ".join(f"when '{t}' then {i}" for i, (t, _) in enumerate(uistate.COMPONENT_RULES)) + " end"
_CKIND = "case ui_type " + " ".join(f"when '{t}' then '{k}'" for t, k in uistate.COMPONENT_RULES) + " end"


@query(
    "component_targets",
    f"""with {EL}, k as (select *, {_RANK} as rk, {_CKIND} as kind, {_SHORT} as name, {_DEPTH} as dp from el
  where visible and bounding_box.width >= 60 and bounding_box.height between 16 and 4000 and dom_path <> ''),
f as (select * from k where rk is not null and not (ui_type = 'region' and name = '') qualify row_number() over (partition by crawl_id, url, dom_path order by rk, pos, element_id) = 1)
select * from (select crawl_id, url, dom_path, row_number() over (partition by crawl_id, url order by dp, rk, pos, element_id) as place, kind,
  coalesce(nullif(name, ''), '(unnamed ' || kind || ')') as name from f) where place <= 30""",
)
def component_targets(s, d):
    return uistate.component_targets(current_elements(elements(s, d), "dom_path", "ui_type", "visible", "bounding_box", "accessible_name", "text"))


def _before_after(s, d):
    rows = current_elements(elements(s, d), "dom_path", "visible", "category", "ui_type", "accessible_name", "text", "tag")
    two = pairs(s, d)
    before = two.join(rows.withColumnRenamed("crawl_id", "prev_crawl_id"), "prev_crawl_id")
    after = two.join(rows.withColumnRenamed("crawl_id", "next_crawl_id"), "next_crawl_id")
    return before, after


@query(
    "ui_state_reveal",
    f"""with {_PAIRS}, {EL} select prev_crawl_id, next_crawl_id, a.url, a.element_id from prs join el a on a.crawl_id = next_crawl_id where a.visible and a.dom_path <> ''
  and not exists (select 1 from el b where b.crawl_id = prev_crawl_id and b.url = a.url and b.visible and b.dom_path = a.dom_path)""",
)
def ui_state_reveal(s, d):
    before, after = _before_after(s, d)
    return uistate.revealed(before, after, ["prev_crawl_id", "next_crawl_id", "url"]).select("prev_crawl_id", "next_crawl_id", "url", "element_id")


#: Overlays by ui_type, as the SQL names them.
_OVERLAY = """case ui_type when 'dialog' then 'modal' when 'drawer' then 'drawer' when 'menu' then 'menu' when 'menubar' then 'menu' when 'tabpanel' then 'tab-panel'
  when 'tooltip' then 'tooltip' when 'popover' then 'popover' when 'listbox' then 'listbox' when 'tree' then 'tree' when 'disclosure' then 'disclosure' end"""
_STATES = f"""{_PAIRS}, {EL},
tr as (select prev_crawl_id, next_crawl_id, url, coalesce(accessible_name, text, '') as trigger_name, controls,
  map_contains(attributes, 'aria-expanded') or map_contains(states, 'expanded') as expands
  from prs join el on crawl_id = prev_crawl_id where category in ('button', 'nav') and len(controls) > 0),
rv as (select prev_crawl_id, next_crawl_id, a.url, a.dom_path, a.pos, a.category, a.tag, a.text, {_OVERLAY} as kind, {_SHORT} as name, {_DEPTH} as dp
  from prs join el a on a.crawl_id = next_crawl_id where a.visible and a.dom_path <> ''
  and not exists (select 1 from el b where b.crawl_id = prev_crawl_id and b.url = a.url and b.visible and b.dom_path = a.dom_path)),
jn as (select tr.*, rv.dom_path, rv.pos, rv.kind, rv.name, rv.dp, case when list_contains(controls, rv.dom_path) and kind is not null then 1
    when category in ('dialog', 'menu', 'tab', 'tooltip', 'region') and kind is not null then 2 when expands then 3 end as rk, list_position(controls, rv.dom_path) as told
  from tr join rv on rv.prev_crawl_id = tr.prev_crawl_id and rv.next_crawl_id = tr.next_crawl_id and rv.url = tr.url),
bs as (select * from jn where rk is not null
  qualify row_number() over (partition by prev_crawl_id, next_crawl_id, url, trigger_name order by rk, case when rk = 1 then told else 0 end, dp, pos, dom_path) = 1),
st as (select prev_crawl_id, next_crawl_id, url, trigger_name, case when rk = 3 then 'disclosure' else kind end as kind,
  case when rk = 3 then trigger_name else coalesce(nullif(name, ''), trigger_name) end as name, dom_path from bs)"""


def _states(s, d):
    scope = ["prev_crawl_id", "next_crawl_id", "url"]
    before, after = _before_after(s, d)
    acts = current_elements(elements(s, d), *["category", "accessible_name", "text", "controls", "attributes", "states"]).where("category in ('button', 'nav') and size(controls) > 0")
    expands = F.coalesce(F.map_contains_key("attributes", F.lit("aria-expanded")), F.lit(False)) | F.coalesce(F.map_contains_key("states", F.lit("expanded")), F.lit(False))
    triggers = pairs(s, d).join(acts.withColumnRenamed("crawl_id", "prev_crawl_id"), "prev_crawl_id").select(
        *scope, F.coalesce("accessible_name", "text", F.lit("")).alias("trigger_name"), "controls", expands.alias("expands")
    )
    shown = uistate.revealed(before, after, scope)
    return uistate.classify_states(triggers, shown, scope), shown, scope


@query("ui_state_classify", f"with {_STATES} select * from st")
def ui_state_classify(s, d):
    return _states(s, d)[0]


_LISTED = "coalesce(array_to_string(list({0} order by turn) filter (where {1}), ' | '), '')"


@query(
    "ui_state_contents",
    f"""with {_STATES}, hd as (select s.prev_crawl_id, s.next_crawl_id, s.url, s.dom_path, rv.name, rv.text, rv.category, rv.tag,
  row_number() over (partition by s.prev_crawl_id, s.next_crawl_id, s.url, s.dom_path order by rv.pos, rv.dom_path) as turn
  from (select distinct prev_crawl_id, next_crawl_id, url, dom_path from st) s join rv on rv.prev_crawl_id = s.prev_crawl_id and rv.next_crawl_id = s.next_crawl_id and rv.url = s.url
  and starts_with(rv.dom_path, s.dom_path) and rv.dom_path <> s.dom_path),
hs as (select prev_crawl_id, next_crawl_id, url, dom_path, {_LISTED.format('name', 'turn <= 60')} as controls,
  {_LISTED.format('name', "turn <= 60 and category in ('input', 'select', 'textarea')")} as fields,
  coalesce(array_to_string(list(text order by turn) filter (where regexp_matches(lower(tag), '^h[1-6]$') and text <> '')[1:10], ' | '), '') as headings from hd group by all)
select st.*, coalesce(controls, '') as controls, coalesce(fields, '') as fields, coalesce(headings, '') as headings from st
left join hs on hs.prev_crawl_id = st.prev_crawl_id and hs.next_crawl_id = st.next_crawl_id and hs.url = st.url and hs.dom_path = st.dom_path""",
)
def ui_state_contents(s, d):
    states, shown, scope = _states(s, d)
    built = uistate.build_states(states, shown, scope)
    return built.withColumns({c: F.array_join(c, " | ") for c in ("controls", "fields", "headings")})


@query(
    "state_dedupe",
    f"""with {EL}, s as (select element_id as seq, ui_type as kind, lower({strip_sql("coalesce(accessible_name, '')")}) as label from el where ui_type is not null)
select kind, regexp_replace(label, '[\\s\\p{{Z}}]+', ' ', 'g') as label, min(seq) as first_seq, count(*) as instances from s group by all""",
)
def state_dedupe(s, d):
    rows = current_elements(elements(s, d), "ui_type", "accessible_name").where("ui_type is not null")
    states = rows.select(F.col("element_id").alias("seq"), F.col("ui_type").alias("kind"), F.col("accessible_name").alias("trigger_label"), F.array().cast("array<string>").alias("control_names"))
    return uistate.distinct_states(states).select("kind", "label", "first_seq", "instances")


@query(
    "probe_plan",
    f"""with {EL}, k as (select *, {_KIND} as kind, {safety_sql(_NAME)} as safety from el),
p as (select *, coalesce(visible, true) and coalesce(enabled, true) and nullif(frame, '') is null and kind in ('tab', 'expander', 'disclosure', 'menu') and safety = 'SAFE' as ok from k),
t as (select *, ok and sum(ok::int) over (partition by crawl_id, url order by pos, element_id rows unbounded preceding) <= 2 as executed from p)
select crawl_id, url, count(*) as elements_seen, count(*) filter (where executed) as executed, count(*) filter (where not executed) as observed_only,
  count(*) filter (where safety = 'BLOCK') as blocked, count(*) filter (where safety = 'CAUTION') as caution from t group by 1, 2""",
)
def probe_plan(s, d):
    rows = current_elements(elements(s, d), "category", "tag", "role", "accessible_name", "text", "attributes", "dom_path", "visible", "enabled", "frame")
    name = F.coalesce(F.nullif("accessible_name", F.lit("")), F.col("text"))
    rows = rows.withColumns({"kind": identity.interaction_type(), "safety": identity.safety_label(name)})
    rows = rows.withColumn("skipped_reason", identity.decision(F.col("kind"), F.col("safety")))
    return uistate.probe_stats(uistate.probe_plan(rows, 2))


_TEXT = """tx as (select crawl_id, url, trim(regexp_replace(string_agg(coalesce(accessible_name, text, ''), ' ' order by pos, element_id) filter (where visible), '[\\s\\p{Z}]+', ' ', 'g')) as body
  from el group by 1, 2),
hx as (select crawl_id, url, list_reduce(list_prepend(0::hugeint, flatten(list_transform(regexp_extract_all(coalesce(body, ''), '(?s).'),
    lambda c: case when unicode(c) < 65536 then [unicode(c)::hugeint] else [(55232 + (unicode(c) >> 10))::hugeint, (56320 + (unicode(c) & 1023))::hugeint] end))),
    lambda h, c: (31 * h + c) % 4294967296) as u from tx),
hs as (select crawl_id, url, (case when u >= 2147483648 then u - 4294967296 else u end)::varchar as content_hash from hx)"""


def _page_texts(rows):
    shown = F.when(F.col("visible"), F.struct("pos", "element_id", F.coalesce("accessible_name", "text", F.lit("")).alias("t")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x.t), " ")


@query("content_hashes", f"with {EL}, {_TEXT} select * from hs")
def content_hashes(s, d):
    rows = current_elements(elements(s, d), "visible", "accessible_name", "text")
    return rows.groupBy("crawl_id", "url").agg(_page_texts(rows).alias("body")).select("crawl_id", "url", uistate.content_hash(F.col("body")).alias("content_hash"))


@query(
    "interaction_score",
    f"""with {_PAIRS}, {PG}, {EL}, {_TEXT}, st as (select el.crawl_id, el.url, count(*) filter (where visible) as vi, count(*) filter (where visible and category = 'dialog') as vd,
  count(*) filter (where states['expanded'] = 'true') as ex, any_value(content_hash) as ch from el join hs on hs.crawl_id = el.crawl_id and hs.url = el.url group by 1, 2)
select prev_crawl_id, next_crawl_id, a.url, a.vd > b.vd as dialog_opened, a.ex <> b.ex as expanded_changed, a.vd > b.vd or a.ex <> b.ex or a.vi <> b.vi or a.ch <> b.ch as dom_changed
from prs join st b on b.crawl_id = prev_crawl_id join st a on a.crawl_id = next_crawl_id and a.url = b.url""",
)
def interaction_score(s, d):
    rows = current_elements(elements(s, d), "visible", "category", "states", "accessible_name", "text")
    state = F.struct(
        F.col("url").alias("url"),
        F.count_if(F.col("visible") & (F.col("category") == "dialog")).alias("visible_dialogs"),
        F.count_if(F.try_element_at("states", F.lit("expanded")) == "true").alias("expanded"),
        F.count_if("visible").alias("visible_interactive"),
        uistate.content_hash(_page_texts(rows)).alias("content_hash"),
    )
    st = rows.groupBy("crawl_id", "url").agg(state.alias("state"))
    two = pairs(s, d).join(st.select(F.col("crawl_id").alias("prev_crawl_id"), "url", F.col("state").alias("before")), "prev_crawl_id")
    two = two.join(st.select(F.col("crawl_id").alias("next_crawl_id"), "url", F.col("state").alias("after")), ["next_crawl_id", "url"])
    found = uistate.score("before", "after")
    return two.select("prev_crawl_id", "next_crawl_id", "url", *[found[k].alias(k) for k in ("dialog_opened", "expanded_changed", "dom_changed")])


@query(
    "component_crops",
    f"""with {EL}, ct as ({SQL["component_targets"]}) select element_id, coalesce('components/' || ct.place || '.png', clip_screenshot) as clip_screenshot from el
left join ct on ct.crawl_id = el.crawl_id and ct.url = el.url and ct.dom_path = el.dom_path""",
)
def component_crops(s, d):
    crops = component_targets(s, d).select("crawl_id", "url", "dom_path", F.format_string("components/%d.png", "place").alias("picture"))
    rows = current_elements(elements(s, d), "dom_path", "clip_screenshot")
    return uistate.attach_crops(rows, crops).select("element_id", "clip_screenshot")


@query("event_log_stream", "select event_type, count(*) as events, count(distinct user_id) as users, min(event_id) as first_event from events group by 1")
def event_log_stream(s, d):
    out = log.replay(table(s, d, "events"))
    return out.groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_event"))
