from datetime import datetime as T

import pytest
from pyspark.sql import functions as F

from prismgrid import adapters, api, reports, settings
from prismgrid.functions import identity
from prismgrid.functions.urls import dom_key, page_key
from prismgrid.operators import components, correlate, diff, navigation, redaction, relations, runs, uistate
from prismgrid.plans.literals import PAGES, TREE
from prismgrid.sources import code, html, sinks

U = "https://x.example/p"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))
    return row.select(column.alias("v")).first().v


def el(i, **more):
    return {"element_id": i, "crawl_id": "c", "url": U, "pos": i, "arrived_at": T(2025, 1, 1), "category": "button", "tag": "button", "dom_path": f"d{i}", "attributes": {}, **more}


def test_urls(spark):
    key = lambda u: one(spark, page_key(F.col("u")), u=u)
    assert key("http://x.example/a/#frag") == "http://x.example/a" and key("http://x.example/") == key("http://x.example") == "http://x.example/"
    assert key("http://x.example/a/?q=1") == "http://x.example/a?q=1" and key("/a/") == "/a" and key("/") == "/" and key(None) is None
    assert one(spark, dom_key(F.col("p")), p=" a  >\u00a0b ") == "a>b"
    assert one(spark, navigation.without_noise(F.col("u")), u="http://x.example/a?utm_source=s&b=2&a=1#f") == "http://x.example/a?a=1&b=2"
    assert one(spark, navigation.with_hash_route(F.col("u")), u="http://x.example/#/orders") == "http://x.example/#/orders"
    assert one(spark, navigation.redact_query(F.col("u")), u="http://x.example/?token=abc&page=2") == "http://x.example/?token=REDACTED&page=2"
    assert one(spark, navigation.endpoint_pattern(F.col("u")), u="https://api.x.example/customers/12345/orders") == "api.x.example/customers/:id/orders"
    assert one(spark, navigation.slug(F.col("u")), u="https://example.org/docs/api") == "example.org_docs_api"
    for raw in ("/orders/${id}", "/orders/:orderId", "/orders/{id}?x=1", "/orders/42/"):
        assert one(spark, navigation.source_pattern(F.col("u")), u=raw) == "/orders/:id"


@pytest.mark.parametrize(
    ("label", "expect"),
    [("Delete account", "BLOCK"), ("DeleteAll", "BLOCK"), ("Resend Email", "BLOCK"), ("Crunchbase", "SAFE"), ("Payroll", "SAFE"), ("Confirmation number", "SAFE"), ("Save changes", "CAUTION"), ("Home", "SAFE"), (None, "SAFE")],
)
def test_safety(spark, label, expect):
    assert one(spark, identity.safety_label(F.col("n")), n=label) == expect


@pytest.mark.parametrize(("value", "expect"), [("btn-a1f3c9", True), ("Button__x9f2", True), ("item-12345", True), ("save-button", False), ("primary-nav", False), ("", True), (None, True)])
def test_generated_ids(spark, value, expect):
    assert one(spark, identity.looks_generated(F.col("v0")), v0=value) is expect


def test_fingerprints(frame):
    rows = [
        el(1, attributes={"data-testid": "go", "id": "x"}, accessible_name="A"),
        el(2, attributes={"id": "btn-a1f3c9"}, dom_path="m > b:nth-of-type(1)", accessible_name="Same"),
        el(3, attributes={}, dom_path="m > b:nth-of-type(1)", accessible_name="same "),
        el(4, dom_path="m > b:nth-of-type(2)", accessible_name="Same"),
        el(4, dom_path="m > b:nth-of-type(2)", accessible_name="Same"),
        {"element_id": 5}, {},
    ]
    got = {r.element_id: r for r in components.fingerprints(frame("elements", rows, ", strategy string, c string")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].strategy == "data-testid"
    assert got[2].fingerprint == got[3].fingerprint != got[4].fingerprint
    assert got[3].component_signature == got[4].component_signature


def test_ui_types(frame):
    rows = [
        el(1, attributes={"aria-roledescription": "Card"}), el(2, attributes={"role": "dialog"}), el(3, attributes={"role": "dialog", "aria-modal": "true"}),
        el(4, tag="nav", accessible_name="Breadcrumb"), el(5, tag="input", attributes={"type": "file"}), el(6, tag="div"), el(7, tag="a", attributes={"target": "_blank"}), el(8, tag="th", attributes={"aria-sort": "asc"}),
    ]
    got = components.current_elements(frame("elements", rows), *components.IDENTITY).select("element_id", identity.ui_type().alias("k")).collect()
    assert [r.k for r in sorted(got)] == ["card", "drawer", "dialog", "breadcrumb", "file-upload", None, "external-link", "sortable-column"]


def test_renames_in_differences(frame):
    def page(c, n):
        return {"page_id": n, "crawl_id": c, "url": U, "arrived_at": T(2025, 1, 1)}

    old = [el(1, crawl_id="a", attributes={"id": "save"}, accessible_name="Create customer"), el(2, crawl_id="a", dom_path="q", accessible_name="Filter list"), el(3, crawl_id="a", dom_path="z", accessible_name="Gone")]
    new = [el(11, crawl_id="b", attributes={"id": "save"}, accessible_name="Add customer"), el(12, crawl_id="b", dom_path="q", accessible_name="Refine list"), el(13, crawl_id="b", dom_path="n", accessible_name="New")]
    prints = components.fingerprints(frame("elements", old + new))
    pages = navigation.current_pages(frame("page_nodes", [page("a", 1), page("b", 2)]))
    spark = prints.sparkSession
    pairs = lambda x, y: spark.createDataFrame([(x, y)], "prev_crawl_id string, next_crawl_id string")
    got = {(r.change_kind, r.matched_by, r.accessible_name, r.previous_name) for r in diff.diff_elements(prints, pages, pairs("a", "b")).collect()}
    assert got == {("renamed", "fingerprint", "Add customer", "Create customer"), ("renamed", "structural", "Refine list", "Filter list"), ("removed", None, "Gone", None), ("added", None, "New", None)}
    assert diff.diff_elements(prints, pages, pairs("a", "a")).count() == 0


FOUND = ["alice@acme.example", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "+44 20 7946 0958", "(555) 123-4567"]
KEPT = ["1234567890123456", "2026-08-22", "08.22.2026", "1-25 of 340", "8080 9090", "12-345-678", "192.168.1.1", "2024.11.3", "1 234.56", "Orders (12)", "", None]


def test_redaction_corpus(spark):
    rows = spark.createDataFrame([(t,) for t in FOUND + KEPT], "t string")
    got = {r.t: r for r in redaction.redact(rows, "t", names=["Ann Lee"]).collect()}
    assert all(got[t].redacted.startswith("<") and t not in got[t].redacted for t in FOUND)
    assert all(got[t].redacted == t for t in KEPT)
    again = redaction.redact(spark.createDataFrame([(got[t].redacted,) for t in FOUND], "t string"), "t")
    assert all(r.t == r.redacted for r in again.collect())
    mixed = spark.createDataFrame([("ask ann lee at a@b.co, not Annlee",)], "t string")
    assert redaction.redact(mixed, "t", style="mask", names=["Ann Lee"]).first().redacted == "ask **** at ****, not Annlee"
    with pytest.raises(ValueError):
        redaction.redact(mixed, "t", ["NOPE"])


def test_mask_targets(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a > b"), (None, "a > bc"), ("f", "a"), (None, None)], "frame string, dom_path string")
    assert {tuple(r) for r in redaction.narrowest_targets(rows).collect()} == {("", "a > b"), ("", "a > bc"), ("f", "a")}


def test_forms_and_tables_of_parsed_pages(spark):
    rows = html.elements_of(spark.createDataFrame(list(PAGES.items()), "url string, html string"))
    full = rows.selectExpr("cast(pos + 100 * length(url) as bigint) as element_id", "'c' as crawl_id", "timestamp_ntz'2025-01-01' as arrived_at", "*", "cast(null as struct<x: double, y: double, width: double, height: double>) as bounding_box").withColumn("ui_type", identity.ui_type())
    fields = {(r.form, r.label, r.kind, r.required, r.options, r.option_count, r.default_value) for r in relations.form_fields(full).collect()}
    assert fields == {("#new", "Quantity", "spinbutton", True, "", 0, None), ("#new", "speed", "radio-group", False, "Fast | Slow", 2, "Fast")}
    assert [(r.fields, r.actions) for r in relations.forms(full).collect()] == [(2, "Create order")]
    assert [(r["columns"], r.row_count, r.row_actions) for r in relations.tables(full).collect()] == [("Order | Status", 1, "View")]
    assert {(r.kind, r.source) for r in relations.element_links(full).where("kind = 'groups'").collect()} == {("groups", "#new")}


def test_source_index_and_routes(spark, frame, tmp_path):
    for path, text in {**TREE, "node_modules/x.js": "export const X = 1;", "a.min.js": "x", "b.txt": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = code.read_tree(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == set(TREE)
    found = {r.name: r for r in code.components(files).collect()}
    assert found["Billing"].kind == "page" and found["Billing"].test_ids == ["pay-now"] and found["Shell"].kind == "layout"
    assert {(r.method, r.pattern) for r in code.endpoints(files).collect()} == {("POST", "/click/:id"), ("GET", "/view/:id/graphql")}
    pages = frame("page_nodes", [{"page_id": i, "crawl_id": "c", "url": f"https://x.example{p}", "arrived_at": T(2025, 1, 1)} for i, p in enumerate(["/", "/billing/7", "/queues/a/b", "/reports/", "/none"])])
    assert {(r.url[17:], r.source_name, r.confidence) for r in correlate.correlate_routes(pages, code.routes(files)).collect()} == {("/", "Home", "high"), ("/billing/7", "Billing", "medium"), ("/reports", "Reports", "high")}
    els = frame("elements", [el(1, attributes={"data-testid": "pay-now"}, accessible_name="x"), el(2, accessible_name="Quick  filters"), el(3, accessible_name="Show more"), el(4, accessible_name="Print")])
    assert {(r.element_id, r.source_name, r.confidence) for r in correlate.correlate_elements(els, code.components(files)).collect()} == {(1, "Billing", "confirmed"), (2, "Queues", "high"), (3, None, "low")}


def test_states(spark):
    triggers = spark.createDataFrame([("k", "Open", ["m"], True)], "scope string, trigger_name string, controls array<string>, expands boolean")
    schema = "scope string, category string, ui_type string, dom_path string, accessible_name string, text string, pos int"
    shown = lambda *rows: spark.createDataFrame([("k", *r, None, i) for i, r in enumerate(rows)], schema)
    kinds = lambda s: [(r.kind, r.name, r.dom_path) for r in uistate.classify_states(triggers, s, ["scope"]).collect()]
    assert kinds(shown(("dialog", "dialog", "a", "Big"), ("menu", "menu", "m", ""))) == [("menu", "Open", "m")]
    assert kinds(shown(("dialog", "drawer", "a > b", "In"), ("dialog", "dialog", "a", "Out"))) == [("modal", "Out", "a")]
    assert kinds(shown(("other", None, "a > b", "x"), ("other", None, "a", "y"))) == [("disclosure", "Open", "a")]


def test_screens(frame):
    def page(i, path, depth):
        return {"page_id": i, "crawl_id": "c", "url": f"https://x.example{path}", "depth": depth, "arrived_at": T(2025, 1, 1)}

    def edge(i, a, b):
        return {"edge_id": i, "crawl_id": "c", "source": f"https://x.example{a}", "target": f"https://x.example{b}", "label": "go", "arrived_at": T(2025, 1, 1)}

    pages = frame("page_nodes", [page(1, "/", 0), page(2, "/a", 1), page(3, "/island", None)])
    edges = frame("nav_edges", [edge(1, "/", "/a"), edge(2, "/a", "/"), edge(3, "/a", "/b#x"), edge(4, "/b", "/a"), edge(5, "/island", "/island"), edge(6, "/", ""), {}])
    assert {(r.url[17:], r.clicks) for r in navigation.bfs_depths(pages, edges).collect()} == {("/", 0), ("/a", 1), ("/b", 2)}
    assert [r.url[17:] for r in navigation.orphan_screens(pages, edges).collect()] == ["/island"]
    assert {(r.target[17:], r.screens) for r in navigation.not_captured(pages, edges).collect()} == {("/b", 1)}
    empty = frame("page_nodes", []), frame("nav_edges", [])
    assert navigation.bfs_depths(*empty).count() == navigation.orphan_screens(*empty).count() == navigation.egress_ledger(empty[1]).count() == 0


def test_retention_at_the_limit(frame):
    rows = [{"crawl_id": n, "finished_at": f, "started_at": s, "arrived_at": T(2025, 1, 1)} for n, f, s in [("30", T(2025, 1, 1), None), ("30.5", T(2024, 12, 31, 12), None), ("none", None, None), ("start", None, T(2024, 1, 1))]]
    got = {r.crawl_id: r.bucket for r in runs.retention_plan(frame("crawls", rows), "2025-01-31 00:00:00", 30).collect()}
    assert got == {"30": "kept", "30.5": "expired", "none": "undetermined", "start": "expired"}
    assert {r.bucket for r in runs.retention_plan(frame("crawls", rows), "2025-01-31 00:00:00", 0).collect()} == {"kept", "undetermined"}


def test_settings_adapters_reports(spark, tmp_path):
    with pytest.raises(ValueError):
        settings.Settings.of({"typo": 1})
    s = settings.Settings.of({"environment": "prod", "authorized": True})
    assert s.refusal() and not s.over(authorized_by="me").refusal() and s.digest() != s.over(max_pages=3).digest()
    assert settings.Settings.of({"environment": "preprod"}).refusal() is None
    (tmp_path / "s.json").write_text("\ufeff" + '{"start_url": "https://x.example", "include": ["/a/**"]}', encoding="utf-8")
    assert settings.load(str(tmp_path / "s.json")).include == ("/a/**",)
    with pytest.raises(ValueError):
        adapters.build([{"name": "nope"}])
    a = adapters.build([{"name": "skip_paths", "options": {"patterns": ["/x"]}}, {"name": "logged_in_marker", "options": {"name": "Sign out"}}])
    rows = spark.createDataFrame([("/x/1", ["Home"]), ("/y", ["sign out "])], "u string, names array<string>")
    assert [tuple(r) for r in rows.select(adapters.may_visit(a, F.col("u")), adapters.signed_in(a, F.col("names"))).collect()] == [(False, False), (True, True)]
    f = str(tmp_path / "r.md")
    reports.splice(f, "m", "one"), reports.splice(f, "m", "two"), reports.splice(f, "m", "two")
    assert open(f).read().count("two") == 1 and "one" not in open(f).read()
    assert "same pages" in reports.change_summary({"pages_added": 0}, {}) and "1 page added" in reports.change_summary({"pages_added": 1}, {"pages added": ["/a"]})
    compile(reports.test_skeleton([{"kind": "smoke", "automatable": True, "steps": [("navigate", "/"), ("guard_skip", "Delete")]}]), "t", "exec")


def test_sinks_and_api(spark, frame, tmp_path):
    els = frame("elements", [el(1, accessible_name="Delete", options=[("A", None, True, False), ("B", None, False, False)], states={"b": "2", "a": "1"})])
    sinks.elements_csv(els, str(tmp_path / "e"))
    row = spark.read.csv(str(tmp_path / "e"), header=True).first()
    assert (row.label, row.options, row.states) == ("Delete", "*A* | B", "a=1; b=2")
    sinks.controls_csv(els, frame("nav_edges", []), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().safety == "BLOCK"
    sinks.documents_json(els.select("crawl_id", "pos"), ["crawl_id"], str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"crawl_id":"c","rows":[{"pos":1}]}'
    for depth, body in (("a", '{"run_id": "r"}'), ("a/b", "{broken"), ("a/b/c", "{}")):
        (tmp_path / "runs" / depth).mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / depth / "run.json").write_text(body)
    assert sorted((r.run_id or "", r.broken) for r in sinks.find_captures(spark, str(tmp_path / "runs")).collect()) == [("", True), ("r", False)]
    assert all(getattr(api, name) for name in api.__all__)


def test_frames_origins_and_snapshots(spark, tmp_path):
    page = spark.createDataFrame([("https://x.example/", "a")], "url string, dom_path string")
    inner = spark.createDataFrame([("https://x.example/", "b", "own"), ("https://x.example/", "c", "other"), ("https://x.example/", "d", "blank")], "url string, dom_path string, frame string")
    frames = spark.createDataFrame([("https://x.example/", "own", "https://X.example/f"), ("https://x.example/", "other", "https://y.example/f"), ("https://x.example/", "blank", "about:blank")], "url string, frame string, frame_url string")
    from prismgrid.operators.capture import merge_frames

    assert {(r.dom_path, r.frame) for r in merge_frames(page, inner, frames).collect()} == {("a", None), ("b", "own"), ("d", "blank")}
    tree = '- main\n  - textbox "API token": hunter2\n  - button "Go": x\n  - searchbox: "q" and\n  - textbox "empty":'
    expect = '- main\n  - textbox "API token":\n  - button "Go": x\n  - searchbox:\n  - textbox "empty":'
    assert one(spark, redaction.redact_snapshot(F.col("t")), t=tree) == expect
    (tmp_path / "x").mkdir()
    assert runs.prune([str(tmp_path / "x"), str(tmp_path / "none")]) and (tmp_path / "x").exists()
    assert runs.prune([str(tmp_path / "x"), str(tmp_path / "none")], delete=True) == [str(tmp_path / "x")] and not (tmp_path / "x").exists()


def test_clicks_along_a_chain_of_pages(frame):
    links = [(i, i + 1) for i in range(45)] + [(i, i - 1) for i in range(1, 46)] + [(3, 8), (20, 2), (46, 47)]
    url = lambda i: f"https://x.example/{i}"
    pages = frame("page_nodes", [{"page_id": i, "crawl_id": "c", "url": url(i), "depth": i, "arrived_at": T(2025, 1, 1)} for i in range(48)])
    edges = frame("nav_edges", [{"edge_id": i, "crawl_id": "c", "source": url(a), "target": url(b), "label": "go", "arrived_at": T(2025, 1, 1)} for i, (a, b) in enumerate(links)])
    clicks, queue = {0: 0}, [0]
    for node in queue:
        for a, b in links:
            if a == node and b not in clicks:
                clicks[b] = clicks[node] + 1
                queue.append(b)
    assert max(clicks.values()) == 41
    assert {r.url: r.clicks for r in navigation.bfs_depths(pages, edges).collect()} == {url(i): n for i, n in clicks.items()}
