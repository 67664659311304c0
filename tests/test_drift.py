import json
from collections import Counter

from prismgrid.operators import drift


def lines(feed, no, records):
    return [{"file_id": 1, "feed": feed, "file_no": no, "line_no": i, "record": r if isinstance(r, (str, type(None))) else json.dumps(r)} for i, r in enumerate(records)]


def found(frame, rows):
    out = drift.schema_changes(frame("crawl_files", rows, ", features string, kind string"))
    return {(r.feed, r.file_no, r.field_path, r.change_kind, r.new_path) for r in out.collect()}


BASE = {"crawl_id": "cr_12ab", "schema_version": "0.1.0", "config": {"max_pages": 25}, "navigation": [{"label": "Orders", "to": "/a/1"}]}


def test_added_removed_renamed_retyped(frame):
    two = {"crawl_id": "cr_77ff", "schema_version": {"major": 0, "minor": 1}, "config": {"page_limit": 50}, "navigation": [{"caption": "Orders", "to": "/b/2"}], "note": True}
    rows = lines("f", 3, [BASE, BASE, "{broken", None, "null", "[1]"]) + lines("f", 7, [two, two])
    assert found(frame, rows) == {
        ("f", 7, "schema_version", "retyped", ""),
        ("f", 7, "config.max_pages", "renamed", "config.page_limit"),
        ("f", 7, "navigation[].label", "renamed", "navigation[].caption"),
        ("f", 7, "note", "added", ""),
    }


def test_container_renamed_hides_what_is_below(frame):
    rows = lines("f", 1, [{"a": "x", "stats": {"n": 1, "gone": 2}}]) + lines("f", 2, [{"a": "x", "statistics": {"n": 3, "new": "s"}}])
    assert found(frame, rows) == {("f", 2, "stats", "renamed", "statistics")}


def test_different_content_is_no_rename(frame):
    rows = lines("f", 1, [{"k": 1, "locale": "de-DE"}] * 3) + lines("f", 2, [{"k": 2, "url": "https://x.example/a/long/path"}] * 3)
    assert found(frame, rows) == {("f", 2, "locale", "removed", ""), ("f", 2, "url", "added", "")}


def test_feeds_apart_and_nulls_have_no_type(frame):
    rows = lines("f", 1, [{"a": None}]) + lines("f", 2, [{"a": 5}]) + lines("g", 1, [{"b": 1}])
    assert found(frame, rows) == set()


def test_empty_table(frame):
    assert found(frame, []) == set()
    assert drift.unified_records(frame("crawl_files", [])).count() == 0


def test_lifespans(frame):
    rows = lines("f", 1, [{"a": 1}]) + lines("f", 2, [{"a": "x"}]) + lines("f", 3, [{"a": "y", "b": 1}])
    out = {(r.path, r.kind, r.first_file, r.last_file, r.starts, r.ends) for r in drift.lifespans(drift.file_footers(frame("crawl_files", rows))).collect()}
    assert out == {("a", "number", 1, 1, False, True), ("a", "string", 2, 3, True, False), ("b", "number", 3, 3, True, False)}


def test_unified_records_follow_aliases_and_casts(frame):
    old = [{"crawl_id": f"cr_{i}", "started_at": "2025-01-01T00:00:00Z", "config": {"max_pages": 25 * i}, "navigation": [{"label": "Help"}]} for i in (1, 2)]
    new = [{"crawl_id": f"cr_{i}", "started_at": 1735689600, "config": {"page_limit": str(25 * i)}, "navigation": [{"label": ["Help"]}]} for i in (3, 4)]
    mid = [{"crawl_id": f"cr_{i}", "started_at": 1735689600, "config": {"page_limit": 25 * i}, "navigation": [{"label": "Help"}]} for i in (1, 2)]
    out = drift.unified_records(frame("crawl_files", lines("f", 1, old) + lines("f", 2, mid) + lines("f", 3, new))).collect()
    assert Counter(r.started_at for r in out) == {"2025-01-01T00:00:00Z": 6}
    assert sorted(r.max_pages for r in out) == [25, 25, 50, 50, 75, 100]
    assert {r.navigation[0].nav_label for r in out} == {"Help"}


def test_blocks_of_files_change_nothing(frame, monkeypatch):
    rows = []
    for no in range(1, 12):
        record = {"a": no if no % 4 else str(no), "keep": True}
        if no not in (4, 5, 8):
            record["b"] = "x"
        rows += lines("f", no * 3, [record])
    whole = found(frame, rows)
    spans = lambda: sorted(map(tuple, drift.lifespans(drift.file_footers(frame("crawl_files", rows))).collect()))
    one = spans()
    monkeypatch.setattr(drift, "BLOCK", 2)
    assert found(frame, rows) == whole and spans() == one
    assert ("f", 12, "b", "removed", "") in whole and ("f", 18, "b", "added", "") in whole and ("f", 12, "a", "retyped", "") in whole


def test_contents_behind_a_long_common_opening_decide(frame):
    opening = "This note was written by the capture service while it looked at the page and at all that the page links to, so that what follows can be told from what was there before; the words of this opening never change. "
    assert len(opening) > 200
    one = ["orders invoices customers ledgers quotes", "ledgers quotes orders refunds customers", "invoices refunds orders customers ledgers"]
    two = ["harbour weather tides wind clouds", "wind tides rain harbour snow", "clouds snow weather rain tides"]
    old = [{"k": 1, "first": opening + 8 * (t + " ")} for t in one]
    new = [{"k": 1, "a_weather": opening + 8 * (t + " "), "b_orders": opening + 8 * (u + " ")} for t, u in zip(two, reversed(one), strict=True)]
    assert drift.features(old[0]["first"]) != drift.features(new[0]["a_weather"])
    assert found(frame, lines("f", 1, old) + lines("f", 2, new)) == {("f", 2, "first", "renamed", "b_orders"), ("f", 2, "a_weather", "added", "")}


def leaves(value):
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    return [] if value is None else [value]


def test_no_leaf_of_a_readable_record_is_lost(frame):
    record = {
        "crawl_id": "cr_1", "extra": "e1", "auth_used": "perhaps", "schema_version": {"major": 7, "minor": 8, "patch": 9, "build": "b1"},
        "config": {"max_pages": "plenty", "theme": "dark"},
        "navigation": [
            {"label": "Orders", "weight": 31, "opens_new": "tab"}, "bare entry", None, ["listed"],
            {"label": {"text": "Help", "lang": "en"}, "to": "/h", "rank": {"of": 41, "all": [42]}},
        ],
    }
    rows = drift.unified_records(frame("crawl_files", lines("f", 1, [record, {"navigation": {"label": "One", "weight": 51}}, {"navigation": "text"}]))).collect()
    row, single, scalar = sorted(rows, key=lambda r: r.line_no)
    rest = json.loads(row.rest)
    assert (rest["navigation[0].weight"], rest["navigation[0].opens_new"]) == (31, "tab")
    assert (rest["navigation[1]"], rest["navigation[3]"], rest["navigation[4].rank"]) == ("bare entry", ["listed"], {"of": 41, "all": [42]})
    assert [n and n.nav_label for n in row.navigation] == ["Orders", None, None, None, "Help"]
    assert json.loads(single.rest) == {"navigation[0].weight": 51} and json.loads(scalar.rest) == {"navigation": "text"}
    held = json.dumps([*leaves(rest), *leaves(row.asDict(recursive=True))])
    assert [x for x in leaves(record) if str(x) not in held] == []


def test_container_and_label_both_renamed(frame):
    old, both, third, more = (
        [{"crawl_id": "cr_1", holder: [{name: "Orders", "to": "/a/1"}, {name: "Help", "to": "/a/2"}]}]
        for holder, name in (("navigation", "label"), ("edges", "label"), ("edges", "linkLabel"), ("links", "linkLabel"))
    )
    back = [{"crawl_id": "cr_1", "navigation": [{"linkLabel": "Orders", "to": "/a/1"}, {"linkLabel": "Help", "to": "/a/2"}]}]
    # In f the label is renamed below the new container; g learns of it under the declared
    # one only, and its last file has a third container with the other name.
    rows = lines("f", 1, old) + lines("f", 2, both) + lines("f", 3, third)
    rows += lines("g", 1, old) + lines("g", 2, back) + lines("g", 3, more)
    for some in (rows, [r for r in rows if r["feed"] == "f"], [r for r in rows if r["feed"] == "g"]):
        out = drift.unified_records(frame("crawl_files", some)).collect()
        assert [[n.nav_label for n in r.navigation] for r in out] == [["Orders", "Help"]] * len(some)
        assert {r.rest for r in out} == {"{}"}


def test_a_name_may_mean_another_field_in_another_feed(frame):
    f = [[{"crawl_id": f"cr_{i}", "engine_version": f"0.{i}.1"}] * 3 for i in (1, 2)]
    f += [[{"crawl_id": f"cr_{i}", "tool": f"0.{i}.1"}] * 3 for i in (3, 4)]
    g = [[{"crawl_id": "cr_5", "run_id": f"run-{i}-x"}] * 3 for i in (1, 2)] + [[{"crawl_id": "cr_6", "tool": f"run-{i}-x"}] * 3 for i in (3, 4)]
    rows = [x for k, r in enumerate(f) for x in lines("f", k + 1, r)] + [x for k, r in enumerate(g) for x in lines("g", k + 1, r)]
    assert {("f", 3, "engine_version", "renamed", "tool"), ("g", 3, "run_id", "renamed", "tool")} <= found(frame, rows)
    out = drift.unified_records(frame("crawl_files", rows)).collect()
    assert {(r.feed, r.engine_version) for r in out if r.feed == "f"} == {("f", f"0.{i}.1") for i in (1, 2, 3, 4)}
    assert {(r.run_id, r.engine_version) for r in out if r.feed == "g"} == {(f"run-{i}-x", None) for i in (1, 2, 3, 4)}


def test_two_names_of_one_field_in_a_record_collide(frame):
    old = [{"crawl_id": f"cr_{i}", "config": {"max_pages": 25}} for i in (1, 2)]
    new = [{"crawl_id": f"cr_{i}", "config": {"page_limit": 25}} for i in (3, 4)]
    both = [{"crawl_id": "cr_5", "config": {"max_pages": 30, "page_limit": 40}}]
    out = drift.unified_records(frame("crawl_files", lines("f", 1, old) + lines("f", 2, new) + lines("g", 1, both))).collect()
    (r,) = [r for r in out if r.feed == "g"]
    assert (r.max_pages, json.loads(r.rest), r.collisions) == (30, {"config.page_limit": 40}, ["config.page_limit"])
    assert {tuple(r.collisions) for r in out if r.feed == "f"} == {()}
