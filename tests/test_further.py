import json
from datetime import datetime as T

import pytest

from prismgrid import __main__ as command
from prismgrid import reports, session, settings
from prismgrid.operators import navigation, relations, runs, shred, uistate
from prismgrid.sources import html, sinks

AT = T(2025, 1, 1)


def page(i, depth=None, crawl="c"):
    return {"page_id": i, "crawl_id": crawl, "url": f"https://x.example/{i}", "depth": depth, "arrived_at": AT}


def edge(i, a, b, crawl="c"):
    return {"edge_id": i, "crawl_id": crawl, "source": f"https://x.example/{a}", "target": f"https://x.example/{b}", "arrived_at": AT}


def test_frontier_claims_its_budget_in_order(frame):
    pages = frame("page_nodes", [page(i, 0 if i == 0 else 1) for i in range(8)] + [page(9, 1, "d")])
    # 0 -> 3, 2, 1; 3 -> 4; 1 -> 5; 7 is missed; 99 does not exist; d has no entry page
    links = [(1, 0, 3), (2, 0, 2), (3, 0, 1), (4, 3, 4), (5, 1, 5), (6, 0, 99), (7, 0, 3)]
    edges = frame("nav_edges", [edge(*e) for e in links])
    take = lambda **k: [(int(r.url[-1]), r.clicks, r.turn) for r in navigation.crawl_frontier(pages, edges, **k).orderBy("turn").collect()]
    assert take() == [(0, 0, 1), (3, 1, 2), (2, 1, 3), (1, 1, 4), (4, 2, 5), (5, 2, 6)]
    # 5 is only linked from 1, which is not claimed
    assert take(max_pages=3) == [(0, 0, 1), (3, 1, 2), (2, 1, 3)]
    assert take(max_depth=1) == [(0, 0, 1), (3, 1, 2), (2, 1, 3), (1, 1, 4)]
    assert navigation.crawl_frontier(frame("page_nodes", []), frame("nav_edges", [])).count() == 0


def test_tables_above_sixty_steps_and_circles(frame):
    def el(i, path, up, category="region", **more):
        return {"element_id": i, "crawl_id": "c", "url": "https://x.example/", "pos": i, "dom_path": path, "parent_path": up, "category": category, "arrived_at": AT, **more}

    chain = [el(0, "t", "", "table", accessible_name="Orders", column_names=["A", "B"], row_count=2)]
    chain += [el(i, f"n{i}", f"n{i - 1}" if i > 1 else "t") for i in range(1, 61)]
    rows = chain + [el(70, "b", "n60", "button", accessible_name="Pay"), el(71, "x", "y"), el(72, "y", "x"), el(73, "z", "x", "link", accessible_name="Lost"), el(74, "v", "nowhere", "button")]
    (got,) = relations.tables(frame("elements", rows)).collect()
    assert (got.name, got.columns, got.row_count, got.row_actions) == ("Orders", "A | B", 2, "Pay")


def test_content_hash_is_that_of_scripts(spark):
    def brute(text):
        h = 0
        units = " ".join(text.split()).encode("utf-16-le")
        for k in range(0, len(units), 2):
            h = (31 * h + int.from_bytes(units[k : k + 2], "little")) & 0xFFFFFFFF
        return str(h - (1 << 32) if h >= 1 << 31 else h)

    texts = ["", "hello", "a  b\n c ", "Grüße 😀 日本", "x" * 500]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r.t: r.h for r in rows.select("t", uistate.content_hash(rows.t).alias("h")).collect()}
    assert {t: got[t] for t in texts} == {t: brute(t) for t in texts} and got[None] == "0" and got["hello"] == "99162322"


def test_what_lies_inside_a_container(spark):
    rows = spark.createDataFrame([("p", "main > div > a", 1), ("p", "main > div2", 2), ("p", "main > div", 3), ("q", "main > div > b", 4), ("p", None, 5)], "page string, dom_path string, n int")
    held = spark.createDataFrame([("p", "main > div"), ("p", "main"), ("p", "")], "page string, container string")
    got = {(r.container, r.n) for r in uistate.inside(rows, held, ["page"]).collect()}
    assert got == {("main > div", 1), ("main > div", 2), ("main", 1), ("main", 2), ("main", 3)}


def test_index_takes_each_run_once(spark):
    rows = "run_id string, crawl_id string, at timestamp, outcome string, pages int, finishes bigint"
    index = spark.createDataFrame([("r", "1", AT, "ok", 3, 1)], rows)
    more = spark.createDataFrame([("r", "1", AT, "failed", 0, 1), ("s", "2", AT, "ok", 1, 1)], rows)
    assert {(r.run_id, r.outcome) for r in runs.append_index(index, more).collect()} == {("r", "ok"), ("s", "ok")}
    twice = spark.createDataFrame([("r", "a", "failed", None, 1), ("r", "b", "ok", 4, 2)], "run_id string, crawl_id string, outcome string, pages_crawled int, t int")
    (got,) = runs.run_index(twice, twice.t).collect()
    assert (got.crawl_id, got.outcome, got.pages, got.finishes) == ("b", "ok", 4, 2)


def test_unread_bodies_and_pages_are_reported(spark, frame, monkeypatch):
    bodies = ["", None, " \n", "{broken", "[1]", '"text"', "null", '{"pages": []}', '"{\\"pages\\": []}"', "[" * 200_000]
    rows = frame("raw_captures", [{"capture_id": i, "body": b} for i, b in enumerate(bodies)])
    got = {r.capture_id: r.reason for r in shred.unread_bodies(rows).collect()}
    assert got == {0: "blank", 1: "blank", 2: "blank", 3: "unreadable", 4: "no object", 5: "unreadable", 6: "no object", 9: "unreadable"}
    deep = spark.createDataFrame([("u", "<div>" * 5000), ("v", "<p>x")], "url string, html string")
    lost = {r.url for r in html.unparsed_pages(deep).collect()}
    assert lost <= {"u"} and {r.url for r in html.headings_of(deep).collect()} == set()


def test_bodies_are_striped_in_parts(frame, monkeypatch):
    body = json.dumps({"navigation": [{"to": "/a"}], "pages": [{"url": "u", "page": {"elements": [{"dom_path": "p", "options": ["x", "y"]}]}}]})
    rows = frame("raw_captures", [{"capture_id": i, "body": body} for i in range(5)])
    whole = sorted(map(tuple, shred.capture_records(rows).collect()))
    monkeypatch.setattr(shred, "HELD", len(body) + 1)
    assert sorted(map(tuple, shred.capture_records(rows).collect())) == whole and len(whole) == 25


def test_clusters_need_a_shared_folder():
    class Sc:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)})())})())

        getConf = staticmethod(lambda: {})  # noqa: N815

    fake = type("Spark", (), {"sparkContext": Sc, "conf": {}})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)


def test_descriptions():
    s = settings.Settings.of({"block_words": ["Obliterate", "delete"], "never_touch": ["#nav"], "exclude": ["/x"], "max_pages": 5})
    got, plain = settings.describe_envelope(s), settings.describe_envelope(settings.Settings())
    assert got["block_words_extra"] == ["delete", "obliterate"] and plain["block_words"] < got["block_words"] <= plain["block_words"] + 2
    assert got["never_touch"] == ["#nav"] and got["allow_list"] == sorted(got["allow_list"])
    assert settings.describe_session(None, "s", "https://x.example", 0) == []
    assert settings.describe_session({"origins": []}, "s", "https://x.example", 0)[0].startswith("info")
    assert settings.output_folder("out", "shop", True, "2025-01-02").endswith("2025-01-02/shop")
    assert settings.output_folder("out", "shop", False, "2025-01-02").endswith("out/shop")
    notes = reports.scoping_notes(s, 2, ["Danger"])
    assert any("/x" in n for n in notes) and any("2 linked pages" in n for n in notes) and any("Danger" in n for n in notes)
    assert reports.scoping_notes(settings.Settings(), 0) == ["Nothing was left out by the settings."]


def test_reports_and_documents(spark, tmp_path):
    rows = [{"kind": "route", "confidence": c, "observed": o, "source_name": "Home", "path": "a.js", "line": 1, "evidence": "path"} for c, o in (("low", "/b"), ("high", "/a|b"))]
    text = reports.correlation_report(rows, ["/z"])
    assert text.index("/a\\|b") < text.index("| low | /b") < text.index("- /z")
    text = reports.crawl_report("Shop", {"screens": 2}, [{"url": "/b", "depth": None}, {"url": "/a", "depth": 0, "title": "A"}], [("/a", "/b", "Go")])
    assert text.index("| /a | A | 0") < text.index("| /b |") < text.index("flowchart")
    ts = reports.test_skeleton_ts([{"kind": "smoke", "automatable": True, "steps": [("navigate", "/"), ("guard_skip", "Delete\nall")]}, {"kind": "form", "automatable": False}])
    assert ts.count("test(") == 1 and "// not automated: Delete all" in ts
    screens = spark.createDataFrame([("c", "u", 1)], "crawl_id string, url string, n int")
    paths = sinks.write_documents({"crawl": screens, "relations": screens.limit(0)}, str(tmp_path))
    assert json.loads(spark.read.text(paths["crawl"]).first().value) == {"crawl_id": "c", "rows": [{"url": "u", "n": 1}]}
    assert spark.read.text(paths["relations"]).count() == 0
    with pytest.raises(ValueError):
        sinks.write_documents({"other": screens}, str(tmp_path))


def test_command(capsys):
    assert command.main(["list"]) == 0 and "p3_found" in capsys.readouterr().out
    assert command.main(["nothing", "a", "b"]) == 2
