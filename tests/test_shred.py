import json
import random

from prismgrid.operators import shred


def rows(frame, bodies):
    got = shred.capture_records(frame("raw_captures", [{"capture_id": i, "body": b} for i, b in bodies], ", child_key string"))
    return {tuple(r) for r in got.collect()}


def test_shapes(frame):
    body = {
        "navigation": {"from": "/a", "to": "/b"},
        "pages": [
            None,
            {"url": "/p#x", "page": {"elements": [
                {"dom_path": "a > b", "options": ["Bare", None, {"label": "L"}], "bounding_box": [1, 2, 3, 4]},
                None,
                {"dom_path": "c", "options": {"label": "one"}, "bounding_box": "{\"x\": 1}"},
                {"options": '["q", {"label": "r"}]', "bounding_box": {"origin": {"x": 1, "y": 2}, "size": {}}},
                {"dom_path": "d", "options": "alone", "bounding_box": None},
            ]}},
            {"url": "/q", "page": None},
        ],
    }
    assert rows(frame, [(1, json.dumps(body))]) == {
        (1, "navigation", "0", ""),
        (1, "page", "1", ""), (1, "page", "2", ""),
        (1, "element", "1.0", "/p#x"), (1, "element", "1.2", "/p#x"), (1, "element", "1.3", "/p#x"), (1, "element", "1.4", "/p#x"),
        (1, "option", "1.0.0", "a > b"), (1, "option", "1.0.2", "a > b"), (1, "option", "1.2.0", "c"),
        (1, "option", "1.3.0", ""), (1, "option", "1.3.1", ""), (1, "option", "1.4.0", "d"),
        (1, "bounding_box", "1.0", "a > b"), (1, "bounding_box", "1.2", "c"), (1, "bounding_box", "1.3", ""),
    }


def test_unreadable_and_wrapped(frame):
    body = json.dumps({"navigation": [{"to": "/x"}]})
    bodies = [(1, None), (2, ""), (3, body[:-3]), (4, "[]"), (None, body), (5, "﻿" + body), (6, json.dumps(body)), (5, "﻿" + body)]
    assert rows(frame, bodies) == {(5, "navigation", "0", ""), (6, "navigation", "0", "")}
    assert rows(frame, []) == set()


def naive(body):
    out = []
    as_list = lambda v: v if isinstance(v, list) else [] if v in (None, "", {}) else [v]
    for i, n in enumerate(as_list(body.get("navigation"))):
        if n is not None:
            out.append(("navigation", f"{i}", ""))
    for i, p in enumerate(as_list(body.get("pages"))):
        if p is None:
            continue
        out.append(("page", f"{i}", ""))
        for j, e in enumerate(as_list((p.get("page") or {}).get("elements"))):
            if e is None:
                continue
            out.append(("element", f"{i}.{j}", p.get("url") or ""))
            if e.get("bounding_box") not in (None, {}, [], ""):
                out.append(("bounding_box", f"{i}.{j}", e.get("dom_path") or ""))
            for k, o in enumerate(as_list(e.get("options"))):
                if o is not None:
                    out.append(("option", f"{i}.{j}.{k}", e.get("dom_path") or ""))
    return out


def test_levels_against_plain_walk(frame):
    rng = random.Random(7)

    def some(make, most):
        return rng.choice([None, [], make(), *[[make() if rng.random() < 0.8 else None for _ in range(rng.randint(1, most))]] * 5])

    option = lambda: rng.choice(["text", {"label": "x"}])
    element = lambda: {"dom_path": rng.choice(["a", "b > c", None]), "options": some(option, 4), "bounding_box": rng.choice([None, {}, {"x": 1}, [1, 2]])}
    page = lambda: {"url": rng.choice(["/u", "/v"]), "page": rng.choice([None, {"elements": some(element, 4)}, {"elements": some(element, 4)}])}
    bodies = [(i, {"navigation": some(lambda: {"to": "x"}, 3), "pages": some(page, 4)}) for i in range(60)]
    expect = {(i, *r) for i, b in bodies for r in naive(b)}
    assert rows(frame, [(i, json.dumps(b)) for i, b in bodies]) == expect


def test_tables_keep_the_parent(frame):
    body = {"pages": [{"url": "/p", "page": {"elements": [{"dom_path": "a", "bounding_box": {"x": "5", "y": 2}, "options": ["o"]}]}}]}
    table = frame("raw_captures", [{"capture_id": 9, "body": json.dumps(body)}] * 2)
    assert [tuple(r) for r in shred.capture_table(table, "option").collect()] == [(9, "0.0.0", "0.0", "a", "o", None, None, None)]
    assert [tuple(r) for r in shred.capture_table(table, "bounding_box").collect()] == [(9, "0.0", "0.0", "a", 5.0, 2.0, None, None)]
    assert [r.parent_key for r in shred.capture_table(table, "element").collect()] == ["0"]


def test_no_leaf_of_a_body_is_lost(frame):
    option = {"label": "L1", "value": None, "hint": "h1", "selected": True}
    element = {"dom_path": "d1", "role": None, "states": {"busy": True}, "data": {"k": ["v1"]}, "options": ["o1", option], "bounding_box": {"x": 11, "origin": {"y": 12, "z": 13}, "unit": "px"}}
    page = {"title": "t1", "viewport": {"width": 1440}, "theme": "dark", "elements": [element, {"dom_path": "d2", "bounding_box": [1, 2, 3, 4, 15], "options": []}]}
    links = [{"url": "/o1", "label": "ol", "rank": 21}, None, "/o2"]
    body = {"crawl_id": "c1", "config": {"limit": 31}, "note": "n1", "navigation": [{"to": "/b", "weight": 41}], "pages": [{"url": "/p", "out_links": links, "score": 51, "page": page}, {"url": "/q", "page": "text page"}]}
    table = frame("raw_captures", [{"capture_id": 1, "body": json.dumps(body)}])
    got = {t: {r.child_key: r for r in shred.capture_table(table, t).collect()} for t in shred.TABLE_SCHEMA}
    left = {t: {k: json.loads(r.rest or "{}") for k, r in rows.items()} for t, rows in got.items() if "rest" in shred.TABLE_SCHEMA[t]}
    assert json.loads(got["page"]["0"].viewport) == {"width": 1440} and json.loads(got["element"]["0.0"].states) == {"busy": True}
    assert left["page"] == {"0": {"score": 51, "page.theme": "dark"}, "1": {"page": "text page"}}
    assert left["element"] == {
        "0.0": {"role": None, "data": {"k": ["v1"]}, "options[1].value": None, "options[1].hint": "h1", "bounding_box": {"origin.z": 13, "unit": "px"}},
        "0.1": {"bounding_box": [1, 2, 3, 4, 15], "options": []},
    }
    assert {k: (r.parent_key, r.parent_ref, r.url, r.rest) for k, r in got["out_link"].items()} == {"0.0": ("0", "/p", "/o1", '{"rank": 21}'), "0.2": ("0", "/p", "/o2", None)}
    assert left["navigation"] == {"0": {"weight": 41}} and left["capture"] == {"0": {"note": "n1"}}
    assert (got["capture"]["0"].crawl_id, got["capture"]["0"].config) == ("c1", '{"limit": 31}')
