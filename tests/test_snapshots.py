import random
from datetime import datetime as T

from prismgrid.operators import snapshots


def crawl(i, day, done=True, **more):
    return {"crawl_id": i, "site": "s", "config_file": "f", "started_at": T(2025, 1, day), "finished_at": T(2025, 1, day, 1) if done else None, "arrived_at": T(2025, 2, 1), **more}


def el(i, c, path, name, day=1, **more):
    return {"element_id": i, "crawl_id": c, "url": "https://x.example/", "dom_path": path, "accessible_name": name, "arrived_at": T(2025, 3, day), **more}


def changes(frame, crawls, pages, elements):
    out = snapshots.snapshot_changes(frame("crawls", crawls, ", pair string, side int"), frame("page_nodes", pages), frame("elements", elements, ", name string"))
    return {(r.prev_crawl_id, r.crawl_id, r.record_type, r.url, r.frame, r.dom_path, r.change_kind) for r in out.collect()}


def test_added_removed_changed_and_unfinished(frame):
    crawls = [crawl("a", 1), crawl("b", 2, done=False), crawl("c", 3), crawl("c", 3)]
    els = [
        el(1, "a", "x > y", "Save"), el(2, "c", "x>y", "  SAVE "), el(3, "a", "p", "old"), el(4, "c", "p", "new"),
        el(5, "a", "gone", None), el(6, "c", "fresh", ""), el(7, "a", "q", None), el(8, "c", "q", ""), el(9, "b", "only-b", "x"),
    ]
    u = "https://x.example/"
    assert changes(frame, crawls, [], els) == {
        ("a", "c", "element", u, "", "p", "changed"),
        ("a", "c", "element", u, "", "gone", "removed"),
        ("a", "c", "element", u, "", "fresh", "added"),
    }


def test_last_delivery_counts_and_frames_are_apart(frame):
    els = [el(1, "a", "p", "one"), el(2, "b", "p", "two", day=1), el(2, "b", "p", "one", day=5), el(3, "b", "p", "one", frame="f")]
    assert changes(frame, [crawl("a", 1), crawl("b", 2)], [], els) == {("a", "b", "element", "https://x.example/", "f", "p", "added")}


def test_pages(frame):
    pages = [
        {"page_id": 1, "crawl_id": "a", "url": "https://x.example/p#x", "arrived_at": T(2025, 1, 1)},
        {"page_id": 2, "crawl_id": "b", "url": "https://x.example/p/", "arrived_at": T(2025, 1, 1)},
        {"page_id": 3, "crawl_id": "b", "url": "https://x.example/q", "arrived_at": T(2025, 1, 1)},
        {"page_id": 4, "crawl_id": "b", "url": "https://x.example/q#z", "arrived_at": T(2025, 1, 1)},
    ]
    assert changes(frame, [crawl("a", 1), crawl("b", 2)], pages, []) == {("a", "b", "page", "https://x.example/q", "", "", "added")}


def test_empty_and_nulls(frame):
    assert changes(frame, [], [], []) == set()
    assert changes(frame, [{}, crawl(None, 1)], [{}], [{}]) == set()
    assert changes(frame, [crawl("a", 1), crawl("b", 2)], [{}], [el(1, "b", None, None, url=None)]) == {("a", "b", "element", "", "", "", "added")}


def test_random_snapshots_against_brute_force(frame):
    rng = random.Random(4)
    crawls = [crawl(f"c{i}", i + 1) for i in range(4)]
    els, n, held = [], 0, {}
    for c in crawls:
        for path in "abcdefgh":
            if rng.random() < 0.6:
                n += 1
                held[c["crawl_id"], path] = name = rng.choice(["x", "y", None])
                els.append(el(n, c["crawl_id"], path, name))
    expect = set()
    for old, new in zip(crawls, crawls[1:]):
        for path in "abcdefgh":
            o, w = (old["crawl_id"], path), (new["crawl_id"], path)
            kind = None
            if o in held and w in held:
                kind = "changed" if (held[o] or "") != (held[w] or "") else None
            elif o in held or w in held:
                kind = "removed" if o in held else "added"
            if kind:
                expect.add((old["crawl_id"], new["crawl_id"], "element", "https://x.example/", "", path, kind))
    assert changes(frame, crawls, [], els) == expect
