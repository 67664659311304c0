import random
from datetime import datetime as T

import pytest

from prismgrid.operators import orphans


def el(i, path, arrived, **more):
    return {"element_id": i, "crawl_id": "c", "url": "https://x.example/a", "dom_path": path, "arrived_at": arrived, **more}


def cases(frame, elements=(), pages=(), edges=()):
    out = orphans.find_orphans(
        frame("elements", elements, ", month string, h1 int, c int"), frame("page_nodes", pages), frame("nav_edges", edges)
    )
    return {tuple(r) for r in out.collect()}


JAN, FEB = T(2025, 1, 10), T(2025, 2, 3)


def test_missing_late_deleted_and_spelled_otherwise(frame):
    rows = [
        el(1, "form", JAN),
        el(2, "late", FEB),
        el(3, "gone", JAN, deleted_at=T(2025, 1, 20)),
        el(4, "kept", JAN, deleted_at=T(2025, 2, 20)),
        el(10, "x", JAN, controls=["fo rm", "late", "gone", "kept", "never", "", None, " "], owner_form=" "),
        el(11, "y", JAN, owner_form="never  >  b", url="https://x.example/a/#top"),
    ]
    assert cases(frame, rows) == {
        ("elements", "controls", 10, "late", "2025-01"),
        ("elements", "controls", 10, "gone", "2025-01"),
        ("elements", "controls", 10, "never", "2025-01"),
        ("elements", "owner_form", 11, "never>b", "2025-01"),
    }


def test_first_arrival_of_repeated_deliveries_sets_the_month(frame):
    rows = [el(1, "a", FEB), el(2, "b", FEB, controls=["a"]), el(2, "b", JAN, controls=["a"])]
    assert cases(frame, rows) == {("elements", "controls", 2, "a", "2025-01")}


def test_pages_and_frames(frame):
    pages = [{"page_id": 1, "crawl_id": "c", "url": "https://x.example/p/", "arrived_at": JAN}]
    edges = [
        {"edge_id": 1, "crawl_id": "c", "target": "https://x.example/p#s", "arrived_at": JAN},
        {"edge_id": 2, "crawl_id": "d", "target": "https://x.example/p", "arrived_at": JAN},
        {"edge_id": 3, "crawl_id": "c", "target": "", "arrived_at": JAN},
        {"edge_id": 4, "crawl_id": "c", "target": "https://x.example/", "arrived_at": JAN},
        {"edge_id": 4, "crawl_id": "c", "target": "https://x.example/", "arrived_at": FEB},
    ]
    rows = [el(1, "a", JAN, frame="f"), el(2, "b", JAN, controls=["a"])]
    assert cases(frame, rows, pages, edges) == {
        ("nav_edges", "target", 2, "https://x.example/p", "2025-01"),
        ("nav_edges", "target", 4, "https://x.example/", "2025-01"),
        ("elements", "controls", 2, "a", "2025-01"),
    }


def test_empty_and_null_rows(frame):
    assert cases(frame) == set()
    assert cases(frame, [{}, {"element_id": 5, "controls": ["a"]}], [{}], [{}]) == set()


def generated(rng, n):
    """Rows with repeated deliveries, corrections, deletions and late arrivals, in random order."""
    day = lambda: T(2025, rng.randint(1, 4), rng.randint(1, 28))
    gone = lambda: day() if rng.random() < 0.3 else None
    rows, pages, edges = [], [], []
    for _ in range(n):
        path = lambda: rng.choice("abcdef")
        rows.append(el(rng.randint(1, n // 2), path(), day(), deleted_at=gone(), controls=[path() for _ in range(rng.randint(0, 2))], owner_form=rng.choice(["a", "zz", None])))
        pages.append({"page_id": rng.randint(1, 6), "crawl_id": "c", "url": f"https://x.example/{path()}", "arrived_at": day(), "deleted_at": gone()})
        edges.append({"edge_id": rng.randint(1, n // 2), "crawl_id": "c", "target": f"https://x.example/{path()}", "arrived_at": day()})
    return rows, pages, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_of_the_deliveries_gives_the_same_orphans(spark, frame, tmp_path, seed):
    rng = random.Random(seed)
    tables = generated(rng, 24)
    log = orphans.OrphanLog(spark, str(tmp_path))
    parts = rng.randint(2, 4)
    turn = [[rng.randrange(parts) for _ in t] for t in tables]
    for k in range(parts):
        part = [[r for r, at in zip(t, ts, strict=True) if at == k] for t, ts in zip(tables, turn, strict=True)]
        frames = [frame(name, rows) for name, rows in zip(("elements", "page_nodes", "nav_edges"), part, strict=True)]
        log.append(orphans.deliveries(*frames), number=k)
        log.append(orphans.deliveries(*frames), number=k)  # a replay changes nothing
        if k == 1:
            log.compact()
    whole = cases(frame, *tables)
    assert {tuple(r)[:5] for r in log.orphans().collect()} == whole and whole
    report = orphans.orphan_report(*[frame(n, t) for n, t in zip(("elements", "page_nodes", "nav_edges"), tables, strict=True)])
    assert sorted(map(tuple, log.counts().collect())) == sorted(map(tuple, report.collect()))


def test_redelivered_page_with_a_deletion(spark, frame, tmp_path):
    page = {"page_id": 1, "crawl_id": "c", "url": "https://x.example/p"}
    log = orphans.OrphanLog(spark, str(tmp_path))
    assert log.orphans().count() == 0
    none = frame("elements", [])
    log.append(orphans.deliveries(none, frame("page_nodes", [{**page, "arrived_at": JAN}]), frame("nav_edges", [])))
    log.append(orphans.deliveries(none, frame("page_nodes", [{**page, "arrived_at": FEB, "deleted_at": FEB}]), frame("nav_edges", [])))
    edge = {"edge_id": 1, "crawl_id": "c", "target": "https://x.example/p", "arrived_at": T(2025, 3, 1)}
    log.append(orphans.deliveries(none, frame("page_nodes", []), frame("nav_edges", [edge])))
    assert [tuple(r) for r in log.orphans().collect()] == [("nav_edges", "target", 1, "https://x.example/p", "2025-03", False)]


def test_report_counts_resolved(frame):
    rows = [el(1, "a", FEB), el(2, "b", JAN, controls=["a", "never"])]
    out = orphans.orphan_report(frame("elements", rows), frame("page_nodes", []), frame("nav_edges", []))
    assert [tuple(r) for r in out.collect()] == [("elements", "controls", "2025-01", 2, 1, 1)]
