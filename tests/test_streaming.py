import json
import os

from pyspark.sql import functions as F

from prismgrid.operators.orphans import OrphanLog, deliveries
from prismgrid.streaming import events, orphans, settle


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def write(folder, n, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows))
    os.utime(folder / f"{n}.json", (1e9 + n, 1e9 + n))  # the stream reads files by their age


def test_log_drops_cut_lines_and_repeats(spark, tmp_path):
    rows = [{"event_id": i, "ts": f"2025-01-0{1 + i % 3}T00:00:00Z", "user_id": 1, "event_type": "a", "value": 1.0} for i in range(6)]
    write(tmp_path / "log", 1, [*rows, rows[0], '{"event_id": 9, "ts'])
    stream = events.read_log(spark, str(tmp_path / "log"))
    assert drained(spark, events.distinct_events(stream), "once").count() == 6
    assert events.read_log_batch(spark, str(tmp_path / "log")).count() == 7
    assert drained(spark, events.stage_windows(stream), "windows", "complete").agg(F.sum("events")).first()[0] == 7


def test_replay_is_exactly_once(spark, tmp_path):
    rows = [{"event_id": i, "ts": "2025-01-01T00:00:00Z", "user_id": 1, "event_type": "a", "value": 1.0} for i in range(4)]
    write(tmp_path / "log", 1, rows)
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    for _ in range(2):
        events.run_to_end(events.read_log(spark, str(tmp_path / "log")), target, state)
    write(tmp_path / "log", 2, [{**rows[0], "event_id": 10}])
    events.run_to_end(events.read_log(spark, str(tmp_path / "log")), target, state)
    assert sorted(r.event_id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 10]


def test_settled_pages(spark, tmp_path):
    polls = [("p", i, s, False) for i, s in enumerate("abbbc")] + [("q", i, "x", True) for i in range(7)] + [("r", 0, "a", False)]
    for batch, part in enumerate((polls[:2] + polls[5:8], polls[2:5] + polls[8:])):
        write(tmp_path / "polls", batch, [dict(zip(("page", "poll", "state", "live"), r, strict=True)) for r in part])
    stream = spark.readStream.schema("page string, poll bigint, state string, live boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "polls"))
    got = drained(spark, settle.settled_pages(stream), "settled").collect()
    assert {tuple(r) for r in got} == {("p", 2, "b", 2), ("q", 5, "x", 6)}


def test_orphans_of_a_stream_follow_arrivals_and_deletions(spark, tmp_path):
    from prismgrid.schemas import TABLES

    page = {"page_id": 1, "crawl_id": "c", "url": "https://x.example/p"}
    steps = [
        ("nav_edges", {"edge_id": 1, "crawl_id": "c", "target": "https://x.example/p/", "arrived_at": "2025-02-01T00:00:00"}),
        ("page_nodes", {**page, "arrived_at": "2025-01-05T00:00:00"}),
        ("page_nodes", {**page, "arrived_at": "2025-01-07T00:00:00", "deleted_at": "2025-01-08T00:00:00"}),
    ]
    names = ("elements", "page_nodes", "nav_edges")
    for name in names:
        (tmp_path / name).mkdir()
    log, found = OrphanLog(spark, str(tmp_path / "log")), []
    for n, (name, row) in enumerate(steps):
        write(tmp_path / name, n, [row])
        a, b, c = deliveries(*[spark.readStream.schema(TABLES[t]).json(str(tmp_path / t)) for t in names])
        query = orphans.maintain(a.unionByName(b).unionByName(c), log).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
        found.append(log.orphans().count())
    assert found == [1, 0, 1]
