"""References to records that do not exist, as keyed state that deliveries advance.

The state has three parts. *Records* hold the last version of every id. *Balances* hold
per target key and month +1 for a record that first arrives and -1 when it is deleted,
with the number of references that probe the key at the end of that month. *References*
hold every reference under its target key. The running balance of a key decides: above
zero its references resolve, at zero they wait, an arrival resolves them and a deletion
reopens them.

A delivery is turned into signed rows by :func:`advance`: what the former version of an
id had put into the balances and references is taken back, what its new version says is
put in. So repeated deliveries, corrections and late rows count once, whatever the cut
of the deliveries. A full run is the first delivery to an empty state; :class:`OrphanLog`
keeps the state in a folder and works on the keys that a delivery touches only.

Keys are shuffled as two 64-bit hashes and are summed per key and month before the
exchange, so that a key that everybody refers to costs one row per map task and month.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismgrid.functions.urls import dom_key, frame_key, key128, page_key

KEY = ["h1", "h2", "month"]
REF = ["ref_table", "ref_field", "ref_id", "missing_target"]
_REFS = "array<struct<ref_field: string, missing_target: string, h1: bigint, h2: bigint>>"
#: Columns of one version of a record: its own key as a target, and its references.
VERSION = ["deleted_at", "h1", "h2", "refs"]


def _month(ts: Column) -> Column:
    """Months since year 0; the end of month m is the start of month m + 1."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def _period(month: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))


def element_deliveries(elements: DataFrame) -> DataFrame:
    """Delivered element rows as (record_table, id, arrived_at, VERSION)."""
    crawl, url, frame = F.col("crawl_id"), page_key(F.col("url")), frame_key(F.col("frame"))
    keyed = elements.where("element_id is not null").select(
        "element_id",
        "arrived_at",
        "deleted_at",
        crawl.alias("crawl"),
        url.alias("url"),
        frame.alias("frame"),
        dom_key(F.col("dom_path")).alias("dom"),
        F.filter(F.transform("controls", dom_key), lambda c: c != "").alias("controls"),
        F.nullif(dom_key(F.col("owner_form")), F.lit("")).alias("owner_form"),
    )

    def named(field: str, target: Column) -> Column:
        h1, h2 = key128("element", F.col("crawl"), F.col("url"), F.col("frame"), target)
        return F.struct(F.lit(field).alias("ref_field"), target.alias("missing_target"), h1.alias("h1"), h2.alias("h2"))

    none = F.array().cast(_REFS)
    refs = F.concat(
        F.coalesce(F.transform(F.array_distinct("controls"), lambda c: named("controls", c)), none),
        F.when(F.col("owner_form").isNotNull(), F.array(named("owner_form", F.col("owner_form")))).otherwise(none),
    )
    h1, h2 = key128("element", *[F.col(c) for c in ("crawl", "url", "frame", "dom")])
    return keyed.select(
        F.lit("elements").alias("record_table"),
        F.col("element_id").alias("id"),
        "arrived_at",
        "deleted_at",
        h1.alias("h1"),
        h2.alias("h2"),
        refs.cast(_REFS).alias("refs"),
    )


def page_deliveries(page_nodes: DataFrame) -> DataFrame:
    """Delivered page rows: targets that refer to nothing."""
    h1, h2 = key128("page", F.col("crawl_id"), page_key(F.col("url")))
    return page_nodes.where("page_id is not null").select(
        F.lit("page_nodes").alias("record_table"),
        F.col("page_id").alias("id"),
        "arrived_at",
        "deleted_at",
        h1.alias("h1"),
        h2.alias("h2"),
        F.array().cast(_REFS).alias("refs"),
    )


def edge_deliveries(nav_edges: DataFrame) -> DataFrame:
    """Delivered edge rows: references to pages that nothing refers to."""
    target = F.when(F.regexp_replace("target", r"[\s\p{Z}]+", "") != "", page_key(F.col("target")))
    h1, h2 = key128("page", F.col("crawl_id"), F.col("to"))
    ref = F.struct(F.lit("target").alias("ref_field"), F.col("to").alias("missing_target"), h1.alias("h1"), h2.alias("h2"))
    return (
        nav_edges.where("edge_id is not null")
        .select("edge_id", "arrived_at", "crawl_id", target.alias("to"))
        .select(
            F.lit("nav_edges").alias("record_table"),
            F.col("edge_id").alias("id"),
            "arrived_at",
            F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
            F.lit(None).cast("bigint").alias("h1"),
            F.lit(None).cast("bigint").alias("h2"),
            F.when(F.col("to").isNotNull(), F.array(ref)).otherwise(F.array()).cast(_REFS).alias("refs"),
        )
    )


def deliveries(elements: DataFrame, page_nodes: DataFrame, nav_edges: DataFrame) -> list[DataFrame]:
    """The deliveries of the three tables, in one shape. Also for streams."""
    return [element_deliveries(elements), page_deliveries(page_nodes), edge_deliveries(nav_edges)]


def versions(rows: DataFrame) -> DataFrame:
    """One row per id: first arrival, the last delivery's arrival and values.

    Deliveries arriving at the same instant are ordered by their values, so the choice
    never depends on the order of rows.
    """
    first = F.col("first_at") if "first_at" in rows.columns else F.col("arrived_at")
    return (
        rows.groupBy("record_table", "id")
        .agg(F.min(first).alias("first_at"), F.max(F.struct("arrived_at", *VERSION)).alias("m"))
        .select("record_table", "id", "first_at", "m.*")
    )


def effects(rows: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """What versions put into the balances and the references, with a sign.

    A version without any arrival has no month and puts in nothing; a deletion never
    precedes the arrival.
    """
    rows = rows.where("first_at is not null")
    born, gone = _month(F.col("first_at")), _month(F.greatest("first_at", "deleted_at"))
    events = F.array_compact(
        F.array(
            F.struct(born.alias("month"), F.lit(sign).alias("d")),
            F.when(F.col("deleted_at").isNotNull(), F.struct(gone.alias("month"), F.lit(-sign).alias("d"))),
        )
    )
    parents = rows.where("h1 is not null").select("h1", "h2", F.inline(events))
    refs = rows.where("size(refs) > 0").select(
        F.col("record_table").alias("ref_table"), F.col("id").alias("ref_id"), born.alias("month"), F.inline("refs")
    )
    refs = refs.select(*REF, *KEY, F.lit(sign).alias("n"))
    return parents, refs


class Change(NamedTuple):
    """What a delivery changes: new versions, and signed rows of balances and references."""

    records: DataFrame
    balances: DataFrame
    references: DataFrame


def summed(events: DataFrame) -> DataFrame:
    """Signed rows of balances added up per key and month."""
    return events.groupBy(*KEY).agg(F.sum("balance").alias("balance"), F.sum("probes").alias("probes"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def advance(delivered: list[DataFrame], former: DataFrame | None = None, prepared=lambda df: df) -> Change:
    """The change that deliveries bring to a state.

    ``former`` are the records of the state; without it the state is empty. ``prepared``
    is applied to the new versions, which are used twice, and may write them down.
    """
    if former is None:
        # The tables have ids of their own, so each is reduced where it lies.
        kept = [versions(rows) for rows in delivered]
        parents, refs = map(list, zip(*[effects(k, 1) for k in kept], strict=True))
        records = _union(kept)
    else:
        batch = versions(_union(delivered))
        id_of = ["record_table", "id"]
        old = former.join(batch.select(id_of), id_of, "left_semi")
        records = prepared(versions(old.unionByName(batch)))
        old = versions(former.join(records.select(id_of), id_of, "left_semi"))
        parents, refs = map(list, zip(effects(old, -1), effects(records, 1), strict=True))
    references = _union(refs)
    events = _union(
        [p.select(*KEY, F.col("d").alias("balance"), F.lit(0).alias("probes")) for p in parents]
        + [references.select(*KEY, F.lit(0).alias("balance"), F.col("n").alias("probes"))]
    )
    return Change(records, summed(events), references)


def waiting(balances: DataFrame) -> DataFrame:
    """Keys and months whose probes found no living record at the end of the month.

    ``resolved`` tells whether a living record is there at the end of all deliveries.
    """
    key = W.partitionBy("h1", "h2")
    return (
        balances.withColumn("alive", F.sum("balance").over(key.orderBy("month")))
        .withColumn("alive_last", F.sum("balance").over(key))
        .where("probes > 0 and alive <= 0")
        .select(*KEY, (F.col("alive_last") > 0).alias("resolved"))
    )


def open_references(balances: DataFrame, references: DataFrame) -> DataFrame:
    """References that wait: REF, period and whether a later arrival resolved them."""
    return references.join(waiting(balances), KEY).select(*REF, _period(F.col("month")).alias("period"), "resolved")


def find_orphans(elements: DataFrame, page_nodes: DataFrame, nav_edges: DataFrame) -> DataFrame:
    """Orphan references: (ref_table, ref_field, ref_id, missing_target, period).

    The state after one delivery of all rows. Nulls: null or blank references are none; a
    null crawl or url only equals another null; a null frame is the page itself. Repeated
    deliveries count once, with the values of the last. Empty tables give no rows, or
    every reference where only the targets' table is empty. Further columns are ignored.
    """
    state = advance(deliveries(elements, page_nodes, nav_edges))
    return open_references(state.balances, state.references).drop("resolved")


def orphan_report(elements: DataFrame, page_nodes: DataFrame, nav_edges: DataFrame) -> DataFrame:
    """Periodic snapshot of the state, per table, field and month.

    ``new_orphans`` are references of the month that found no record by its end;
    ``resolved`` counts those of them that a later arrival resolves, and ``open_at_end``
    those that wait still (a record deleted again reopens them).
    """
    state = advance(deliveries(elements, page_nodes, nav_edges))
    return counted(open_references(state.balances, state.references))


def counted(orphans: DataFrame) -> DataFrame:
    """Counts per table, field and period of open references."""
    return orphans.groupBy("ref_table", "ref_field", "period").agg(
        F.count("*").alias("new_orphans"),
        F.count_if("resolved").alias("resolved"),
        F.count_if(~F.col("resolved")).alias("open_at_end"),
    )


class OrphanLog:
    """The state in a folder that all executors share, as a log of turns.

    Each delivery appends its new versions and signed rows of balances, references and
    orphans; nothing is rewritten. A turn counts once its orphans are written, so a turn
    that was broken off is simply written again. Keys that a delivery does not touch are
    filtered out of the log before any exchange. :meth:`compact` adds the log up.
    Deliveries have even turns, compactions odd ones.
    """

    SCHEMA = {
        "records": f"record_table string, id bigint, first_at timestamp_ntz, arrived_at timestamp_ntz, deleted_at timestamp_ntz, h1 bigint, h2 bigint, refs {_REFS}",
        "balances": "h1 bigint, h2 bigint, month int, balance bigint, probes bigint",
        "references": "ref_table string, ref_field string, ref_id bigint, missing_target string, h1 bigint, h2 bigint, month int, n int",
        "orphans": "ref_table string, ref_field string, ref_id bigint, missing_target string, period string, resolved boolean, n bigint",
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def turns(self) -> list[int]:
        """Complete turns that are read: the last compaction and what came after it."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        place = hadoop.Path(f"{self.folder}/orphans")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        paths = [s.getPath() for s in fs.listStatus(place)]
        done = sorted(int(p.getName().split("=")[1]) for p in paths if fs.exists(hadoop.Path(p, "_SUCCESS")))
        base = max((t for t in done if t % 2), default=0)
        return [t for t in done if t >= base]

    def _read(self, part: str, turns: list[int]) -> DataFrame | None:
        if not turns:
            return None
        return self.spark.read.schema(self.SCHEMA[part]).parquet(*[f"{self.folder}/{part}/turn={t}" for t in turns])

    def _write(self, part: str, turn: int, rows: DataFrame) -> DataFrame:
        rows.select(StructType.fromDDL(self.SCHEMA[part]).names).write.mode("overwrite").parquet(f"{self.folder}/{part}/turn={turn}")
        return self._read(part, [turn])

    def append(self, delivered: list[DataFrame], number: int | None = None) -> None:
        """Bring deliveries to the state; a ``number`` that is in it is not repeated."""
        turns = self.turns()
        last = max(turns, default=-2)
        turn = last + 2 - last % 2 if number is None else 2 * number
        if turn <= last:
            return
        former, balances, references = (self._read(p, turns) for p in ("records", "balances", "references"))
        change = advance(delivered, former, lambda df: self._write("records", turn, df))
        if former is None:
            self._write("records", turn, change.records)
        new_balances = self._write("balances", turn, change.balances)
        new_references = self._write("references", turn, change.references)
        if former is None:
            signed = open_references(new_balances, new_references).withColumn("n", F.lit(1))
        else:
            # What the touched keys had open is taken back, what they have open now is put in.
            keys = new_balances.select("h1", "h2").distinct()
            old_b, old_r = (df.join(keys, ["h1", "h2"], "left_semi") for df in (balances, references))
            before = open_references(summed(old_b), _held(old_r)).withColumn("n", F.lit(-1))
            now = open_references(summed(old_b.unionByName(new_balances)), _held(old_r.unionByName(new_references)))
            signed = before.unionByName(now.withColumn("n", F.lit(1)))
        self._write("orphans", turn, _net(signed))

    def orphans(self) -> DataFrame:
        """Open references now: what :func:`find_orphans` gives for all deliveries, with ``resolved``."""
        found = self._read("orphans", self.turns())
        if found is None:
            return self.spark.createDataFrame([], self.SCHEMA["orphans"]).drop("n")
        return _net(found).where("n > 0").drop("n")

    def counts(self) -> DataFrame:
        """Snapshot of the counts per table, field and period."""
        return counted(self.orphans())

    def compact(self) -> None:
        """Add up all turns into one; the folders of older turns are no longer read."""
        turns = self.turns()
        if len(turns) < 2:
            return
        records, balances, references, orphans = (self._read(p, turns) for p in self.SCHEMA)
        turn = max(turns) + 1 + max(turns) % 2
        self._write("records", turn, versions(records))
        self._write("balances", turn, summed(balances).where("balance <> 0 or probes <> 0"))
        self._write("references", turn, _held(references).withColumn("n", F.lit(1)))
        self._write("orphans", turn, _net(orphans))


def _held(references: DataFrame) -> DataFrame:
    return references.groupBy(*REF, *KEY).agg(F.sum("n").alias("n")).where("n > 0").drop("n")


def _net(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*REF, "period", "resolved").agg(F.sum("n").alias("n")).where("n <> 0")
