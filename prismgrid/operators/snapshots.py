"""What changed between consecutive full snapshots.

Each snapshot is unpivoted into cells (key, field, value) plus one marker cell per key.
A cell counts +1 in the comparison where its snapshot is the new one and -1 where it is
the old one; cells whose sum is not zero classify their key. All cells of one key of one
comparison meet in one partition, so there is one exchange for both sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions.urls import SPACE, dom_key, frame_key, page_key

KEY = ["record_type", "url", "frame", "dom_path"]


def latest(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per id: the last delivery's values and ``first_at``, the first arrival.

    Deliveries arriving at the same instant are ordered by their values, so the
    choice never depends on the order of rows. Rows without an id are left out.
    """
    cells = F.struct(*[F.col(c) for c in columns])
    return (
        rows.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min("arrived_at").alias("first_at"), F.max(F.struct("arrived_at", cells.alias("c"))).alias("m"))
        .select(id_col, "first_at", "m.c.*")
    )


def comparisons(crawls: DataFrame) -> DataFrame:
    """(crawl_id, chain, prev, next): the finished crawls that take part in comparisons.

    A chain is the finished crawls of one site and config file by started_at, ties by
    finished_at and crawl_id; nulls of site and config file are equal. Crawls without a
    start or an end are passed over. ``prev`` and ``next`` are the crawls before and after
    it in its chain, of which ``chain`` is a hash.
    """
    done = (
        latest(crawls, "crawl_id", ["site", "config_file", "started_at", "finished_at"])
        .where("finished_at is not null and started_at is not null")
        .drop("first_at")
    )
    return _neighbours(done).where("prev is not null or next is not null")


def _sides():
    """(pair, side) of a crawl: +1 as the new snapshot, -1 as the old one."""

    def one(old, new, side):
        pair = F.struct(F.col(old).alias("prev_crawl_id"), F.col(new).alias("crawl_id"))
        return F.struct(pair.alias("pair"), F.lit(side).alias("side"))

    return F.array_compact(
        F.array(
            F.when(F.col("prev").isNotNull(), one("prev", "crawl_id", 1)),
            F.when(F.col("next").isNotNull(), one("crawl_id", "next", -1)),
        )
    )


def _neighbours(done: DataFrame) -> DataFrame:
    """crawl_id with the chain's crawl before and after it (``prev``, ``next``).

    Chains are cut by month of start, so that a chain of very many crawls is no single
    task's; the ends of the months are linked over one row per chain and month.
    """
    order = ["started_at", "finished_at", "crawl_id"]
    rows = done.select(
        F.struct("site", "config_file").alias("chain"), F.date_trunc("month", "started_at").alias("month"), *order
    )
    inside = W.partitionBy("chain", "month").orderBy(*order)
    ends = (
        rows.groupBy("chain", "month")
        .agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
        .select(
            "chain",
            "month",
            F.lag("hi.crawl_id").over(W.partitionBy("chain").orderBy("month")).alias("before"),
            F.lead("lo.crawl_id").over(W.partitionBy("chain").orderBy("month")).alias("after"),
        )
    )
    near = rows.select(
        "chain", "month", "crawl_id", F.lag("crawl_id").over(inside).alias("p"), F.lead("crawl_id").over(inside).alias("n")
    )
    same = F.col("r.chain").eqNullSafe(F.col("e.chain")) & (F.col("r.month") == F.col("e.month"))
    return near.alias("r").join(ends.alias("e"), same).select(
        "crawl_id",
        F.xxhash64("r.chain").alias("chain"),
        F.coalesce("p", "before").alias("prev"),
        F.coalesce("n", "after").alias("next"),
    )


def name_value(name):
    """A name without letter case, outer white space and length of inner white space."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), SPACE, " ")))


def snapshot_records(page_nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Keyed records of all snapshots: KEY columns, crawl_id and the compared name."""
    pages = latest(
        page_nodes.select("page_id", "arrived_at", "crawl_id", page_key(F.col("url")).alias("url")),
        "page_id",
        ["crawl_id", "url"],
    ).select(
        "crawl_id",
        F.lit("page").alias("record_type"),
        "url",
        F.lit("").alias("frame"),
        F.lit("").alias("dom_path"),
        F.lit(None).cast("string").alias("name"),
    )
    items = latest(
        elements.select(
            "element_id",
            "arrived_at",
            "crawl_id",
            page_key(F.col("url")).alias("url"),
            frame_key(F.col("frame")).alias("frame"),
            dom_key(F.col("dom_path")).alias("dom_path"),
            name_value(F.col("accessible_name")).alias("name"),
        ),
        "element_id",
        ["crawl_id", "url", "frame", "dom_path", "name"],
    ).select("crawl_id", F.lit("element").alias("record_type"), "url", "frame", "dom_path", "name")
    return pages.unionByName(items)


def snapshot_changes(crawls: DataFrame, page_nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Changes of each finished crawl against the chain's previous finished one.

    Columns: prev_crawl_id, crawl_id, record_type, url, frame, dom_path, change_kind and
    changed_fields (null unless changed). Several records of one key within a snapshot
    are compared as the set of their names; null urls and paths form keys of their own,
    put out as ''. Rows of crawls that are in no comparison give nothing; empty tables
    give no rows.
    """
    rows = (
        snapshot_records(page_nodes, elements)
        .join(comparisons(crawls), "crawl_id")
        .select("chain", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in KEY], "name", "crawl_id", "prev", "next")
    )
    # Each record is placed once, by chain and key, and takes its signs there. The groups
    # below hold chain and key too, so neither sum exchanges again.
    signed = rows.repartition(F.col("chain"), *[F.col(c) for c in KEY]).select(
        "chain", *KEY, "name", F.inline(_sides())
    )
    marker = F.struct(F.lit("").alias("field"), F.lit("").alias("value"))
    field = F.struct(F.lit("accessible_name").alias("field"), F.col("name").alias("value"))
    cells = signed.select(
        "chain", "pair", *KEY, "side", F.inline(F.array_compact(F.array(marker, F.when(F.col("name").isNotNull(), field))))
    )
    nonzero = (
        cells.groupBy("chain", "pair", *KEY, "field", "value")
        .agg((F.max(F.greatest("side", F.lit(0))) + F.min(F.least("side", F.lit(0)))).alias("sum"))
        .where("sum <> 0")
    )
    of_key = nonzero.groupBy("chain", "pair", *KEY).agg(
        F.sum(F.when(F.col("field") == "", F.col("sum"))).alias("presence"),
        F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("fields"),
    )
    kind = (
        F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    )
    return of_key.select(
        "pair.prev_crawl_id",
        "pair.crawl_id",
        *KEY,
        kind.alias("change_kind"),
        F.when(F.col("presence").isNull(), F.array_join("fields", ",")).alias("changed_fields"),
    )
