"""Current rows of the capture tables: one per id, as last delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.functions.urls import page_key


def current(rows: DataFrame, id_col: str, columns: list[str], ties: list[str]) -> DataFrame:
    """One row per id with the columns of the last delivery, ties by the given text columns."""
    order = F.struct("arrived_at", *[F.coalesce(F.col(c), F.lit("")) for c in ties])
    return (
        rows.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max_by(F.struct(*columns), order).alias("c"))
        .select(id_col, "c.*")
    )


def current_elements(elements: DataFrame, *columns: str) -> DataFrame:
    """element_id, crawl_id, url (as page key), pos and the columns asked for."""
    names = list(dict.fromkeys(["crawl_id", "url", "pos", *columns]))
    rows = current(elements.withColumn("url", page_key(F.col("url"))), "element_id", names, ["accessible_name", "text"])
    return rows.where("crawl_id is not null and url is not null")


def current_pages(page_nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per crawl and page key: the least depth, then the least page_id."""
    names = list(dict.fromkeys(["crawl_id", "url", "depth", *columns]))
    rows = current(page_nodes.withColumn("url", page_key(F.col("url"))), "page_id", names, ["title", "url"])
    rest = [n for n in names if n not in ("crawl_id", "url")]
    return (
        rows.where("crawl_id is not null and url is not null")
        .groupBy("crawl_id", "url")
        .agg(F.min_by(F.struct(*rest), F.struct(F.coalesce("depth", F.lit(1 << 30)), "page_id")).alias("c"))
        .select("crawl_id", "url", "c.*")
    )


def current_edges(nav_edges: DataFrame) -> DataFrame:
    """Navigation with both ends: source and target as page keys, defaults filled in."""
    rows = current(nav_edges, "edge_id", ["crawl_id", "source", "target", "label", "region", "control"], ["target", "label"])
    blank = F.lit("")
    return (
        rows.where("crawl_id is not null and source <> '' and target <> ''")
        .select(
            "edge_id",
            "crawl_id",
            page_key(F.col("source")).alias("source"),
            page_key(F.col("target")).alias("target"),
            F.coalesce("label", blank).alias("label"),
            F.nullif("region", blank).alias("region"),
            F.coalesce(F.nullif("control", blank), F.lit("link")).alias("control"),
        )
    )


def merge_frames(page_elements: DataFrame, frame_elements: DataFrame, frames: DataFrame) -> DataFrame:
    """Elements of a page and of its frames of the same origin, with the frame's key.

    ``frames`` is (url, frame, frame_url); elements of other origins stay outside and are
    only known by their frame. Both element tables have url and the same columns, the
    frames' elements also ``frame``.
    """
    from prismgrid.operators.navigation import same_origin

    entered = frames.where(same_origin(F.col("url"), F.col("frame_url"))).select("url", "frame")
    inside = frame_elements.join(entered, ["url", "frame"], "left_semi")
    return page_elements.withColumn("frame", F.lit(None).cast("string")).unionByName(inside)
