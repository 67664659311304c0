"""Element and component changes between two analysed captures, with renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions.identity import structural_signature
from prismgrid.functions.text import strip

SCOPE = ["prev_crawl_id", "next_crawl_id", "url"]


def crawl_pairs(comparisons: DataFrame) -> DataFrame:
    """(prev_crawl_id, next_crawl_id) of consecutive captures of a chain."""
    return comparisons.where("prev is not null").select(F.col("prev").alias("prev_crawl_id"), F.col("crawl_id").alias("next_crawl_id"))


def _sides(prints: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = ["url", "pos", "element_id", "fingerprint", "category", "role", "landmark", "accessible_name", "dom_path"]
    old = pairs.join(prints.select(F.col("crawl_id").alias("prev_crawl_id"), *keep), "prev_crawl_id")
    new = pairs.join(prints.select(F.col("crawl_id").alias("next_crawl_id"), *keep), "next_crawl_id")
    return old, new


def diff_pages(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pages added and removed between the two captures of each pair."""
    old = pairs.join(pages.select(F.col("crawl_id").alias("prev_crawl_id"), "url"), "prev_crawl_id").withColumn("side", F.lit(-1))
    new = pairs.join(pages.select(F.col("crawl_id").alias("next_crawl_id"), "url"), "next_crawl_id").withColumn("side", F.lit(1))
    both = old.unionByName(new).groupBy(*SCOPE).agg(F.max("side").alias("hi"), F.min("side").alias("lo"))
    return both.where("hi = lo").select(*SCOPE, F.when(F.col("hi") > 0, "added").otherwise("removed").alias("change_kind"))


def diff_elements(prints: DataFrame, pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Added, removed and renamed elements of pages that both captures hold.

    First the i-th elements of equal fingerprint are paired by position; what is left
    over is paired where category, role, landmark and structure occur exactly once on
    each side; the rest is added or removed. The elements of a page are placed together
    once; pairing, leftovers and their counts all use that placement.
    """
    kept = pairs.join(pages.select(F.col("crawl_id").alias("prev_crawl_id"), "url"), "prev_crawl_id").join(
        pages.select(F.col("crawl_id").alias("next_crawl_id"), "url"), ["next_crawl_id", "url"]
    )
    old, new = _sides(prints, pairs)
    both = (
        old.withColumn("side", F.lit(-1))
        .unionByName(new.withColumn("side", F.lit(1)))
        .repartition(*SCOPE)
        .join(kept.select(*SCOPE).distinct(), SCOPE, "left_semi")
        .withColumn("name", F.lower(strip(F.coalesce("accessible_name", F.lit("")))))
    )
    turn = F.row_number().over(W.partitionBy(*SCOPE, "fingerprint", "side").orderBy("pos", "element_id"))
    facts = F.struct("element_id", "category", "role", "landmark", "accessible_name", "dom_path", "name")
    paired = (
        both.withColumn("turn", turn)
        .groupBy(*SCOPE, "fingerprint", "turn")
        .agg(F.max(F.when(F.col("side") < 0, facts)).alias("o"), F.max(F.when(F.col("side") > 0, facts)).alias("n"))
    )
    blank = F.lit("")
    e = F.coalesce("n", "o")
    key = F.concat_ws("|", e.category, F.coalesce(e.role, blank), F.coalesce(e.landmark, blank), structural_signature(e.dom_path))
    left = F.col("o").isNull() | F.col("n").isNull()
    # Paired elements have a group of their own beside the leftovers of their page and structure.
    same = W.partitionBy(*SCOPE, "key")
    judged = (
        paired.withColumn("key", F.when(left, key))
        .withColumn("alone", left & (F.count("o").over(same) == 1) & (F.count("n").over(same) == 1))
        .withColumn("former", F.when(~left, F.col("o")).when(F.col("alone"), F.max(F.when(left, F.col("o"))).over(same)))
    )
    moved = F.col("n").isNotNull() & F.col("former").isNotNull() & (F.col("n.name") != F.col("former.name"))
    return judged.where(moved | (left & ~F.col("alone"))).select(
        *SCOPE,
        F.when(moved, "renamed").when(F.col("n").isNull(), "removed").otherwise("added").alias("change_kind"),
        F.when(moved, F.when(left, "structural").otherwise("fingerprint")).alias("matched_by"),
        e.element_id.alias("element_id"),
        e.accessible_name.alias("accessible_name"),
        F.when(moved, F.col("former.accessible_name")).alias("previous_name"),
    )


def diff_components(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """Component signatures that only one capture of a pair holds."""
    sigs = components.select("crawl_id", "signature").distinct()
    old = pairs.join(sigs.withColumnRenamed("crawl_id", "prev_crawl_id"), "prev_crawl_id").withColumn("side", F.lit(-1))
    new = pairs.join(sigs.withColumnRenamed("crawl_id", "next_crawl_id"), "next_crawl_id").withColumn("side", F.lit(1))
    both = old.unionByName(new).groupBy("prev_crawl_id", "next_crawl_id", "signature").agg(F.sum("side").alias("side"))
    return both.where("side <> 0").select(
        "prev_crawl_id", "next_crawl_id", "signature", F.when(F.col("side") > 0, "added").otherwise("removed").alias("change_kind")
    )


def diff_stats(page_changes: DataFrame, element_changes: DataFrame) -> DataFrame:
    """Number of changes of each kind per pair of captures."""
    rows = page_changes.select("prev_crawl_id", "next_crawl_id", F.concat(F.lit("pages_"), "change_kind").alias("counter")).unionByName(
        element_changes.select("prev_crawl_id", "next_crawl_id", F.concat(F.lit("elements_"), "change_kind").alias("counter"))
    )
    return rows.groupBy("prev_crawl_id", "next_crawl_id", "counter").agg(F.count("*").alias("n"))
