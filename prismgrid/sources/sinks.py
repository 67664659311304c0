"""Where results go: Parquet tables first, CSV and JSON lines for exchange, text for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.functions.identity import control_label, safety_label
from prismgrid.operators.capture import current_elements
from prismgrid.operators.navigation import link_destinations


def save(df: DataFrame, folder: str, by: list[str] | None = None) -> None:
    """Replace a Parquet table; partitioned by columns with few values if named."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(folder)


def options_cell(options):
    """Labels joined by ' | ', the selected ones between stars."""
    return F.array_join(F.transform(F.coalesce(options, F.array()), lambda o: F.when(o.selected, F.concat(F.lit("*"), o.label, F.lit("*"))).otherwise(o.label)), " | ")


def states_cell(states):
    """k=v pairs sorted by key, joined by '; '."""
    pairs = F.array_sort(F.map_entries(F.coalesce(states, F.create_map().cast("map<string, string>"))))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e.key, F.lit("="), e.value)), "; ")


def elements_csv(elements: DataFrame, folder: str) -> DataFrame:
    """One line per current element with a fixed header; returns what was written."""
    rows = current_elements(elements, "category", "tag", "role", "accessible_name", "text", "ui_type", "landmark", "visible", "enabled", "options", "states", "dom_path")
    out = rows.select("crawl_id", "url", "pos", "category", "tag", "role", control_label().alias("label"), "ui_type", "landmark", "visible", "enabled", options_cell(F.col("options")).alias("options"), states_cell(F.col("states")).alias("states"), "dom_path")
    out.write.mode("overwrite").option("header", True).csv(folder)
    return out


def controls_csv(elements: DataFrame, nav_edges: DataFrame, folder: str) -> DataFrame:
    """One line per link or button: label, safety and where it leads."""
    out = link_destinations(elements, nav_edges).withColumn("safety", safety_label(F.col("label")))
    out.write.mode("overwrite").option("header", True).csv(folder)
    return out


def documents_json(df: DataFrame, key: list[str], folder: str) -> None:
    """One JSON object a line per key, its rows nested in order of all columns.

    Keys must have few rows each (a page, a crawl), as an object holds all of them.
    """
    rest = [c for c in df.columns if c not in key]
    nested = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows"))
    nested.select(F.to_json(F.struct(*key, "rows")).alias("value")).write.mode("overwrite").text(folder)


#: Documents of a capture: name -> the key that one object is written for.
DOCUMENTS = {
    "crawl": ["crawl_id"], "relations": ["crawl_id", "url"], "analysis": ["crawl_id"], "probe": ["crawl_id", "url"],
    "semantics": ["crawl_id", "url"], "documentation": ["crawl_id", "url"], "qaplan": ["crawl_id", "url"],
    "diff": ["prev_crawl_id", "next_crawl_id"], "source_index": ["path"], "correlation": ["crawl_id"], "inventory": ["crawl_id"],
}


def write_documents(frames: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write the named documents of captures as JSON lines; gives the folder of each.

    Each is written even if its table is empty, so that a reader finds it.
    """
    if unknown := sorted(set(frames) - set(DOCUMENTS)):
        raise ValueError(f"unknown documents: {', '.join(unknown)}")
    written = {name: f"{folder.rstrip('/')}/{name}" for name in frames}
    for name, rows in frames.items():
        documents_json(rows, DOCUMENTS[name], written[name])
    return written


def urls_text(pages: DataFrame, folder: str) -> None:
    """Distinct URLs, one a line; an empty table gives an empty folder."""
    pages.where("url is not null").select(F.col("url").alias("value")).distinct().write.mode("overwrite").text(folder)


def find_captures(spark: SparkSession, root: str) -> DataFrame:
    """Run records at ``root/*/run.json`` and ``root/*/*/run.json``; broken ones have nulls."""
    schema = "run_id string, crawl_id string, started_at string, finished_at string, outcome string, broken string"
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    found = reader.option("pathGlobFilter", "run.json").option("recursiveFileLookup", True).json(root)
    with_path = found.withColumn("path", F.col("_metadata.file_path"))
    depth = F.size(F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/"))
    return with_path.where(depth.isin(2, 3)).withColumn("broken", F.col("broken").isNotNull())
