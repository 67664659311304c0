"""Test scenarios and page records derived from labelled captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.operators.capture import current_pages
from prismgrid.operators.navigation import first_links, resolved_links

SMOKE_LABELS = ["primary_action", "navigation", "data_display", "filter", "form_input", "secondary_action"]


def page_controls(labels: DataFrame) -> DataFrame:
    """Distinct control names per page and meaning, ranked by their first place."""
    first = (
        labels.where("accessible_name <> ''")
        .groupBy("crawl_id", "url", "label", "accessible_name")
        .agg(F.min("element_id").alias("at"))
    )
    rank = F.row_number().over(W.partitionBy("crawl_id", "url", "label").orderBy("at"))
    return first.withColumn("rank", rank)


def scenarios(page_nodes: DataFrame, nav_edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Scenarios of each page: type, priority, whether automatable and number of steps.

    smoke: open, title if any, and up to 6 distinct names, 2 a meaning; navigation: up to
    3 labelled links to captured pages; form: up to 4 fields filled, never submitted;
    destructive_guard: every destructive name as a step that is never run.
    """
    pages = current_pages(page_nodes, "title").select("crawl_id", "url", F.nullif("title", F.lit("")).alias("title"))
    controls = page_controls(labels)
    shown = controls.where((F.col("rank") <= 2) & F.col("label").isin(SMOKE_LABELS))
    per_page = controls.groupBy("crawl_id", "url").agg(
        F.count_if(F.col("label").isin("form_input", "filter")).alias("fields"),
        F.count_if(F.col("label") == "destructive").alias("destructive"),
    )
    names = shown.groupBy("crawl_id", "url").agg(F.least(F.count_distinct("accessible_name"), F.lit(6)).alias("names"))
    links = (
        resolved_links(nav_edges)
        .where("label <> '' and source <> target")
        .join(pages.select("crawl_id", F.col("url").alias("target")), ["crawl_id", "target"], "left_semi")
        .groupBy("crawl_id", F.col("source").alias("url"))
        .agg(F.least(F.count_distinct("label"), F.lit(3)).cast("int").alias("links"))
    )
    facts = pages.join(per_page, ["crawl_id", "url"], "left").join(names, ["crawl_id", "url"], "left").join(links, ["crawl_id", "url"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")

    def row(kind, priority, automatable, steps, i=0):
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), F.lit(automatable).alias("automatable"),
            F.lit(i).alias("number") if isinstance(i, int) else i.alias("number"), steps.cast("int").alias("steps"),
        )

    smoke = F.array(row("smoke", "P1", True, F.lit(1) + F.col("title").isNotNull().cast("int") + n("names")))
    moves = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= n("links")), lambda i: row("navigation", "P2", True, F.lit(3), i - 1))
    form = F.when(n("fields") > 0, F.array(row("form", "P2", False, F.lit(2) + F.least(n("fields"), F.lit(4)))))
    guard = F.when(n("destructive") > 0, F.array(row("destructive_guard", "P1", False, F.lit(1) + n("destructive"))))
    empty = F.filter(smoke, lambda s: F.lit(False))
    all_rows = F.concat(smoke, moves, F.coalesce(form, empty), F.coalesce(guard, empty))
    return facts.select("crawl_id", "url", F.inline(all_rows))


def scenario_steps(page_nodes: DataFrame, nav_edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The steps of every scenario: crawl_id, url, kind, number, step, action, target, note.

    As many as :func:`scenarios` counts, in order from 0. Names shown in smoke tests go by
    meaning, then by their first place, each once; links by the first edge that has the label.
    """
    pages = current_pages(page_nodes, "title").select("crawl_id", "url", F.nullif("title", F.lit("")).alias("title"))
    page = ["crawl_id", "url"]
    controls = page_controls(labels)
    meaning = F.array_position(F.array(*map(F.lit, SMOKE_LABELS)), F.col("label"))
    place = lambda *by: F.row_number().over(W.partitionBy(*page).orderBy(*by))

    def steps(rows: DataFrame, kind: str, action: str, step, target: str = "name", note: str = "", number=None) -> DataFrame:
        number = F.lit(0) if number is None else number
        return rows.select(
            *page, F.lit(kind).alias("kind"), number.cast("int").alias("number"), step.cast("int").alias("step"),
            F.lit(action).alias("action"), F.col(target).alias("target"), F.lit(note).alias("note"),
        )

    shown = (
        controls.where((F.col("rank") <= 2) & (meaning > 0))
        .groupBy(*page, F.col("accessible_name").alias("name"))
        .agg(F.min(F.struct(meaning.alias("m"), "rank")).alias("o"))
        .withColumn("i", place("o"))
        .where("i <= 6")
        .join(pages, page)
    )
    fields = controls.where(F.col("label").isin("form_input", "filter")).withColumnRenamed("accessible_name", "name")
    fields = fields.withColumn("i", place(F.col("label") == "filter", "rank"))
    risky = controls.where("label = 'destructive'").withColumnRenamed("accessible_name", "name").withColumn("i", F.col("rank"))
    links = (
        first_links(nav_edges)
        .where("label <> '' and source <> target")
        .join(pages.select("crawl_id", F.col("url").alias("target")), ["crawl_id", "target"], "left_semi")
        .groupBy("crawl_id", F.col("source").alias("url"), F.col("label").alias("name"))
        .agg(F.min(F.struct("edge_id", "target")).alias("f"))
        .withColumns({"i": place("f.edge_id", "name"), "leads_to": F.col("f.target")})
        .where("i <= 3")
        .join(pages.select(*page), page, "left_semi")
    )
    titled = pages.where("title is not null")
    formed, guarded = fields.select(*page).distinct(), risky.select(*page).distinct()
    skip = "Do NOT auto-submit — needs test data & authorization."
    last = fields.where("i <= 4").groupBy(*page).agg(F.max("i").alias("i")).withColumn("name", F.lit("submit"))
    number = F.col("i") - 1
    parts = [
        steps(pages, "smoke", "navigate", F.lit(0), "url"),
        steps(titled, "smoke", "assert_title", F.lit(1), "title"),
        steps(shown, "smoke", "assert_visible", F.col("i") + F.col("title").isNotNull().cast("int")),
        steps(links, "navigation", "navigate", F.lit(0), "url", number=number),
        steps(links, "navigation", "click", F.lit(1), number=number),
        steps(links, "navigation", "assert_url", F.lit(2), "leads_to", number=number),
        steps(formed, "form", "navigate", F.lit(0), "url"),
        steps(fields.where("i <= 4"), "form", "fill", F.col("i")),
        steps(last, "form", "guard_skip", F.col("i") + 1, note=skip),
        steps(guarded, "destructive_guard", "navigate", F.lit(0), "url"),
        steps(risky, "destructive_guard", "guard_skip", F.col("i"), note="destructive — must never be automated"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page_records(page_nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """A sentence on what each page is for, by the meanings of its controls."""
    controls = page_controls(labels)
    facts = controls.groupBy("crawl_id", "url").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when((F.col("label") == "primary_action") & (F.col("rank") <= 4), F.struct("rank", "accessible_name")))), lambda s: s.accessible_name),
            ", ",
        ).alias("primary"),
        F.bool_or(F.col("label") == "data_display").alias("data"),
        F.bool_or(F.col("label").isin("filter", "form_input")).alias("inputs"),
        F.bool_or(F.col("label") == "destructive").alias("destructive"),
    )
    parts = F.array_compact(
        F.array(
            F.when(F.col("primary") != "", F.concat(F.lit("primary actions ("), F.col("primary"), F.lit(")"))),
            F.when(F.col("data"), F.lit("data tables")),
            F.when(F.col("inputs"), F.lit("input controls")),
            F.when(F.col("destructive"), F.lit("destructive actions")),
        )
    )
    base = F.concat(F.lit("The “"), F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")), F.lit("” page"))
    purpose = F.when(F.size(parts) > 0, F.concat(base, F.lit(" provides "), F.array_join(parts, "; "), F.lit("."))).otherwise(
        F.concat(base, F.lit(" is primarily navigational or informational."))
    )
    return current_pages(page_nodes, "title").join(facts, ["crawl_id", "url"], "left").select("crawl_id", "url", purpose.alias("purpose"))
