"""Links between elements, forms and their fields, tables and their row actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions.identity import control_label
from prismgrid.functions.text import filled
from prismgrid.session import settled
from prismgrid.operators.capture import current_elements
from prismgrid.operators.components import reading_order

PAGE = ["crawl_id", "url"]
LINKED = ["category", "accessible_name", "text", "ui_type", "dom_path", "parent_path", "controls", "owner_form"]


def _by_path(rows: DataFrame) -> DataFrame:
    """One element per page and path: the last by position, as for a lookup filled in order."""
    at = F.struct("pos", "element_id")
    return (
        rows.where("dom_path <> ''")
        .groupBy(*PAGE, "dom_path")
        .agg(F.max_by(F.struct("element_id", "label"), at).alias("t"))
        .select(*PAGE, F.col("dom_path").alias("target"), F.col("t.element_id").alias("target_id"), F.col("t.label").alias("target_label"))
    )


def element_links(elements: DataFrame) -> DataFrame:
    """contains, controls and groups links whose both ends are captured on the page.

    An element is never linked to itself by controls. The paths are compared as delivered.
    """
    rows = current_elements(elements, *LINKED).withColumn("label", control_label())
    ends = F.concat(
        F.array(
            F.struct(F.lit("contains").alias("kind"), F.nullif("parent_path", F.lit("")).alias("target")),
            F.struct(F.lit("groups").alias("kind"), F.nullif("owner_form", F.lit("")).alias("target")),
        ),
        F.transform(F.coalesce("controls", F.array().cast("array<string>")), lambda c: F.struct(F.lit("controls").alias("kind"), c.alias("target"))),
    )
    out = rows.select(*PAGE, "element_id", "dom_path", "label", F.inline(ends)).where("target <> ''")
    found = out.join(_by_path(rows), [*PAGE, "target"]).where("not (kind = 'controls' and target_id = element_id)")
    outward = F.col("kind") == "controls"
    return found.select(
        *PAGE,
        "kind",
        F.when(outward, F.col("dom_path")).otherwise(F.col("target")).alias("source"),
        F.when(outward, F.col("target")).otherwise(F.col("dom_path")).alias("target"),
        F.when(outward, F.col("label")).otherwise(F.col("target_label")).alias("source_label"),
        F.when(outward, F.col("target_label")).otherwise(F.col("label")).alias("target_label"),
    )


def form_fields(elements: DataFrame) -> DataFrame:
    """Fields of each page's forms in reading order, radios of one group as one field.

    Fields whose form is not captured are in the form '(ungrouped inputs)'. Options are
    joined by ' | '; the default is the value, 'checked' or 'unchecked', the selected
    options, or for a radio group its first member.
    """
    rows = current_elements(
        elements, *LINKED, "attributes", "states", "options", "option_count", "value", "group_name", "enabled", "bounding_box"
    ).withColumn("label", control_label())
    placed = reading_order(rows)
    forms = _by_path(rows).select(*PAGE, F.col("target").alias("owner_form"), F.lit(True).alias("known"))
    kind = F.coalesce(F.nullif("ui_type", F.lit("")), F.col("category"))
    labels = F.transform(F.filter(F.coalesce("options", F.array()), lambda o: o.label != ""), lambda o: o.label)
    chosen = F.transform(F.filter(F.coalesce("options", F.array()), lambda o: o.selected), lambda o: o.label)
    ticked = F.when(F.try_element_at("states", F.lit("checked")) == "true", "checked").otherwise("unchecked")
    default = F.when(F.col("ui_type").isin("checkbox", "radio"), ticked).otherwise(
        F.coalesce(F.nullif("value", F.lit("")), F.nullif(F.array_join(chosen, ", "), F.lit("")))
    )
    hidden = (F.col("category") == "input") & F.coalesce(F.try_element_at("attributes", F.lit("type")) == "hidden", F.lit(False))
    fields = (
        placed.where(F.col("category").isin("input", "select", "textarea") & ~hidden)
        .join(forms, [*PAGE, "owner_form"], "left")
        .select(
            *PAGE,
            F.when(F.col("known"), F.col("owner_form")).otherwise("(ungrouped inputs)").alias("form"),
            "place",
            "label",
            kind.alias("kind"),
            (F.coalesce(F.try_element_at("states", F.lit("required")), F.lit("")) == "true").alias("required"),
            F.array_join(labels, " | ").alias("options"),
            F.coalesce("option_count", F.lit(0)).alias("option_count"),
            default.alias("default_value"),
            F.when((kind == "radio"), F.nullif("group_name", F.lit(""))).alias("radio_group"),
        )
    )
    key = F.coalesce(F.concat(F.lit("g:"), "radio_group"), F.concat(F.lit("p:"), F.col("place").cast("string")))
    members = F.array_sort(F.collect_list(F.struct("place", "label")))
    return (
        fields.groupBy(*PAGE, "form", key.alias("field"))
        .agg(
            F.min("place").alias("place"),
            F.max("radio_group").alias("radio_group"),
            members.alias("members"),
            F.bool_or("required").alias("required"),
            F.min_by(F.struct("label", "kind", "options", "option_count", "default_value"), "place").alias("f"),
            F.count("*").alias("n"),
        )
        .select(
            *PAGE,
            "form",
            "place",
            F.coalesce("radio_group", "f.label").alias("label"),
            F.when(F.col("radio_group").isNotNull(), "radio-group").otherwise(F.col("f.kind")).alias("kind"),
            "required",
            F.when(F.col("radio_group").isNotNull(), F.array_join("members.label", " | ")).otherwise(F.col("f.options")).alias("options"),
            F.when(F.col("radio_group").isNotNull(), F.col("n").cast("int")).otherwise(F.col("f.option_count")).alias("option_count"),
            F.when(F.col("radio_group").isNotNull(), F.col("members")[0]["label"]).otherwise(F.col("f.default_value")).alias("default_value"),
        )
    )


def forms(elements: DataFrame) -> DataFrame:
    """Each form that has fields: name, number of fields, and the labels of its buttons."""
    fields = form_fields(elements).groupBy(*PAGE, "form").agg(F.count("*").alias("fields"))
    rows = current_elements(elements, *LINKED, "bounding_box").withColumn("label", control_label())
    named = F.coalesce(filled(F.col("accessible_name")), filled(F.col("text")))
    owners = (
        rows.where("dom_path <> ''")
        .groupBy(*PAGE, F.col("dom_path").alias("form"))
        .agg(F.max_by(F.when(named.isNotNull(), F.col("label")).otherwise("(unnamed form)"), F.struct("pos", "element_id")).alias("name"))
    )
    buttons = (
        reading_order(rows)
        .where("category = 'button' and owner_form <> ''")
        .groupBy(*PAGE, F.col("owner_form").alias("form"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda s: s.label), " | ").alias("actions"))
    )
    return (
        fields.join(owners, [*PAGE, "form"], "left")
        .join(buttons, [*PAGE, "form"], "left")
        .select(*PAGE, "form", F.coalesce("name", "form").alias("name"), "fields", F.coalesce("actions", F.lit("")).alias("actions"))
    )


def nearest_tables(parents: DataFrame) -> DataFrame:
    """The table that each captured path lies in or is: PAGE, path, nearest.

    ``parents`` has PAGE, path, up (the next captured path, or '') and is_table. Each round
    lets a path take over what its parent knows, a table or a parent twice as far, so a
    chain of n steps takes log n rounds, of the unsettled paths only. A chain cannot be
    longer than the paths of its page are many; what is unsettled then runs in a circle.
    Paths whose chain ends, leaves the captured paths or runs in a circle are absent.
    """
    known = settled(parents.select(*PAGE, "path", "up", F.when(F.col("is_table"), F.col("path")).alias("nearest")))
    most = known.groupBy(*PAGE).count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= most and not known.where("nearest is null and up <> ''").isEmpty():
        above = known.select(*PAGE, F.col("path").alias("up"), F.col("up").alias("next"), F.col("nearest").alias("found"))
        moved = (
            known.where("nearest is null and up <> ''")
            .drop("nearest")
            .join(above, [*PAGE, "up"])
            .select(*PAGE, "path", F.col("next").alias("up"), F.col("found").alias("nearest"))
        )
        known = settled(known.where("nearest is not null").unionByName(moved))
        reach *= 2
    return known.where("nearest is not null").select(*PAGE, "path", "nearest")


def tables(elements: DataFrame) -> DataFrame:
    """Data tables with columns, rows and the distinct actions inside them.

    An action belongs to the nearest table on its chain of captured parents, however long.
    """
    rows = current_elements(elements, *LINKED, "column_names", "row_count", "landmark").withColumn("label", control_label())
    at = F.struct("pos", "element_id")
    parents = rows.where("dom_path <> ''").groupBy(*PAGE, F.col("dom_path").alias("path")).agg(
        F.max_by(F.coalesce("parent_path", F.lit("")), at).alias("up"), F.bool_or(F.coalesce(F.col("category") == "table", F.lit(False))).alias("is_table")
    )
    owned = (
        rows.where(F.col("category").isin("button", "link") & (F.col("parent_path") != ""))
        .select(*PAGE, "label", "pos", "element_id", F.col("parent_path").alias("path"))
        .join(nearest_tables(parents), [*PAGE, "path"])
    )
    acts = (
        owned.groupBy(*PAGE, F.col("nearest").alias("path"), "label")
        .agg(F.min(F.struct("pos", "element_id")).alias("at"))
        .groupBy(*PAGE, "path")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s.label), " | ").alias("row_actions"))
    )
    named = F.coalesce(filled(F.col("accessible_name")), filled(F.col("text")))
    return (
        rows.where("category = 'table'")
        .join(acts.withColumnRenamed("path", "dom_path"), [*PAGE, "dom_path"], "left")
        .select(
            *PAGE,
            "element_id",
            "dom_path",
            F.when(named.isNotNull(), F.col("label")).otherwise("(unnamed table)").alias("name"),
            F.coalesce(F.array_join("column_names", " | "), F.lit("")).alias("columns"),
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.coalesce("row_actions", F.lit("")).alias("row_actions"),
        )
    )


def relation_stats(page_nodes: DataFrame, nav_edges: DataFrame, elements: DataFrame) -> DataFrame:
    """Counters of each capture's relations: (crawl_id, counter, n), zeros left out."""
    from prismgrid.operators.capture import current_edges, current_pages
    from prismgrid.operators.navigation import orphan_screens

    grouped = forms(elements)
    edges = current_edges(nav_edges)
    counted = [
        (current_pages(page_nodes), "screens", F.lit(1)),
        (edges, "navigation_edges", F.lit(1)),
        (edges.where("label <> ''"), "labelled_edges", F.lit(1)),
        (element_links(elements), "element_links", F.lit(1)),
        (grouped, "forms", F.lit(1)),
        (grouped, "form_fields", F.col("fields")),
        (current_elements(elements, "category").where("category = 'table'"), "tables", F.lit(1)),
        (orphan_screens(page_nodes, nav_edges), "orphan_screens", F.lit(1)),
    ]
    out = None
    for rows, name, n in counted:
        part = rows.groupBy("crawl_id").agg(F.sum(n).cast("bigint").alias("n")).select("crawl_id", F.lit(name).alias("counter"), "n")
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")
