"""Components, regions, menus and totals of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions import identity
from prismgrid.functions.text import filled
from prismgrid.operators.capture import current_elements, current_pages

#: Columns that identify an element.
IDENTITY = ["category", "tag", "role", "accessible_name", "text", "landmark", "attributes", "dom_path"]
REGIONS = ["banner", "navigation", "main", "form", "dialog", "complementary", "contentinfo", "region", "search", "unlabeled"]
#: Most pages named as examples of a component or menu.
EXAMPLES = 5


def fingerprints(elements: DataFrame) -> DataFrame:
    """Stable identities of the current elements.

    Columns: element_id, crawl_id, url, pos, the identifying columns, strategy,
    fingerprint, component_signature. Nulls count as empty text; elements without a crawl
    or url are left out; repeated deliveries count once.
    """
    return current_elements(elements, *IDENTITY).withColumns(identity.fingerprint_columns())


def shared_components(prints: DataFrame) -> DataFrame:
    """Named controls on two or more pages of a crawl, by landmark, role, name and category."""
    name = filled(F.col("accessible_name"))
    key = {
        "landmark": F.coalesce("landmark", F.lit("")),
        "role": F.coalesce("role", F.lit("")),
        "name": F.lower(name),
        "category": F.coalesce("category", F.lit("")),
    }
    # Per page first, so that no group of a crawl holds more than its pages.
    per_page = (
        prints.where(name.isNotNull())
        .select("crawl_id", "url", *[c.alias(n) for n, c in key.items()], F.struct("url", "pos", "element_id", "component_signature", "accessible_name").alias("first"))
        .groupBy("crawl_id", "url", *key)
        .agg(F.count("*").alias("n"), F.min("first").alias("first"))
    )
    return (
        per_page.groupBy("crawl_id", *key)
        .agg(
            F.count("*").alias("page_count"),
            F.sum("n").alias("instance_count"),
            F.min("first").alias("first"),
        )
        .where("page_count >= 2")
        .select(
            "crawl_id",
            F.concat(F.lit("shared-"), F.substring(F.sha1(F.concat_ws("|", *key)), 1, 8)).alias("component_id"),
            F.lit("shared").alias("kind"),
            F.col("first.component_signature").alias("signature"),
            "role",
            F.col("first.accessible_name").alias("label"),
            "landmark",
            "category",
            "page_count",
            "instance_count",
        )
    )


def repeated_components(prints: DataFrame) -> DataFrame:
    """Shapes that occur at least twice on a page."""
    first = F.struct("url", "pos", "element_id", "role", "accessible_name", "landmark", "category")
    per_page = prints.groupBy("crawl_id", "component_signature", "url").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return (
        per_page.groupBy("crawl_id", "component_signature")
        .agg(
            F.count_if(F.col("n") >= 2).alias("page_count"),
            F.sum(F.when(F.col("n") >= 2, F.col("n"))).alias("instance_count"),
            F.min("first").alias("first"),
        )
        .where("page_count >= 1")
        .select(
            "crawl_id",
            F.concat(F.lit("repeated-"), F.substring(F.sha1("component_signature"), 1, 8)).alias("component_id"),
            F.lit("repeated").alias("kind"),
            F.col("component_signature").alias("signature"),
            F.coalesce("first.role", F.lit("")).alias("role"),
            F.coalesce(F.nullif("first.accessible_name", F.lit("")), "first.category").alias("label"),
            F.coalesce("first.landmark", F.lit("")).alias("landmark"),
            F.coalesce("first.category", F.lit("")).alias("category"),
            "page_count",
            "instance_count",
        )
    )


def components(prints: DataFrame) -> DataFrame:
    return shared_components(prints).unionByName(repeated_components(prints))


def regions(elements: DataFrame) -> DataFrame:
    """Elements per page, landmark and category, landmarks in reading order (``place``)."""
    rows = current_elements(elements, "landmark", "category").withColumn(
        "region", F.coalesce(F.nullif("landmark", F.lit("")), F.lit("unlabeled"))
    )
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, REGIONS)), F.col("region")), F.lit(0)), F.lit(100)) - 1
    return rows.groupBy("crawl_id", "url", "region", "category").agg(F.count("*").alias("n")).withColumn("place", place)


def navigation_menus(elements: DataFrame) -> DataFrame:
    """Equal menus of a crawl: label, items in order, whether a breadcrumb, and pages."""
    rows = current_elements(elements, "category", "landmark", "accessible_name")
    at = F.struct("pos", "element_id")
    item = (F.col("category") == "link") & (F.col("landmark") == "navigation") & (F.col("accessible_name") != "")
    per_page = (
        rows.where(item | (F.col("category") == "nav"))
        .groupBy("crawl_id", "url")
        .agg(
            F.min_by(F.coalesce("accessible_name", F.lit("")), F.when(F.col("category") == "nav", at)).alias("label"),
            F.array_sort(F.collect_list(F.when(item, F.struct("pos", "element_id", "accessible_name")))).alias("items"),
        )
        .where("size(items) > 0")
        .select(
            "crawl_id",
            "url",
            F.coalesce("label", F.lit("")).alias("label"),
            F.array_join(F.col("items.accessible_name"), " | ").alias("items"),
        )
    )
    return (
        per_page.groupBy("crawl_id", "label", "items")
        .agg(F.count("*").alias("page_count"), F.min("url").alias("first_page"))
        .withColumn("is_breadcrumb", F.col("label").rlike("(?i)breadcrumb"))
    )


def analysis_stats(prints: DataFrame) -> DataFrame:
    """Per crawl: pages, elements, distinct fingerprints, elements per strategy."""
    count = lambda s: F.count_if(F.col("strategy") == s)
    per_page = prints.groupBy("crawl_id", "url", "fingerprint", "strategy").count()
    per_print = per_page.groupBy("crawl_id", "url").agg(
        F.sum("count").alias("elements"),
        F.count_distinct("fingerprint").alias("unique_fingerprints"),
        *[F.sum(F.when(F.col("strategy") == s, F.col("count")).otherwise(0)).alias(n) for s, n in (("data-testid", "by_testid"), ("id", "by_id"), ("name", "by_name"), ("structural", "by_structure"))],
    )
    # A fingerprint holds its page's url, so distinct ones of pages add up.
    return per_print.groupBy("crawl_id").agg(
        F.count("*").alias("pages"),
        *[F.sum(c).alias(c) for c in ("elements", "unique_fingerprints", "by_testid", "by_id", "by_name", "by_structure")],
    )


def page_counts(elements: DataFrame) -> DataFrame:
    """Counters of each page: per category, visible, total, and shadow or iframe if any."""
    rows = current_elements(elements, "category", "visible", "shadow_depth", "frame")
    keys = F.array(
        F.struct(F.coalesce("category", F.lit("")).alias("counter"), F.lit(1).alias("always")),
        F.struct(F.when(F.col("visible"), "visible_elements").alias("counter"), F.lit(1).alias("always")),
        F.struct(F.lit("total_elements").alias("counter"), F.lit(1).alias("always")),
        F.struct(F.when(F.col("shadow_depth") > 0, "shadow_elements").alias("counter"), F.lit(1).alias("always")),
        F.struct(F.when(F.col("frame") != "", "iframe_elements").alias("counter"), F.lit(1).alias("always")),
    )
    return (
        rows.select("crawl_id", "url", F.inline(keys))
        .where("counter is not null")
        .groupBy("crawl_id", "url", "counter")
        .agg(F.sum("always").alias("n"))
    )


def inventory_screens(page_nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per captured page: title, depth, elements, visible ones, out-links."""
    counts = current_elements(elements, "visible").groupBy("crawl_id", "url").agg(
        F.count("*").alias("elements_total"), F.count_if("visible").alias("elements_visible")
    )
    pages = current_pages(page_nodes, "title", "out_links")
    return pages.join(counts, ["crawl_id", "url"], "left").select(
        "crawl_id",
        "url",
        "title",
        "depth",
        F.coalesce("elements_total", F.lit(0)).alias("elements_total"),
        F.coalesce("elements_visible", F.lit(0)).alias("elements_visible"),
        F.coalesce(F.array_size("out_links"), F.lit(0)).alias("out_links"),
    )


def type_coverage(elements: DataFrame) -> DataFrame:
    """Catalogue types found or absent, and types the application declared itself."""
    found = current_elements(elements, *IDENTITY).select(identity.ui_type().alias("ui_type")).where("ui_type is not null").groupBy("ui_type").agg(F.count("*").alias("n"))
    catalogue = elements.sparkSession.createDataFrame([(t,) for t in identity.UI_TYPES], "ui_type string")
    return (
        found.join(catalogue.withColumn("known", F.lit(True)), "ui_type", "full")
        .select(
            "ui_type",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(F.col("known").isNull(), "app_declared").when(F.col("n").isNull(), "absent").otherwise("found").alias("bucket"),
        )
    )


def unnamed_controls(elements: DataFrame) -> DataFrame:
    """Interactive elements without name and text, per page and kind."""
    rows = current_elements(elements, "category", "accessible_name", "text", "ui_type")
    nameless = filled(F.coalesce(F.nullif("accessible_name", F.lit("")), F.col("text"))).isNull()
    return (
        rows.where(F.col("category").isin("button", "link", "tab", "menu", "disclosure", "input", "select", "textarea") & nameless)
        .groupBy("crawl_id", "url", F.coalesce(F.nullif("ui_type", F.lit("")), F.col("category")).alias("kind"))
        .agg(F.count("*").alias("n"))
    )


def reading_order(rows: DataFrame) -> DataFrame:
    """Adds ``place``: elements with a box by rounded y and x, then the others by position."""
    box = F.col("bounding_box")
    order = W.partitionBy("crawl_id", "url").orderBy(
        box.isNull(), F.bround(box.y).cast("long"), F.bround(box.x).cast("long"), "pos", "element_id"
    )
    return rows.withColumn("place", F.row_number().over(order))


def actions(elements: DataFrame) -> DataFrame:
    """Distinct actionable controls of each page in reading order, with their safety."""
    rows = reading_order(current_elements(elements, "category", "accessible_name", "text", "ui_type", "landmark", "enabled", "options", "bounding_box"))
    label = filled(F.coalesce(F.nullif("accessible_name", F.lit("")), F.col("text")))
    kind = F.coalesce(F.nullif("ui_type", F.lit("")), F.col("category"))
    named = F.filter(F.slice(F.coalesce("options", F.array()), 1, 8), lambda o: o.label != "")
    return (
        rows.where(F.col("category").isin("button", "tab", "menu", "disclosure") & ~F.coalesce(F.col("ui_type").isin("tabpanel", "tablist", "menubar"), F.lit(False)) & label.isNotNull())
        .select("crawl_id", "url", label.alias("label"), kind.alias("kind"), F.coalesce("landmark", F.lit("")).alias("region"), "place", "enabled", F.array_join(F.transform(named, lambda o: o.label), " / ").alias("options"))
        .groupBy("crawl_id", "url", "label", "kind", "region")
        .agg(F.min_by(F.struct("enabled", "options"), "place").alias("f"), F.min("place").alias("place"))
        .select("crawl_id", "url", "label", "kind", "region", "place", "f.enabled", "f.options", identity.safety_label(F.col("label")).alias("safety"))
    )


def semantic_labels(prints: DataFrame) -> DataFrame:
    """Meaning of every element: label, confidence and rationale."""
    return prints.select("element_id", "crawl_id", "url", "fingerprint", "category", "accessible_name", identity.meaning().alias("m")).select(
        "element_id", "crawl_id", "url", "fingerprint", "category", "accessible_name", "m.*"
    )


def refine_labels(labels: DataFrame, refined: DataFrame) -> DataFrame:
    """Labels with those of a provider (fingerprint, label, confidence, rationale) laid over."""
    allowed = ["primary_action", "secondary_action", "navigation", "filter", "data_display", "destructive", "form_input", "informational"]
    new = refined.where(F.col("label").isin(allowed)).groupBy("fingerprint").agg(
        F.max(F.struct("label", "confidence", "rationale")).alias("r")
    )
    return labels.join(new, "fingerprint", "left").select(
        "element_id",
        "crawl_id",
        "url",
        "fingerprint",
        F.coalesce("r.label", "label").alias("label"),
        F.coalesce("r.confidence", "confidence").alias("confidence"),
        F.coalesce("r.rationale", "rationale").alias("rationale"),
        F.when(F.col("r").isNotNull(), "provider").otherwise("deterministic").alias("source"),
    )


def mock_refinement(labels: DataFrame) -> DataFrame:
    """The offline provider: row links named view, open or details become actions."""
    row_link = (F.col("category") == "link") & F.lower(F.trim("accessible_name")).isin("view", "open", "details")
    return labels.select(
        "fingerprint",
        F.when(row_link, "secondary_action").otherwise(F.col("label")).alias("label"),
        F.lit("high").alias("confidence"),
        F.lit("mock-refined").alias("rationale"),
    )
