"""What runs, linked to the source that declares it, with a ladder of confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions.text import squeezed
from prismgrid.operators.capture import current_elements, current_pages
from prismgrid.operators.navigation import path_of, source_pattern


def _owners(components: DataFrame, array: str, key) -> DataFrame:
    rows = components.select("path", "name", "line", F.explode(array).alias("raw")).select(key(F.col("raw")).alias("key"), "path", "name", "line").where("key <> ''")
    first = F.min(F.struct("path", "line", "name"))
    return rows.groupBy("key").agg(F.count("*").alias("owners"), first.alias("first"))


def correlate_elements(elements: DataFrame, components: DataFrame) -> DataFrame:
    """Controls by test id (one owner confirmed, several medium), else by label.

    One owner of a label is high; several are low and none of them is picked. A
    component that lists a label twice after normalising counts twice. Equal controls of
    a page count once, the first.
    """
    rows = current_elements(elements, "category", "accessible_name", "attributes", "dom_path", "text").where("category in ('button', 'link', 'input', 'select', 'nav')")
    name = squeezed(F.col("accessible_name"))
    turn = F.row_number().over(W.partitionBy("crawl_id", "url", F.coalesce(F.nullif(name, F.lit("")), F.col("dom_path"))).orderBy("pos", "element_id"))
    once = rows.withColumn("turn", turn).where("turn = 1").select("element_id", "crawl_id", "url", "accessible_name", name.alias("label"), F.try_element_at("attributes", F.lit("data-testid")).alias("test_id"))
    by_id = _owners(components, "test_ids", F.trim).select(F.col("key").alias("test_id"), F.col("owners").alias("i_owners"), F.col("first").alias("i_first"))
    by_label = _owners(components, "labels", squeezed).select(F.col("key").alias("label"), F.col("owners").alias("l_owners"), F.col("first").alias("l_first"))
    joined = once.join(by_id, "test_id", "left").join(by_label, "label", "left").where("i_owners is not null or l_owners is not null")
    confidence = F.when(F.col("i_owners") == 1, "confirmed").when(F.col("i_owners") > 1, "medium").when(F.col("l_owners") == 1, "high").otherwise("low")
    source = F.when(F.col("i_owners").isNotNull(), F.col("i_first")).when(F.col("l_owners") == 1, F.col("l_first"))
    return joined.select("element_id", "crawl_id", "url", "accessible_name", confidence.alias("confidence"), source["name"].alias("source_name"), source["path"].alias("source_path"), F.coalesce("i_owners", "l_owners").alias("owners"))


def correlate_routes(page_nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """Pages by equal route path, else by a route with parameters that matches.

    Exact: one high, several medium; by pattern: one medium, several low. Routes with
    parameters are joined on their number of segments first, so a page meets only
    patterns of its own length; routes with ``*`` are joined on their literal first segment.
    """
    path = F.coalesce(F.nullif(F.regexp_replace(path_of(F.col("url")), "/+$", ""), F.lit("")), F.lit("/"))
    pages = current_pages(page_nodes).select("crawl_id", "url", path.alias("at"))
    own = F.coalesce(F.nullif(F.regexp_replace("route", "/+$", ""), F.lit("")), F.lit("/"))
    order = F.struct("path", "line", "place", "route", "component")
    exact = routes.groupBy(own.alias("at")).agg(F.count("*").alias("n"), F.min(order).alias("r"))
    hit = pages.join(exact, "at")
    left = pages.join(exact.select("at"), "at", "left_anti")
    escaped = F.regexp_replace(F.regexp_replace(own, r"([.+?^$()\[\]{}|\\])", r"\\$1"), r"\*", ".*")
    pattern = F.concat(F.lit("^"), F.regexp_replace(escaped, ":[A-Za-z_][A-Za-z0-9_]*", "[^/]+"), F.lit("/?$"))
    patterned = routes.where(F.col("route").contains(":")).select(order.alias("r"), pattern.alias("pattern"), F.size(F.split(own, "/")).alias("segments"), own.contains("*").alias("open"))
    sized = left.withColumn("segments", F.size(F.split("at", "/")))
    same = sized.join(patterned.where("not open").drop("open"), "segments").where(F.expr("at rlike pattern"))
    first = F.regexp_extract("at", "^/([^/]*)", 1)
    head = F.regexp_extract(F.col("r.route"), "^/([^/:*]*)", 1)
    open_ = patterned.where("open").drop("open", "segments").withColumn("head", head)
    wild = sized.drop("segments").withColumn("head", F.explode(F.array_distinct(F.array(first, F.lit(""))))).join(open_, "head").where(F.expr("at rlike pattern")).drop("head")
    found = same.drop("segments").unionByName(wild).groupBy("crawl_id", "url", "at").agg(F.count("*").alias("n"), F.min("r").alias("r"))
    name = F.coalesce("r.component", "r.route")
    return hit.select("crawl_id", "url", name.alias("source_name"), F.col("r.path").alias("source_path"), F.when(F.col("n") == 1, "high").otherwise("medium").alias("confidence")).unionByName(
        found.select("crawl_id", "url", name.alias("source_name"), F.col("r.path").alias("source_path"), F.when(F.col("n") == 1, "medium").otherwise("low").alias("confidence"))
    )


def _tail(pattern):
    """Path of an endpoint with a leading slash, with or without a host."""
    bare = F.regexp_replace(pattern, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare)), "(?<=.)/+$", "")


def correlate_endpoints(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Observed API calls by path: one call site of the method high, several medium, another method low."""
    seen = requests.where(F.col("resource_type").isin("xhr", "fetch")).groupBy(F.upper("method").alias("method"), _tail(source_pattern(F.col("url"))).alias("tail")).agg(F.min_by("url", "request_id").alias("example"))
    sites = endpoints.select(_tail(F.col("pattern")).alias("tail"), F.upper("method").alias("of"), F.struct("path", "line", "url").alias("site"))
    joined = seen.join(sites, "tail").groupBy("method", "tail", "example").agg(
        F.count_if(F.col("of") == F.col("method")).alias("same"),
        F.min(F.when(F.col("of") == F.col("method"), F.col("site"))).alias("own"),
        F.min("site").alias("other"),
    )
    site = F.coalesce("own", "other")
    return joined.select("method", "example", site["url"].alias("source_name"), site["path"].alias("source_path"), F.when(F.col("same") == 1, "high").when(F.col("same") > 1, "medium").otherwise("low").alias("confidence"))
