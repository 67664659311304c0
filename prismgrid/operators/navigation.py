"""URLs, links between screens, reachability, hosts and endpoints."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions.identity import safety_label
from prismgrid.functions.text import squeezed, strip
from prismgrid.functions.urls import page_key
from prismgrid.operators.capture import current_edges, current_elements, current_pages
from prismgrid.session import settled

# Query parameters without identity, key names that are secret.
NOISE = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref",
    "sessionid", "session_id", "sid", "phpsessid", "jsessionid",
]
SECRET = (
    "token|api[_-]?key|apikey|secret|password|passwd|pwd|auth|authorization|session|sig|signature|access[_-]?token"
    "|refresh[_-]?token|code|bearer"
)
ID_SEGMENT = r"^([0-9]+|[0-9a-f]{8,}|[0-9a-fA-F-]{16,})$"
#: Parts of a URL: scheme with colon, authority with slashes, path, query, fragment.
PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def path_of(url: Column) -> Column:
    return F.coalesce(F.nullif(part(url, 3), F.lit("")), F.lit("/"))


def host_of(url: Column) -> Column:
    return F.lower(part(url, 2))


def without_noise(url: Column, drop=()) -> Column:
    """Page key whose query has no noise parameters, the others sorted."""
    key = page_key(url)
    pairs = F.filter(F.split(F.regexp_extract(key, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin([*NOISE, *drop]))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(F.regexp_replace(key, r"\?.*$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def with_hash_route(url: Column) -> Column:
    """Page key that keeps a fragment of the form ``#/route``."""
    return F.concat(page_key(url), F.regexp_extract(url, r"(#/.*)$", 1))


def glob(pattern: str) -> str:
    """A path pattern (``*`` within, ``**`` across segments, ``?`` one character) as a regex."""
    import re

    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in parts) + "$"


def in_scope(url: Column, include=(), exclude=()) -> Column:
    """Excluded always loses; without includes everything else is in."""
    path = path_of(url)
    out, kept = F.lit(False), F.lit(not include)
    for p in exclude:
        out = out | path.rlike(glob(p))
    for p in include:
        kept = kept | path.rlike(glob(p))
    return kept & ~out


def redact_query(url: Column, extra=()) -> Column:
    """Values of secret query keys replaced; other pairs are kept as they are written."""
    keys = "|".join([SECRET, *[e.lower() for e in extra]])
    pair = lambda p: F.when(F.split_part(p, F.lit("="), F.lit(1)).rlike(f"(?i){keys}"), F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("=REDACTED"))).otherwise(p)
    query = F.array_join(F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), pair), "&")
    return F.when(url.rlike(r"\?[^#]"), F.concat(F.regexp_extract(url, r"^([^?]*)", 1), F.lit("?"), query, F.regexp_extract(url, "(#.*)$", 1))).otherwise(url)


def endpoint_pattern(url: Column) -> Column:
    """Host and path, path segments that look like ids as ``:id``."""
    segments = F.transform(F.split(part(url, 3), "/"), lambda s: F.when(s.rlike(ID_SEGMENT), ":id").otherwise(s))
    return F.coalesce(F.nullif(F.concat(part(url, 2), F.array_join(segments, "/")), F.lit("")), url)


def source_pattern(url: Column) -> Column:
    """An endpoint as source code spells it: placeholders and numbers as ``:id``, no query."""
    bare = F.regexp_replace(url, r"\?.*$", "")
    for p in (r"\$\{[^}]*\}", r":[A-Za-z_][A-Za-z0-9_]*", r"\{[^}]*\}"):
        bare = F.regexp_replace(bare, p, ":id")
    return F.regexp_replace(F.regexp_replace(bare, r"/[0-9]+(?=/|$)", "/:id"), "/+$", "")


def slug(url: Column) -> Column:
    path = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    host = F.coalesce(F.nullif(part(url, 2), F.lit("")), F.lit("page"))
    name = F.when(path == "", host).otherwise(F.concat(host, F.lit("_"), path))
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit("page")), 1, 120)


def modules(urls: DataFrame, prefixes: dict[str, str], default: str = "general") -> DataFrame:
    """Adds ``module``: the one with the longest path prefix at a segment's end.

    The rules are a small driver-side table and become one expression, longest first.
    """
    path = F.regexp_replace(path_of(F.col("url")), "/+$", "")
    found = F.lit(default)
    for prefix, name in sorted(prefixes.items(), key=lambda kv: len(kv[0].rstrip("/"))):
        prefix = prefix.rstrip("/")
        if prefix:
            found = F.when((path == prefix) | path.startswith(prefix + "/"), name).otherwise(found)
    return urls.withColumn("module", found)


def resolved_links(nav_edges: DataFrame) -> DataFrame:
    """Per screen and same-host target the first link: label, region and control."""
    return first_links(nav_edges).drop("edge_id")


def first_links(nav_edges: DataFrame) -> DataFrame:
    """Like :func:`resolved_links`, with the link's edge_id."""
    edges = current_edges(nav_edges).where(F.col("target").rlike("^(https?|file):") & (host_of(F.col("target")) == host_of(F.col("source"))))
    return (
        edges.groupBy("crawl_id", "source", "target")
        .agg(F.min_by(F.struct(strip(F.col("label")).alias("label"), F.coalesce("region", F.lit("")).alias("region"), "control"), "edge_id").alias("f"), F.min("edge_id").alias("edge_id"))
        .select("crawl_id", "source", "target", "f.*", "edge_id")
    )


def same_origin(a: Column, b: Column) -> Column:
    """Equal scheme and authority; about: and data: addresses inherit."""
    inherits = a.rlike("^(about|data):") | b.rlike("^(about|data):")
    return inherits | ((F.lower(part(a, 1)) == F.lower(part(b, 1))) & (host_of(a) == host_of(b)))


def deep_links(nav_edges: DataFrame, budget: int = 40) -> DataFrame:
    """Links found by clicking: safe labels only, each tried once per capture, in order,
    the first ``budget`` of a capture (the feature)."""
    label = squeezed(F.col("label"))
    clicked = current_edges(nav_edges).where((F.col("control") == "deep-nav") & (label != "") & (safety_label(F.col("label")) == "SAFE"))
    once = clicked.groupBy("crawl_id", label.alias("label")).agg(F.min(F.struct("edge_id", "source", "target")).alias("f"))
    turn = F.row_number().over(W.partitionBy("crawl_id").orderBy("f.edge_id"))
    return once.withColumn("turn", turn).where(F.col("turn") <= budget).select("crawl_id", "label", "turn", "f.source", "f.target")


def not_captured(page_nodes: DataFrame, nav_edges: DataFrame) -> DataFrame:
    """Targets a capture found but does not hold, with the number of screens that link there."""
    pages = current_pages(page_nodes).select("crawl_id", F.col("url").alias("target"))
    found = current_edges(nav_edges).select("crawl_id", "source", "target").distinct()
    return found.join(pages, ["crawl_id", "target"], "left_anti").groupBy("crawl_id", "target").agg(F.count("*").alias("screens"))


def adjacency(page_nodes: DataFrame, nav_edges: DataFrame) -> DataFrame:
    """Distinct screens linking to and from each captured screen, itself left out."""
    pages = current_pages(page_nodes).select("crawl_id", "url")
    edges = current_edges(nav_edges).where("source <> target").select("crawl_id", "source", "target").distinct()
    ends = edges.select("crawl_id", F.col("source").alias("url"), F.lit(1).alias("out"), F.lit(0).alias("inn")).unionByName(
        edges.select("crawl_id", F.col("target").alias("url"), F.lit(0).alias("out"), F.lit(1).alias("inn"))
    )
    counts = ends.groupBy("crawl_id", "url").agg(F.sum("out").alias("outbound"), F.sum("inn").alias("inbound"))
    return pages.join(counts, ["crawl_id", "url"], "left").select(
        "crawl_id", "url", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound")
    )


def orphan_screens(page_nodes: DataFrame, nav_edges: DataFrame) -> DataFrame:
    """Screens no other screen links to that are no entry: depth 0, else the first page."""
    pages = current_pages(page_nodes)
    crawl = W.partitionBy("crawl_id")
    entry = F.when(F.max((F.col("depth") == 0).cast("int")).over(crawl) == 1, F.coalesce(F.col("depth") == 0, F.lit(False))).otherwise(
        F.row_number().over(crawl.orderBy(F.col("depth").asc_nulls_last(), "url")) == 1
    )
    linked = current_edges(nav_edges).where("source <> target").select("crawl_id", F.col("target").alias("url")).distinct()
    return pages.withColumn("entry", entry).where("not entry").join(linked, ["crawl_id", "url"], "left_anti").select("crawl_id", "url", "depth")


def bfs_depths(page_nodes: DataFrame, nav_edges: DataFrame) -> DataFrame:
    """Least number of clicks from each capture's entry pages (depth 0) to a screen.

    One round per click over the frontier only; each round's new screens are cut off
    from their history through the shared folder. The search ends when a
    round finds no new screen; unreachable ones are absent.
    """
    edges = settled(current_edges(nav_edges).where("source <> target").select("crawl_id", "source", "target").distinct())
    seen = settled(current_pages(page_nodes).where("depth = 0").select("crawl_id", "url", F.lit(0).alias("clicks")))
    frontier = seen
    for step in count(1):
        frontier = settled(
            frontier.join(edges.withColumnRenamed("source", "url"), ["crawl_id", "url"])
            .select("crawl_id", F.col("target").alias("url"))
            .distinct()
            .join(seen, ["crawl_id", "url"], "left_anti")
            .withColumn("clicks", F.lit(step))
        )
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        # A long chain takes many rounds; the plan of all of them is cut off now and then.
        if step % 20 == 0:
            seen = settled(seen.coalesce(edges.sparkSession.sparkContext.defaultParallelism))


def crawl_frontier(page_nodes: DataFrame, nav_edges: DataFrame, max_pages: int = 25, max_depth: int = 3) -> DataFrame:
    """What a capture with a budget takes of the available pages: crawl_id, url, clicks, turn.

    The search starts at the entry pages (depth 0) and follows links to pages that exist,
    at most ``max_depth`` clicks. Within a round pages are claimed by the first link that
    leads to them, then by url; a capture claims ``max_pages`` distinct pages and follows
    no link of a page it did not claim (both limits are the feature).
    """
    pages = current_pages(page_nodes).select("crawl_id", "url", "depth")
    edges = current_edges(nav_edges).where("source <> target").groupBy("crawl_id", "source", "target").agg(F.min("edge_id").alias("edge_id"))
    edges = settled(edges.join(pages.select("crawl_id", F.col("url").alias("target")), ["crawl_id", "target"], "left_semi"))
    crawl = W.partitionBy("crawl_id")

    def claimed(found: DataFrame) -> DataFrame:
        turn = F.col("used") + F.row_number().over(crawl.orderBy("edge_id", "url"))
        return settled(found.withColumn("turn", turn).where(F.col("turn") <= max_pages).drop("used"))

    start = pages.where("depth = 0").select("crawl_id", "url", F.lit(0).alias("clicks"), F.lit(-1).cast("bigint").alias("edge_id"), F.lit(0).cast("bigint").alias("used"))
    seen = frontier = claimed(start)
    for step in range(1, max_depth + 1):
        used = seen.groupBy("crawl_id").agg(F.max("turn").alias("used"))
        frontier = claimed(
            frontier.select("crawl_id", F.col("url").alias("source"))
            .join(edges, ["crawl_id", "source"])
            .groupBy("crawl_id", F.col("target").alias("url"))
            .agg(F.min("edge_id").alias("edge_id"))
            .join(seen, ["crawl_id", "url"], "left_anti")
            .join(used, "crawl_id")
            .select("crawl_id", "url", F.lit(step).alias("clicks"), "edge_id", "used")
        )
        seen = seen.unionByName(frontier)
    return seen.select("crawl_id", "url", "clicks", F.col("turn").cast("int").alias("turn"))


def top_endpoints(requests: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent endpoints of API requests (a top-k report), ties by name."""
    api = requests.where(F.col("resource_type").isin("xhr", "fetch"))
    counts = api.groupBy(endpoint_pattern(F.col("url")).alias("endpoint")).agg(F.count("*").alias("calls"))
    return counts.where("endpoint <> ''").orderBy(F.desc("calls"), "endpoint").limit(limit)


def egress_ledger(nav_edges: DataFrame) -> DataFrame:
    """Contacted hosts per capture: requests, first path, and whether in scope.

    The target host is the most frequent host of the capture's sources, ties by name.
    """
    edges = current_edges(nav_edges).select("crawl_id", "edge_id", host_of(F.col("source")).alias("home"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"))
    homes = edges.groupBy("crawl_id", "home").count().groupBy("crawl_id").agg(F.min_by("home", F.struct(-F.col("count"), F.col("home"))).alias("home"))
    return (
        edges.where("host <> ''")
        .groupBy("crawl_id", "host")
        .agg(F.count("*").alias("requests"), F.min_by("path", "edge_id").alias("first_path"))
        .join(homes, "crawl_id")
        .select("crawl_id", "host", "requests", "first_path", (F.col("host") == F.col("home")).alias("in_scope"))
    )


def link_destinations(elements: DataFrame, nav_edges: DataFrame) -> DataFrame:
    """Where the links of each screen lead, by equal label, the first edge of it."""
    first = (
        current_edges(nav_edges)
        .where("label <> ''")
        .groupBy("crawl_id", F.col("source").alias("url"), "label")
        .agg(F.min_by("target", "edge_id").alias("leads_to"))
    )
    name = strip(F.coalesce(F.nullif("accessible_name", F.lit("")), F.col("text")))
    links = current_elements(elements, "category", "accessible_name", "text").where("category in ('link', 'button')")
    return links.select("element_id", "crawl_id", "url", name.alias("label")).where("label <> ''").join(first, ["crawl_id", "url", "label"], "left")


def api_endpoints(requests: DataFrame) -> DataFrame:
    """API requests by method and endpoint: calls, first request's graphql flag, statuses.

    Needs columns request_id, method, url, resource_type, status.
    """
    path = F.lower(part(F.col("url"), 3))
    graphql = path.contains("graphql") | ((F.upper("method") == "POST") & path.endswith("/gql"))
    return (
        requests.where(F.col("resource_type").isin("xhr", "fetch"))
        .groupBy(F.upper("method").alias("method"), endpoint_pattern(F.col("url")).alias("endpoint"))
        .agg(
            F.count("*").alias("calls"),
            F.min_by(graphql, "request_id").alias("graphql"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") != 0, F.col("status")))).cast("array<string>"), ",").alias("statuses"),
        )
    )
