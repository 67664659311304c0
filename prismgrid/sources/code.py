"""Source trees as tables: components, routes and endpoints found by line patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgrid.functions.text import strip
from prismgrid.operators.navigation import source_pattern

# Files that count, places that don't, and the patterns of a line.
SUFFIXES = ["js", "jsx", "ts", "tsx", "vue", "svelte", "mjs", "cjs"]
SKIPPED = [
    "node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".nuxt", ".svelte-kit", "__pycache__",
    ".venv", "venv", "vendor", ".cache", "public", "static",
]
MAX_BYTES = 512_000
EXPORTED = r"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Z][A-Za-z0-9_]*)"
DEFAULT_EXPORT = r"export\s+default\s+([A-Z][A-Za-z0-9_]*)\s*[;\n]"
ROUTE_TAG = r"""<Route[^>]*\bpath\s*=\s*["'{]+\s*["'`]?([^"'`}\s]+)"""
ROUTE_KEY = r"""["']?(?:path|route)["']?\s*[:=]\s*["'`]([^"'`]+)["'`]"""
ROUTE_COMPONENT = r"""(?:component|element)\s*[:=]\s*[{<]?\s*([A-Z][A-Za-z0-9_]*)"""
CALL = r"""(?:fetch|axios(?:\.\w+)?|\bapi\.\w+|\bhttp\.\w+|request)\s*\(\s*["'`]([^"'`]+)["'`]"""
METHOD_NAME = r"(?i)\b(?:axios|api|http)\.(get|post|put|patch|delete)\b"
METHOD_OPTION = r"""(?i)method\s*:\s*["'](\w+)["']"""
LABEL = r"""(?:aria-label|title|label|placeholder|alt)\s*=\s*["'{]+\s*["'`]?([^"'`}<>]{2,60})"""
TAG_TEXT = r">\s*([A-Z][A-Za-z0-9 ,'&./-]{2,48})\s*<"
TEST_ID = r"""(?:data-testid|data-test-id|data-cy|testID)\s*=\s*["'{]+\s*["'`]?([^"'`}\s<>]+)"""
MAX_LABELS, MAX_TEST_IDS = 40, 20


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the source files below a folder; big and bundled files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.substring_index("path", folder.rstrip("/") + "/", -1)
    skipped = r"(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    kept = files.where(
        (F.col("length") <= MAX_BYTES)
        & F.col("path").rlike(r"(?i)\.(" + "|".join(SUFFIXES) + ")$")
        & ~F.col("path").rlike(r"\.(min\.js|bundle\.js|d\.ts)$")
        & ~inside.rlike(skipped)
    )
    return kept.select(inside.alias("path"), F.decode("content", "UTF-8").alias("text"))


def _lines(files: DataFrame) -> DataFrame:
    return files.where("text <> ''").select("path", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "code")).withColumn("line", F.col("line") + 1)


def _all(pattern: str):
    return F.regexp_extract_all("code", F.lit(pattern), F.lit(1))


def _first_distinct(found: DataFrame, name: str, limit: int) -> DataFrame:
    """Per file the first distinct values in order of their places."""
    first = found.where(f"{name} <> ''").groupBy("path", name).agg(F.min(F.struct("line", "place")).alias("at"))
    sorted_ = F.array_sort(F.collect_list(F.struct("at", name)))
    return first.groupBy("path").agg(F.slice(F.transform(sorted_, lambda s: s[name]), 1, limit).alias(f"{name}s"))


def components(files: DataFrame) -> DataFrame:
    """(path, name, kind, line, labels, test_ids) of files that declare a component."""
    stem = F.regexp_extract("path", r"([^/]*?)\.[^./]*$", 1)
    head = F.array_join(F.slice(F.split("text", r"\r\n|\r|\n"), 1, 400), "\n")
    exported = F.coalesce(F.nullif(F.regexp_extract(head, EXPORTED, 1), F.lit("")), F.nullif(F.regexp_extract(head, DEFAULT_EXPORT, 1), F.lit("")))
    single = F.col("path").rlike(r"(?i)\.(vue|svelte)$")
    name = F.coalesce(
        exported,
        F.when(stem.rlike(r"^\p{Lu}") & ~F.lower(stem).isin("index", "app"), stem),
        F.when(single & (stem != ""), F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, 2, 10000))),
    )
    low = F.lower("path")
    kind = F.when(low.rlike("(^|/)(pages?|views?|screens?|routes?)(/|$)"), "page").when(low.contains("layout"), "layout").otherwise("component")
    named = files.where("text <> ''").select("path", name.alias("name"), kind.alias("kind")).where("name is not null")
    lines = _lines(files)
    labels = lines.select("path", "line", F.posexplode(F.concat(_all(LABEL), _all(TAG_TEXT))).alias("place", "raw")).select("path", "line", "place", strip(F.col("raw")).alias("label"))
    ids = lines.select("path", "line", F.posexplode(_all(TEST_ID)).alias("place", "test_id"))
    at = lines.join(named.select("path", "name"), "path").where(F.col("code").contains(F.col("name"))).groupBy("path").agg(F.min("line").alias("line"))
    none = F.array().cast("array<string>")
    return (
        named.join(at, "path", "left")
        .join(_first_distinct(labels, "label", MAX_LABELS), "path", "left")
        .join(_first_distinct(ids, "test_id", MAX_TEST_IDS), "path", "left")
        .select("path", "name", "kind", F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("labels", none).alias("labels"), F.coalesce("test_ids", none).alias("test_ids"))
    )


def routes(files: DataFrame) -> DataFrame:
    """(path, line, place, route, component): routes start with / and hold no space."""
    found = _lines(files).select("path", "line", F.nullif(F.regexp_extract("code", ROUTE_COMPONENT, 1), F.lit("")).alias("component"), F.posexplode(F.concat(_all(ROUTE_TAG), _all(ROUTE_KEY))).alias("place", "route"))
    return found.where(F.col("route").startswith("/") & ~F.col("route").contains(" "))


def endpoints(files: DataFrame) -> DataFrame:
    """(path, line, method, url, pattern): the first call site per method and pattern."""
    method = F.upper(F.coalesce(F.nullif(F.regexp_extract("code", METHOD_NAME, 1), F.lit("")), F.nullif(F.regexp_extract("code", METHOD_OPTION, 1), F.lit("")), F.lit("GET")))
    found = _lines(files).select("path", "line", method.alias("method"), F.posexplode(_all(CALL)).alias("place", "url")).where(F.col("url").rlike("^(/|https?://)"))
    pattern = F.coalesce(F.nullif(source_pattern(F.col("url")), F.lit("")), F.lit("/"))
    return found.groupBy("method", pattern.alias("pattern")).agg(F.min(F.struct("path", "line", "place", "url")).alias("f")).select("f.path", "f.line", "method", "f.url", "pattern")
