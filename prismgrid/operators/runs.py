"""Runs, stages, retention and login checks as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions.text import any_word, squeezed
from prismgrid.operators.capture import current, current_elements, current_pages
from prismgrid.operators.navigation import path_of

# Path segments and phrases of a login page.
LOGIN_SEGMENTS = ["login", "log-in", "signin", "sign-in", "sso", "auth", "oauth", "authenticate", "session/new"]
LOGIN_PHRASES = [
    "sign in", "sign-in", "signin", "log in", "log-in", "login", "session expired", "session has expired",
    "please authenticate", "continue with google", "continue with email", "single sign-on",
]


def run_metrics(events: DataFrame) -> DataFrame:
    """Stage durations of each run with their share and the run's slowest stage.

    A run is a user of the event stream, a stage an event type; a stage lasts from its
    first to its last event, in whole milliseconds.
    """
    stages = events.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage")).agg(
        F.count("*").alias("events"),
        F.expr("cast((unix_micros(cast(max(ts) as timestamp)) - unix_micros(cast(min(ts) as timestamp))) div 1000 as bigint)").alias("duration_ms"),
    )
    run = W.partitionBy("run_id")
    total = F.sum("duration_ms").over(run)
    return stages.select(
        "run_id",
        "stage",
        "events",
        "duration_ms",
        F.try_divide(F.col("duration_ms").cast("double"), total.cast("double")).alias("share"),
        F.max_by("stage", F.struct("duration_ms", "stage")).over(run).alias("slowest_stage"),
    )


def run_outcomes(crawls: DataFrame) -> DataFrame:
    """One narrow row per run: outcome (failed, partial, ok), duration and pace.

    A run that never finished failed; one with failed pages is partial. Rows without a
    run_id take the crawl_id.
    """
    rows = current(crawls, "crawl_id", ["run_id", "site", "config_file", "started_at", "finished_at", "pages_crawled", "pages_failed", "auth_used"], ["run_id", "site"])
    seconds = F.expr("cast((unix_micros(cast(finished_at as timestamp)) - unix_micros(cast(started_at as timestamp))) div 1000000 as bigint)")
    return rows.select(
        F.coalesce("run_id", "crawl_id").alias("run_id"),
        "crawl_id",
        "site",
        F.when(F.col("finished_at").isNull(), "failed").when(F.col("pages_failed") > 0, "partial").otherwise("ok").alias("outcome"),
        seconds.alias("seconds"),
        "pages_crawled",
        F.when((F.col("pages_crawled") > 0) & (seconds > 0), (seconds * 1000).cast("double") / F.col("pages_crawled")).alias("ms_per_page"),
        F.coalesce("auth_used", F.lit(False)).alias("auth_used"),
    )


def retention_plan(crawls: DataFrame, now: str, retention_days: int) -> DataFrame:
    """Captures kept, expired or undetermined at ``now`` (a timestamp literal, UTC).

    The age counts from the end, else the start, in days with two decimals, never below
    0; a capture expires when its age is greater than the retention. 0 keeps everything.
    """
    rows = current(crawls, "crawl_id", ["site", "started_at", "finished_at"], ["site"])
    when = F.coalesce("finished_at", "started_at").cast("timestamp")
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(when)
    age = F.round(F.greatest(micros / F.lit(86_400_000_000.0), F.lit(0.0)), 2)
    bucket = F.when(when.isNull(), "undetermined").when(F.lit(retention_days > 0) & (age > retention_days), "expired").otherwise("kept")
    return rows.select("crawl_id", "site", age.alias("age_days"), bucket.alias("bucket"))


def settle_runs(events: DataFrame, needed: int = 2) -> DataFrame:
    """Runs of equal consecutive polls per page, and whether one settled it.

    A page is a user of the event stream, its polls the events by time, a poll's state
    the event type. Islands come from comparing with the poll before.
    """
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    changed = F.coalesce((F.col("event_type") != F.lag("event_type").over(order)).cast("int"), F.lit(1))
    islands = events.withColumn("changed", changed).withColumn("island", F.sum("changed").over(order))
    return (
        islands.groupBy("user_id", "island", "event_type")
        .agg(F.count("*").alias("polls"), F.min("event_id").alias("first_event"))
        .withColumn("settled", F.col("polls") >= needed)
    )


def rendered(state: Column) -> Column:
    """Whether a polled state ``text:interactive:...`` shows something."""
    parts = F.split(state, ":")
    text, interactive = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.coalesce((text >= 20) | (interactive >= 1), F.lit(False))


def auth_checks(page_nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Signals that a page is a login page or empty, the first that fires.

    In order: a visible password field, a login segment in the final URL's path, a login
    phrase in the title, no elements at all.
    """
    password = F.lower(F.try_element_at("attributes", F.lit("type"))) == "password"
    seen = (
        current_elements(elements, "attributes", "visible")
        .groupBy("crawl_id", "url")
        .agg(F.count("*").alias("n"), F.coalesce(F.bool_or(password & F.col("visible")), F.lit(False)).alias("password"))
    )
    pages = current_pages(page_nodes, "title", "final_url", "requested_url").join(seen, ["crawl_id", "url"], "left")
    segment = r"(?:^|/)(?:" + "|".join(sorted(LOGIN_SEGMENTS, key=lambda s: (-len(s), s))) + r")(?:/|$)"
    path = squeezed(path_of(F.coalesce(F.nullif("final_url", F.lit("")), F.col("requested_url"), F.lit(""))))
    signal = (
        F.when(F.col("password"), "password-field")
        .when(path.rlike(segment), "login-url")
        .when(squeezed(F.col("title")).rlike(any_word(LOGIN_PHRASES)), "logged-out-title")
        .when(F.col("n").isNull(), "empty-page")
    )
    return pages.select("crawl_id", "url", signal.alias("signal"))


def auth_verdict(checks: DataFrame, crawls: DataFrame) -> DataFrame:
    """Per crawl the logged-out and empty pages, and whether its session had expired."""
    used = current(crawls, "crawl_id", ["auth_used"], ["site"])
    counts = checks.groupBy("crawl_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("signal").isNotNull() & (F.col("signal") != "empty-page")).alias("logged_out"),
        F.count_if(F.col("signal") == "empty-page").alias("empty"),
    )
    expired = F.coalesce("auth_used", F.lit(False)) & (
        (F.col("logged_out") > 0) | ((F.col("empty") > 0) & (2 * F.col("empty") >= F.col("pages")))
    )
    return counts.join(used, "crawl_id").select("crawl_id", "pages", "logged_out", "empty", expired.alias("auth_expired"))


def retention_totals(plan: DataFrame) -> DataFrame:
    """Captures per bucket and their oldest age."""
    return plan.groupBy("bucket").agg(F.count("*").alias("captures"), F.max("age_days").alias("oldest_days"))


def prune(folders: list[str], delete: bool = False) -> list[str]:
    """List the folders of expired captures; remove them only if told to, go on after errors."""
    import shutil

    gone = []
    for folder in folders:
        try:
            if delete:
                shutil.rmtree(folder)
            gone.append(folder)
        except OSError:
            continue
    return gone


def numbered(events: DataFrame) -> DataFrame:
    """Events with their running number in the run, from 1, by time, then id."""
    turn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("run_id"), "event_id", turn.alias("seq"))


def run_index(outcomes: DataFrame, finished_at: Column) -> DataFrame:
    """One row per run, however often it was finished: the last finish, ties by crawl_id.

    ``outcomes`` has run_id, crawl_id, outcome, pages_crawled and what ``finished_at`` needs.
    """
    order = F.struct(finished_at.alias("at"), "crawl_id")
    return outcomes.groupBy("run_id").agg(
        F.max_by(F.struct("crawl_id", finished_at.alias("at"), "outcome", F.coalesce("pages_crawled", F.lit(0)).alias("pages")), order).alias("r"),
        F.count("*").alias("finishes"),
    ).select("run_id", "r.*", "finishes")


def append_index(index: DataFrame, finished: DataFrame) -> DataFrame:
    """The index with further runs; a run that is in it already stays as it is."""
    return index.unionByName(finished.join(index.select("run_id"), "run_id", "left_anti").select(index.columns))
