"""What an interaction revealed, and the parts of a page worth a picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.functions.text import SPACES, strip

PAGE = ["crawl_id", "url"]
# Kinds of states and of components, sizes in pixels, most per page.
STATE_KINDS = {
    "dialog": "modal", "drawer": "drawer", "menu": "menu", "menubar": "menu", "tabpanel": "tab-panel", "tooltip": "tooltip",
    "popover": "popover", "listbox": "listbox", "tree": "tree", "disclosure": "disclosure",
}
CONTAINERS = ["dialog", "menu", "tab", "tooltip", "region"]
COMPONENT_RULES = [
    ("form", "form"), ("dialog", "dialog"), ("drawer", "drawer"), ("tabpanel", "tab-panel"), ("table", "table"),
    ("grid", "table"), ("region", "region"),
]
MIN_WIDTH, MIN_HEIGHT, MAX_HEIGHT, MAX_PER_PAGE, MAX_NAME = 60, 16, 4000, 30, 60


def depth(path: Column) -> Column:
    """Steps of a path; a shadow boundary counts four."""
    return F.length(path) - F.length(F.replace(path, F.lit(">"), F.lit(""))) + F.regexp_count(path, F.lit(">>>"))


def short_name() -> Column:
    """The name cut at 60 characters, a text of at most 60, or ''."""
    text = strip(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "))
    name = F.nullif(strip(F.coalesce("accessible_name", F.lit(""))), F.lit(""))
    return F.coalesce(F.substring(name, 1, MAX_NAME), F.when(F.length(text) <= MAX_NAME, text), F.lit(""))


def component_targets(rows: DataFrame) -> DataFrame:
    """Forms, overlays, panels, tables and named regions that are visible and large enough.

    Needs crawl_id, url, pos, element_id, dom_path, ui_type, visible, bounding_box,
    accessible_name, text. At most 30 a page (the feature), outermost first.
    """
    rank = F.coalesce(*[F.when(F.col("ui_type") == t, i) for i, (t, _) in enumerate(COMPONENT_RULES)])
    kind = F.coalesce(*[F.when(F.col("ui_type") == t, k) for t, k in COMPONENT_RULES])
    box = F.col("bounding_box")
    fits = (box.width >= MIN_WIDTH) & box.height.between(MIN_HEIGHT, MAX_HEIGHT)
    name = short_name()
    kept = rows.where(F.col("visible") & fits & (F.col("dom_path") != "")).withColumns({"rank": rank, "kind": kind, "name": name}).where("rank is not null and not (ui_type = 'region' and name = '')")
    first = kept.groupBy(*PAGE, "dom_path").agg(F.min(F.struct("rank", "pos", "element_id", "kind", "name")).alias("f"))
    order = W.partitionBy(*PAGE).orderBy(depth(F.col("dom_path")), "f.rank", "f.pos", "f.element_id")
    return (
        first.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= MAX_PER_PAGE)
        .select(*PAGE, "dom_path", "place", "f.kind", F.coalesce(F.nullif("f.name", F.lit("")), F.concat(F.lit("(unnamed "), "f.kind", F.lit(")"))).alias("name"))
    )


def revealed(before: DataFrame, after: DataFrame, scope: list[str]) -> DataFrame:
    """Elements visible after that were not visible before, within a scope of equal keys."""
    seen = before.where("visible and dom_path <> ''").select(*scope, "dom_path").distinct()
    return after.where("visible and dom_path <> ''").join(seen, [*scope, "dom_path"], "left_anti")


def classify_states(triggers: DataFrame, shown: DataFrame, scope: list[str]) -> DataFrame:
    """The state each trigger opened: kind, name and dom_path; triggers without one are absent.

    First the revealed target of its ``controls``, then the outermost revealed container,
    then for an expanding trigger the outermost revealed element. ``triggers`` needs the
    scope, trigger_name, controls, expands; ``shown`` the scope, category, ui_type,
    dom_path, accessible_name, text, pos.
    """
    kinds = F.create_map(*[F.lit(x) for kv in STATE_KINDS.items() for x in kv])
    rows = shown.select(*scope, "category", "dom_path", "pos", F.try_element_at(kinds, F.col("ui_type")).alias("kind"), short_name().alias("name"))
    joined = triggers.join(rows, scope)
    told = F.array_position("controls", F.col("dom_path"))
    rank = (
        F.when((told > 0) & F.col("kind").isNotNull(), 1)
        .when(F.col("category").isin(CONTAINERS) & F.col("kind").isNotNull(), 2)
        .when(F.col("expands"), 3)
    )
    order = F.struct(rank.alias("rank"), F.when(rank == 1, told).otherwise(0).alias("turn"), depth(F.col("dom_path")).alias("depth"), "pos", "dom_path")
    best = joined.where(rank.isNotNull()).groupBy(*scope, "trigger_name").agg(F.min_by(F.struct("kind", "name", "dom_path", rank.alias("rank")), order).alias("b"))
    by_trigger = F.col("b.rank") == 3
    return best.select(
        *scope,
        "trigger_name",
        F.when(by_trigger, "disclosure").otherwise(F.col("b.kind")).alias("kind"),
        F.when(by_trigger, F.col("trigger_name")).otherwise(F.coalesce(F.nullif("b.name", F.lit("")), "trigger_name")).alias("name"),
        "b.dom_path",
    )


def distinct_states(states: DataFrame) -> DataFrame:
    """States of equal signature as one with its number of instances, the first by ``seq``.

    The signature is kind and trigger label, or for unlabelled triggers the set of the
    first 8 control names. Needs seq, kind, trigger_label, control_names.
    """
    label = F.lower(strip(F.regexp_replace(F.coalesce("trigger_label", F.lit("")), SPACES, " ")))
    names = F.array_sort(F.array_distinct(F.filter(F.slice(F.coalesce("control_names", F.array().cast("array<string>")), 1, 8), lambda n: n != "")))
    return states.groupBy("kind", label.alias("label"), F.when(label == "", F.to_json(names)).otherwise("").alias("controls")).agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("instances")
    )


def score(before: str, after: str) -> dict[str, Column]:
    """What changed between two state structs (url, visible_dialogs, expanded, visible_interactive, content_hash)."""
    a, b = F.col(after), F.col(before)
    out = {
        "route_changed": ~a.url.eqNullSafe(b.url),
        "dialog_opened": a.visible_dialogs > b.visible_dialogs,
        "expanded_changed": ~a.expanded.eqNullSafe(b.expanded),
    }
    rest = ~a.visible_interactive.eqNullSafe(b.visible_interactive) | ~a.content_hash.eqNullSafe(b.content_hash)
    return out | {"dom_changed": out["route_changed"] | out["dialog_opened"] | out["expanded_changed"] | rest}


def tab_allowed(label: Column, tabs: str = "all", listed=(), excluded=()) -> Column:
    """Whether a tab may be opened: excluded always loses, then none, listed or all."""
    name = F.lower(strip(F.regexp_replace(F.coalesce(label, F.lit("")), SPACES, " ")))
    clean = lambda xs: [" ".join(x.split()).lower() for x in xs]
    permitted = F.lit(False) if tabs == "none" else name.isin(clean(listed)) if tabs == "listed" else F.lit(True)
    return permitted & ~name.isin(clean(excluded))


def probe_plan(decisions: DataFrame, max_interactions: int = 40) -> DataFrame:
    """Which allowed interactions of each page are executed within the budget (the feature)."""
    allowed = F.col("skipped_reason").isNull()
    turn = F.sum(allowed.cast("int")).over(W.partitionBy(*PAGE).orderBy("pos", "element_id"))
    return decisions.withColumn("executed", allowed & (turn <= max_interactions))


def probe_stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy(*PAGE).agg(
        F.count("*").alias("elements_seen"),
        F.count_if("executed").alias("executed"),
        F.count_if(~F.col("executed")).alias("observed_only"),
        F.count_if(F.col("safety") == "BLOCK").alias("blocked"),
        F.count_if(F.col("safety") == "CAUTION").alias("caution"),
    )


def inside(rows: DataFrame, containers: DataFrame, scope: list[str]) -> DataFrame:
    """Rows whose dom_path begins with a container's path: scope, container and the row.

    ``containers`` has the scope and container. Each row is unfolded to the prefixes of
    the lengths that containers of its scope have, so that the join is one of equal keys.
    """
    held = containers.select(*scope, "container").where("container <> ''").distinct()
    lengths = held.groupBy(*scope).agg(F.collect_set(F.length("container")).alias("__lengths"))
    cut = F.filter("__lengths", lambda n: n < F.length("dom_path"))
    unfolded = rows.where("dom_path <> ''").join(lengths, scope).withColumn("__n", F.explode(cut))
    return unfolded.withColumn("container", F.expr("substring(dom_path, 1, __n)")).drop("__lengths", "__n").join(held, [*scope, "container"])


#: Controls and headings kept of a state, and the categories of fields.
MAX_CONTROLS, MAX_HEADINGS = 60, 10
FIELD_CATEGORIES = ["input", "select", "textarea"]


def build_states(states: DataFrame, shown: DataFrame, scope: list[str]) -> DataFrame:
    """States with what they hold: their controls, fields and headings by name, in order.

    ``states`` come from :func:`classify_states`; ``shown`` are the revealed elements. A
    state without anything inside stays, with empty lists. Controls (the first 60) and
    headings (the first 10) are limited as the feature says; fields are among the controls.
    """
    found = inside(shown, states.withColumnRenamed("dom_path", "container"), scope).withColumn("label", short_name())
    order = W.partitionBy(*scope, "container").orderBy("pos", "dom_path")
    placed = found.withColumn("turn", F.row_number().over(order))
    heading = F.lower(F.coalesce("tag", F.lit(""))).rlike("^h[1-6]$") & (F.coalesce("text", F.lit("")) != "")
    listed = lambda test, what: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("turn", what.alias("v"))))), lambda s: s.v)
    held = placed.groupBy(*scope, F.col("container").alias("dom_path")).agg(
        listed(F.col("turn") <= MAX_CONTROLS, F.col("label")).alias("controls"),
        listed((F.col("turn") <= MAX_CONTROLS) & F.col("category").isin(FIELD_CATEGORIES), F.col("label")).alias("fields"),
        F.slice(listed(heading, F.col("text")), 1, MAX_HEADINGS).alias("headings"),
    )
    none = F.array().cast("array<string>")
    names = ("controls", "fields", "headings")
    return states.join(held, [*scope, "dom_path"], "left").withColumns({n: F.coalesce(n, none) for n in names})


def content_hash(text: Column) -> Column:
    """32-bit hash of a text with white space squeezed, as browsers' scripts compute it.

    h = 31 h + unit over the UTF-16 units, wrapped to a signed 32-bit number, as text.
    """
    plain = strip(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    whole = F.lit(1 << 32)

    def step(h: Column, c: Column) -> Column:
        point = F.ascii(c).cast("bigint")
        one = F.pmod(h * 31 + point, whole)
        high, low = F.lit(0xD7C0) + F.shiftright(point, 10), F.lit(0xDC00) + point.bitwiseAND(F.lit(1023))
        return F.when(point < 0x10000, one).otherwise(F.pmod(F.pmod(h * 31 + high, whole) * 31 + low, whole))

    h = F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.lit(0).cast("bigint"), step)
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("string")


def attach_crops(elements: DataFrame, crops: DataFrame) -> DataFrame:
    """Elements with the picture of the component at their dom_path, else their own.

    ``crops`` has crawl_id, url, dom_path and picture; of several the least counts.
    """
    one = crops.where("dom_path <> ''").groupBy(*PAGE, "dom_path").agg(F.min("picture").alias("picture"))
    return elements.join(one, [*PAGE, "dom_path"], "left").withColumn("clip_screenshot", F.coalesce("picture", "clip_screenshot")).drop("picture")
