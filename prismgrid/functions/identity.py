"""Identity, taxonomy, safety and meaning of one element, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismgrid.functions.text import any_word, filled, squeezed, strip

# Names and mappings that results must agree on.
INPUT_TYPES = {
    "button": "button", "submit": "button", "reset": "button", "checkbox": "checkbox", "radio": "radio",
    "range": "slider", "number": "spinbutton", "search": "searchbox", "file": "file-upload",
    "date": "date-input", "datetime-local": "date-input", "month": "date-input", "week": "date-input",
    "time": "time-input", "color": "color-picker", "password": "password-input", "email": "textbox",
    "tel": "textbox", "url": "textbox", "text": "textbox",
}
TAG_TYPES = {
    "a": "link", "button": "button", "nav": "navigation", "main": "main", "header": "banner",
    "footer": "contentinfo", "aside": "sidebar", "form": "form", "fieldset": "fieldset", "table": "table",
    "th": "columnheader", "img": "image", "select": "combobox", "textarea": "textbox", "dialog": "dialog",
    "ul": "list", "ol": "list", "li": "listitem", "details": "disclosure", "summary": "disclosure",
    "progress": "progressbar", "meter": "meter", "canvas": "canvas", "svg": "graphic", "video": "video",
    "audio": "audio", "iframe": "iframe", "option": "option", "datalist": "listbox", "h1": "heading",
    "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
}
ROLE_TYPES = {
    "alertdialog": "dialog", "complementary": "sidebar", "search": "search-landmark", "img": "image",
    "graphics-document": "graphic", "graphics-symbol": "graphic", "doc-pagelist": "pagination",
    "menuitemcheckbox": "menuitem", "menuitemradio": "menuitem", "switch": "checkbox", "textbox": "textbox",
}
UI_TYPES = [
    "navigation", "breadcrumb", "sidebar", "banner", "contentinfo", "main", "search-landmark", "region", "toolbar",
    "menubar", "menu", "menuitem", "tablist", "tab", "tabpanel", "tree", "treeitem", "disclosure", "heading",
    "dialog", "drawer", "tooltip", "popover", "table", "grid", "columnheader", "sortable-column", "list",
    "listitem", "pagination", "button", "link", "external-link", "download-link", "textbox", "password-input",
    "searchbox", "checkbox", "radio", "radiogroup", "combobox", "listbox", "option", "slider", "spinbutton",
    "date-input", "time-input", "color-picker", "file-upload", "rich-text-editor", "form", "fieldset", "alert",
    "status", "live-region", "progressbar", "meter", "validation-message", "image", "graphic", "canvas", "video",
    "audio", "iframe",
]
BLOCK_WORDS = [
    "delete", "remove", "destroy", "erase", "wipe", "purge", "pay", "purchase", "buy", "checkout", "order now",
    "place order", "send", "approve", "reject", "execute", "run", "deploy", "deactivate", "disable", "archive",
    "revoke", "unsubscribe", "logout", "log out", "sign out", "reset", "cancel subscription", "confirm", "publish",
    "merge", "transfer", "withdraw", "resend", "resubmit", "republish", "redeploy", "rerun", "retry", "terminate",
    "decommission", "suspend", "impersonate", "restore",
]
CAUTION_WORDS = [
    "submit", "save", "apply", "update", "create", "add", "upload", "search", "filter", "edit", "rename", "move",
    "import", "export", "invite", "share", "download",
]
PRIMARY_HINTS = [
    "create", "add", "new", "save", "submit", "continue", "next", "confirm", "apply", "done", "finish", "start",
    "generate", "upload",
]
FILTER_HINTS = ["search", "filter", "query", "find", "sort", "refine"]
ALLOWED_INTERACTIONS = ["tab", "expander", "disclosure", "menu"]
GENERATED = [r"(?i)[0-9a-f]{6,}", r"(__|--)[A-Za-z0-9]{4,}$", r"^[:\p{L}\p{N}_-]*\p{Nd}{3,}$"]


def _attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def looks_generated(value: Column) -> Column:
    """Ids and test ids that a build makes up; null and '' count as generated."""
    v = strip(value)
    odd = F.length(v) > 40
    for pattern in GENERATED:
        odd = odd | v.rlike(pattern)
    return F.coalesce(value == "", F.lit(True)) | odd


def structural_signature(path: Column) -> Column:
    """The chain of tags and positions of a DOM path, without ``#id`` parts."""
    parts = F.transform(F.split(F.coalesce(path, F.lit("")), " > "), lambda s: F.regexp_replace(strip(s), "#[^ >]+", ""))
    return F.array_join(F.filter(parts, lambda s: s != ""), " > ")


def shape_signature(path: Column) -> Column:
    return F.regexp_replace(structural_signature(path), r":nth-of-type\([0-9]+\)", "")


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def fingerprint_columns() -> dict[str, Column]:
    """strategy, fingerprint and component_signature of an element of a page."""
    role = F.coalesce(F.nullif("role", F.lit("")), F.col("tag"))
    name = F.substring(squeezed(F.coalesce(F.nullif("accessible_name", F.lit("")), F.col("text"))), 1, 80)
    test, own, named = _attribute("data-testid"), _attribute("id"), _attribute("name")
    landmark = F.col("landmark")
    path = F.col("dom_path")
    strategy = (
        F.when(~looks_generated(test), "data-testid")
        .when(~looks_generated(own), "id")
        .when(~looks_generated(named), "name")
        .otherwise("structural")
    )
    basis = (
        F.when(~looks_generated(test), _text("testid=", test))
        .when(~looks_generated(own), _text("id=", own))
        .when(~looks_generated(named), _text("name=", named, "|role=", role))
        .otherwise(_text("struct=", structural_signature(path), "|role=", role, "|name=", name, "|lm=", landmark))
    )
    shape = _text(F.col("category"), "|", role, "|", landmark, "|", shape_signature(path))
    return {
        "strategy": strategy,
        "fingerprint": F.substring(F.sha1(_text(F.col("url"), "|", F.col("category"), "|", basis)), 1, 16),
        "component_signature": F.substring(F.sha1(shape), 1, 12),
    }


def _mapped(key: Column, table: dict[str, str]) -> Column:
    """Lookup in a small fixed table; null if absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def ui_type() -> Column:
    """The recognised kind of an element, null if there is none."""
    described = F.lower(strip(_attribute("aria-roledescription")))
    tag = F.lower(strip(F.coalesce("tag", F.lit(""))))
    given = F.lower(F.element_at(F.split(strip(F.coalesce(_attribute("role"), F.lit(""))), " "), 1))
    of_input = F.when(
        tag == "input",
        F.coalesce(_mapped(F.lower(F.coalesce(_attribute("type"), F.lit("text"))), INPUT_TYPES), F.lit("textbox")),
    )
    blank = F.lit("")
    role = F.coalesce(F.nullif(given, blank), of_input, _mapped(tag, TAG_TYPES), F.lower(strip(F.col("role"))), blank)
    kind = F.coalesce(_mapped(role, ROLE_TYPES), role)
    words = F.lower(_text(F.col("accessible_name"), " ", _attribute("aria-label"), " ", _attribute("class")))
    sort = F.nullif(_attribute("aria-sort"), blank)
    return (
        F.when(described != "", F.substring(described, 1, 40))
        .when((kind == "navigation") & words.rlike("breadcrumb|bread crumb"), "breadcrumb")
        .when((kind == "navigation") & words.rlike("pagination|pager|paging"), "pagination")
        .when((kind == "dialog") & ~F.coalesce(_attribute("aria-modal") == "true", F.lit(False)), "drawer")
        .when((kind == "link") & _attribute("download").isNotNull(), "download-link")
        .when((kind == "link") & (_attribute("target") == "_blank"), "external-link")
        .when((kind == "columnheader") & sort.isNotNull(), "sortable-column")
        .when(kind.isin(UI_TYPES), kind)
        .when(_attribute("contenteditable").isin("", "true"), "rich-text-editor")
        .when(sort.isNotNull(), "sortable-column")
        .when(_attribute("aria-invalid") == "true", "validation-message")
        .when(F.nullif(_attribute("aria-live"), blank).isNotNull(), "live-region")
        .when(_attribute("aria-expanded").isNotNull(), "disclosure")
        .when(F.nullif(_attribute("aria-haspopup"), blank).isNotNull(), "menu")
    )


def safety_label(name: Column, block_extra=(), caution_extra=()) -> Column:
    """BLOCK, CAUTION or SAFE by whole words; camelCase counts as words. '' is SAFE."""
    words = squeezed(F.regexp_replace(F.coalesce(name, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " "))
    return (
        F.when(words.rlike(any_word([*BLOCK_WORDS, *map(str.lower, block_extra)])), "BLOCK")
        .when(words.rlike(any_word([*CAUTION_WORDS, *map(str.lower, caution_extra)])), "CAUTION")
        .otherwise("SAFE")
    )


def interaction_type() -> Column:
    """What acting on an element would be, by signals in order."""
    has = lambda k: F.coalesce(F.map_contains_key("attributes", F.lit(k)), F.lit(False))
    tag, role = F.lower(F.coalesce("tag", F.lit(""))), F.lower(F.coalesce("role", F.lit("")))
    return (
        F.when((role == "tab") | has("aria-selected"), "tab")
        .when((tag == "summary") | (has("open") & (tag == "details")), "disclosure")
        .when(has("aria-haspopup"), "menu")
        .when(has("aria-expanded"), "expander")
        .when(F.col("category") == "link", "navigation")
        .when(F.col("category") == "button", "button")
        .when(F.col("category").isin("input", "select", "textarea", "form"), "form-control")
        .otherwise("other")
    )


def decision(kind: Column, label: Column, never_touch=()) -> Column:
    """Why an element must not be acted on; null if it may be."""
    name = F.lower(F.coalesce(F.nullif("accessible_name", F.lit("")), F.col("text"), F.lit("")))
    path = F.lower(F.coalesce("dom_path", F.lit("")))
    banned = F.lit(None).cast("string")
    for rule in reversed([r for r in never_touch if r.strip()]):
        needle = rule.strip().lower()
        banned = F.when(name.contains(needle) | path.contains(needle), rule).otherwise(banned)
    return (
        F.when(~F.coalesce("visible", F.lit(True)) | ~F.coalesce("enabled", F.lit(True)), "not visible/enabled")
        .when(banned.isNotNull(), F.concat(F.lit("matches never_touch rule '"), banned, F.lit("'")))
        .when(F.nullif("frame", F.lit("")).isNotNull(), "inside an iframe (observed only)")
        .when(~kind.isin(ALLOWED_INTERACTIONS), F.concat(F.lit("type '"), kind, F.lit("' not on allow-list (observe only)")))
        .when(label != "SAFE", F.concat(F.lit("label "), label, F.lit(" (observe only)")))
    )


def meaning() -> Column:
    """struct(label, confidence, rationale) of an element by its category, role and name."""
    role = F.lower(F.coalesce("role", F.lit("")))
    name = F.lower(strip(F.coalesce("accessible_name", F.lit(""))))
    safety = safety_label(F.col("accessible_name"))
    category, landmark = F.col("category"), F.coalesce("landmark", F.lit(""))

    def says(label: str, confidence: str, why: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(why).alias("rationale"))

    of_filter = role.isin("searchbox", "combobox") | name.rlike("|".join(FILTER_HINTS)) | (landmark == "search")
    field = category.isin("input", "select", "textarea")
    return (
        F.when((category == "table") | role.isin("table", "grid"), says("data_display", "high", "table/grid"))
        .when(category == "image", says("informational", "high", "image"))
        .when(category == "nav", says("navigation", "high", "nav landmark"))
        .when(category == "dialog", says("informational", "medium", "dialog container"))
        .when(category == "form", says("form_input", "medium", "form container"))
        .when(field & of_filter, says("filter", "medium", "search/filter control"))
        .when(field, says("form_input", "high", "form field"))
        .when((category == "link") & (landmark == "navigation"), says("navigation", "high", "link in nav"))
        .when(category == "link", says("navigation", "medium", "content link"))
        .when((category == "button") & (safety == "BLOCK"), says("destructive", "high", "destructive label"))
        .when((category == "button") & name.rlike("|".join(PRIMARY_HINTS)), says("primary_action", "high", "primary verb"))
        .when((category == "button") & (safety == "CAUTION"), says("secondary_action", "medium", "state-changing"))
        .when(category == "button", says("secondary_action", "medium", "button"))
        .otherwise(says("informational", "low", "default"))
    )


def control_label() -> Column:
    """The name a person reads, a short text, or a placeholder of the kind."""
    text = filled(F.col("text"))
    return F.coalesce(
        filled(F.col("accessible_name")),
        F.when(F.length(text) <= 60, text),
        F.concat(F.lit("(unnamed "), F.coalesce(F.nullif("ui_type", F.lit("")), F.col("category"), F.lit("")), F.lit(")")),
    )
