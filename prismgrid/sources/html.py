"""Pages of HTML as element and heading rows, parsed once per page.

A tree is built with the standard library's tokenizer, void elements and implied ends of
paragraphs, list items, cells and options included; other repairs of a browser are not
made. What depends on layout (boxes, computed visibility) is not known: ``visible`` is
read from attributes only. Pages that cannot be parsed give no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

# Tags, roles and attributes that results must agree on.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = {
    "p", "ul", "ol", "li", "table", "tr", "td", "th", "div", "section", "article", "form", "nav", "header",
    "footer", "main", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "fieldset", "details", "dialog",
}
LANDMARK_TAGS = {"header": "banner", "nav": "navigation", "main": "main", "footer": "contentinfo", "aside": "complementary", "form": "form", "dialog": "dialog"}
LANDMARK_ROLES = [
    "navigation", "main", "banner", "contentinfo", "complementary", "dialog", "alertdialog", "form", "search",
    "region",
]
ROLES = {
    "button": "button", "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "aside": "complementary",
    "form": "form", "table": "table", "img": "img", "select": "combobox", "textarea": "textbox", "dialog": "dialog", "ul": "list",
    "ol": "list", "li": "listitem", "th": "columnheader", "td": "cell", "tr": "row", "summary": "button", "label": "label",
}
INPUT_ROLES = {"button": "button", "submit": "button", "reset": "button", "checkbox": "checkbox", "radio": "radio", "range": "slider", "search": "searchbox", "number": "spinbutton"}
NAMED_BY_CONTENT = {
    "button", "link", "heading", "cell", "columnheader", "rowheader", "row", "menuitem", "menuitemcheckbox",
    "menuitemradio", "option", "radio", "checkbox", "switch", "tab", "treeitem", "tooltip", "label",
}
ATTRIBUTES = [
    "id", "name", "type", "href", "role", "placeholder", "alt", "value", "title", "for", "data-testid",
    "aria-label", "aria-labelledby", "aria-describedby", "aria-expanded", "aria-controls", "aria-hidden",
    "aria-disabled", "disabled", "aria-haspopup", "aria-selected", "aria-pressed", "open", "aria-roledescription",
    "aria-modal", "aria-sort", "aria-live", "aria-invalid", "aria-required", "required", "contenteditable",
    "draggable", "target", "download", "accesskey", "aria-keyshortcuts", "class",
]
CHOICE_TYPES = {"checkbox", "radio", "range", "number", "date", "datetime-local", "month", "week", "time", "color"}
KEPT_VALUE_TYPES = CHOICE_TYPES | {"button", "submit", "reset", "hidden"}
OPTION_ROLES = {"listbox": {"option"}, "radiogroup": {"radio"}, "menu": {"menuitem", "menuitemcheckbox", "menuitemradio"}, "menubar": {"menuitem", "menuitemcheckbox", "menuitemradio"}, "tablist": {"tab"}}
MAX_OPTIONS, MAX_COLUMNS, MAX_SEGMENTS = 50, 40, 40


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag", "text")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.kids, self.text = tag, attrs, parent, [], []

    def walk(self):
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def content(self) -> str:
        parts = [k.content() if isinstance(k, Node) else k for k in self.kids if not (isinstance(k, Node) and k.tag in ("script", "style"))]
        return re.sub(r"\s+", " ", "".join(parts)).strip()

    def above(self):
        n = self.parent
        while n is not None and n.tag:
            yield n
            n = n.parent


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags):
        n = self.at
        while n.tag and n.tag not in tags:
            if n.tag in ("table", "ul", "ol", "select", "form", "div") and tags != {n.tag}:
                return
            n = n.parent
        if n.tag:
            self.at = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED_END:
            self._close(IMPLIED_END[tag])
        elif tag in BLOCKS and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.tag and n.tag != tag:
            n = n.parent
        if n.tag:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def first_word(text: str) -> str:
    return (text.split() or [""])[0]


def role(n: Node) -> str | None:
    if n.attrs.get("role", "").strip():
        return first_word(n.attrs["role"])
    if n.tag == "input":
        return INPUT_ROLES.get(n.attrs.get("type", "text").lower(), "textbox")
    if n.tag == "a":
        return "link" if "href" in n.attrs else None
    return "heading" if re.fullmatch("h[1-6]", n.tag) else ROLES.get(n.tag)


def category(n: Node) -> str | None:
    """The first group that claims the node, in order."""
    t, r, kind = n.tag, first_word(n.attrs.get("role", "")), n.attrs.get("type", "text").lower()
    pushing = t == "input" and kind in ("button", "submit", "reset")
    tests = (
        ("button", t == "button" or pushing or r == "button"),
        ("link", (t == "a" and "href" in n.attrs) or r == "link"),
        ("input", t == "input" and kind != "hidden"),
        ("select", t == "select" or r in ("combobox", "listbox")),
        ("textarea", t == "textarea"),
        ("form", t == "form" or r == "form"),
        ("image", t == "img" or r == "img"),
        ("table", t == "table" or r in ("table", "grid")),
        ("dialog", t == "dialog" or r in ("dialog", "alertdialog")),
        ("nav", t == "nav" or r == "navigation"),
        ("tab", r in ("tab", "tablist", "tabpanel")),
        ("menu", r in ("menu", "menubar", "menuitem", "toolbar")),
        ("tree", r in ("tree", "treeitem")),
        ("disclosure", t in ("details", "summary") or "aria-expanded" in n.attrs),
        ("status", r in ("alert", "status", "progressbar") or "aria-live" in n.attrs or t in ("progress", "meter")),
        ("tooltip", r == "tooltip"),
        ("region", t == "aside" or r in ("complementary", "search") or (r == "region" and "aria-label" in n.attrs)),
        ("columnheader", t == "th" or r == "columnheader" or "aria-sort" in n.attrs),
        ("editor", n.attrs.get("contenteditable") in ("true", "")),
        ("media", t in ("canvas", "video", "audio", "iframe") or (t == "svg" and "aria-label" in n.attrs)),
    )
    return next((c for c, hit in tests if hit), None)


CATEGORIES = [
    "button", "link", "input", "select", "textarea", "form", "image", "table", "dialog", "nav", "tab", "menu",
    "tree", "disclosure", "status", "tooltip", "region", "columnheader", "editor", "media",
]


class Page:
    """Facts of the nodes of one parsed page."""

    def __init__(self, html: str):
        tree = _Tree()
        tree.feed(html)
        tree.close()
        self.nodes = list(tree.root.walk())
        self.by_id: dict[str, Node] = {}
        self.labels: dict[str, Node] = {}
        seen: dict[str, int] = {}
        for n in self.nodes:
            if i := n.attrs.get("id"):
                self.by_id.setdefault(i, n)
                seen[i] = seen.get(i, 0) + 1
            if n.tag == "label" and n.attrs.get("for"):
                self.labels.setdefault(n.attrs["for"], n)
        self.unique = {i for i, k in seen.items() if k == 1}

    def path(self, n: Node) -> str:
        parts: list[str] = []
        while n is not None and n.tag and len(parts) < MAX_SEGMENTS:
            if n.attrs.get("id") in self.unique:
                parts.insert(0, f"#{n.attrs['id']}")
                break
            same = [k for k in n.parent.kids if isinstance(k, Node) and k.tag == n.tag]
            parts.insert(0, n.tag if len(same) == 1 else f"{n.tag}:nth-of-type({next(i for i, k in enumerate(same, 1) if k is n)})")
            n = n.parent
        return " > ".join(parts)

    def name(self, n: Node) -> str | None:
        a = n.attrs
        if a.get("aria-label", "").strip():
            return a["aria-label"].strip()
        referred = " ".join(filter(None, (self.by_id[i].content() for i in a.get("aria-labelledby", "").split() if i in self.by_id)))
        if referred:
            return referred
        if n.tag in ("input", "select", "textarea"):
            wrap = next((p for p in n.above() if p.tag == "label"), None)
            for label in (self.labels.get(a.get("id", "")), wrap):
                if label is not None and label.content():
                    return label.content()
            if n.tag == "input" and a.get("type", "").lower() in ("button", "submit", "reset") and a.get("value"):
                return a["value"]
            if a.get("placeholder", "").strip():
                return a["placeholder"].strip()
        if n.tag == "img" and a.get("alt", "").strip():
            return a["alt"].strip()
        own = n.content()
        if own and len(own) <= 200 and role(n) in NAMED_BY_CONTENT:
            return own
        if a.get("title", "").strip():
            return a["title"].strip()
        return own if own and len(own) <= 120 and "role" in a else None

    def landmark(self, n: Node) -> str | None:
        for p in n.above():
            r = first_word(p.attrs.get("role", ""))
            if r in LANDMARK_ROLES:
                return r
            if p.tag in LANDMARK_TAGS:
                return LANDMARK_TAGS[p.tag]
        return None

    def options(self, n: Node) -> list[tuple]:
        if n.tag in ("select", "datalist"):
            found = [k for k in n.walk() if k.tag == "option"]
            return [((k.attrs.get("label") or k.content())[:120], k.attrs.get("value", k.content())[:120] or None, "selected" in k.attrs, "disabled" in k.attrs) for k in found]
        wanted = OPTION_ROLES.get(first_word(n.attrs.get("role", "")), set())
        yes = lambda k, *names: any(k.attrs.get(x) == "true" for x in names)
        return [
            ((self.name(k) or k.content()[:120]), k.attrs.get("value") or None, yes(k, "aria-selected", "aria-checked"), yes(k, "aria-disabled") or "disabled" in k.attrs)
            for k in n.walk()
            if first_word(k.attrs.get("role", "")) in wanted
        ]

    def states(self, n: Node) -> dict[str, str]:
        a, st = n.attrs, {}
        box = n.tag == "input" and a.get("type", "").lower() in ("checkbox", "radio")
        st["checked"] = "true" if box and "checked" in a else a.get("aria-checked", "")
        for key in ("selected", "expanded", "pressed", "current", "sort", "invalid"):
            st[key] = a.get(f"aria-{key}", "")
        for key in ("required", "readonly"):
            st[key] = "true" if key in a else a.get(f"aria-{key}", "")
        if n.tag == "details" and "open" in a:
            st["open"] = "true"
        if n.tag == "select" and "multiple" in a:
            st["multiple"] = "true"
        if n.tag in ("input", "textarea") and (a.get("value") or (n.tag == "textarea" and n.content())) and a.get("type", "text").lower() not in KEPT_VALUE_TYPES:
            st["has_value"] = "true"
        quiet = ("checked", "required", "readonly", "multiple", "open")
        return {k: v for k, v in st.items() if v and not (v == "false" and k in quiet)}

    def value(self, n: Node, options: list[tuple]) -> str | None:
        if n.tag == "select":
            return ", ".join(o[0] for o in options if o[2])[:200] or None
        kind = n.attrs.get("type", "text").lower()
        return (n.attrs.get("value", "")[:120] or None) if n.tag == "input" and kind in CHOICE_TYPES else None

    def group(self, n: Node) -> str | None:
        for p in n.above():
            if first_word(p.attrs.get("role", "")) in ("group", "radiogroup") and self.name(p):
                return self.name(p)[:120]
        for p in n.above():
            if p.tag == "fieldset":
                legend = next((k.content() for k in p.walk() if k.tag == "legend"), "")
                if legend:
                    return legend[:120]
        return n.attrs.get("name", "")[:120] or None if n.attrs.get("type", "").lower() in ("radio", "checkbox") else None

    def shape(self, n: Node) -> tuple[list[str], int]:
        inside = list(n.walk())
        heads = [k for k in inside if first_word(k.attrs.get("role", "")) == "columnheader" or (k.tag == "th" and any(p.tag == "thead" for p in k.above()))]
        rows = [k for k in inside if k.tag == "tr"]
        if not heads and rows:
            heads = [k for k in rows[0].walk() if k.tag == "th"]
        columns = [c for c in (k.content() for k in heads) if c][:MAX_COLUMNS]
        body = [k for k in rows if any(p.tag == "tbody" for p in k.above())]
        return columns, len(body) or max(0, len(rows) - (1 if columns else 0))

    def visible(self, n: Node) -> bool:
        hidden = lambda k: "hidden" in k.attrs or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", k.attrs.get("style", ""))
        return not (hidden(n) or any(hidden(p) for p in n.above()) or n.attrs.get("type", "").lower() == "hidden")

    def elements(self) -> list[dict]:
        claimed = [(CATEGORIES.index(c), i, n, c) for i, n in enumerate(self.nodes) if (c := category(n))]
        claimed.sort(key=lambda x: x[:2])
        paths = {id(n): self.path(n) for _, _, n, _ in claimed}
        rows = []
        for pos, (_, _, n, c) in enumerate(claimed):
            options = self.options(n)
            keep = n.tag != "textarea" and (n.tag != "input" or n.attrs.get("type", "text").lower() in KEPT_VALUE_TYPES)
            attrs = {a: n.attrs[a][: 120 if a == "class" else 300] for a in ATTRIBUTES if a in n.attrs and (a != "value" or keep)}
            form = self.by_id.get(n.attrs["form"]) if n.attrs.get("form") else next((p for p in n.above() if p.tag == "form" or first_word(p.attrs.get("role", "")) == "form"), None)
            columns, count = self.shape(n) if c == "table" else ([], 0)
            refs = (n.attrs.get("aria-controls", "") + " " + n.attrs.get("aria-owns", "")).split()
            rows.append(
                {
                    "pos": pos, "category": c, "tag": n.tag, "role": role(n), "accessible_name": self.name(n), "text": n.content()[:500] or None,
                    "visible": self.visible(n), "enabled": "disabled" not in n.attrs and n.attrs.get("aria-disabled") != "true",
                    "attributes": attrs, "dom_path": paths[id(n)], "landmark": self.landmark(n), "options": options[:MAX_OPTIONS],
                    "option_count": len(options), "states": self.states(n), "value": self.value(n, options),
                    "parent_path": next((paths[id(p)] for p in n.above() if id(p) in paths), ""),
                    "controls": [paths[id(self.by_id[i])] for i in refs if i in self.by_id and id(self.by_id[i]) in paths],
                    "group_name": self.group(n), "owner_form": self.path(form) if form is not None else None,
                    "column_names": columns, "row_count": count,
                }
            )
        return rows

    def headings(self) -> list[dict]:
        found = [n for n in self.nodes if (re.fullmatch("h[1-6]", n.tag) or first_word(n.attrs.get("role", "")) == "heading") and n.content()]
        level = lambda n: int(n.tag[1]) if re.fullmatch("h[1-6]", n.tag) else int(n.attrs["aria-level"]) if n.attrs.get("aria-level", "").isdigit() else 2
        return [{"pos": i, "level": level(n), "text": n.content()[:200], "dom_path": self.path(n)} for i, n in enumerate(found)]


ELEMENT_SCHEMA = (
    "url string, pos int, category string, tag string, role string, accessible_name string, text string, visible boolean, enabled boolean, "
    "attributes map<string, string>, dom_path string, landmark string, "
    "options array<struct<label: string, value: string, selected: boolean, disabled: boolean>>, option_count int, states map<string, string>, "
    "value string, parent_path string, controls array<string>, group_name string, owner_form string, column_names array<string>, row_count int"
)


READERS = {
    "elements": lambda p: p.elements(),
    "headings": lambda p: p.headings(),
    "failures": lambda p: [*p.elements(), *p.headings()][:0],
}


def _rows(pages: DataFrame, method: str, schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in re.split(r", (?=\w+ \w)", schema)]

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for url, html in zip(pdf["url"], pdf["html"], strict=True):
                try:
                    rows += [{"url": url} | r for r in (READERS[method](Page(html)))]
                except (AssertionError, RecursionError, TypeError) as e:
                    if method == "failures":
                        rows.append({"url": url, "reason": type(e).__name__})
            for r in rows:
                for c in ("attributes", "states"):
                    if c in r:
                        r[c] = dict(r[c])
                if "options" in r:
                    r["options"] = [dict(zip(("label", "value", "selected", "disabled"), o, strict=True)) for o in r["options"]]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return pages.select("url", "html").where("html is not null").mapInPandas(parse, schema)


def elements_of(pages: DataFrame) -> DataFrame:
    """Element rows of pages (url, html), categories in order and document order within."""
    return _rows(pages, "elements", ELEMENT_SCHEMA)


def headings_of(pages: DataFrame) -> DataFrame:
    """Heading rows of pages (url, html): pos, level, text, dom_path."""
    return _rows(pages, "headings", "url string, pos int, level int, text string, dom_path string")


def unparsed_pages(pages: DataFrame) -> DataFrame:
    """Pages that :func:`elements_of` and :func:`headings_of` leave out: url and the reason."""
    return _rows(pages, "failures", "url string, reason string")
