"""Deeply nested capture bodies as flat tables, by columnar shredding.

A body is striped into one column per leaf path. Each entry has a value, a repetition
level (which repeated ancestor it continues; 0 starts a body) and a definition level (how
far down the path something is there). Tables are rebuilt from the level sequences alone:
places are counts of equal repetition levels since the last smaller one, and a row's
ancestor is the number of its ancestor's entries begun so far.

Definition levels: a repeated node adds one for a slot and one more for a non-null entry,
so that null entries keep their place without becoming records.

What of an entry is in no leaf and no nested table stands in its ``rest`` as JSON by path;
what options and boxes leave is in the rest of their element. A leaf or list that is there
but null or empty stands in rest too, an absent one does not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Repeated:
    """A repeated node: where its list is, the leaves of an entry, and nested nodes."""

    name: str
    path: tuple[str, ...]
    leaves: tuple[str, ...]
    children: tuple[Repeated, ...] = ()
    beside: tuple[tuple[str, ...], ...] = ()  # paths that other nodes hold
    rest: bool = True
    level: int = 1
    parent: Repeated | None = field(default=None, repr=False)

    def __post_init__(self):
        for c in self.children:
            c.parent = self
            c.settle(self.level + 1)
        self.lists = {*self.beside, *(c.path for c in self.children)}
        self.known = {tuple(leaf.split(".")) for leaf in self.leaves} | self.lists
        self.above = {p[:i] for p in self.known for i in range(1, len(p))}

    def settle(self, level: int):
        self.level = level
        for c in self.children:
            c.settle(level + 1)

    def walk(self) -> Iterator[Repeated]:
        yield self
        for c in self.children:
            yield from c.walk()


BOX = ("x", "y", "width", "height")
CAPTURE = (
    Repeated("capture", (), ("crawl_id", "schema_version", "config", "stats"), beside=(("navigation",), ("pages",))),
    Repeated("navigation", ("navigation",), ("from", "to", "label", "region", "control")),
    Repeated(
        "page",
        ("pages",),
        ("url", "depth", "page.title", "page.viewport"),
        (
            Repeated("out_link", ("out_links",), ("url", "label", "region", "control")),
            Repeated(
                "element",
                ("page", "elements"),
                ("dom_path", "category", "tag", "role", "accessible_name", "text", "states", "bounding_box"),
                (Repeated("option", ("options",), ("label", "value", "selected", "disabled"), rest=False),),
            ),
        ),
    ),
)
NODES = {n.name: n for root in CAPTURE for n in root.walk()}
TABLE_SCHEMA = {
    "navigation": "`from` string, `to` string, label string, region string, control string, rest string",
    "page": "url string, depth string, title string, viewport string, rest string",
    "element": "dom_path string, category string, tag string, role string, accessible_name string, text string, states string, rest string",
    "option": "label string, value string, selected string, disabled string",
    "bounding_box": "x double, y double, width double, height double",
    "capture": "crawl_id string, schema_version string, config string, stats string, rest string",
    "out_link": "url string, label string, region string, control string, rest string",
}
#: Tables whose records problem 4 asks for.
RECORDS = ("navigation", "page", "element", "option", "bounding_box")
TOP = ("capture", "navigation", "page")


def read_json(text: str | None):
    """The JSON value of a text, None if it can't be read; text in text is opened once more."""
    if text is None:
        return None
    try:
        value = json.loads(text.removeprefix("﻿"))
        if isinstance(value, str):
            value = json.loads(value.removeprefix("﻿"))
        return value
    except (ValueError, RecursionError):
        return None


def opened(value):
    """A container that was delivered as JSON text; other values as they are."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        found = read_json(value)
        return found if isinstance(found, (list, dict)) else value
    return value


def entries(value) -> list:
    """A list of entries; a single value stands for a list of one, empty ones for none."""
    value = opened(value)
    if isinstance(value, list):
        return value
    return [] if value is None or value == "" or value == {} else [value]


def reach(value, path: tuple[str, ...]):
    for name in path:
        value = opened(value)
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


def as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def number(value) -> float | None:
    try:
        return None if value is None or isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None


def box(value) -> tuple | None:
    """(x, y, width, height) of a box in any form; None if there is no box."""
    value = opened(value)
    if value is None or value in ("", {}, []):
        return None
    if isinstance(value, str):
        value = value.replace(",", " ").split()
    if isinstance(value, list):
        return tuple(number(v) for v in (value + [None] * 4)[:4])
    if isinstance(value, dict):
        flat = dict(value)
        for part in ("origin", "size"):
            if isinstance(value.get(part), dict):
                flat |= value[part]
        return tuple(number(flat.get(k)) for k in BOX)
    return (None,) * 4


def box_left(value):
    """What of a box its four numbers do not hold: its other fields, all of it, or None."""
    value = opened(value)
    if value is None or value in ("", {}, []):
        return None
    held = lambda v: v is None or number(v) is not None
    if isinstance(value, dict):
        parts = {p: value[p] for p in ("origin", "size") if isinstance(value.get(p), dict)}
        left = {
            k: v for k, v in value.items() if k not in parts and not (k in BOX and held(v) and not any(k in p for p in parts.values()))
        }
        for name, part in parts.items():
            again = parts.get("size", {}) if name == "origin" else {}
            left |= {f"{name}.{k}": v for k, v in part.items() if not (k in BOX and held(v) and k not in again)}
        return left or None
    parts = value.replace(",", " ").split() if isinstance(value, str) else value
    return None if isinstance(parts, list) and len(parts) <= 4 and all(map(held, parts)) else value


def left_of(node: Repeated, entry) -> dict:
    """What of an entry is in no leaf and no nested node, by path."""
    left: dict = {}

    def keep(path: tuple[str, ...], v):
        name = ".".join(path)
        while name in left:
            name += "~"
        left[name] = v

    def walk(value: dict, at: tuple[str, ...]):
        for k, v in value.items():
            path = (*at, k)
            if path in node.known:
                if v is None or (path in node.lists and v in ("", {}, [])):
                    keep(path, v)
                elif k == "bounding_box" and (more := box_left(v)) is not None:
                    keep(path, more)
            elif path in node.above and isinstance(inner := opened(v), dict) and inner:
                walk(inner, path)
            else:
                keep(path, v)

    if isinstance(entry, dict):
        walk(entry, ())
    return left


class Columns:
    """Striped leaf columns of a batch of bodies, and what is left of entries if wanted."""

    def __init__(self, rest: bool = False):
        self.rest = {n: [] for n in NODES} if rest else None
        self.levels = {n: ([], []) for n in NODES}  # repetition, definition; shared by a node's leaves
        self.values = {(n.name, leaf): [] for n in NODES.values() for leaf in n.leaves}
        self.bodies: list[int] = []

    def _gap(self, node: Repeated, r: int, d: int):
        for n in node.walk():
            rs, ds = self.levels[n.name]
            rs.append(r)
            ds.append(d)
            for leaf in n.leaves:
                self.values[n.name, leaf].append(None)
            if self.rest is not None:
                self.rest[n.name].append(None)

    def _stripe(self, node: Repeated, holder, r: int, d: int) -> dict:
        """Stripe a node's entries; returns what is left of them if it has no rest itself."""
        handed: dict = {}
        slots = entries(reach(holder, node.path))
        if not slots:
            self._gap(node, r, d)
        for i, entry in enumerate(slots):
            at = r if i == 0 else node.level
            if entry is None:
                self._gap(node, at, d + 1)
                continue
            entry = opened(entry)
            rs, ds = self.levels[node.name]
            rs.append(at)
            ds.append(d + 2)
            for leaf in node.leaves:
                if leaf == "bounding_box":
                    got = box(reach(entry, (leaf,)))
                elif not isinstance(entry, dict):
                    got = as_text(entry) if leaf == node.leaves[0] else None
                else:
                    got = as_text(reach(entry, tuple(leaf.split("."))))
                self.values[node.name, leaf].append(got)
            left = {} if self.rest is None else left_of(node, entry)
            for child in node.children:
                left |= self._stripe(child, entry, at, d + 2)
            if self.rest is not None:
                kept = left and node.rest
                self.rest[node.name].append(json.dumps(left, ensure_ascii=False, sort_keys=True) if kept else None)
                if left and not node.rest:
                    handed |= {f"{'.'.join(node.path)}[{i}].{k}": v for k, v in left.items()}
        return handed

    def add(self, body_id: int, body: str | None):
        """Stripe one body; an unreadable one leaves no trace."""
        found = read_json(body)
        if isinstance(found, dict):
            self.bodies.append(body_id)
            for root in CAPTURE:
                self._stripe(root, found, 0, 0)


def _places(r: np.ndarray, level: int) -> np.ndarray:
    """0-based place at one level: entries that continue it since it last began."""
    steps = np.cumsum(r == level)
    began = np.maximum.accumulate(np.where(r < level, np.arange(len(r)), 0))
    return steps - steps[began]


def assemble(columns: Columns, table: str) -> dict[str, list]:
    """Rows of one table from the level sequences: body, child_key, parent_ref, leaves."""
    node = NODES["element" if table == "bounding_box" else table]
    r, d = (np.array(x, dtype=np.int32) for x in columns.levels[node.name])
    there = d >= 2 * node.level
    if table == "bounding_box":
        boxes = columns.values["element", "bounding_box"]
        there &= np.fromiter((b is not None for b in boxes), bool, len(boxes))
    at = np.flatnonzero(there)
    chain = []
    n = node
    while n is not None:
        chain.insert(0, n)
        n = n.parent
    places = [_places(r, n.level)[at] for n in chain]
    body = (np.cumsum(r == 0) - 1)[at]
    if table in TOP:
        refs = [""] * len(at)
    elif table == "bounding_box":
        refs = [columns.values["element", "dom_path"][i] or "" for i in at]
    else:
        holder, leaf = (("page", "url"), ("element", "dom_path"))[table == "option"]
        begun = (np.cumsum(r <= node.parent.level) - 1)[at]
        refs = [columns.values[holder, leaf][i] or "" for i in begun]
    out = {
        "capture_id": [columns.bodies[b] for b in body],
        "child_key": [".".join(map(str, p)) for p in zip(*[x.tolist() for x in places], strict=True)],
        "parent_ref": refs,
    }
    if table == "bounding_box":
        for k, name in enumerate(BOX):
            out[name] = [columns.values["element", "bounding_box"][i][k] for i in at]
    else:
        for leaf in node.leaves:
            if leaf != "bounding_box":
                values = columns.values[node.name, leaf]
                out[leaf.split(".")[-1]] = [values[i] for i in at]
        if columns.rest is not None and node.rest:
            out["rest"] = [columns.rest[node.name][i] for i in at]
    return out


#: Characters of bodies that a task stripes before it passes their rows on; a longer body is alone.
HELD = 1 << 22


def _shredded(batches, make, rest: bool = False):
    for batch in batches:
        columns, held = Columns(rest), 0
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = body.as_py()
            if held and held + len(text) > HELD:
                yield from make(columns)
                columns, held = Columns(rest), 0
            columns.add(i, text)
            held += len(text)
        yield from make(columns)


def unread_bodies(raw_captures: DataFrame) -> DataFrame:
    """Bodies that give no records: (capture_id, reason), each once.

    ``blank`` is null or holds white space only, ``unreadable`` is no JSON or nested too
    deeply to be read, ``no object`` is other JSON. Rows without an id count, too.
    """

    def judge(batches):
        for batch in batches:
            ids, reasons = [], []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = body.as_py()
                found = read_json(text)
                if not isinstance(found, dict):
                    blank = text is None or not text.strip()
                    bare = text is not None and text.removeprefix("\ufeff").strip() == "null"
                    ids.append(i)
                    reasons.append("blank" if blank else "unreadable" if found is None and not bare else "no object")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reasons, pa.string())], names=["capture_id", "reason"])

    return raw_captures.select("capture_id", "body").mapInArrow(judge, "capture_id bigint, reason string").distinct()


def _bodies(raw_captures: DataFrame) -> DataFrame:
    return raw_captures.select("capture_id", "body").where("capture_id is not null and body is not null")


def capture_records(raw_captures: DataFrame) -> DataFrame:
    """Every record of every body: (capture_id, child_table, child_key, parent_ref).

    Null, blank and unreadable bodies have none, nor have rows without an id. Repeated
    deliveries of a body give one set of rows; where they differ, all their records
    stand. A missing url or dom_path of the parent is ''. Empty tables give no rows.
    """
    tables = RECORDS
    kind = pa.schema(
        [("capture_id", pa.int64()), ("child_table", pa.string()), ("child_key", pa.string()), ("parent_ref", pa.string())]
    )

    def make(columns):
        for t in tables:
            rows = assemble(columns, t)
            n = len(rows["child_key"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["capture_id"], pa.int64()),
                    pa.array([t] * n, pa.string()),
                    pa.array(rows["child_key"], pa.string()),
                    pa.array(rows["parent_ref"], pa.string()),
                ],
                schema=kind,
            )

    return (
        _bodies(raw_captures)
        .mapInArrow(
            lambda it: _shredded(it, make),
            "capture_id bigint, child_table string, child_key string, parent_ref string",
        )
        .distinct()
    )


def capture_table(raw_captures: DataFrame, table: str) -> DataFrame:
    """One flat table with keys to the parent: capture_id, child_key, parent_key, parent_ref, fields.

    ``parent_key`` is the child_key of the row's parent, '' at the top. Of several
    deliveries of a record the one with the greatest values is kept.
    """
    fields = TABLE_SCHEMA[table]
    names = [f.split()[0].strip("`") for f in fields.split(", ")]
    number_like = table == "bounding_box"

    def make(columns):
        rows = assemble(columns, table)
        arrays = [
            pa.array(rows["capture_id"], pa.int64()),
            pa.array(rows["child_key"], pa.string()),
            pa.array(rows["parent_ref"], pa.string()),
            *[pa.array(rows[n], pa.float64() if number_like else pa.string()) for n in names],
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["capture_id", "child_key", "parent_ref", *names])

    flat = _bodies(raw_captures).mapInArrow(
        lambda it: _shredded(it, make, True), f"capture_id bigint, child_key string, parent_ref string, {fields}"
    )
    parent = "" if table in TOP else r"\.[0-9]+$"
    parent_key = (
        F.col("child_key")
        if number_like
        else F.regexp_replace("child_key", parent, "") if parent else F.lit("")
    )
    kept = flat.groupBy("capture_id", "child_key").agg(F.max(F.struct("parent_ref", *names)).alias("m"))
    return kept.select("capture_id", "child_key", parent_key.alias("parent_key"), "m.*")
