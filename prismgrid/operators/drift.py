"""Schemas that drift between files: a catalogue of the lifespans of fields.

Every file is reduced to its footer: the fields that occur, the JSON types of their
non-null values and a bounded profile of the content. Lifespans are islands of
consecutive files per feed, field and type; where one starts or ends inside the feed
something changed. A field that ends where another of the same parent, type and content
starts was renamed, which gives the alias table that unifies the records.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.operators.shred import as_text, number, read_json
from prismgrid.session import checkpoint

KINDS = {bool: "boolean", int: "number", float: "number", str: "string", dict: "object", list: "array"}
_KIND_FEATURES = {t: f"t:{k}" for t, k in KINDS.items()}
#: Content features are hashed into this many classes per group, so footers stay small.
CLASSES = 64
#: Files of a feed that one task orders.
BLOCK = 1024
#: Files whose footers a task holds before it passes them on.
FILES_HELD = 2000
#: Least share of content in common, averaged over the groups, for a rename.
LEAST_ALIKE = 0.3
_RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"a(?: a)+"), "a a"))
_DIGITS = re.compile(r"\d")
_NINES = str.maketrans("012345678", "9" * 9)


def _class(group: str, text: str) -> str:
    return f"{group}{zlib.crc32(text.encode(errors='surrogatepass')) % CLASSES}"


def _text_features(value: str) -> tuple[str, ...]:
    shape = value.translate(_NINES)
    for pattern, sign in _RUNS:
        shape = pattern.sub(sign, shape)
    words = value.lower().split()
    length = "w" if len(words) > 3 else int(math.log2(len(value) + 1))
    return (_class("s", shape), f"l{length}", *[_class("v", w) for w in words if not _DIGITS.search(w)])


#: Features of short texts, which repeat, are remembered; they are the same either way.
_short_features = functools.lru_cache(maxsize=1 << 16)(_text_features)


@functools.lru_cache(maxsize=1 << 16)
def _number_features(value: float, whole: bool) -> tuple[str, ...]:
    if not whole and not math.isfinite(value):
        return ("m?",)
    kind, size = "i" if whole else "f", abs(value) + 1
    return (f"m{kind}{int(math.log2(size))}", f"c{kind}{int(math.log10(size))}")


def features(value) -> tuple[str, ...]:
    """Bounded classes of one value's content: shape, length and vocabulary."""
    if isinstance(value, str):
        return _short_features(value) if len(value) < 200 else _text_features(value)
    if isinstance(value, bool):
        return ("b1" if value else "b0",)
    if isinstance(value, (int, float)):
        return _number_features(value, isinstance(value, int))
    if isinstance(value, dict):
        return tuple(_class("k", k) for k in value)
    return ()


def footer(records: list, seen: dict) -> None:
    """Add readable records of one file to ``seen``: (path) -> counts of kinds and features."""

    def visit(value, path: str):
        note = seen.get(path)
        if note is None:
            note = seen[path] = {"n": 0}
        note["n"] += 1
        if value is None:
            return
        kind = _KIND_FEATURES[type(value)]
        note[kind] = note.get(kind, 0) + 1
        for f in features(value):
            note[f] = note.get(f, 0) + 1
        if isinstance(value, dict):
            for k, v in value.items():
                visit(v, f"{path}.{k}")
        elif isinstance(value, list):
            for v in value:
                for f in features(v):
                    note["e" + f] = note.get("e" + f, 0) + 1
                if isinstance(v, dict):
                    for k, x in v.items():
                        visit(x, f"{path}[].{k}")
                elif isinstance(v, list):
                    visit(v, f"{path}[]")

    for record in records:
        for k, v in record.items():
            visit(v, k)


def file_footers(crawl_files: DataFrame) -> DataFrame:
    """(feed, file_no, path, parts) of every file: counts of types and content features.

    A part is what one task read of the file, as text ``feature=count|...`` with types as
    ``t:...``; it is taken apart only where contents are compared.

    Lines that cannot be read, or hold no object, are skipped; a file with no readable
    record has no footer. Lines without a feed or file number are left out.
    """

    def rows_of(files):
        rows = [(*k, p, "|".join([f"{f}={n}" for f, n in note.items()])) for k, seen in files.items() for p, note in seen.items()]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
            names=["feed", "file_no", "path", "part"],
        )

    def stripe(batches):
        files: dict = {}
        for batch in batches:
            for feed, no, record in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                value = read_json(record)
                if isinstance(value, dict):
                    footer([value], files.setdefault((feed, no), {}))
            if len(files) > FILES_HELD:
                yield rows_of(files)
                files = {}
        yield rows_of(files)

    # A task gives a file's field one row, so the list below is no longer than the tasks
    # that read of the file.
    return (
        crawl_files.where("feed is not null and file_no is not null and record is not null")
        .select("feed", "file_no", "record")
        .mapInArrow(stripe, "feed string, file_no int, path string, part string")
        .groupBy("feed", "file_no", "path")
        .agg(F.collect_list("part").alias("parts"))
    )


def _places(footers: DataFrame) -> DataFrame:
    """(feed, file_no, seq, next_file, files): each file's place in its feed, from 1.

    Places are counted per block of file numbers and shifted by what lies before, so that
    no task orders all files of a feed.
    """
    files = footers.select("feed", "file_no").distinct().withColumn("block", F.floor(F.col("file_no") / BLOCK))
    feed = W.partitionBy("feed")
    blocks = (
        files.groupBy("feed", "block")
        .agg(F.count("*").alias("n"), F.min("file_no").alias("first"))
        .select(
            "feed",
            "block",
            F.coalesce(F.sum("n").over(feed.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
            F.lead("first").over(feed.orderBy("block")).alias("next_block"),
            F.sum("n").over(feed).alias("files"),
        )
    )
    inside = W.partitionBy("feed", "block").orderBy("file_no")
    return (
        files.select("*", F.row_number().over(inside).alias("inside"), F.lead("file_no").over(inside).alias("after"))
        .join(blocks, ["feed", "block"])
        .select(
            "feed",
            "file_no",
            (F.col("earlier") + F.col("inside")).alias("seq"),
            F.coalesce("after", "next_block").alias("next_file"),
            "files",
        )
    )


def _beside(rows: DataFrame) -> DataFrame:
    """Adds place and kind of the same field's file before and after, found by lag and lead.

    The places are cut into blocks; the rows at their edges are lent to the neighbouring
    block, so that a field of a feed with very many files is no single task's.
    """
    at = F.floor(F.col("seq") / BLOCK)
    blocks = F.array_compact(
        F.array(
            F.struct(at.alias("block"), F.lit(False).alias("lent")),
            F.when(F.col("seq") % BLOCK == 0, F.struct((at - 1).alias("block"), F.lit(True).alias("lent"))),
            F.when(F.col("seq") % BLOCK == BLOCK - 1, F.struct((at + 1).alias("block"), F.lit(True).alias("lent"))),
        )
    )
    path = W.partitionBy("feed", "path", "block").orderBy("seq")
    return (
        rows.select("*", F.inline(blocks))
        .select(
            "*",
            F.lag("seq").over(path).alias("seq_before"),
            F.lag("kind").over(path).alias("kind_before"),
            F.lead("seq").over(path).alias("seq_after"),
            F.lead("kind").over(path).alias("kind_after"),
        )
        .where("not lent")
        .drop("block", "lent")
    )


def catalogue(footers: DataFrame) -> DataFrame:
    """Lifespans with what lies beside them: LIFESPAN and next_file, kind_before, kind_after.

    An island is a run of consecutive files of a feed in which a field has one kind.
    ``next_file`` is the file after the island's last; ``kind_before`` and ``kind_after``
    are the field's kinds in the files beside the island, null where it is absent.
    """
    types = F.flatten(F.transform("parts", lambda p: F.regexp_extract_all(p, F.lit("t:([a-z]+)="), F.lit(1))))
    kind = F.array_join(F.array_sort(F.array_distinct(types)), "|")
    rows = _beside(footers.select("feed", "file_no", "path", kind.alias("kind")).join(_places(footers), ["feed", "file_no"]))
    before = F.when(F.col("seq_before") == F.col("seq") - 1, F.col("kind_before"))
    after = F.when(F.col("seq_after") == F.col("seq") + 1, F.col("kind_after"))
    edges = (
        rows.withColumns({"kind_before": before, "kind_after": after})
        .withColumns(
            {
                "first": ~F.coalesce(F.col("kind_before") == F.col("kind"), F.lit(False)),
                "last": ~F.coalesce(F.col("kind_after") == F.col("kind"), F.lit(False)),
            }
        )
        .where("first or last")
    )
    # Only the ends of islands are left, so this order is as long as the changes are many.
    island = W.partitionBy("feed", "path", "kind").orderBy("seq")
    own = F.struct("seq", "file_no", "next_file", "kind_after")
    return (
        edges.withColumn("end", F.when(F.col("last"), own).otherwise(F.lead(own).over(island)))
        .where("first")
        .select(
            "feed",
            "path",
            "kind",
            F.col("file_no").alias("first_file"),
            F.col("end.file_no").alias("last_file"),
            (F.col("end.seq") - F.col("seq") + 1).alias("n_files"),
            (F.col("seq") > 1).alias("starts"),
            (F.col("end.seq") < F.col("files")).alias("ends"),
            "end.next_file",
            "kind_before",
            "end.kind_after",
        )
    )


LIFESPAN = ["feed", "path", "kind", "first_file", "last_file", "n_files", "starts", "ends"]


def lifespans(footers: DataFrame) -> DataFrame:
    """Islands: (feed, path, kind, first_file, last_file, n_files, starts, ends).

    ``starts`` and ``ends`` tell whether the island begins after the feed's first file or
    ends before its last. A file in which all values are null has kind ''.
    """
    return catalogue(footers).select(LIFESPAN)


def _group(feature: str) -> str:
    return feature[:2] if feature[0] == "e" else feature[0]


def profile(parts: list[str]) -> dict[str, dict[str, int]]:
    """Counts of content features of all parts, by group."""
    groups: dict[str, dict[str, int]] = {}
    for part in parts:
        for cell in part.split("|"):
            f, _, n = cell.rpartition("=")
            if f != "n" and not f.startswith("t:"):
                group = groups.setdefault(_group(f), {})
                group[f] = group.get(f, 0) + int(n)
    return groups


def alike(a: dict, b: dict) -> float:
    """Content in common of two profiles: mean overlap over the groups that either has."""
    groups = a.keys() | b.keys()
    total = 0.0
    for g in groups & a.keys() & b.keys():
        x, y = a[g], b[g]
        nx, ny = sum(x.values()), sum(y.values())
        total += sum(min(n / nx, y.get(f, 0) / ny) for f, n in x.items())
    return total / len(groups) if groups else 0.0


def resolve(events: list[tuple]) -> list[tuple]:
    """Changes of one file from its events (event, path, kind, kind_before, parts).

    Gives (field_path, change_kind, new_path, old_type, new_type). Ends and starts of one
    parent and kind whose contents are alike are renames, the most alike first; what lies
    below a changed container is left out.
    """
    ends, starts = {}, {}
    for event, path, kind, _, parts in events:
        if kind and event != "retyped":
            side = ends if event == "end" else starts
            side.setdefault((path[: path.rfind(".") + 1], kind), []).append((path, profile(parts)))
    pairs = []
    for key, gone in ends.items():
        for old, a in gone:
            for new, b in starts.get(key, ()):
                score = alike(a, b)
                if score >= LEAST_ALIKE:
                    pairs.append((-score, old, new, key[1]))
    renamed, taken = {}, set()
    for _, old, new, kind in sorted(pairs):
        if old not in renamed and new not in taken:
            renamed[old] = (new, kind)
            taken.add(new)
    changes = [(old, "renamed", new, kind, kind) for old, (new, kind) in renamed.items()]
    for event, path, kind, before, _ in events:
        if event == "retyped":
            changes.append((path, "retyped", "", before, kind))
        elif event == "end" and path not in renamed:
            changes.append((path, "removed", "", kind, ""))
        elif event == "start" and path not in taken:
            changes.append((path, "added", "", "", kind))
    tops = {p for c in changes if any(k in t for t in c[3:] for k in ("object", "array")) for p in (c[0], c[2]) if p}

    def above(path: str):
        for i, sign in enumerate(path):
            if sign == "." or path.startswith("[]", i):
                yield path[:i]

    return [c for c in changes if not any(p in tops for p in above(c[0]))]


def schema_changes(crawl_files: DataFrame, footers: DataFrame | None = None) -> DataFrame:
    """Changes of each file against the feed's previous one.

    Columns: feed, file_no, field_path, change_kind (added, removed, renamed, retyped),
    new_path, old_type, new_type. Read from the catalogue of lifespans: where an island
    starts or ends inside the feed, its field was added, removed or changed its type. Below a
    container that is renamed, added, removed or changes between object, array and scalar
    nothing is reported. A field whose values are all null has no type and no content: it
    is neither retyped nor renamed. Of several candidates the most alike are paired first,
    ties by name. Repeated lines and lines that cannot be read change nothing; empty
    tables give no rows. A task holds the changed fields of one file at a time.
    """
    # Read twice, for the catalogue and for contents; the footers are what is left of the records.
    footers = checkpoint(file_footers(crawl_files)) if footers is None else footers
    event = F.array_compact(
        F.array(
            F.when(
                F.col("starts") & F.col("kind_before").isNull(),
                F.struct(F.lit("start").alias("event"), F.col("first_file").alias("at_file"), F.col("first_file").alias("file_no")),
            ),
            F.when(
                F.col("ends") & F.col("kind_after").isNull(),
                F.struct(F.lit("end").alias("event"), F.col("next_file").alias("at_file"), F.col("last_file").alias("file_no")),
            ),
            F.when(
                F.col("starts") & (F.col("kind") != "") & (F.col("kind_before") != ""),
                F.struct(F.lit("retyped").alias("event"), F.col("first_file").alias("at_file"), F.lit(None).cast("int").alias("file_no")),
            ),
        )
    )
    events = catalogue(footers).select("feed", "path", "kind", "kind_before", F.inline(event))
    held = F.struct("event", "path", "kind", F.coalesce("kind_before", F.lit("")).alias("before"), F.coalesce("parts", F.array()).alias("parts"))
    files = (
        events.join(footers, ["feed", "file_no", "path"], "left")
        .groupBy("feed", "at_file")
        .agg(F.collect_list(held).alias("events"))
    )
    names = ["feed", "file_no", "field_path", "change_kind", "new_path", "old_type", "new_type"]

    def resolved(batches):
        for batch in batches:
            rows = []
            for feed, no, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(feed, no, *c) for c in resolve([tuple(e.values()) for e in found])]
            kinds = [pa.string(), pa.int32()] + [pa.string()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return files.mapInArrow(resolved, ", ".join(f"{n} {'int' if n == 'file_no' else 'string'}" for n in names))


#: Declared fields of a record: path -> (column, type).
MODEL = {
    "crawl_id": ("crawl_id", "string"),
    "run_id": ("run_id", "string"),
    "schema_version": ("schema_version", "version"),
    "engine_version": ("engine_version", "string"),
    "started_at": ("started_at", "time"),
    "finished_at": ("finished_at", "time"),
    "auth_used": ("auth_used", "boolean"),
    "config.start_url": ("start_url", "string"),
    "config.strategy": ("strategy", "string"),
    "config.max_pages": ("max_pages", "number"),
    "config.max_depth": ("max_depth", "number"),
    "stats.pages_crawled": ("pages_crawled", "number"),
    "stats.pages_failed": ("pages_failed", "number"),
    "stats.runtime_seconds": ("runtime_seconds", "number"),
    "navigation[].from": ("nav_from", "string"),
    "navigation[].to": ("nav_to", "string"),
    "navigation[].label": ("nav_label", "string"),
    "navigation[].region": ("nav_region", "string"),
    "navigation[].control": ("nav_control", "string"),
}
CONTAINERS = sorted({p.split(".")[0].removesuffix("[]") for p in MODEL if "." in p})


def _beside_containers(known: dict[str, str]) -> dict[str, str]:
    """Children of a container under each of its other names, where these are not known."""
    names: dict[str, list[str]] = {}
    for alias, canonical in known.items():
        if canonical in CONTAINERS:
            names.setdefault(canonical, []).append(alias)
    found: dict[str, str] = {}
    for alias, canonical in sorted(known.items(), key=lambda x: (x[1], x[0])):
        holder, sign, child = alias.partition("[]." if "[]." in alias else ".")
        for other in names.get(known.get(holder, ""), ()):
            path = f"{other}{sign}{child}"
            if sign and path not in known:
                found.setdefault(path, canonical)
    return found


def alias_table(changes: DataFrame) -> DataFrame:
    """(canonical, alias): names that renames lead to from a declared field, in any feed.

    Renames are followed in both directions, a step per round, until no name is new; the
    table is bounded by the distinct field names of declared parents. Each alias belongs
    to one canonical name, the least. Below a renamed container no rename is reported, so
    what its children are called under one of its names they may be called under each.
    """
    spark = changes.sparkSession
    links = changes.where("change_kind = 'renamed'").select("field_path", "new_path").distinct()
    links = links.unionByName(links.select(F.col("new_path").alias("field_path"), F.col("field_path").alias("new_path"))).distinct()
    known = {p: p for p in [*MODEL, *CONTAINERS]}
    fresh = dict(known)
    while fresh:
        step = spark.createDataFrame([(a, c) for a, c in fresh.items()], "alias string, canonical string")
        found = (
            links.join(step, links["field_path"] == step["alias"])
            .groupBy("new_path")
            .agg(F.min("canonical").alias("canonical"))
            .toLocalIterator()
        )
        fresh = {r.new_path: r.canonical for r in found if r.new_path not in known}
        known |= fresh
        beside = _beside_containers(known)
        fresh |= beside
        known |= beside
    return spark.createDataFrame([(c, a) for a, c in sorted(known.items())], "canonical string, alias string")


def feed_aliases(changes: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(feed, alias, canonical, from_file): where a feed's own rename speaks against the table.

    One name may stand for different fields in different feeds; the alias table holds one
    meaning. In a feed that renames a declared field (or a name of one) to such a name,
    the name has that field's meaning from the file of the rename on.
    """
    rows = changes.where("change_kind = 'renamed'").select("feed", "file_no", "field_path", "new_path").distinct()
    table = changes.sparkSession.createDataFrame([(a, c) for a, c in sorted(aliases.items())], "name string, canonical string")
    old = table.select(F.col("name").alias("field_path"), F.col("canonical").alias("meant"))
    new = table.select(F.col("name").alias("new_path"), F.col("canonical").alias("listed"))
    own = rows.join(old, "field_path").join(new, "new_path").where("meant <> listed")
    return own.groupBy("feed", F.col("new_path").alias("alias"), F.col("meant").alias("canonical")).agg(F.min("file_no").alias("from_file"))


def _truth(value):
    return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())


def _moment(value):
    try:
        return datetime.fromtimestamp(value, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (ValueError, OverflowError, OSError):
        return None


def _dotted(value):
    return ".".join(str(value.get(k, 0)) for k in ("major", "minor", "patch"))


def _titled(value):
    return as_text(value.get("text", value))


def _joined(value):
    return ", ".join(as_text(v) or "" for v in value)


#: Casts to a declared type, by the JSON type of what is cast; '' stands for all others.
CASTS = {
    "number": {"": number},
    "boolean": {"": _truth},
    "time": {"number": _moment, "": as_text},
    "version": {"object": _dotted, "array": _joined, "": as_text},
    "string": {"object": _titled, "array": _joined, "": as_text},
}


def generate_casts(aliases: dict[str, str]) -> dict[tuple[str, str], object]:
    """The cast of every name of a declared field, by the name and the JSON type of the value."""
    return {
        (canonical, kind): CASTS[MODEL[canonical][1]].get(kind, CASTS[MODEL[canonical][1]][""])
        for canonical in {c for c in aliases.values() if c in MODEL}
        for kind in KINDS.values()
    }


def not_held(value, cast, kind: str):
    """What of a value its cast does not hold: the value, an object's other fields, or None."""
    if value is None:
        return None
    if cast is None:
        return value
    if isinstance(value, dict):
        used = ("major", "minor", "patch") if kind == "version" else ("text",) if "text" in value else value
        return {k: v for k, v in value.items() if k not in used} or None
    if kind == "time" and isinstance(value, float) and value % 1:
        return value
    return None


def unified_records(crawl_files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All readable records in one table of declared columns, plus what is left as JSON.

    One row per distinct (feed, file_no, line_no, record). Renamed fields are found by
    the alias table, other types are cast; what a cast cannot read is null and left in
    ``rest``. ``rest`` goes by path; ``navigation[2].weight`` belongs to the entry at
    place 2 of the column, where an entry that is no object is null. Of two names of one
    field in a record the first with a value fills the column, the other is left and its
    path is listed in ``collisions``. A feed's own renames go before those of other feeds.
    """
    changes = checkpoint(schema_changes(crawl_files)) if changes is None else changes
    aliases = {r.alias: r.canonical for r in alias_table(changes).toLocalIterator()}
    casts = generate_casts(aliases)
    # Only contradictions, at most one a feed and name.
    own: dict[str, list] = {}
    for r in sorted(feed_aliases(changes, aliases).toLocalIterator(), key=lambda r: (r.feed, r.from_file, r.alias)):
        own.setdefault(r.feed, []).append((r.from_file, r.alias, r.canonical))
    shared = aliases
    scalars = [p for p in MODEL if "[]" not in p]
    nav = [p for p in MODEL if "[]" in p]
    simple = {"number": "double", "boolean": "boolean"}
    schema = ", ".join(
        ["feed string", "file_no int", "line_no int"]
        + [f"{MODEL[p][0]} {simple.get(MODEL[p][1], 'string')}" for p in scalars]
        + ["navigation array<struct<" + ", ".join(f"{MODEL[p][0]}: string" for p in nav) + ">>", "rest string", "collisions array<string>"]
    )

    def unify(record: dict, aliases: dict[str, str]) -> tuple[dict, list, dict, list]:
        got, entries, rest, collisions = {}, [], {}, []

        def keep(path: str, v):
            while path in rest:
                path += "~"
            rest[path] = v

        def put(to: dict, name: str, v, place: str, raw: str):
            """Cast into a declared field; what its column does not hold is kept."""
            if to.get(name) is not None:
                if v is not None:
                    keep(raw, v)
                    collisions.append(raw)
                return
            to[name] = None if v is None else casts[name, KINDS[type(v)]](v)
            left = not_held(v, to[name], MODEL[name][1])
            if left is not None:
                keep(place, left)

        for k, v in record.items():
            name = aliases.get(k, k)
            if name in MODEL:
                put(got, name, v, name, k)
            elif isinstance(v, dict) and f"{name}." in {p.split(".")[0] + "." for p in scalars if "." in p}:
                for k2, v2 in v.items():
                    deep = aliases.get(f"{k}.{k2}", aliases.get(f"{name}.{k2}", f"{name}.{k2}"))
                    if deep in MODEL:
                        put(got, deep, v2, deep, f"{k}.{k2}")
                    else:
                        keep(f"{name}.{k2}", v2)
            elif name == "navigation" and (v is None or isinstance(v, (dict, list))):
                for entry in v if isinstance(v, list) else [] if v is None else [v]:
                    place = f"navigation[{len(entries)}]"
                    if not isinstance(entry, dict):
                        entries.append(None)
                        if entry is not None:
                            keep(place, entry)
                        continue
                    one = {}
                    for k2, v2 in entry.items():
                        deep = aliases.get(f"{k}[].{k2}", aliases.get(f"{name}[].{k2}", f"{name}[].{k2}"))
                        if deep in MODEL:
                            put(one, deep, v2, f"{place}.{deep.split('.')[1]}", f"{place}.{k2}")
                        else:
                            keep(f"{place}.{k2}", v2)
                    entries.append({MODEL[p][0]: one.get(p) for p in nav})
            else:
                keep(name, v)
        return got, entries, rest, collisions

    def names_of(feed, no) -> dict[str, str]:
        return shared | {a: c for start, a, c in own[feed] if no is not None and start <= no} if feed in own else shared

    def read(batches):
        import pandas as pd

        names = [MODEL[p][0] for p in scalars]
        for pdf in batches:
            rows = []
            for feed, no, line, record in pdf.itertuples(index=False):
                value = read_json(record)
                if isinstance(value, dict):
                    got, entries, rest, collisions = unify(value, names_of(feed, no))
                    left = json.dumps(rest, ensure_ascii=False, sort_keys=True)
                    rows.append((feed, no, line, *[got.get(p) for p in scalars], entries, left, collisions))
            yield pd.DataFrame(rows, columns=["feed", "file_no", "line_no", *names, "navigation", "rest", "collisions"], dtype=object)

    return (
        crawl_files.where("record is not null")
        .select("feed", "file_no", "line_no", "record")
        .distinct()
        .mapInPandas(read, schema)
    )
