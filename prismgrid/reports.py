"""Short Markdown from small result tables; nothing here reads whole tables.

Each function takes rows that were reduced before: per-crawl totals or the first few
examples, chosen by a stated order. HTML, pictures and prose by a model are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path

EXAMPLES = 5


def counted(n: int, noun: str) -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


def change_summary(stats: dict[str, int], examples: dict[str, list[str]]) -> str:
    """A paragraph on a comparison from its counters, then the first examples of each kind."""
    if not any(stats.values()):
        return "The two captures hold the same pages and controls."
    said = [counted(n, k.replace("_", " ").replace("pages", "page").replace("elements", "control")) for k, n in sorted(stats.items()) if n]
    lines = ["Between the two captures: " + ", ".join(said) + "."]
    for kind, names in sorted(examples.items()):
        if names:
            more = len(names) - EXAMPLES
            lines.append(f"- **{kind}**: " + ", ".join(f"`{n}`" for n in names[:EXAMPLES]) + (f" and {more} more" if more > 0 else ""))
    return "\n\n".join([lines[0], "\n".join(lines[1:])]).strip()


def table_markdown(header: list[str], rows: Iterable[tuple]) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(header) + " |", "|" + "---|" * len(header), *body])


def mermaid(edges: Iterable[tuple[str, str, str]], screens: list[str]) -> str:
    """A flow chart of the distinct labelled edges between the given screens."""
    name = {u: f"s{i}" for i, u in enumerate(screens)}
    lines = ["flowchart LR", *[f'  {n}["{u}"]' for u, n in name.items()]]
    for a, b, label in dict.fromkeys(edges):
        if a in name and b in name and a != b:
            lines.append(f"  {name[a]} -->|{label}| {name[b]}" if label else f"  {name[a]} --> {name[b]}")
    return "\n".join(lines)


def splice(path: str, mark: str, text: str) -> None:
    """Replace the marked part of a file, or append it; doing it twice changes nothing."""
    begin, end = f"<!-- {mark} -->", f"<!-- /{mark} -->"
    file = Path(path)
    old = file.read_text(encoding="utf-8") if file.exists() else ""
    part = f"{begin}\n{text}\n{end}"
    if begin in old and end in old:
        new = old[: old.index(begin)] + part + old[old.index(end) + len(end) :]
    else:
        new = (old.rstrip() + "\n\n" if old.strip() else "") + part + "\n"
    file.write_text(new, encoding="utf-8")


def test_skeleton(scenarios: Iterable[dict]) -> str:
    """One test function per automatable scenario; steps that must not run are comments."""
    out = ["def step(action, target):", "    raise NotImplementedError(action)", ""]
    for i, s in enumerate(x for x in scenarios if x.get("automatable")):
        out += ["", f"def test_{s['kind']}_{i}():"]
        for action, target in s.get("steps", []):
            out.append(f"    # not automated: {target}" if action == "guard_skip" else f"    step({action!r}, {target!r})")
        if not s.get("steps"):
            out.append("    pass")
    return "\n".join(out) + "\n"


def narrate(summary: str, complete: Callable[[str], str] | None = None) -> str:
    """The deterministic text, or what an operator's text provider makes of it if it answers."""
    if complete is None:
        return summary
    try:
        return complete(summary) or summary
    except Exception:  # noqa: BLE001
        return summary


def offline_provider(prompt: str) -> str:
    return "[mock-generated] " + prompt[:200]


CONFIDENCE = ("high", "medium", "low")


def correlation_report(rows: Iterable[dict], unmatched: Iterable[str] = ()) -> str:
    """Matches of a running application with its sources, by kind, the surest first.

    Rows have kind, confidence, observed, source_name, path, line and evidence.
    """
    rows = sorted(rows, key=lambda r: (r["kind"], CONFIDENCE.index(r["confidence"]), r["observed"]))
    lines = ["# What was observed and where it comes from", "", "Matches are guesses from names and paths; read the evidence.", ""]
    lines.append("Confidence: " + ", ".join(f"{c} {sum(r['confidence'] == c for r in rows)}" for c in CONFIDENCE))
    for kind in dict.fromkeys(r["kind"] for r in rows):
        cells = [(r["confidence"], r["observed"], f"{r['source_name']} ({r['path']}:{r['line']})", r["evidence"]) for r in rows if r["kind"] == kind]
        lines += ["", f"## {kind}", "", table_markdown(["confidence", "observed", "source", "evidence"], cells)]
    rest = sorted(unmatched)
    if rest:
        lines += ["", "## Observed, not found in the sources", "", *[f"- {u}" for u in rest]]
    return "\n".join(lines) + "\n"


def crawl_report(title: str, totals: dict[str, int], screens: list[dict], edges: Iterable[tuple[str, str, str]] = ()) -> str:
    """One capture as Markdown: totals, its screens in order of depth and url, how they are linked."""
    order = sorted(screens, key=lambda s: (s.get("depth") is None, s.get("depth") or 0, s["url"]))
    lines = [f"# {title}", "", table_markdown(["counter", "n"], sorted(totals.items())), "", "## Screens", ""]
    lines.append(table_markdown(["url", "title", "depth", "elements"], [(s["url"], s.get("title"), s.get("depth"), s.get("elements")) for s in order]))
    edges = list(edges)
    if edges:
        lines += ["", "```mermaid", mermaid(edges, [s["url"] for s in order]), "```"]
    return "\n".join(lines) + "\n"


def scoping_notes(settings, missed: int, refused_tabs: Iterable[str] = ()) -> list[str]:
    """What a capture left out, in plain words, from its settings and counters."""
    notes = []
    if settings.include:
        notes.append(f"Only addresses matching {', '.join(settings.include)} were visited.")
    if settings.exclude:
        notes.append(f"Addresses matching {', '.join(settings.exclude)} were left out.")
    if missed:
        notes.append(f"{counted(missed, 'linked page')} beyond {settings.max_pages} pages or {settings.max_depth} clicks not captured.")
    tabs = sorted(set(refused_tabs))
    if tabs:
        notes.append(f"Tabs that were not opened: {', '.join(tabs)}.")
    return notes or ["Nothing was left out by the settings."]


def test_skeleton_ts(scenarios: Iterable[dict]) -> str:
    """The skeleton of tests for a TypeScript runner; guarded steps are comments."""
    out = ['import { test } from "./runner";', ""]
    for i, s in enumerate(x for x in scenarios if x.get("automatable")):
        out.append(f"test({_quoted(s['kind'] + ' ' + str(i))}, async ({{ step }}) => {{")
        for action, target in s.get("steps", []):
            note = str(target).replace(chr(10), " ")
            out.append(f"  // not automated: {note}" if action == "guard_skip" else f"  await step({_quoted(action)}, {_quoted(str(target))});")
        out += ["});", ""]
    return "\n".join(out)


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)
