"""Plug-ins that may veto pages or judge a session, combined so that any veto wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KNOWN: dict[str, type[Adapter]] = {}


class Adapter:
    """Opinions are nullable boolean columns: null means none."""

    def should_visit(self, url: Column) -> Column:
        return F.lit(None).cast("boolean")

    def is_logged_in(self, names: Column) -> Column:
        return F.lit(None).cast("boolean")

    def on_pages(self, pages: DataFrame) -> DataFrame:
        return pages


def register(name: str) -> Callable[[type[Adapter]], type[Adapter]]:
    def keep(cls):
        _KNOWN[name] = cls
        return cls

    return keep


def available() -> list[str]:
    return sorted(_KNOWN)


def build(specs) -> list[Adapter]:
    """Adapters of specs {name, options}; an unknown name is an error."""
    out = []
    for spec in specs:
        if spec["name"] not in _KNOWN:
            raise ValueError(f"unknown adapter {spec['name']!r}; there are {', '.join(available())}")
        out.append(_KNOWN[spec["name"]](**spec.get("options", {})))
    return out


@register("skip_paths")
class SkipPaths(Adapter):
    """Vetoes URLs that match any pattern."""

    def __init__(self, patterns=()):
        self.patterns = list(patterns)

    def should_visit(self, url):
        hit = F.lit(False)
        for p in self.patterns:
            hit = hit | url.rlike(p)
        return F.when(hit, False)


@register("logged_in_marker")
class LoggedInMarker(Adapter):
    """A page is signed in if one of its controls has the given name."""

    def __init__(self, name=""):
        self.name = name

    def is_logged_in(self, names):
        return F.exists(names, lambda n: F.lower(F.trim(n)) == self.name.strip().lower())


def may_visit(adapters: list[Adapter], url: Column) -> Column:
    """True unless an adapter says no; an adapter that fails has no opinion."""
    out = F.lit(True)
    for a in adapters:
        try:
            opinion = a.should_visit(url)
        except Exception:  # noqa: BLE001
            continue
        out = out & F.coalesce(opinion, F.lit(True))
    return out


def signed_in(adapters: list[Adapter], names: Column) -> Column:
    """False if any adapter says so, True if some say yes, else null."""
    opinions = []
    for a in adapters:
        try:
            opinions.append(a.is_logged_in(names))
        except Exception:  # noqa: BLE001
            continue
    if not opinions:
        return F.lit(None).cast("boolean")
    said = F.array_compact(F.array(*opinions))
    return F.when(F.size(said) > 0, F.forall(said, lambda x: x))
