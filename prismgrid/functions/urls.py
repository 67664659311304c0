"""URL and DOM-path identity as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAGMENT = r"(?s)#.*$"
#: A slash that ends a path longer than "/", before the query or the end.
PATH_SLASH = r"^((?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)?/[^?]*)/(\?.*)?$"
BARE_HOST = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)(\?.*)?$"
SPACE = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}]+"


def page_key(url: Column) -> Column:
    """Identity of a page: no fragment, no slash ending the path (``/`` stays).

    A host without any path is the host's ``/``. Null stays null.
    """
    bare = F.regexp_replace(url, FRAGMENT, "")
    return F.regexp_replace(F.regexp_replace(bare, PATH_SLASH, "$1$2"), BARE_HOST, "$1/$2")


def dom_key(path: Column) -> Column:
    """Identity of a DOM path: all white space left out. Null stays null."""
    return F.regexp_replace(path, SPACE, "")


def frame_key(frame: Column) -> Column:
    """Null means the page itself."""
    return F.coalesce(frame, F.lit(""))


def key128(tag: str, *parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a composite key, null parts included."""
    cells = [F.coalesce(p, F.lit("\x00")) for p in parts]
    return (
        F.xxhash64(F.lit(tag), *cells),
        F.xxhash64(F.lit("\x01" + tag), *[c for p in reversed(cells) for c in (p, F.lit("\x02"))]),
    )
