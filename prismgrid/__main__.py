"""``python -m prismgrid QUERY FOLDER OUT``: run one query over the tables of a folder.

``python -m prismgrid list`` names the queries. The result is written as Parquet; the
session is the one that ``spark-submit`` or its settings give.
"""

from __future__ import annotations

import importlib
import sys

PLANS = ("plans.problems", "plans.reference", "plans.literals", "plans.further")


def queries() -> dict:
    found: dict = {}
    for name in PLANS:
        found |= importlib.import_module(f"prismgrid.{name}").QUERIES
    return found


def main(args: list[str]) -> int:
    known = queries()
    if args == ["list"]:
        print("\n".join(sorted(known)))
        return 0
    if len(args) != 3 or args[0] not in known:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from prismgrid.session import prepare
    from prismgrid.sources.sinks import save

    save(known[args[0]](prepare(SparkSession.builder.getOrCreate()), args[1]), args[2])
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
