"""Settle detection as a keyed stateful stream: equal polls in a row, tightened while
connections stay open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Equal polls in a row: usually, and while a connection stays open.
NEEDED, NEEDED_LIVE = 2, 6
OUTPUT = "page string, poll bigint, state string, polls int"
STATE = "last string, run int, done boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, run, done = state.get if state.exists else (None, 0, False)
    out = []
    rows = pd.concat(list(batches)).sort_values("poll")
    for poll, value, live in zip(rows["poll"], rows["state"], rows["live"], strict=True):
        run = run + 1 if value == last and run else 1
        last = value
        if not done and run >= (NEEDED_LIVE if live else NEEDED):
            done = True
            out.append((key[0], int(poll), value, int(run)))
    state.update((last, int(run), bool(done)))
    yield pd.DataFrame(out, columns=["page", "poll", "state", "polls"])


def settled_pages(polls: DataFrame) -> DataFrame:
    """The first settled poll of each page from a stream of (page, poll, state, live).

    The state per page is the last value and its run, whatever the number of polls.
    """
    return polls.groupBy("page").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
