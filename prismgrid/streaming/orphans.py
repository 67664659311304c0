"""Orphan references of a stream of deliveries, kept in an orphan log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from prismgrid.operators.orphans import OrphanLog


def maintain(delivered: DataFrame, log: OrphanLog) -> DataStreamWriter:
    """Bring every micro-batch of deliveries to the log, each exactly once.

    ``delivered`` is a streaming union of :func:`prismgrid.operators.orphans.deliveries`.
    A batch that is replayed after a failure has its number and is not counted again.
    """
    return delivered.writeStream.foreachBatch(lambda rows, number: log.append([rows], number))
