"""Readers for the capture tables, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismgrid.schemas import TABLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one Parquet table of ``folder``.

    Tables declared in :mod:`prismgrid.schemas` are read with that schema, so a
    missing column comes out null and no footer has to be opened for inference;
    further columns in the files are not read.
    """
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(f"{folder}/{name}.parquet")
