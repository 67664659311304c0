"""Session helpers: settings that results depend on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set the few runtime settings that change results or plans everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    A folder of our own is set only where the session names none and all its threads run
    on this machine, as in tests; a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prismgrid-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder, for loops of many rounds.

    A checkpoint keeps the estimated size of its plan, which grows with every join of a
    loop; a written table has the size that it has.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Steps of a plan that move rows: their partitions are not known before they ran.
MOVING = re.compile("Aggregate|Join|Window|Sort|Exchange|Repartition|Limit")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files give fewer partitions than there are.

    For work that is heavy for each row. Large inputs have partitions enough and are
    left where they are, without a shuffle; so are results of joins and aggregates.
    """
    plan = df._jdf.queryExecution()
    if MOVING.search(plan.sparkPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if plan.toRdd().getNumPartitions() < cores else df
