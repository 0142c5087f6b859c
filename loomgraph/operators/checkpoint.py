"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the folder in spark.checkpoint.dir and reads it from there; a folder of this machine is
    taken only where that is unset and the master is local."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-"))
    return df.checkpoint(eager=True)


#: Bytes, as the plan estimates them, that a partition gets where rows are dealt out; and partitions at most.
SHARE, MOST = 1 << 21, 10_000


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out by columns over as many partitions as its estimated bytes ask for, so that what a task
    holds does not grow with df. Where nothing is known of its size, Spark's setting stands."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(-(-size // SHARE) or 1, *columns) if size <= SHARE * MOST else df.repartition(*columns)
