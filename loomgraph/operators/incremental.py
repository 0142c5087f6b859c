"""Which files changed since they were last read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(stored: DataFrame, found: DataFrame) -> DataFrame:
    """rel_path and state (new, changed, deleted or same) of files with size and mtime."""
    both = stored.select("rel_path", F.struct("size", "mtime").alias("was")).join(found.select("rel_path", F.struct("size", "mtime").alias("now")), "rel_path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("same")
    return both.select("rel_path", state.alias("state"))


def is_incremental(stored: DataFrame, found: DataFrame, factor: float = 1.5) -> bool:
    return found.count() <= factor * stored.count()
