"""What the operators share: table access, the shared folder and salted ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in spark.checkpoint.dir; a folder of this machine is taken
    only where that is unset and the master is local, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, splits: int = 0) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there, so that what follows
    survives the loss of any executor without going back further.

    What is narrow and comes straight from a scan can name a number of splits of the input that a task
    takes one after another, so that the folder does not get a small file for each.
    """
    shared_folder(df.sparkSession)
    if splits:
        df = df.coalesce(max(1, -(-df.rdd.getNumPartitions() // splits)))
    return df.checkpoint(eager=True)


def fewer(df: DataFrame, splits: int) -> DataFrame:
    """What comes from a shuffle and is narrow, with a number of partitions taken one after another by a
    task, so that a result does not get a small file for each."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // splits))


def whole(df: DataFrame) -> Column:
    """All columns of df in one, so that no name of theirs can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def unpacked(df: DataFrame, columns: list[str], replaced: dict[str, Column]) -> DataFrame:
    """The columns that `row` holds, in their order, with those of `replaced` in their place or behind them."""
    kept = [replaced.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    return df.select(*kept, *(c.alias(name) for name, c in replaced.items() if name not in columns))


def ranked(rows: DataFrame, key: str, mixed: str, order: list[str], into: str) -> DataFrame:
    """Adds each row's rank (from 0) among the rows of its key, by `mixed` (a well mixed hash) and `order`.

    A key is dealt out over ranges of `mixed`, so no task has to hold a key whole: the rank is the place
    within key and range plus the number of the key's rows in smaller ranges. The ranges follow the hash
    alone, so the rank is the same for any number of them. There is one count for each key and range.
    """
    bits = max(4, (int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    salted = rows.withColumn("range", F.shiftright(mixed, 64 - bits))
    counts = salted.groupBy(key, "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(key, "range").orderBy(mixed, *order)) - 1
    placed = salted.withColumn("place", place.cast("long")).join(counts, [key, "range"])
    return placed.withColumn(into, F.col("place") + F.col("before")).drop("place", "before", "range")


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to a new place in the shared checkpoint folder and reads it again."""
    place = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)
