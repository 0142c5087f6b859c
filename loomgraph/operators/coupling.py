"""Which files change together: co-occurrence counts over commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def couplings(commits: DataFrame, commit: str = "commit_id", file: str = "file_path", max_files: int = 20, min_count: int = 3, min_score: float = 0.3) -> DataFrame:
    """a < b, both (commits with both) and score (both over the rarer one's commits, 1 at most).

    Commits of more than `max_files` files count for nothing, so a commit gives a bounded number of pairs.
    """
    files = commits.select(F.col(commit).alias("c"), F.col(file).alias("f")).where("f is not null").distinct()
    small = files.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_files).select("c")  # counted before they are gathered
    sets = files.join(small, "c", "left_semi").groupBy("c").agg(F.collect_list("f").alias("fs"))
    single = sets.select(F.explode("fs").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select(F.array_sort("fs").alias("fs")).select("fs", F.posexplode("fs").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("fs", F.col("i") + 2, F.lit(max_files))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= min_count)
    counted = pairs.join(single.select(F.col("f").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("f").alias("b"), F.col("n").alias("n_b")), "b")
    return counted.withColumn("score", F.least(F.lit(1.0), F.col("both") / F.least("n_a", "n_b"))).where(F.col("score") >= min_score).select("a", "b", "both", "score")


def coupling_edges(found: DataFrame) -> DataFrame:
    """FILE_CHANGES_WITH edges between file names, with text properties."""
    props = F.create_map(F.lit("co_changes"), F.col("both").cast("string"), F.lit("coupling_score"), F.format_string("%.2f", "score"))
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("FILE_CHANGES_WITH").alias("type"), props.alias("properties"))
