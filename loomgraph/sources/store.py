"""Tables of many projects as Parquet, one partition for each project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Store:
    """nodes, edges and further tables below one folder, partitioned by project."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, table: str, project: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{table}")
        return rows.where(F.col("project") == project) if project is not None else rows

    def has(self, table: str, project: str) -> bool:
        """Whether the project has a partition of this table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/project={project}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Replaces the partitions of the projects in rows, and no others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{self.folder}/{table}")

    def upsert(self, table: str, rows: DataFrame, key: list[str], order: str) -> None:
        """Adds rows to their projects; of rows with one key the last in order stays, new ones before stored ones."""
        try:
            stored = self.read(table).join(rows.select("project").distinct(), "project", "left_semi").withColumn("_new", F.lit(0))
            both = stored.unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            both = rows.withColumn("_new", F.lit(1))
        place = F.row_number().over(Window.partitionBy("project", *key).orderBy(F.desc("_new"), F.desc(order)))
        from loomgraph.operators.checkpoint import cut

        self.replace(table, cut(both.withColumn("_place", place).where("_place = 1").drop("_place", "_new")))

    def delete(self, table: str, project: str) -> None:
        """Drops the project's partition."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/project={project}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def projects(self) -> DataFrame:
        """project, nodes, edges and status of everything stored."""
        n = self.read("nodes").groupBy("project").agg(F.count(F.lit(1)).alias("nodes"))
        e = self.read("edges").groupBy("project").agg(F.count(F.lit(1)).alias("edges"))
        both = n.join(e, "project", "full_outer").fillna(0, ["nodes", "edges"])
        return both.withColumn("status", F.when(F.col("nodes") > 0, "ready").otherwise("empty")).orderBy("project")
