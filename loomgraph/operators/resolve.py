"""Resolving references to symbols: the best candidate of a ladder of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.checkpoint import cut


def last_segment(name: Column) -> Column:
    return F.element_at(F.filter(F.split(name, r"[/\\.:]+"), lambda x: x != ""), -1)


def resolve(refs: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """ref_id, symbol id, strategy and confidence of the best candidate of each reference.

    refs: ref_id, name, file_path, preferred_label. symbols: id, name, qualified_name, label, file_path,
    start_line. bindings: file_path, alias, namespace (a qualified-name part of what it stands for).

    Candidates come from equi-joins on the qualified name, the last segment or the binding. What many
    references ask alike is asked once: a rule has one symbol for each name (with its label, file, namespace
    or spelling), and a reference meets only that one.
    """
    r = refs.select("ref_id", F.col("name").alias("ref"), F.col("file_path").alias("ref_file"), F.col("preferred_label").alias("wanted"), last_segment(F.col("name")).alias("last"), F.regexp_extract("name", r"^([^/\\.:]+)", 1).alias("head"))
    r, s = cut(r), cut(symbols.select("id", F.col("name").alias("symbol"), "qualified_name", "label", "file_path", "start_line"))

    def found(rows: DataFrame, step: int, strategy: str, confidence: float) -> DataFrame:
        return rows.select("ref_id", "id", "qualified_name", "label", "file_path", "start_line", F.lit(step).alias("step"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence"))

    def first_of(*by: str) -> DataFrame:
        """The first symbol of each name, or of each name and label or file: no reference meets all of a common name."""
        return first_in(s, "symbol", *by)

    def first_in(rows: DataFrame, *by: str) -> DataFrame:
        best = F.min_by(F.struct("id", *(c for c in ("qualified_name", "label", "file_path", "start_line") if c not in by)), F.struct("file_path", "start_line", "qualified_name", "id"))
        return rows.groupBy(*by).agg(best.alias("_s")).select(*by, "_s.*")

    bound = r.join(bindings.select(F.col("file_path").alias("ref_file"), F.col("alias").alias("head"), "namespace"), ["ref_file", "head"])
    qualified = F.col("ref").rlike(r"[/\\.:]")
    inside = bound.where(qualified).select("last", "namespace").distinct().join(s, F.col("last") == F.col("symbol")).where(F.col("qualified_name").contains(F.col("namespace")))
    ending = r.where(qualified).select("last", "ref").distinct().join(s, F.col("last") == F.col("symbol")).where(F.col("qualified_name").endswith(F.col("ref")))
    parts = [
        found(r.join(first_in(s, "qualified_name"), F.col("ref") == F.col("qualified_name")), 0, "exact", 1.0),
        found(bound.where(qualified).join(first_in(inside, "last", "namespace"), ["last", "namespace"]), 1, "import_namespace", 0.95),
        found(bound.where(~qualified).withColumn("target", last_segment(F.col("namespace"))).join(first_of(), F.col("target") == F.col("symbol")), 2, "import_alias", 0.82),
        found(r.where(qualified).join(first_in(ending, "last", "ref"), ["last", "ref"]), 3, "qualified_suffix", 0.92),
        found(r.join(first_of("label"), (F.col("last") == F.col("symbol")) & (F.col("label") == F.col("wanted"))), 4, "preferred_label", 0.90),
        found(r.join(first_of("file_path"), (F.col("last") == F.col("symbol")) & (F.col("file_path") == F.col("ref_file"))), 5, "same_file", 0.88),
        found(r.join(first_of(), F.col("last") == F.col("symbol")), 6, "first_match", 0.50),
    ]
    place = F.row_number().over(Window.partitionBy("ref_id").orderBy("step", "file_path", "start_line", "qualified_name", "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("_place", place).where("_place = 1").drop("_place", "step")


def emitted(calls: DataFrame, overrides: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """CALLS edges: what a side file says comes first, then the ladder; calls to types give no edge.

    calls: ref_id, source_id, file_path, caller, callee. overrides: file_path, caller, callee, target (a
    qualified name) and confidence.
    """
    ids = symbols.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target"), F.col("label").alias("target_label"))
    told = calls.join(overrides, ["file_path", "caller", "callee"]).join(ids, "target").select("ref_id", "source_id", "target_id", "target_label", "confidence", F.lit("override").alias("strategy"))
    rest = calls.join(told.select("ref_id"), "ref_id", "left_anti").join(resolved.select("ref_id", F.col("id").alias("target_id"), F.col("label").alias("target_label"), "confidence", "strategy"), "ref_id").select("ref_id", "source_id", "target_id", "target_label", "confidence", "strategy")
    return told.unionByName(rest).where("target_label not in ('Class', 'Interface')").select("source_id", "target_id", F.lit("CALLS").alias("type"), "confidence", "strategy")


def throw_edges(throws: DataFrame) -> DataFrame:
    """RAISES for errors and panics, else THROWS."""
    return throws.withColumn("type", F.when(F.col("exception").rlike("Error|error|Panic|panic"), "RAISES").otherwise("THROWS"))


def function_ends(symbols: DataFrame, n_lines: DataFrame) -> DataFrame:
    """The line before the next later start in the file, or the file's last line."""
    ahead = Window.partitionBy("file_path").orderBy("start_line").rangeBetween(1, Window.unboundedFollowing)
    return symbols.join(n_lines, "file_path", "left").withColumn("end_line", F.coalesce(F.min("start_line").over(ahead) - 1, F.col("n_lines")))
