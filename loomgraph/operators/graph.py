"""Property-graph operators over nodes (id, label, name, ...) and edges (source_id, target_id, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import match, rules
from loomgraph.operators.checkpoint import cut, dealt


def degrees(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """nodes with in_degree, out_degree and total_degree; both are counted in one pass before they are joined."""
    return _with_degrees(nodes, _ends(edges, types))


def _ends(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """A row for each end of each edge: id, and 1 in in_degree or out_degree."""
    used = edges.where(F.col("type").isin(types)) if types else edges
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    into = F.struct(F.col("target_id").alias("id"), one.alias("in_degree"), none.alias("out_degree"))
    from_ = F.struct(F.col("source_id").alias("id"), none.alias("in_degree"), one.alias("out_degree"))
    return used.select(F.explode(F.array(into, from_)).alias("end")).select("end.*")


def _with_degrees(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    counts = dealt(ends, "id").groupBy("id").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    joined = nodes.join(counts, "id", "left").fillna(0, ["in_degree", "out_degree"])
    return joined.withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))


def search(nodes: DataFrame, edges: DataFrame, *, label: str = "", name: str = "", qualified_name: str = "", file: str = "", relationship: list[str] | None = None, min_degree: int | None = None, max_degree: int | None = None, exclude_entry_points: bool = False) -> DataFrame:
    """Nodes that match all patterns, with degrees; without order and page. Only their edges are counted."""
    patterns = {"label": label, "name": name, "qualified_name": qualified_name, "file_path": file}
    found = nodes.where(match.all_of([match.like(F.col(c), p) for c, p in patterns.items() if p]))
    ends = _ends(edges, relationship)
    if any(patterns.values()):
        ends = ends.join(found.select("id"), "id", "left_semi")
    found = _with_degrees(found, ends)
    if min_degree is not None:
        found = found.where(F.col("total_degree") >= min_degree)
    if max_degree is not None:
        found = found.where(F.col("total_degree") <= max_degree)
    if exclude_entry_points:
        found = found.where(~((F.col("label") == "Function") & (F.col("in_degree") == 0)))
    return found


def page(found: DataFrame, sort_by: str = "name", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page in a total order: the sort column, then name and id."""
    key = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    return found.orderBy(key, "name", "id").offset(offset).limit(limit or 100)


def histogram(rows: DataFrame, column: str, into: str = "n") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(into))


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("total_degree"), "name", "id").limit(limit)


def entry_points(nodes: DataFrame, edges: DataFrame, label: str, types: list[str] | None = None, scan: int = 100, limit: int = 15) -> DataFrame:
    """Of the `scan` nodes with the most calls out: those that nothing leads to."""
    top = search(nodes, edges, label=label, relationship=types).orderBy(F.desc("out_degree"), "name", "id").limit(scan)
    return top.where("in_degree = 0 and out_degree > 0").orderBy(F.desc("out_degree"), "name", "id").limit(limit)


def neighbours(edges: DataFrame, nodes: DataFrame, limit: int, out: bool = True) -> DataFrame:
    """id, neighbour and place: the first distinct neighbour names of each node in order of edge id."""
    near, far = ("source_id", "target_id") if out else ("target_id", "source_id")
    named = edges.join(nodes.select(F.col("id").alias("_far"), F.col("name").alias("neighbour")), F.col(far) == F.col("_far"))
    first = named.groupBy(F.col(near).alias("id"), "neighbour").agg(F.min("id").alias("_edge"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("_edge", "neighbour"))
    return first.withColumn("place", place).where(F.col("place") <= limit).select("id", "neighbour", "place")


#: Nodes of a level at most that are sent to every task, in place of moving the steps to them.
FEW = 200_000


def _small(rows: DataFrame) -> DataFrame:
    """Stored rows (an id and a few numbers), sent to every task where they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    ahead = edges.select(F.col("source_id").alias("near"), F.col("target_id").alias("far"))
    back = edges.select(F.col("target_id").alias("near"), F.col("source_id").alias("far"))
    return {"out": ahead, "in": back}[direction] if direction != "both" else ahead.unionByName(back)


class _Steps:
    """near and far of all steps but those from a node to itself.

    The steps from few nodes are filtered where the edges are read, below what makes parallel rows one edge,
    so nothing is moved or written but what is found. Once a level has many nodes, the steps are written,
    dealt out by where they begin, and later levels are joined to them without moving them again.
    """

    def __init__(self, edges: DataFrame, direction: str):
        self.all, self.written = _oriented(edges, direction).where("near != far"), None

    def of(self, front: DataFrame) -> DataFrame:
        """The steps that begin at the ids of front, which is stored."""
        few, ids = front.count() <= FEW, front.select(F.col("id").alias("near"))
        if not few and self.written is None:
            self.written = cut(dealt(self.all, "near"))
        return (self.all if self.written is None else self.written).join(F.broadcast(ids) if few else ids, "near", "left_semi")


def _of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("type").isin(types)) if types else edges


def distances(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", types: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """id and dist of all nodes within `depth` of any start (a column id), level by level.

    With a cap, no level is begun once more nodes than that are known.
    """
    steps = _Steps(_of_types(edges, types), direction)
    known = front = cut(starts.select("id").distinct().withColumn("dist", F.lit(0)))
    for level in range(1, depth + 1):
        if cap is not None and known.count() > cap:
            break
        found = steps.of(front).select(F.col("far").alias("id")).distinct()
        front = cut(found.join(_small(known.select("id")), "id", "left_anti").withColumn("dist", F.lit(level)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def traverse(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", types: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Each edge once, with the depth it is first met at in a breadth-first walk."""
    dist = reach = distances(edges, starts, depth, direction, types, cap)
    if cap is not None:
        per = dist.groupBy("dist").agg(F.count(F.lit(1)).alias("n")).collect()  # at most depth + 1 rows
        total, last = 0, -1
        for level, n in sorted((r["dist"], r["n"]) for r in per):
            total += n
            last = level
            if total > cap:
                break
        reach = dist.where(F.col("dist") < max(last, 0)) if total > cap else dist
    used, reach = _of_types(edges, types), reach.where(F.col("dist") < depth)
    ids, ends = _small(reach.select("id")), {"out": ["source_id"], "in": ["target_id"], "both": ["source_id", "target_id"]}[direction]
    at = lambda end, into: reach.select(F.col("id").alias(end), F.col("dist").alias(into))
    met = used.join(ids.withColumnRenamed("id", ends[0]), ends[0], "left_semi").join(_small(at(ends[0], "_near")), ends[0])
    if direction != "both":
        return met.withColumn("depth", F.col("_near") + 1).select(*used.columns, "depth")
    other = _small(at("target_id", "_far"))
    met = met.join(other, "target_id", "left").withColumn("depth", F.least("_near", "_far") + 1)
    late = used.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    late = late.join(other, "target_id").withColumn("depth", F.col("_far") + 1)
    return met.select(*used.columns, "depth").unionByName(late.select(*used.columns, "depth"))


MODES = {
    "calls": ["CALLS"],
    "data_flow": ["CALLS", "DATA_FLOWS"],
    "cross_service": ["HTTP_CALLS", "ASYNC_CALLS", "EMITS", "SUBSCRIBES", "DATA_FLOWS", "CALLS"],
}


def trace(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 6, direction: str = "out", mode: str = "calls", types: list[str] | None = None, cap: int | None = 100, include_tests: bool = False) -> DataFrame:
    """The nodes a trace reaches, with hop and risk; both directions are two one-way walks."""
    types = types or MODES[mode]
    parts = []
    for way in ("out", "in") if direction == "both" else (direction,):
        parts.append(distances(edges, starts, depth, way, types, cap).where("dist > 0").withColumn("way", F.lit(way)))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = nodes.join(_small(found), "id").withColumn("hop", F.col("dist")).withColumn("risk", rules.hop_risk(F.col("dist")))
    return out if include_tests else out.where(~rules.is_test_file(F.coalesce("file_path", F.lit(""))))


def blast_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, hidden: tuple[str, ...] = ("File", "Module")) -> DataFrame:
    """id, hop and risk of every node within depth of a seed other than itself, both ways.

    Each node carries its two nearest distinct seeds, which is enough to tell its nearest other seed.
    """
    steps = _Steps(edges, "both")
    two = Window.partitionBy("id").orderBy("hop", "seed")
    near = cut(seeds.select("id").distinct().select("id", F.col("id").alias("seed"), F.lit(0).alias("hop")))
    for level in range(1, depth + 1):
        front = near.where(F.col("hop") == level - 1)
        if front.isEmpty():
            break
        met = steps.of(front.select("id").distinct())
        reached = met.join(_small(front.select("id", "seed")), F.col("id") == F.col("near")).select(F.col("far").alias("id"), "seed", F.lit(level).alias("hop"))
        merged = near.unionByName(reached).groupBy("id", "seed").agg(F.min("hop").alias("hop"))
        near = cut(merged.withColumn("_place", F.row_number().over(two)).where("_place <= 2").drop("_place"))
    best = near.where("id != seed").groupBy("id").agg(F.min("hop").alias("hop"))
    return nodes.join(_small(best), "id").where(~F.col("label").isin(*hidden)).withColumn("risk", rules.impact_risk(F.col("hop")))


def upserted(nodes: DataFrame, order: Column) -> DataFrame:
    """One node for each qualified_name: the first row's label, name and file, and the widest span."""
    out = nodes.groupBy("project", "qualified_name").agg(F.min_by(F.struct("label", "name", "file_path", "properties"), order).alias("f"), F.min(F.when(F.col("start_line") > 0, F.col("start_line"))).alias("start_line"), F.max("end_line").alias("end_line"))
    return out.select("project", "f.label", "f.name", "qualified_name", "f.file_path", F.coalesce("start_line", F.lit(0)).alias("start_line"), "end_line", "f.properties")


def inserted(edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """The first edge of each (source, target, type) whose ends are known nodes."""
    known = nodes.select("id")
    place = F.row_number().over(Window.partitionBy("source_id", "target_id", "type").orderBy(order))
    ends = edges.where("source_id > 0 and target_id > 0").join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return ends.withColumn("_place", place).where("_place = 1").drop("_place")


def without_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files (a column file_path) and without folders left empty."""
    left = nodes.join(files.select("file_path").distinct(), "file_path", "left_anti")
    paths = left.where("label != 'Folder' and file_path != ''").select(F.explode(F.expr("transform(sequence(1, size(split(file_path, '/'))), i -> array_join(slice(split(file_path, '/'), 1, i), '/'))")).alias("_dir")).distinct()
    folders = left.where("label = 'Folder'").join(paths, F.col("file_path") == F.col("_dir"), "left_semi")
    left = left.where("label != 'Folder'").unionByName(folders.select(*left.columns))
    ids = left.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return left, kept


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder chain of files (project, file_path): nodes (qualified_name, label) and containment edges by name."""
    parts = F.split("file_path", "/")
    chain = files.select("project", "file_path", F.posexplode(parts).alias("i", "_part")).withColumn("path", F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), F.col("i") + 1), "/")).withColumn("parent", F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), F.col("i")), "/"))
    whole = F.col("path") == F.col("file_path")
    named = chain.select("project", "path", "parent", F.when(whole, "File").otherwise("Folder").alias("label")).distinct()
    edges = named.select("project", F.col("parent").alias("source"), F.col("path").alias("target"), F.when(F.col("label") == "File", "CONTAINS_FILE").otherwise("CONTAINS_FOLDER").alias("type"))
    return named.select("project", "path", "label"), edges
