"""From source files to a property graph: one plan from lines to nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import coupling, enrich, extract, graph, resolve, similarity, text_search, vectors
from loomgraph.operators.checkpoint import cut

EMPTY = "cast(map() as map<string,string>)"


def node_id(project: str, qualified_name: Column) -> Column:
    """The same name always has the same positive id."""
    return F.xxhash64(F.lit(project), qualified_name).bitwiseAND(F.lit((1 << 63) - 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(rules.basename(path), r"\.[^.]*$", "")


def nodes_of(files: DataFrame, project: str, lines: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Project, folders (of `placed`, or of the files), files, modules and symbols, one node for each qualified name."""
    defined = extract.spans(extract.definitions(lines), lines)
    place = F.lit(f"{project}:")
    language = F.coalesce("language", F.lit(""))
    folders = graph.structure((files if placed is None else placed).select(F.lit(project).alias("project"), "file_path"))[0].where("label = 'Folder'")
    empty = F.expr(EMPTY).alias("properties")
    n_lines = F.size(F.split("content", "\n", -1))
    parts = [
        files.sparkSession.range(1).select(F.lit("Project").alias("label"), F.lit(project).alias("name"), F.lit(project).alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), empty),
        folders.select("label", rules.basename(F.col("path")).alias("name"), F.concat(place, F.lit("folder:"), "path").alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), empty),
        files.select(F.lit("File").alias("label"), rules.basename(F.col("file_path")).alias("name"), F.concat(place, F.lit("file:"), "file_path", F.lit(":"), language).alias("qualified_name"), "file_path", F.lit(1).alias("start_line"), n_lines.alias("end_line"), F.create_map(F.lit("is_test"), rules.is_test_path(F.col("file_path")).cast("string")).alias("properties")),
        files.where(F.col("language").isin(*extract.DEFINITIONS)).select(F.lit("Module").alias("label"), stem(F.col("file_path")).alias("name"), F.concat(place, F.lit("module:"), "file_path", F.lit(":"), language).alias("qualified_name"), "file_path", F.lit(1).alias("start_line"), n_lines.alias("end_line"), empty),
        defined.select("label", "name", F.concat(place, "file_path", F.lit(":"), language, F.lit(":symbol:"), language, F.lit(":"), "name").alias("qualified_name"), "file_path", "start_line", "end_line", F.create_map(F.lit("is_test"), (rules.is_test_path(F.col("file_path")) & rules.is_test_function(F.col("name"))).cast("string")).alias("properties")),
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn("project", F.lit(project))
    once = graph.upserted(rows, F.struct("start_line", "label"))
    return once.withColumn("id", node_id(project, F.col("qualified_name")))


def owned(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (file_path, line) with source_id: the innermost symbol that holds the line, else the module."""
    at = text_search.attributed(rows.select("file_path", "line").distinct(), symbols, "file_path").select("file_path", "line", F.col("symbol_id").alias("source_id"))
    return rows.join(at.where("source_id is not null"), ["file_path", "line"])


def edges_of(files: DataFrame, nodes: DataFrame, project: str, lines: DataFrame, commits: DataFrame | None = None, overrides: DataFrame | None = None, kept: DataFrame | None = None, passes: bool = True) -> tuple[DataFrame, DataFrame]:
    """All edges, and the route and topic nodes that they need.

    `lines` may be those of changed files alone; then `kept` are the edges that stay, which the passes see
    as well. Without `passes` nothing is derived from the graph (configuration, changes, similarity).
    """
    spark = files.sparkSession
    symbols = nodes.where("label not in ('Project', 'Folder', 'File')")
    targets = symbols.select("id", "name", "qualified_name", "label", "file_path", "start_line")
    file_id = nodes.where("label = 'File'").select("file_path", F.col("id").alias("file_id"))
    of = lambda kind, path: node_id(project, F.concat(F.lit(f"{project}:{kind}:"), path))
    empty = F.expr(EMPTY).alias("properties")

    def edge(rows: DataFrame, kind: str | Column, properties: Column = empty) -> DataFrame:
        return rows.select("source_id", "target_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), properties.alias("properties"))

    inside = graph.structure(files.select(F.lit(project).alias("project"), "file_path"))[1]
    parent = F.when(F.col("source") == "", node_id(project, F.lit(project))).otherwise(of("folder", F.col("source")))
    contains = inside.join(file_id, F.col("target") == F.col("file_path"), "left").select(parent.alias("source_id"), F.coalesce("file_id", of("folder", F.col("target"))).alias("target_id"), "type", empty)
    defines = edge(symbols.join(file_id, "file_path").select(F.col("file_id").alias("source_id"), F.col("id").alias("target_id")), "DEFINES")

    bindings = extract.imports(lines)
    namespace = bindings.where("alias != ''").select("file_path", "alias", F.col("target").alias("namespace"))
    calls = owned(extract.calls(lines), symbols)
    refs = lambda rows, name, wanted: rows.withColumn("ref_id", F.xxhash64("file_path", "line", name)).select("ref_id", F.col(name).alias("name"), "file_path", F.lit(wanted).cast("string").alias("preferred_label"), "source_id").dropDuplicates(["ref_id"])

    def resolved(rows: DataFrame, name: str, wanted: str | None) -> DataFrame:
        asked = refs(rows, name, wanted)
        return asked.select("ref_id", "source_id").join(resolve.resolve(asked, targets, namespace), "ref_id").withColumn("target_id", F.col("id")).where("source_id != target_id")

    info = F.create_map(F.lit("strategy"), F.col("strategy"), F.lit("confidence"), F.format_string("%.2f", F.col("confidence")))
    called = refs(calls, "callee", "Function")
    told = overrides if overrides is not None else spark.createDataFrame([], "file_path string, caller string, callee string, target string, confidence double")
    asked = called.join(symbols.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("caller")), "source_id").withColumnRenamed("name", "callee")
    found = resolve.resolve(called, targets, namespace)
    call_edges = edge(resolve.emitted(asked, told, found, targets).where("source_id != target_id"), "CALLS", info)
    imported = edge(resolved(owned(bindings.where("linked"), symbols), "target", "Module"), "IMPORTS", info)
    used = edge(resolved(owned(extract.usages(lines), symbols), "name", "Class"), "USAGE", info)
    thrown = resolved(owned(extract.throws(lines), symbols), "exception", "Class").join(targets.select(F.col("id").alias("target_id"), F.col("name").alias("exception")), "target_id")
    throw_edges = edge(resolve.throw_edges(thrown), F.col("type"), info)

    def whole(made: DataFrame, *types: str) -> DataFrame:
        stay = None if kept is None else kept.where(F.col("type").isin(*types)).select(*made.columns)
        return made if stay is None else made.unionByName(stay)

    # services: calls with a route or topic as their first string, and registrations
    routed = enrich.routes_of_calls(calls).unionByName(owned(extract.routes(lines), symbols).select("source_id", F.lit("HANDLES").alias("type"), F.concat(F.lit("__route__"), "method", F.lit("__"), "path").alias("route"), F.lit(None).cast("string").alias("broker")))
    routed = cut(routed.withColumn("target_id", node_id(project, F.col("route"))).distinct())
    # a topic has the broker that its calls name; where several do, the first by name
    broker = F.when(F.col("route").startswith("__route__TOPIC__"), F.coalesce(F.min("broker"), F.lit("queue")))
    routes = routed.groupBy(F.col("target_id").alias("id"), "route").agg(broker.alias("broker")).withColumn("topic", F.regexp_extract("route", "^__route__[A-Z]+__(.*)$", 1))
    services = edge(routed, F.col("type")).dropDuplicates(["source_id", "target_id", "type"])
    every_service, every_call = whole(services, "HTTP_CALLS", "ASYNC_CALLS", "HANDLES"), whole(call_edges, "CALLS")
    known = routes.select("id").unionByName(nodes.where("label = 'Route'").select("id")).distinct()
    flows = edge(enrich.data_flows(every_service.unionByName(every_call), known), "DATA_FLOWS")
    topics = enrich.topic_edges(services, routes).withColumn("target_id", node_id(project, F.col("topic_name")))
    extra = routes.select("id", F.lit("Route").alias("label"), F.col("topic").alias("name"), F.col("route").alias("qualified_name")).unionByName(topics.select(F.col("target_id").alias("id"), F.lit("EventTopic").alias("label"), F.col("topic_name").alias("name"), F.col("topic_name").alias("qualified_name")).distinct())
    extra = extra.select(F.lit(project).alias("project"), "label", "name", "qualified_name", F.lit("").alias("file_path"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), empty, "id")

    own_files = nodes.where("label = 'File'").select("id", "file_path")
    tests = edge(enrich.test_edges(nodes, every_call), "TESTS").unionByName(edge(enrich.test_file_edges(own_files), "TESTS_FILE"))
    config = F.col("file_path").rlike(enrich.CONFIG_ENDS)
    keys, code = nodes.where(config & (F.col("label") == "Variable")), symbols.where(~config & ~F.col("label").isin("Module"))
    trust = F.create_map(F.lit("confidence"), F.format_string("%.2f", F.col("confidence")))
    linked = enrich.config_links(keys, code).unionByName(enrich.dependency_links(nodes.where("label = 'Variable'"), whole(imported, "IMPORTS").select(F.col("target_id").alias("id")).distinct().join(targets, "id")))
    configures = edge(linked, "CONFIGURES", trust)

    bodies = symbols.where("label in ('Function', 'Method')").join(files.select("file_path", "content"), "file_path").withColumn("source", text_search.slice_lines(F.col("content"), F.col("start_line"), F.col("end_line")))

    def similar_edges() -> DataFrame:
        coded = bodies.where("label = 'Function'").select("id", similarity.code_tokens(F.col("source")).alias("t")).where(F.size("t") >= 20).select("id", similarity.trigrams(F.col("t")).alias("g")).where(F.size("g") >= 16)
        signed = cut(similarity.signatures(coded.select("id", F.explode("g").alias("g")).select("id", "g.gram", "g.weight"), "id", "gram", weight="weight"))
        return similarity.similar_edges(similarity.similar_pairs(signed, "id"), symbols.select("id", "file_path"))

    def related_edges() -> DataFrame:
        worded = bodies.select("id", vectors.text_tokens(F.concat_ws(" ", "name", "qualified_name", "source")).alias("t"))
        vector = cut(vectors.hashed_vectors(worded, "id", "t"))
        near = vectors.related(worded.select("id", F.explode("t").alias("token")), vector, "id", "token", "vector")
        return edge(near.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "score"), "SEMANTICALLY_RELATED", F.create_map(F.lit("score"), F.format_string("%.3f", F.col("score"))))


    parts = [contains, defines, call_edges, imported, used, throw_edges, services, flows, edge(topics, F.col("type")), tests]
    if passes:
        parts += [configures, similar_edges(), related_edges()]
    if kept is not None:
        parts.append(kept.select(*parts[0].columns))
    if commits is not None and passes:
        together = coupling.coupling_edges(coupling.couplings(commits.where(rules.is_tracked(F.col("file_path")))))
        named = together.join(own_files.select(F.col("id").alias("source_id"), F.col("file_path").alias("source")), "source").join(own_files.select(F.col("id").alias("target_id"), F.col("file_path").alias("target")), "target")
        parts.append(named.select("source_id", "target_id", "type", "properties"))
    made = reduce(DataFrame.unionByName, parts).withColumn("project", F.lit(project)).withColumn("id", F.xxhash64("source_id", "target_id", "type").bitwiseAND(F.lit((1 << 63) - 1)))
    once = made.groupBy("project", "id", "source_id", "target_id", "type").agg(F.min_by("properties", F.to_json("properties")).alias("properties"))
    return once, extra


NODES = ["project", "id", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties"]
#: What the passes make anew whenever a graph changes.
DERIVED = ["DATA_FLOWS", "TESTS", "TESTS_FILE", "CONFIGURES", "SIMILAR_TO", "SEMANTICALLY_RELATED", "FILE_CHANGES_WITH"]


def build(files: DataFrame, project: str, commits: DataFrame | None = None, overrides: DataFrame | None = None, passes: bool = True) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of files (file_path, language, content)."""
    lines = extract.source_lines(files)
    nodes = cut(nodes_of(files, project, lines))
    edges, extra = edges_of(files, nodes, project, lines, commits, overrides, passes=passes)
    return nodes.select(*NODES).unionByName(extra.select(*NODES)), edges


def rebuilt(files: DataFrame, project: str, states: DataFrame, stored_nodes: DataFrame, stored_edges: DataFrame, commits: DataFrame | None = None, overrides: DataFrame | None = None, passes: bool = True) -> tuple[DataFrame, DataFrame]:
    """nodes and edges after some files changed (states: rel_path and state): what belongs to changed or
    deleted files goes, changed files alone are extracted again, and the passes run over the whole graph.
    Edges from other files stay where their target is still there.
    """
    gone = states.where("state != 'same'").select(F.col("rel_path").alias("file_path"))
    nodes, _ = graph.without_files(stored_nodes, stored_edges, gone)
    left = stored_nodes.join(gone, "file_path", "left_semi").select(F.col("id").alias("source_id"))
    edges = stored_edges.where(~F.col("type").isin(DERIVED)).join(left, "source_id", "left_anti")
    changed = files.join(gone, "file_path", "left_semi")
    lines = extract.source_lines(changed)
    new = cut(nodes_of(changed, project, lines, files)).select(*NODES)
    merged = cut(new.unionByName(nodes.select(*NODES).join(new.select("id"), "id", "left_anti").select(*NODES)))
    edges = edges.join(merged.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(merged.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    made, extra = edges_of(files, merged, project, lines, commits, overrides, kept=cut(edges), passes=passes)
    extra = extra.select(*NODES).join(merged.select("id"), "id", "left_anti").select(*NODES)
    return merged.unionByName(extra), made


class GraphTooLarge(ValueError):
    """A graph has more nodes or edges than a caller allows."""


def guarded(nodes: DataFrame, edges: DataFrame, most_nodes: int | None = None, most_edges: int | None = None) -> None:
    """Raises GraphTooLarge where a limit is given and passed."""
    for rows, most, what in ((nodes, most_nodes, "nodes"), (edges, most_edges, "edges")):
        if most is not None and (n := rows.count()) > most:
            raise GraphTooLarge(f"{n} {what}, {most} allowed")
