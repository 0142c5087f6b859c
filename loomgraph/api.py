"""The tools over stored projects: names and arguments in, DataFrames out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import cypher, graph, incremental, text_search, vectors
from loomgraph.operators.checkpoint import cut
from loomgraph.plans import ingest
from loomgraph.sources import files as sources
from loomgraph.sources.store import Store


class Engine:
    """Projects below a folder that all executors can reach."""

    def __init__(self, spark: SparkSession, folder: str, ignore_files: tuple[str, ...] = (".gitignore",), languages: str = ""):
        """ignore_files: names of the files with patterns of what to leave out; languages: entries such as
        `.x=python` for extensions, which come first."""
        self.spark, self.store = spark, Store(spark, folder)
        self.ignore_files, self.languages = ignore_files, sources.extension_map(languages)

    # ingest

    def index_repository(self, repo_path: str, project: str, mode: str = "full", most_nodes: int | None = None, most_edges: int | None = None) -> DataFrame:
        """Reads, extracts, resolves and stores; returns the project's row of list_projects().

        Modes: full; moderate, which passes over generated and lock files; fast, which also makes no passes and
        reads no overlay. A project that is stored already is brought up to date from its changed files,
        unless it has grown by more than half. Everything is made before anything stored is replaced.
        """
        found = cut(self._discovered(repo_path, mode))
        side = lambda name: f"{repo_path.rstrip('/')}/.loomgraph/{name}.json"
        overrides = sources.resolutions(self.spark, side("resolutions")) if os.path.exists(side("resolutions")) else None
        commits, passes = sources.commits(self.spark, repo_path), mode != "fast"
        states = self._states(found, project)
        if states is None:
            nodes, edges = ingest.build(found, project, commits, overrides, passes)
        elif states.where("state != 'same'").isEmpty():
            return self.list_projects().where(F.col("name") == project)
        else:
            nodes, edges = ingest.rebuilt(found, project, states, *self._graph(project), commits, overrides, passes)
        nodes, edges = cut(nodes), cut(edges)
        ingest.guarded(nodes, edges, most_nodes, most_edges)
        docs = found.select(F.lit(project).alias("project"), "file_path", "language", "size", "mtime", F.col("content").alias("text"))
        for table, rows in (("nodes", nodes), ("edges", edges), ("documents", docs)):
            self.store.replace(table, rows)
        if passes and os.path.exists(side("symbols")):
            _, symbols, occurrences = sources.overlay(self.spark, side("symbols"))
            for table, rows in (("overlay_symbols", symbols), ("overlay_occurrences", occurrences)):
                self.store.replace(table, rows.withColumn("project", F.lit(project)))
        return self.list_projects().where(F.col("name") == project)

    def _discovered(self, repo_path: str, mode: str = "full") -> DataFrame:
        return sources.discover(self.spark, repo_path, fast=mode != "full", table=sources.ignore_rules(repo_path, self.ignore_files), overrides=self.languages)

    def _states(self, found: DataFrame, project: str) -> DataFrame | None:
        """rel_path and state of the files found against what is stored, if that is to be brought up to date."""
        if not self.store.has("documents", project):
            return None
        shape = lambda df: df.select(F.col("file_path").alias("rel_path"), "size", "mtime")
        stored = shape(self.store.read("documents", project))
        return cut(incremental.classify(stored, shape(found))) if incremental.is_incremental(stored, found) else None

    def changed(self, repo_path: str, project: str) -> DataFrame:
        """rel_path and state of the repository's files against what is stored."""
        shape = lambda df: df.select(F.col("file_path").alias("rel_path"), "size", "mtime")
        return incremental.classify(shape(self.store.read("documents", project)), shape(self._discovered(repo_path)))

    def ingest_traces(self, project: str, traces: list) -> int:
        """Only counts what it is given."""
        return len(traces)

    # projects

    def list_projects(self) -> DataFrame:
        return self.store.projects().withColumnRenamed("project", "name")

    def index_status(self, project: str) -> DataFrame:
        """One row: ready, empty or not_found."""
        asked = self.spark.createDataFrame([(project,)], "name string")
        return asked.join(self.list_projects(), "name", "left").select("name", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("status", F.lit("not_found")).alias("status"))

    def delete_project(self, project: str) -> None:
        for table in ("nodes", "edges", "documents", "overlay_symbols", "overlay_occurrences"):
            self.store.delete(table, project)

    def manage_adr(self, project: str, mode: str = "get", content: str = "") -> DataFrame:
        """The project's note; update replaces it, sections lists its headings. It outlives a new index."""
        if mode == "update":
            self.store.upsert("summaries", self.spark.createDataFrame([(project, content)], "project string, summary string").withColumn("updated_at", F.current_timestamp()), [], "updated_at")
        note = self.store.read("summaries", project).select("project", "summary", "updated_at")
        return note.select("project", F.explode(text_search.sections(F.col("summary"))).alias("section")) if mode == "sections" else note

    # questions

    def _graph(self, project: str | None) -> tuple[DataFrame, DataFrame]:
        return self.store.read("nodes", project), self.store.read("edges", project)

    def search_graph(self, project: str | None = None, *, query: str = "", semantic_query: list[str] | None = None, label: str = "", name_pattern: str = "", qn_pattern: str = "", file_pattern: str = "", relationship: list[str] | None = None, min_degree: int | None = None, max_degree: int | None = None, exclude_entry_points: bool = False, sort_by: str = "name", sort_direction: str = "asc", limit: int = 100, offset: int = 0) -> DataFrame:
        """By text (query), by meaning (semantic_query) or by patterns and degrees."""
        nodes, edges = self._graph(project)
        terms = text_search.query_terms(query) if query else None
        if terms:
            ranked = text_search.bm25(self.store.read("documents", project), terms, "file_path")
            return text_search.search_nodes(ranked, nodes).select("name", "qualified_name", "label", "file_path", "start_line", "end_line", "rank").orderBy("rank", "name", "qualified_name").offset(offset).limit(limit)
        if semantic_query:
            kinds = nodes.where("label in ('Function', 'Method', 'Class', 'Interface', 'Module')")
            words = kinds.select("id", "name", "qualified_name", "label", "file_path", vectors.text_tokens(F.concat_ws(" ", "name", "qualified_name", "label")).alias("t"))
            made = vectors.hashed_vectors(words, "id", "t")
            asked = self.spark.createDataFrame([(i, w) for i, w in enumerate(semantic_query)], "id int, w string").select("id", vectors.text_tokens(F.col("w")).alias("t"))
            keys = [r["vector"] for r in vectors.hashed_vectors(asked, "id", "t").collect()]  # one row a keyword
            return vectors.search(made, keys, "vector").join(words.drop("t"), "id").select("name", "qualified_name", "label", "file_path", "score").orderBy(F.desc("score"), "name", "qualified_name").offset(offset).limit(limit or 25)
        found = graph.search(nodes, edges, label=label, name=name_pattern, qualified_name=qn_pattern, file=file_pattern, relationship=relationship, min_degree=min_degree, max_degree=max_degree, exclude_entry_points=exclude_entry_points)
        columns = ["name", "qualified_name", "label", "file_path", "in_degree", "out_degree"]
        total = found.agg(F.count(F.lit(1)).alias("total"))
        page = graph.page(found, sort_by, sort_direction == "desc", limit, offset)
        return page.crossJoin(F.broadcast(total)).select(*columns, "total", (F.col("total") > offset + (limit or 100)).alias("has_more"))  # one row

    def connected(self, project: str, limit: int = 5) -> DataFrame:
        """The first neighbours of every node, both ways."""
        nodes, edges = self._graph(project)
        side = lambda out, name: graph.neighbours(edges, nodes, limit, out).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "neighbour"))), lambda x: x["neighbour"]).alias(name))
        return nodes.select("id", "qualified_name").join(side(False, "inbound"), "id", "left").join(side(True, "outbound"), "id", "left")

    def query_graph(self, query: str, project: str | None = None, max_rows: int = 50) -> DataFrame:
        return cypher.run(query, *self._graph(project), max_rows)

    def _starts(self, nodes: DataFrame, name: str) -> DataFrame:
        exact = nodes.where(F.col("qualified_name") == name)
        return (exact if not exact.isEmpty() else nodes.where((F.col("name") == name) & ~F.col("label").isin("File", "Folder", "Module")).orderBy("file_path", "start_line", "id").limit(1)).select("id")

    def trace_call_path(self, project: str, function_name: str, direction: str = "out", depth: int = 6, mode: str = "calls", edge_types: list[str] | None = None, include_tests: bool = False) -> DataFrame:
        nodes, edges = self._graph(project)
        found = graph.trace(nodes, edges, self._starts(nodes, function_name), depth, direction, mode, edge_types, include_tests=include_tests)
        return found.select("way", "name", "qualified_name", "hop", "risk", rules.is_test_file(F.col("file_path")).alias("is_test")).orderBy("way", "hop", "name", "qualified_name")

    def get_code_snippet(self, project: str, qualified_name: str) -> DataFrame:
        """The source of one symbol, or suggestions without source where several match; what the graph does
        not have is looked up by file and name, then in the overlay. LookupError where nothing has it."""
        nodes, edges = self._graph(project)
        own = nodes.where("label not in ('Project', 'Folder')")
        found = text_search.snippet(own, qualified_name)
        if found.isEmpty():
            found = text_search.by_stem(own, qualified_name)
        if found.isEmpty() and self.store.has("overlay_symbols", project):
            symbols = self.store.read("overlay_symbols", project).select("project", F.xxhash64("symbol").alias("id"), "label", "name", "qualified_name", F.col("rel_path").alias("file_path"), "start_line", "end_line")
            method = F.col("match_method")
            found = text_search.snippet(symbols, qualified_name).withColumn("match_method", F.when(method == "exact", "overlay").when(method == "suffix", "overlay_suffix").otherwise(method))
        if found.isEmpty():
            raise LookupError(f"no symbol is called {qualified_name}")
        calls = graph.degrees(found, edges, ["CALLS"]).withColumnsRenamed({"in_degree": "callers", "out_degree": "callees"})
        texts = self.store.read("documents", project).select("file_path", "text")
        source = F.when(F.col("match_method") != "ambiguous", text_search.slice_lines(F.col("text"), F.col("start_line"), F.col("end_line")))
        return calls.join(texts, "file_path", "left").select("name", "qualified_name", "label", "file_path", "start_line", "end_line", source.alias("source"), "match_method", "callers", "callees").orderBy("qualified_name")

    def get_graph_schema(self, project: str) -> DataFrame:
        """kind (label, edge type or language), key and n, largest first."""
        nodes, edges = self._graph(project)
        languages = self.store.read("documents", project).where("language is not null")
        part = lambda rows, c, kind: graph.histogram(rows, c).select(F.lit(kind).alias("kind"), F.col(c).alias("key"), "n")
        return part(nodes, "label", "label").unionByName(part(edges, "type", "type")).unionByName(part(languages, "language", "language")).orderBy("kind", F.desc("n"), "key")

    def get_architecture(self, project: str, aspects: tuple[str, ...] = ("structure", "dependencies")) -> dict[str, DataFrame]:
        """A DataFrame for each aspect: structure, dependencies, languages, packages, hotspots, entry_points, routes, messages."""
        nodes, edges = self._graph(project)
        docs = self.store.read("documents", project)
        names = nodes.select("id", "name")
        named = edges.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
        made = {
            "structure": lambda: graph.histogram(nodes, "label"),
            "dependencies": lambda: graph.histogram(edges, "type"),
            "languages": lambda: graph.histogram(docs.withColumn("language", F.coalesce("language", F.lit("unknown"))), "language"),
            "packages": lambda: graph.histogram(docs.withColumn("package", rules.package(F.col("file_path"))), "package"),
            "hotspots": lambda: graph.hotspots(nodes, edges).select("name", "qualified_name", "total_degree"),
            "entry_points": lambda: graph.entry_points(nodes, edges, "Function").select("name", "qualified_name", "out_degree"),
            "routes": lambda: named.where(F.col("type").contains("HTTP") | F.col("type").contains("ROUTE") | (F.col("type") == "HANDLES")).select("source", "target", "type"),
            "messages": lambda: named.where("type in ('EMITS', 'SUBSCRIBES')").groupBy(F.col("target").alias("topic")).agg(F.array_sort(F.collect_set(F.when(F.col("type") == "EMITS", F.col("source")))).alias("emitters"), F.array_sort(F.collect_set(F.when(F.col("type") == "SUBSCRIBES", F.col("source")))).alias("subscribers")),
        }
        return {a: made[a]() for a in (made if "all" in aspects else aspects)}

    def search_code(self, project: str, pattern: str, mode: str = "compact", file_pattern: str = "", path_filter: str = "", regex: bool = False, limit: int = 25, context: int = 0, counts: bool = False) -> DataFrame:
        """Matching lines by symbol (compact), with source (full), or by file (files); with `counts` one row of
        how many lines and symbols match in all, the share of lines folded away, and whether there are more."""
        docs, nodes = self.store.read("documents", project).select("file_path", "text"), self.store.read("nodes", project)
        hits = text_search.grep(docs, pattern, regex, path_filter, file_pattern)
        if counts:
            found = text_search.folded(text_search.by_symbol(text_search.attributed(hits, nodes)))
            return text_search.hit_counts(hits, found, limit)
        if mode == "files":
            return graph.histogram(hits, "file_path").orderBy("file_path").limit(limit)
        found = text_search.ranked(text_search.folded(text_search.by_symbol(text_search.attributed(hits, nodes))), limit)
        if mode == "compact":
            return found.drop("alone")
        first, last = F.coalesce("start_line", F.array_min("match_lines")), F.coalesce("end_line", F.array_max("match_lines"))
        return found.join(docs, "file_path").withColumn("source", text_search.slice_lines(F.col("text"), first, last, context)).drop("alone", "text")

    def detect_changes(self, project: str, repo_path: str, base_branch: str = "main", since: str | None = None, depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Changed files, the symbols in them, and what those reach."""
        nodes, edges = self._graph(project)
        changed = sources.changed_files(self.spark, repo_path, base_branch, since)
        hit = nodes.where(~F.col("label").isin("File", "Module")).join(changed.select("file_path"), "file_path", "left_semi")
        radius = graph.blast_radius(nodes, edges, hit, depth)
        return changed, hit.select("name", "label", "file_path", "qualified_name"), radius.select("name", "qualified_name", "file_path", "hop", "risk")


