"""Passes that derive nodes and edges from a graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators.checkpoint import cut

MANIFESTS = ["Cargo.toml", "go.mod", "requirements.txt", "Gemfile", "pom.xml", "composer.json", "build.gradle", "pyproject.toml", "setup.py", "setup.cfg", "package.json"]
CONFIG_ENDS = r"\.(yaml|yml|toml|json|ini|xml)$"


def test_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """TESTS: calls from a test function of a test file to something that is not one."""
    marked = nodes.withColumn("is_test", rules.is_test_path(F.col("file_path")) & rules.is_test_function(F.col("name")))
    near = marked.where("is_test").select(F.col("id").alias("source_id"))
    far = marked.where(~rules.is_test_path(F.col("file_path"))).select(F.col("id").alias("target_id"))
    return edges.where("type = 'CALLS'").join(near, "source_id").join(far, "target_id").select("source_id", "target_id", F.lit("TESTS").alias("type")).distinct()


def test_file_edges(files: DataFrame) -> DataFrame:
    """TESTS_FILE: a test file (id, file_path) and the file it is named after."""
    tests = files.where(rules.is_test_path(F.col("file_path"))).select(F.col("id").alias("source_id"), rules.tested_path(F.col("file_path")).alias("path"))
    return tests.join(files.select(F.col("file_path").alias("path"), F.col("id").alias("target_id")), "path").select("source_id", "target_id", F.lit("TESTS_FILE").alias("type"))


def config_links(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """source (a symbol), target (a configuration key) and confidence: 1.0 for equal names in one
    spelling, 0.75 where the symbol's name contains the key's.

    A key is contained in a name only if their parts are aligned or it stands within one of them, so
    candidates come from an equi-join on three-letter pieces: the key's rarest piece must be in the name.
    """
    left = keys.select(F.col("id").alias("target_id"), rules.config_name(F.col("name")).alias("key")).where(rules.is_specific_config(F.col("key")))
    right = symbols.select(F.col("id").alias("source_id"), rules.config_name(F.col("name")).alias("symbol")).where("symbol != ''")
    equal = left.join(right, F.col("key") == F.col("symbol")).select("source_id", "target_id", F.lit(1.0).alias("confidence"))
    pieces = F.expr("array_distinct(transform(sequence(1, char_length(symbol) - 2), i -> substring(symbol, i, 3)))")
    held = right.where(F.char_length("symbol") >= 3).select("source_id", "symbol", F.explode(pieces).alias("piece"))
    counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = left.select("target_id", "key", F.explode(F.expr("array_distinct(transform(sequence(1, char_length(key) - 2), i -> substring(key, i, 3)))")).alias("piece")).join(counts, "piece")
    rarest = own.groupBy("target_id", "key").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    within = rarest.join(held, "piece").where((F.col("key") != F.col("symbol")) & F.col("symbol").contains(F.col("key"))).select("source_id", "target_id", F.lit(0.75).alias("confidence"))
    return equal.unionByName(within)


def dependency_links(variables: DataFrame, imports: DataFrame) -> DataFrame:
    """Manifest variables and what is imported under their name (0.95) or with it in the qualified name (0.80)."""
    names = variables.where(rules.basename(F.col("file_path")).isin(MANIFESTS)).select(F.col("id").alias("target_id"), "name")
    names = names.where(F.char_length("name") > 0)
    equal = names.join(imports.select(F.col("id").alias("source_id"), "name", "qualified_name"), "name").select("source_id", "target_id", F.lit(0.95).alias("confidence"))
    parts = imports.select(F.col("id").alias("source_id"), F.col("name").alias("own"), F.explode(F.array_distinct(F.split("qualified_name", r"[./:]+"))).alias("name"))
    inside = parts.join(names, "name").where("own != name").select("source_id", "target_id", F.lit(0.80).alias("confidence"))
    return equal.unionByName(inside).groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence"))


#: Rows of callers, and of handlers, that meet in one group.
CALLERS, HANDLERS = 1 << 16, 1 << 20


def data_flows(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """DATA_FLOWS from each caller of a route to each of its handlers that it does not call directly.

    There can be as many pairs as callers times handlers, so they are made where they are given back and
    never moved: callers and handlers are cut into blocks by hash, every two blocks meet on their own, and a
    pair of symbols stands in one group alone, whatever routes they share.
    """
    side = F.when(F.col("type") == "HANDLES", 0).when(F.col("type").isin("HTTP_CALLS", "ASYNC_CALLS"), 1)
    held = edges.select(side.alias("side"), F.col("source_id").alias("id"), F.col("target_id").alias("route")).where("side is not null and id is not null and route is not null").distinct()
    held = cut(held.join(routes.select(F.col("id").alias("route")), "route", "left_semi"))
    sizes = {r["side"]: r["n"] for r in held.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    down, across = -(-sizes.get(1, 0) // CALLERS) or 1, -(-sizes.get(0, 0) // HANDLERS) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    handlers = held.where("side = 0").select(every(down).alias("i"), block("id", across).alias("j"), "side", "id", F.col("route").alias("to"))
    callers = held.where("side = 1").select(block("id", down).alias("i"), every(across).alias("j"), "side", "id", F.col("route").alias("to"))
    direct = edges.where("type = 'CALLS' and source_id is not null and target_id is not null").select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct()
    direct = direct.select(block("id", down).alias("i"), block("to", across).alias("j"), F.lit(2).alias("side"), "id", "to")
    met = handlers.unionByName(callers).unionByName(direct).repartition(down * across, "i", "j").sortWithinPartitions("i", "j", "side", "id")
    kind = edges.schema["source_id"].dataType.simpleString()
    return met.mapInArrow(_flows, f"source_id {kind}, target_id {kind}").withColumn("type", F.lit("DATA_FLOWS"))


def _flows(batches):
    """The pairs of each group of rows of equal i and j."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        i, j = (batch.column(c).to_numpy() for c in ("i", "j"))
        new = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if held and (i[s], j[s]) != key:
                yield from _pairs(pa.Table.from_batches(held))
                held = []
            key = i[s], j[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield from _pairs(pa.Table.from_batches(held))


def _pairs(group: pa.Table, most: int = 1 << 20):
    """source_id and target_id of a group, source by source, in batches of about so many pairs."""
    side = group.column("side").to_numpy()
    starts = np.searchsorted(side, [0, 1, 2, 3]).tolist()
    handlers, callers, direct = (group.slice(s, e - s) for s, e in zip(starts, starts[1:]))
    if not handlers.num_rows or not callers.num_rows:
        return
    targets, routes = (pc.unique(handlers.column(c).combine_chunks()) for c in ("id", "to"))
    place = lambda column, among: pc.index_in(column, among).combine_chunks().fill_null(-1).to_numpy()
    order = np.argsort(place(handlers.column("to"), routes), kind="stable")
    to = place(handlers.column("id"), targets)[order]
    first = np.searchsorted(place(handlers.column("to"), routes)[order], np.arange(len(routes) + 1))
    sources = pc.unique(callers.column("id").combine_chunks())
    own, asked = place(callers.column("id"), sources), place(callers.column("to"), routes)
    itself = place(pa.chunked_array([sources]), targets)
    known, called = place(direct.column("id"), sources), place(direct.column("to"), targets)
    good = (known >= 0) & (called >= 0)
    sort = np.argsort(known[good], kind="stable")
    known, called = known[good][sort], called[good][sort]
    at = np.searchsorted(own, np.arange(len(sources) + 1))
    drop = np.searchsorted(known, np.arange(len(sources) + 1))
    out, n = [], 0
    mark = np.zeros(len(targets) + 1, dtype=bool)  # the last place takes what is no target here
    for k in range(len(sources)):
        mark[:] = False
        for r in asked[at[k] : at[k + 1]].tolist():
            if r >= 0:
                mark[to[first[r] : first[r + 1]]] = True
        mark[called[drop[k] : drop[k + 1]]] = False
        mark[[itself[k], -1]] = False
        found = np.flatnonzero(mark)
        for a in range(0, len(found), most):
            part = found[a : a + most]
            out.append((k, part))
            n += len(part)
            if n >= most:
                yield _batch(sources, targets, out)
                out, n = [], 0
    if out:
        yield _batch(sources, targets, out)


def _batch(sources: pa.Array, targets: pa.Array, out: list) -> pa.RecordBatch:
    near = np.repeat([k for k, _ in out], [len(found) for _, found in out])
    return pa.RecordBatch.from_arrays([sources.take(pa.array(near)), targets.take(pa.array(np.concatenate([found for _, found in out])))], ["source_id", "target_id"])


def topic_edges(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """EMITS and SUBSCRIBES between symbols and the topics of asynchronous routes (id, broker, topic)."""
    topic = F.concat(F.lit("__event__"), "broker", F.lit("__"), "topic")
    named = routes.where("broker is not null").select(F.col("id").alias("target_id"), topic.alias("topic_name"))
    kind = F.when(F.col("type") == "ASYNC_CALLS", "EMITS").when(F.col("type") == "HANDLES", "SUBSCRIBES")
    return edges.where("type in ('ASYNC_CALLS', 'HANDLES')").join(named, "target_id").select("source_id", "topic_name", kind.alias("type")).distinct()


def topic_summary(topics: DataFrame) -> DataFrame:
    """Emitters and subscribers of each topic, in order."""
    side = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("source_id"))))
    return topics.groupBy("topic_name").agg(side("EMITS").alias("emitters"), side("SUBSCRIBES").alias("subscribers"))


def routes_of_calls(calls: DataFrame) -> DataFrame:
    """Calls (source_id, callee, first_string) to services, as edges to routes by qualified name, with the broker."""
    kind = rules.service_kind(F.col("callee"))
    path = F.col("first_string").startswith("/") | F.col("first_string").rlike("^https?://")
    method = F.when(kind == "async_broker", F.lit("TOPIC")).otherwise(F.coalesce(rules.http_method(F.col("callee")), F.lit("ANY")))
    edge = F.when(kind == "http_client", "HTTP_CALLS").when(kind == "async_broker", "ASYNC_CALLS").when(kind == "route_registration", "HANDLES").when(path, "HTTP_CALLS")
    return calls.where("first_string is not null").select("source_id", edge.alias("type"), F.concat(F.lit("__route__"), method, F.lit("__"), "first_string").alias("route"), F.when(kind == "async_broker", rules.broker(F.col("callee"))).alias("broker")).where("type is not null")
