"""Steps whose cost must not grow faster than what they read."""

import re
from collections import Counter

import numpy as np
import pytest
from test_catalog import same

from loomgraph.llm import ann
from loomgraph.operators import checkpoint, enrich, graph, similarity
from loomgraph.plans import catalog, views


def planned(made):
    return made._jdf.queryExecution().executedPlan().toString()


def test_flows_are_not_moved(spark):
    """The pairs of callers and handlers are given back where they are made."""
    plan = planned(catalog.QUERIES["dataflow_anti_join"](spark, "/root/testdata/sf0.01"))
    assert "hashpartitioning(source_id" not in plan


def test_flows_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(enrich, "CALLERS", 900)
    monkeypatch.setattr(enrich, "HANDLERS", 700)
    assert same(spark, "dataflow_anti_join", "sf0.01") > 0


def test_flows_of_odd_rows(spark):
    """Names as ids, empty ends, a caller that handles its own route, copies, and calls of what handles nothing."""
    rows = [("a", "HTTP_CALLS", "r"), ("a", "HTTP_CALLS", "r"), ("a", "ASYNC_CALLS", "q"), ("b", "HTTP_CALLS", "r"), (None, "HTTP_CALLS", "r"), ("c", "HTTP_CALLS", None), ("d", "HTTP_CALLS", "unknown")]
    rows += [("h", "HANDLES", "r"), ("h", "HANDLES", "q"), ("a", "HANDLES", "r"), (None, "HANDLES", "r"), ("x", "HANDLES", "unknown")]
    rows += [("b", "CALLS", "h"), ("a", "CALLS", "z"), ("z", "CALLS", "h"), ("b", "CALLS", None)]
    edges = spark.createDataFrame(rows, "source_id string, type string, target_id string")
    made = enrich.data_flows(edges, spark.createDataFrame([("r",), ("q",), ("r",)], "id string"))
    assert sorted(tuple(r) for r in made.collect()) == [("a", "h", "DATA_FLOWS"), ("b", "a", "DATA_FLOWS")]
    assert enrich.data_flows(edges.where("type = 'CALLS'"), spark.createDataFrame([("r",)], "id string")).count() == 0


def test_neighbours_of_queries_unlike_the_table(spark):
    """Queries that lie between the clusters of the table, where fitted vectors say nothing about them."""
    rng = np.random.default_rng(1)
    noise, at = rng.normal(size=(6000, 32)), np.arange(6000)
    x = (rng.normal(size=(40, 32)) * 3)[rng.integers(40, size=6000)] + noise * 0.3
    x[at % 20 == 0] = noise[at % 20 == 0] * 3
    x = x.astype(np.float32).astype(np.float64)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.search(table, table.where("vec_id % 20 = 0"), k=20).collect()}
    score = x[::20] @ x.T
    score[np.arange(300), at[::20]] = -np.inf
    wanted = {(20 * q, int(i)) for q, best in enumerate(np.argsort(-score, axis=1)[:, :20]) for i in best}
    assert len(wanted & got) >= 0.93 * len(wanted)


def test_degrees_are_counted_in_more_parts_where_there_is_more(spark, monkeypatch):
    """A task's share of the edges' ends is bounded: twice the bytes, twice the partitions."""
    counted = []
    for share in (1 << 14, 1 << 13):
        monkeypatch.setattr(checkpoint, "SHARE", share)
        plan = planned(catalog.QUERIES["hotspots"](spark, "/root/testdata/sf0.01"))
        counted.append([int(n) for n in re.findall(r"hashpartitioning\(\w+#\d+L?(?:, \w+#\d+L?)*, (\d+)\), REPARTITION_BY_NUM", plan)])
    assert counted[0] and all(n > 4 and 1.8 * n < m for n, m in zip(*counted))
    assert same(spark, "hotspots", "sf0.01") > 0


def test_rows_of_unknown_size_are_dealt_out_by_the_setting(spark):
    assert checkpoint.dealt(spark.createDataFrame([(1,), (2,)], "id long"), "id").count() == 2


WALKS = ["bfs_out_depth3", "bfs_both_capped", "trace_risk_labels", "blast_radius"]


@pytest.mark.parametrize("name", WALKS)
def test_walks_store_what_they_find_alone(spark, monkeypatch, name):
    stored = []

    def cut(df):
        stored.append(checkpoint.cut(df))
        return stored[-1]

    monkeypatch.setattr(graph, "cut", cut)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert stored and max(df.count() for df in stored) < 0.3 * views.edges(spark, "/root/testdata/sf0.01").count()


@pytest.mark.parametrize("name", WALKS)
def test_walks_with_many_nodes_in_a_level(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "FEW", 2)
    assert same(spark, name, "sf0.01") > 0


@pytest.mark.parametrize("few", [0, 100])
def test_edges_of_a_walk_both_ways(spark, monkeypatch, few):
    """A loop, a cycle, and an edge whose target is nearer than its source."""
    monkeypatch.setattr(graph, "FEW", few)
    rows = [(1, 1, 2), (2, 3, 1), (3, 3, 2), (4, 4, 3), (5, 5, 4), (6, 1, 1), (7, 8, 9)]
    edges = spark.createDataFrame([(*r, "T") for r in rows], "id long, source_id long, target_id long, type string")
    start = spark.createDataFrame([(1,)], "id long")
    walked = lambda way: {r.id: r.depth for r in graph.traverse(edges, start, 2, way).collect()}
    assert walked("both") == {1: 1, 2: 1, 3: 2, 4: 2, 6: 1}
    assert walked("out") == {1: 1, 6: 1} and walked("in") == {2: 1, 4: 2, 6: 1}


def test_similar_pairs_are_not_moved(spark):
    """Pairs of signatures are compared where they meet, not gathered to be told apart."""
    assert "hashpartitioning(a#" not in planned(catalog.QUERIES["minhash_near_dups"](spark, "/root/testdata/sf0.01"))


@pytest.mark.parametrize("hot", [None, 12])
def test_similar_pairs_of_many_blocks(spark, monkeypatch, hot):
    """Each pair once, whatever bands it shares; with a limit, by the buckets within it alone."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    rng = np.random.default_rng(4)
    sigs = (1 << 31) + 10 - rng.integers(0, 5, size=(30, 8))[rng.integers(30, size=150)] * rng.integers(1, 1 << 28, size=8)
    sigs[rng.random(sigs.shape) < 0.15] = 7
    made = spark.createDataFrame([(1000 - i, s.tolist()) for i, s in enumerate(sigs)], "id long, sig array<long>")
    got = sorted(tuple(r) for r in similarity.similar_pairs(made, "id", 4, 0.5, hot).collect())
    rows, wanted = {1000 - i: tuple(s) for i, s in enumerate(sigs.tolist())}, []
    least = {}
    for i in sorted(rows):
        if hot is None and least.setdefault(rows[i], i) != i:
            wanted.append((least[rows[i]], i, 1.0))
    ids = sorted(least.values()) if hot is None else sorted(rows)
    full = Counter((k, rows[i][2 * k : 2 * k + 2]) for i in ids for k in range(4))
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            shared = [k for k in range(4) if rows[i][2 * k : 2 * k + 2] == rows[j][2 * k : 2 * k + 2] and full[k, rows[i][2 * k : 2 * k + 2]] <= (hot or 1000)]
            score = sum(x == y for x, y in zip(rows[i], rows[j])) / 8
            if shared and score >= 0.5:
                wanted.append((i, j, score))
    assert got == sorted(wanted) and len(got) > 50
    assert hot is None or max(full.values()) > hot
