"""Queries on tables larger than the limits they once had."""

import math
import random

import pytest
from test_catalog import same

from loomgraph.plans import catalog


def test_related_beyond_96_rows_of_a_token(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 1, [rng.gauss(0, 1) for _ in range(4)]) for i in range(2100)]
    rows += [(3000 + 7 * i, 1, [1.0, 0.0, 0.0, 0.0]) for i in range(9)]  # equal scores, one token
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    size = {i: math.sqrt(sum(x * x for x in v)) for i, v in table}
    wanted = {}
    for i, v in table[::20] + [t for t in table if t[0] >= 3000]:
        scored = [(-sum(x * y for x, y in zip(v, w)) / (size[i] * size[j]), j) for j, w in table if i != j and i % 7 == j % 7]
        wanted[i] = [j for s, j in sorted(scored)[:6] if s <= -0.45]
    got = {}
    for r in catalog.QUERIES["related_top6"](spark, str(tmp_path)).orderBy("source", "place").collect():
        got.setdefault(r.source, []).append(r.target)
    assert {i: got.get(i, []) for i in wanted} == wanted and any(wanted.values())


def test_label_boost_reaches_late_lines(spark):
    late = catalog.QUERIES["bm25_label_boost_whole"](spark, "/root/testdata/sf0.01").where("label = 'Function' and name not in ('f0', 'f1')")
    assert late.count() > 0


@pytest.mark.parametrize("name, limit", [("cypher_and_or_precedence", 1000), ("cypher_json_property", 300), ("cypher_edge_filter", 100), ("cypher_numeric_filter", 500)])
def test_filters_give_all_rows(spark, name, limit):
    assert same(spark, f"{name}_whole", "sf0.1") > limit


def test_edges_to_known_users_are_inserted(spark):
    made = catalog.QUERIES["edge_insert_whole"](spark, "/root/testdata/sf0.1")
    assert made.where("target_id >= 30").count() > 0 and made.where("target_id < 30").count() > 0


def test_near_copies_in_large_groups_are_paired(spark, tmp_path):
    """Groups of more copies than a bucket once could hold: no text is left without a partner."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text) for i in range(300)] + [(400 + i, f"{text} tail{i}") for i in range(3)] + [(500, "another text of five words"), (501, "too short"), (502, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.a, r.b): r.jaccard for r in catalog.QUERIES["minhash_near_dups"](spark, str(tmp_path)).collect()}
    assert {(0, i) for i in range(1, 300)} <= set(got) and {b for a, b in got} == {*range(1, 300), 400, 401, 402}
    assert all(j >= 0.8 for j in got.values())
