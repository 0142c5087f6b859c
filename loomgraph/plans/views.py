"""The driver's tables as a property graph, documents, symbols and commits, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.checkpoint import dealt

BASE = 10_000_000_000
STEP = 100_000_000_000_000_000
#: label -> (code, table, key, name, file path as SQL, properties by name as SQL)
LABELS = {
    "Region": (1, "region", "r_regionkey", "r_name", "'geo/region.tbl'", {}),
    "Nation": (2, "nation", "n_nationkey", "n_name", "'geo/nation.tbl'", {"region": "n_regionkey"}),
    "Customer": (3, "customer", "c_custkey", "c_name", "concat('sales/', lower(c_mktsegment), '/customer.tbl')", {"segment": "c_mktsegment", "balance": "floor(c_acctbal)", "nation": "c_nationkey"}),
    "Supplier": (4, "supplier", "s_suppkey", "s_name", "'supply/supplier.tbl'", {"nation": "s_nationkey"}),
    "Part": (5, "part", "p_partkey", "p_name", "concat('supply/', lower(p_type), '/part.tbl')", {"brand": "p_brand", "type": "p_type", "size": "p_size"}),
    "Order": (6, "orders", "o_orderkey", "concat('Order#', cast(o_orderkey as varchar(20)))", "'sales/orders.tbl'", {"status": "o_orderstatus", "priority": "o_orderpriority"}),
}
#: type -> (code, table, source label, source key, target label, target key)
TYPES = {
    "IN_REGION": (1, "nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
    "IN_NATION": (2, "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    "BASED_IN": (3, "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    "PLACED": (4, "orders", "Customer", "o_custkey", "Order", "o_orderkey"),
    "CONTAINS": (5, "lineitem", "Order", "l_orderkey", "Part", "l_partkey"),
    "SUPPLIED_BY": (6, "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node_columns(label: str, prop) -> list[str]:
    code, _, key, name, path, props = LABELS[label]
    return [f"{code * BASE} + cast({key} as bigint) as id", f"'{label}' as label", f"{name} as name", f"concat('{label}:', cast({key} as varchar(20))) as qualified_name", f"{path} as file_path", f"cast({key} % 50 * 10 + 1 as int) as start_line", f"cast({key} % 50 * 10 + 10 as int) as end_line", prop(props)]


def nodes(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(LABELS)) -> DataFrame:
    text = lambda v: f"cast(cast({v} as bigint) as string)" if v.startswith(("floor", "p_size")) or v.endswith("key") else v
    prop = lambda props: f"{'map(' + ', '.join(f'{k!r}, {text(v)}' for k, v in props.items()) + ')' if props else 'cast(map() as map<string,string>)'} as properties"
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, LABELS[x][1]).selectExpr(*_node_columns(x, prop)) for x in labels])


def edges(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = tuple(TYPES)) -> DataFrame:
    """Parallel rows of lineitem are one edge."""
    out = []
    for name in types:
        code, source, near, a, far, b = TYPES[name]
        rows = table(spark, sf_dir, source).selectExpr(f"cast({a} as bigint) as a", f"cast({b} as bigint) as b")
        rows = dealt(rows, "a", "b").distinct() if source == "lineitem" else rows
        out.append(rows.selectExpr(f"{code * STEP} + a * 10000000 + b as id", f"{LABELS[near][0] * BASE} + a as source_id", f"{LABELS[far][0] * BASE} + b as target_id", f"'{name}' as type", "cast(map() as map<string,string>) as properties"))
    return reduce(DataFrame.unionByName, out)


def _sql_nodes() -> str:
    parts = []
    for label, (_, source, *_rest) in LABELS.items():
        props = LABELS[label][5]
        text = ", ".join(f"'{k}': " + (f"cast(cast({v} as bigint) as varchar)" if v.startswith(("floor", "p_size")) or v.endswith("key") else v) for k, v in props.items())
        parts.append("select " + ", ".join(_node_columns(label, lambda p, t=text: f"{'MAP {' + t + '}' if t else 'CAST(MAP {} AS MAP(VARCHAR, VARCHAR))'} as properties")) + f" from {source}")
    return "nodes as (" + " union all ".join(parts) + ")"


def _sql_edges() -> str:
    parts = []
    for name, (code, source, near, a, far, b) in TYPES.items():
        rows = f"(select {'distinct' if source == 'lineitem' else ''} cast({a} as bigint) as a, cast({b} as bigint) as b from {source})"
        parts.append(f"select {code * STEP} + a * 10000000 + b as id, {LABELS[near][0] * BASE} + a as source_id, {LABELS[far][0] * BASE} + b as target_id, '{name}' as type from {rows}")
    return "edges as (" + " union all ".join(parts) + ")"


GRAPH = f"{_sql_nodes()}, {_sql_edges()}"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested spans over the lines of documents: the module, a class of lines 1 to 12, functions of five lines."""
    d = table(spark, sf_dir, "documents").where("text is not null").selectExpr("doc_id", "size(split(text, '\n', -1)) as n")
    module = d.selectExpr("doc_id", "doc_id * 1000000 as id", "concat('m', doc_id) as name", "'Module' as label", "1 as start_line", "n as end_line")
    outer = d.selectExpr("doc_id", "doc_id * 1000000 + 1 as id", "concat('C', doc_id) as name", "'Class' as label", "1 as start_line", "12 as end_line")
    inner = d.selectExpr("doc_id", "explode(sequence(0, (n - 1) div 5)) as k").selectExpr("doc_id", "doc_id * 1000000 + 2 + k as id", "concat('f', k) as name", "'Function' as label", "cast(k * 5 + 2 as int) as start_line", "cast(k * 5 + 4 as int) as end_line")
    return module.unionByName(outer).unionByName(inner)


SYMBOLS = """sized as (select doc_id, len(string_split(text, chr(10))) as n from documents where text is not null),
symbols as (
 select doc_id, doc_id * 1000000 as id, concat('m', doc_id) as name, 'Module' as label, 1 as start_line, n as end_line from sized
 union all select doc_id, doc_id * 1000000 + 1, concat('C', doc_id), 'Class', 1, 12 from sized
 union all select doc_id, doc_id * 1000000 + 2 + k, concat('f', k), 'Function', k * 5 + 2, k * 5 + 4 from (select doc_id, unnest(range(0, (n - 1) // 5 + 1)) as k from sized)),
lines as (select doc_id, unnest(string_split(text, chr(10))) as content, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents where text is not null)"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a commit, the brands in them as files."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("commit_id"), F.col("p_brand").alias("file_path")).distinct()
