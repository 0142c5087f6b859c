"""Every query of the graph and text operators by name, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import match, rules
from loomgraph.operators import coupling, cypher, enrich, graph, incremental, resolve, similarity, text_search, vectors
from loomgraph.operators.checkpoint import cut
from loomgraph.plans import views
from loomgraph.plans.views import BASE, GRAPH, SYMBOLS
from loomgraph.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query function under its own name and, where SQL can express it, its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def _cypher(name: str, text: str, sql: str) -> None:
    """Registers a query, and one with a LIMIT also without it, as name_whole."""

    def run(spark, sf_dir):
        return cypher.run(text, views.nodes(spark, sf_dir), views.edges(spark, sf_dir))

    def whole(spark, sf_dir):
        return cypher.run(text.rpartition(" LIMIT ")[0], views.nodes(spark, sf_dir), views.edges(spark, sf_dir), unlimited=True)

    QUERIES[name], ORACLES[name] = run, f"with {GRAPH} {sql}"
    if " LIMIT " in text:
        QUERIES[f"{name}_whole"], ORACLES[f"{name}_whole"] = whole, f"with {GRAPH} {sql.rpartition(' limit ')[0]}"


_cypher(
    "cypher_edge_filter",
    'MATCH (c:Customer)-[r:IN_NATION]->(n:Nation) WHERE n.region = "2" AND c.name CONTAINS "7" RETURN c.name AS customer, n.name AS nation ORDER BY c.name LIMIT 100',
    "select a.name as customer, b.name as nation from nodes a join edges r on a.id = r.source_id join nodes b on b.id = r.target_id where a.label = 'Customer' and b.label = 'Nation' and r.type = 'IN_NATION' and b.properties['region'] = '2' and contains(a.name, '7') order by a.name, r.id limit 100",
)
_cypher("cypher_node_count", 'MATCH (p:Part) WHERE p.brand = "Brand#2" RETURN COUNT(p) AS n', "select cast(count(*) as varchar) as n from nodes where label = 'Part' and properties['brand'] = 'Brand#2'")
_cypher("cypher_edge_count", "MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE p.size >= 40 RETURN COUNT(r) AS n", "select cast(count(*) as varchar) as n from edges r join nodes b on b.id = r.target_id where r.type = 'CONTAINS' and cast(b.properties['size'] as bigint) >= 40")
_cypher("cypher_distinct_label", "MATCH (n) RETURN DISTINCT n.label AS label ORDER BY n.label DESC", "select distinct label from nodes")
_cypher(
    "cypher_and_or_precedence",
    'MATCH (p:Part) WHERE p.type = "ECONOMY" OR p.brand = "Brand#1" AND p.size > 45 RETURN p.qualified_name AS part, p.size AS size ORDER BY p.qualified_name LIMIT 1000',
    "select qualified_name as part, properties['size'] as size from nodes where label = 'Part' and (properties['type'] = 'ECONOMY' or (properties['brand'] = 'Brand#1' and cast(properties['size'] as bigint) > 45)) order by qualified_name limit 1000",
)
_cypher(
    "cypher_numeric_filter",
    'MATCH (c:Customer) WHERE c.balance >= -500 AND c.balance < 0 AND c.segment != "BUILDING" RETURN c.name AS name, c.balance AS balance ORDER BY c.balance, c.name LIMIT 500',
    "select name, properties['balance'] as balance from nodes where label = 'Customer' and cast(properties['balance'] as bigint) between -500 and -1 and properties['segment'] != 'BUILDING' order by properties['balance'], name limit 500",
)
_cypher(
    "cypher_json_property",
    'MATCH (o:Order) WHERE o.priority LIKE "1-%" AND o.name =~ "^Order#(1|2)$|.*77.*" RETURN o.name AS name, o.status AS status, o.missing AS missing ORDER BY o.name LIMIT 300',
    "select name, properties['status'] as status, '' as missing from nodes where label = 'Order' and properties['priority'] like '1-%' and (name in ('Order#1', 'Order#2') or contains(name, '77')) order by name limit 300",
)


@query(f"with {GRAPH} select label, name, file_path from nodes where translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like '%ring%' or translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') like 'customer#0000000_5'")
def search_like_fold(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return n.where(match.like(F.col("name"), "RING") | match.like(F.col("name"), "CUSTOMER#0000000_5")).select("label", "name", "file_path")


@query(f"with {GRAPH} select qualified_name from nodes where contains(name, 'red ring') or contains(name, 'blue ring') or name = 'small widget'")
def regexish_alternation(spark, sf_dir):
    return views.nodes(spark, sf_dir).where(match.regexish(F.col("name"), "(red|blue) ring|^small widget$")).select("qualified_name")


@query(f"with {GRAPH} select label, count(*) as n from nodes where starts_with(file_path, 'supply/') and ends_with(file_path, '/part.tbl') or contains(file_path, 'geo') group by label")
def glob_path(spark, sf_dir):
    n = views.nodes(spark, sf_dir)
    return graph.histogram(n.where(match.glob(F.col("file_path"), "supply/*/part.tbl") | match.glob(F.col("file_path"), "*geo*")), "label")


DEGREES = f"with {GRAPH}, deg as (select n.*, coalesce(i.c, 0) as in_degree, coalesce(o.c, 0) as out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) as total_degree from nodes n left join (select target_id, count(*) c from edges group by 1) i on i.target_id = n.id left join (select source_id, count(*) c from edges group by 1) o on o.source_id = n.id)"


@query(f"{DEGREES} select qualified_name, name, in_degree, out_degree, total_degree from deg where label like '%Part%' and total_degree between 2 and 60 order by total_degree desc, name, id limit 50 offset 10")
def graph_search_degree_page(spark, sf_dir):
    found = graph.search(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), label="Part", min_degree=2, max_degree=60)
    return graph.page(found, "total_degree", descending=True, limit=50, offset=10).select("qualified_name", "name", "in_degree", "out_degree", "total_degree")


@query(f"{DEGREES} select count(*) as total, sum(total_degree) as degrees from deg where label like '%art%'")
def graph_search_total(spark, sf_dir):
    found = graph.search(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), label="art")
    return found.agg(F.count(F.lit(1)).alias("total"), F.sum("total_degree").alias("degrees"))


@query(f"with {GRAPH} select label, count(*) as n from nodes group by label")
def schema_label_hist(spark, sf_dir):
    return graph.histogram(views.nodes(spark, sf_dir), "label")


@query(f"with {GRAPH} select type, count(*) as n from edges group by type")
def schema_type_hist(spark, sf_dir):
    return graph.histogram(views.edges(spark, sf_dir), "type")


@query(f"with {GRAPH} select case when contains(file_path, '/') then split_part(file_path, '/', 1) else '.' end as package, count(distinct file_path) as files from nodes group by 1")
def package_hist(spark, sf_dir):
    return views.nodes(spark, sf_dir).select(rules.package(F.col("file_path")).alias("package"), "file_path").groupBy("package").agg(F.countDistinct("file_path").alias("files"))


@query(f"{DEGREES} select qualified_name, total_degree from deg order by total_degree desc, name, id limit 10")
def hotspots(spark, sf_dir):
    return graph.hotspots(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)).select("qualified_name", "total_degree")


@query(f"{DEGREES} select name, out_degree from (select * from deg where label = 'Customer' order by out_degree desc, name, id limit 100) where in_degree = 0 and out_degree > 0 order by out_degree desc, name, id limit 15")
def entry_points(spark, sf_dir):
    return graph.entry_points(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), "Customer").select("name", "out_degree")


@query(f"with {GRAPH}, named as (select e.source_id as id, n.name as neighbour, min(e.id) as edge from edges e join nodes n on n.id = e.target_id where e.type = 'SUPPLIED_BY' group by 1, 2), placed as (select id, neighbour, row_number() over (partition by id order by edge, neighbour) as place from named) select id, neighbour, cast(place as int) as place from placed where place <= 5")
def neighbors_first_k(spark, sf_dir):
    return graph.neighbours(views.edges(spark, sf_dir, ("SUPPLIED_BY",)), views.nodes(spark, sf_dir), 5)


def _walk(start: str, depth: int, both: bool, types: str = "") -> str:
    used = f"where type in ({types})" if types else ""
    back = f" union all select target_id, source_id from edges {used}" if both else ""
    return f"with recursive {GRAPH}, steps as (select source_id as near, target_id as far from edges {used}{back}), walk as (select {start} as id, 0 as d union select s.far, w.d + 1 from walk w join steps s on s.near = w.id where w.d < {depth}), dist as (select id, min(d) as dist from walk group by id)"


@query(f"{_walk(f'{3 * BASE + 7}', 3, False)} select e.source_id, e.target_id, e.type, d.dist + 1 as depth from edges e join dist d on d.id = e.source_id where d.dist < 3")
def bfs_out_depth3(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    starts = spark.range(3 * BASE + 7, 3 * BASE + 8)
    return graph.traverse(e, starts, 3).select("source_id", "target_id", "type", "depth")


@query(
    f"{_walk(f'{BASE}', 3, True, chr(39) + 'IN_REGION' + chr(39) + ',' + chr(39) + 'IN_NATION' + chr(39))}, levels as (select dist, sum(count(*)) over (order by dist) as seen from dist group by dist), reach as (select d.* from dist d join levels l using (dist) where l.seen <= 5 and d.dist < 3), met as (select e.id, min(r.dist) + 1 as depth from edges e join reach r on r.id in (e.source_id, e.target_id) where e.type in ('IN_REGION', 'IN_NATION') group by e.id) select e.source_id, e.target_id, m.depth from edges e join met m using (id)"
)
def bfs_both_capped(spark, sf_dir):
    e = views.edges(spark, sf_dir, ("IN_REGION", "IN_NATION"))
    return graph.traverse(e, spark.range(BASE, BASE + 1), 3, "both", cap=5).select("source_id", "target_id", "depth")


@query(f"{_walk(f'{3 * BASE + 7}', 4, False)} select n.qualified_name, d.dist as hop, case when d.dist <= 1 then 'CRITICAL' when d.dist = 2 then 'HIGH' when d.dist = 3 then 'MEDIUM' else 'LOW' end as risk from dist d join nodes n using (id) where d.dist > 0")
def trace_risk_labels(spark, sf_dir):
    found = graph.trace(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), spark.range(3 * BASE + 7, 3 * BASE + 8), 4, "out", types=list(views.TYPES), cap=None)
    return found.select("qualified_name", "hop", "risk")


@query(
    f"with recursive {GRAPH}, steps as (select source_id as near, target_id as far from edges union all select target_id, source_id from edges), walk as (select {4 * BASE} + k as seed, {4 * BASE} + k as id, 0 as d from range(1, 4) t(k) union select w.seed, s.far, w.d + 1 from walk w join steps s on s.near = w.id where w.d < 2), best as (select id, min(d) as hop from walk where id != seed group by id) select n.qualified_name, b.hop, case when b.hop <= 1 then 'high' when b.hop = 2 then 'medium' else 'low' end as risk from best b join nodes n using (id) where n.label not in ('Region', 'Order')"
)
def blast_radius(spark, sf_dir):
    seeds = spark.range(4 * BASE + 1, 4 * BASE + 4)
    return graph.blast_radius(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), seeds, 2, ("Region", "Order")).select("qualified_name", "hop", "risk")


@query(
    "with baskets as (select distinct o_custkey as c, p_brand as f from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey), small as (select c from baskets group by c having count(*) <= 20), used as (select * from baskets join small using (c)), single as (select f, count(*) n from used group by f), pairs as (select x.f as a, y.f as b, count(*) as n from used x join used y on x.c = y.c and x.f < y.f group by 1, 2) select a, b, n as \"both\", least(1.0, round(n / least(s.n_a, t.n_b), 6)) as score from pairs join (select f as a, n as n_a from single) s using (a) join (select f as b, n as n_b from single) t using (b) where n >= 3 and n / least(s.n_a, t.n_b) >= 0.3"
)
def cochange_coupling(spark, sf_dir):
    return coupling.couplings(views.baskets(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _bm25(terms: list[str]) -> str:
    token = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    counts = ", ".join(f"len(list_filter(tokens, lambda t: starts_with(t, '{t}'))) as f{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) filter (where f{i} > 0) as n{i}" for i in range(len(terms)))
    score = " ".join(f"- greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"with t as (select doc_id, {token} as tokens from documents), c as (select doc_id, len(tokens) as dl, {counts} from t), s as (select count(*) as n, avg(dl) as avgdl, {stats} from c), ranked as (select doc_id, 0.0 {score} as rank from c, s where {' and '.join(f'f{i} > 0' for i in range(len(terms)))})"


def _docs(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"{_bm25(['license'])} select doc_id, round(rank, 6) as rank from ranked")
def bm25_single(spark, sf_dir):
    return text_search.bm25(_docs(spark, sf_dir), text_search.query_terms("license")).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"{_bm25(['the', 'er'])} select doc_id, round(rank, 6) as rank from ranked order by ranked.rank, doc_id limit 50")
def bm25_prefix_and(spark, sf_dir):
    found = text_search.bm25(_docs(spark, sf_dir), text_search.query_terms("the er"))
    return found.orderBy("rank", "doc_id").limit(50).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"{_bm25(['the']).replace('with t', f'with {SYMBOLS}, t', 1)} select s.doc_id, s.name, s.label, round(r.rank - case s.label when 'Function' then 10 when 'Class' then 5 else 0 end, 6) as rank from symbols s join ranked r using (doc_id) where s.label != 'Module'")
def bm25_label_boost_whole(spark, sf_dir):
    """Symbols of every line of a document."""
    ranked = text_search.bm25(_docs(spark, sf_dir), text_search.query_terms("the"))
    return text_search.search_nodes(ranked, views.symbols(spark, sf_dir), "doc_id").select("doc_id", "name", "label", F.round("rank", 6).alias("rank"))


ATTRIBUTED = f"with {SYMBOLS}, hits as (select * from lines where contains(content, 'the ')), spans as (select h.doc_id, h.line, s.id, s.name, s.label, s.start_line, s.end_line, row_number() over (partition by h.doc_id, h.line order by s.end_line - s.start_line nulls last, s.name desc, s.id) as place from hits h left join symbols s on s.doc_id = h.doc_id and s.label != 'Module' and h.line between s.start_line and s.end_line), owned as (select doc_id, line, coalesce(id, doc_id * 1000000) as symbol_id, case when id is null then concat('m', doc_id) else name end as name, case when id is null then 'Module' else label end as label, start_line, end_line from spans where place = 1)"


def _attributed(spark, sf_dir):
    hits = text_search.grep(views.table(spark, sf_dir, "documents").where("text is not null"), "the ", key="doc_id")
    return text_search.attributed(hits, views.symbols(spark, sf_dir), "doc_id")


@query(f"{ATTRIBUTED} select doc_id, line, symbol_id, name, label from owned")
def span_attribution(spark, sf_dir):
    return _attributed(spark, sf_dir).select("doc_id", "line", "symbol_id", "name", "label")


GROUPED = f"{ATTRIBUTED}, grouped as (select doc_id, symbol_id, any_value(name) as name, any_value(label) as label, any_value(start_line) as start_line, any_value(end_line) as end_line, min(line) as first_line, max(line) as last_line, count(*) as n_lines from owned group by doc_id, symbol_id), scored as (select *, case when label in ('Function', 'Class') then 0 when label = 'Module' then 2 else 3 end as r from grouped), folded as (select * from scored i where not exists (select 1 from scored o where o.doc_id = i.doc_id and o.r < i.r and i.first_line >= o.start_line and i.last_line <= o.end_line))"


@query(f"{GROUPED} select doc_id, symbol_id, label, first_line, n_lines from folded")
def span_fold(spark, sf_dir):
    found = text_search.folded(text_search.by_symbol(_attributed(spark, sf_dir), "doc_id"), "doc_id")
    return found.select("doc_id", "symbol_id", "label", F.array_min("match_lines").alias("first_line"), F.size("match_lines").cast("long").alias("n_lines"))


@query(f"{GROUPED} select doc_id, name, first_line from folded order by r, doc_id, coalesce(start_line, 0), name, first_line limit 40")
def grep_lines_ranked(spark, sf_dir):
    found = text_search.folded(text_search.by_symbol(_attributed(spark, sf_dir), "doc_id"), "doc_id")
    return text_search.ranked(found, 40, "doc_id").select("doc_id", "name", F.array_min("match_lines").alias("first_line"))


@query(f"with {SYMBOLS} select doc_id, count(*) as hits from lines where contains(content, 'license') or contains(content, 'License') group by doc_id")
def grep_files_mode(spark, sf_dir):
    return text_search.grep(views.table(spark, sf_dir, "documents").where("text is not null"), "license|License", regex=True, key="doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query(f"with {SYMBOLS} select doc_id, string_agg(content, chr(10) order by line) as snippet from lines where line between 2 and 4 group by doc_id union all select doc_id, '' from sized where n < 2")
def snippet_lines(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text_search.slice_lines(F.col("text"), F.lit(3), F.lit(3), 1).alias("snippet"))


@query(f"with {GRAPH} select qualified_name, 'ambiguous' as match_method from nodes where ends_with(lower(qualified_name), ':77') order by qualified_name, id limit 10")
def snippet_suggestions(spark, sf_dir):
    return text_search.snippet(views.nodes(spark, sf_dir), ":77").select("qualified_name", "match_method")


@query(f"with {SYMBOLS}, f as (select s.*, min(s.start_line) over (partition by s.doc_id order by s.start_line range between 1 following and unbounded following) as nxt from symbols s where label != 'Module') select f.doc_id, f.id, coalesce(f.nxt - 1, z.n) as end_line from f join sized z using (doc_id)")
def next_start_window(spark, sf_dir):
    s = views.symbols(spark, sf_dir)
    n = s.where("label = 'Module'").select(F.col("doc_id").alias("file_path"), F.col("end_line").alias("n_lines"))
    found = resolve.function_ends(s.where("label != 'Module'").drop("end_line").withColumnRenamed("doc_id", "file_path"), n)
    return found.select(F.col("file_path").alias("doc_id"), "id", "end_line")


CALLS = "calls as (select user_id as source_id, 'HTTP_CALLS' as type, event_id % 997 as target_id from events where event_type = 'click' union all select user_id, 'ASYNC_CALLS', event_id % 997 from events where event_type = 'view' union all select user_id, 'HANDLES', event_id % 997 from events where event_type = 'signup' union all select user_id, 'CALLS', (event_id * 7) % 100 from events where event_type = 'error')"


def _calls(spark, sf_dir):
    kind = F.create_map(*[F.lit(x) for kv in {"click": "HTTP_CALLS", "view": "ASYNC_CALLS", "signup": "HANDLES", "error": "CALLS"}.items() for x in kv])
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.try_element_at(kind, F.col("event_type")).alias("type"), "event_id").where("type is not null")
    return e.withColumn("target_id", F.when(F.col("type") == "CALLS", F.col("event_id") * 7 % 100).otherwise(F.col("event_id") % 997)).drop("event_id")


@query(f"with {CALLS} select distinct c.source_id, h.source_id as target_id, 'DATA_FLOWS' as type from calls c join calls h on h.target_id = c.target_id where c.type in ('HTTP_CALLS', 'ASYNC_CALLS') and h.type = 'HANDLES' and c.source_id != h.source_id and not exists (select 1 from calls d where d.type = 'CALLS' and d.source_id = c.source_id and d.target_id = h.source_id)")
def dataflow_anti_join(spark, sf_dir):
    return enrich.data_flows(_calls(spark, sf_dir), spark.range(997))


@query(f"with {CALLS}, t as (select distinct source_id, concat('__event__kafka__t', target_id) as topic_name, type from calls where type in ('ASYNC_CALLS', 'HANDLES') and target_id % 2 = 0) select topic_name, count(*) filter (where type = 'ASYNC_CALLS') as emitters, count(*) filter (where type = 'HANDLES') as subscribers from t group by topic_name")
def topic_links(spark, sf_dir):
    routes = spark.range(997).select("id", F.when(F.col("id") % 2 == 0, "kafka").alias("broker"), F.concat(F.lit("t"), "id").alias("topic"))
    found = enrich.topic_summary(enrich.topic_edges(_calls(spark, sf_dir), routes))
    return found.select("topic_name", F.size("emitters").cast("long").alias("emitters"), F.size("subscribers").cast("long").alias("subscribers"))


@query(
    "with keys as (select distinct p_name as name from part), named as (select distinct replace(p_name, ' ', '_') as name from part union select distinct concat(lower(p_type), '-', p_name) from part), norm as (select name, lower(regexp_replace(name, '[-_./: ]+', '.', 'g')) as n from named), k as (select name, replace(name, ' ', '.') as n from keys) select k.name as key, norm.name as symbol, case when k.n = norm.n then 1.0 else 0.75 end as confidence from k join norm on contains(norm.n, k.n) where len(string_split(k.n, '.')) >= 2 and len(list_filter(string_split(k.n, '.'), lambda p: len(p) < 3)) = 0"
)
def config_name_link(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    keys = p.select(F.col("p_name").alias("name")).distinct().withColumn("id", F.col("name"))
    names = p.select(F.translate("p_name", " ", "_").alias("name")).union(p.select(F.concat_ws("-", F.lower("p_type"), "p_name"))).distinct().withColumn("id", F.col("name"))
    return enrich.config_links(keys, names).select(F.col("target_id").alias("key"), F.col("source_id").alias("symbol"), "confidence")


NAMES = "case event_id % 5 when 0 then 'requests.get' when 1 then 'app.route(/x)' when 2 then 'celery.send_task' when 3 then 'HttpClient.send' else 'math.floor' end"


@query(f"with n as (select {NAMES} as callee from events), k as (select callee, case callee when 'app.route(/x)' then 'route_registration' when 'requests.get' then 'http_client' when 'HttpClient.send' then 'http_client' when 'celery.send_task' then 'async_broker' end as kind, case callee when 'requests.get' then 'GET' end as method, case callee when 'celery.send_task' then 'celery' end as broker from n) select callee, kind, method, broker, count(*) as n from k group by all")
def classify_service_calls(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.expr(NAMES).alias("callee"))
    return e.groupBy("callee", rules.service_kind(F.col("callee")).alias("kind"), rules.http_method(F.col("callee")).alias("method"), rules.broker(F.col("callee")).alias("broker")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with symbols as (select p_partkey as id, split_part(p_name, ' ', 2) as name, concat(p_brand, '.', replace(p_name, ' ', '.')) as qn, p_type as label, p_brand as file_path, p_size as start_line from part), refs as (select s_suppkey as ref_id, case s_suppkey % 4 when 0 then 'Brand#3.red.ring' when 1 then 'ring' when 2 then 'blue.widget' else 'bolt' end as name, concat('Brand#', s_nationkey) as file_path, case when s_suppkey % 3 = 0 then 'PROMO' end as wanted from supplier), r as (select *, split_part(name, '.', len(string_split(name, '.'))) as last from refs), c as (select r.ref_id, s.id, s.file_path, s.start_line, s.qn, case when s.qn = r.name then 0 when contains(r.name, '.') and ends_with(s.qn, r.name) then 3 when s.label = r.wanted then 4 when s.file_path = r.file_path then 5 else 6 end as step from r join symbols s on s.name = r.last), b as (select *, row_number() over (partition by ref_id order by step, file_path, start_line, qn, id) as place from c) select ref_id, id, case step when 0 then 'exact' when 3 then 'qualified_suffix' when 4 then 'preferred_label' when 5 then 'same_file' else 'first_match' end as strategy, case step when 0 then 1.0 when 3 then 0.92 when 4 then 0.90 when 5 then 0.88 else 0.50 end as confidence from b where place = 1"
)
def resolution_ladder(spark, sf_dir):
    p = views.table(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), F.concat("p_brand", F.lit("."), F.translate("p_name", " ", ".")).alias("qualified_name"), F.col("p_type").alias("label"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"))
    s = views.table(spark, sf_dir, "supplier")
    name = F.expr("case s_suppkey % 4 when 0 then 'Brand#3.red.ring' when 1 then 'ring' when 2 then 'blue.widget' else 'bolt' end")
    refs = s.select(F.col("s_suppkey").alias("ref_id"), name.alias("name"), F.concat(F.lit("Brand#"), "s_nationkey").alias("file_path"), F.expr("case when s_suppkey % 3 = 0 then 'PROMO' end").alias("preferred_label"))
    none = spark.createDataFrame([], "file_path string, alias string, namespace string")
    return resolve.resolve(refs, symbols, none).select("ref_id", "id", "strategy", "confidence")


BOUND_NAMES = "case c_custkey % 6 when 0 then 'm.ring' when 1 then 'w' when 2 then 'm' when 3 then 'w.bolt' when 4 then 'Brand#3.red.ring' else 'gear' end"


@query(
    f"""with symbols as (select p_partkey as id, split_part(p_name, ' ', 2) as name, concat(p_brand, '.', replace(p_name, ' ', '.')) as qn, p_type as label, p_brand as file_path, p_size as start_line from part),
binds as (select concat('Brand#', n_nationkey) as file_path, 'm' as alias, concat('Brand#', n_nationkey * 7 % 25, '.') as ns from nation union all select concat('Brand#', n_nationkey), 'w', 'x.widget' from nation where n_nationkey % 2 = 0),
r as (select c_custkey as ref_id, {BOUND_NAMES} as name, concat('Brand#', c_nationkey) as file_path, split_part({BOUND_NAMES}, '.', 1) as head, split_part({BOUND_NAMES}, '.', -1) as last from customer),
b as (select r.*, ns from r left join binds on binds.file_path = r.file_path and alias = head),
c as (select ref_id, s.*, case when qn = b.name then 0 when contains(b.name, '.') and contains(qn, ns) then 1 when contains(b.name, '.') and ends_with(qn, b.name) then 3 when s.file_path = b.file_path then 5 else 6 end as step from b join symbols s on s.name = last
union all select ref_id, s.*, 2 from b join symbols s on s.name = split_part(ns, '.', -1) where not contains(b.name, '.')),
best as (select *, row_number() over (partition by ref_id order by step, file_path, start_line, qn, id) as place from c)
select ref_id, id, case step when 0 then 'exact' when 1 then 'import_namespace' when 2 then 'import_alias' when 3 then 'qualified_suffix' when 5 then 'same_file' else 'first_match' end as strategy,
case step when 0 then 1.0 when 1 then 0.95 when 2 then 0.82 when 3 then 0.92 when 5 then 0.88 else 0.50 end as confidence from best where place = 1"""
)
def resolution_bindings(spark, sf_dir):
    """The ladder where files bind names: a namespace of their own, and an alias of one name."""
    p = views.table(spark, sf_dir, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), F.concat("p_brand", F.lit("."), F.translate("p_name", " ", ".")).alias("qualified_name"), F.col("p_type").alias("label"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("start_line"))
    own = views.table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), "n_nationkey").alias("file_path"), "n_nationkey")
    spaces = own.select("file_path", F.lit("m").alias("alias"), F.concat(F.lit("Brand#"), F.col("n_nationkey") * 7 % 25, F.lit(".")).alias("namespace"))
    names = own.where("n_nationkey % 2 = 0").select("file_path", F.lit("w").alias("alias"), F.lit("x.widget").alias("namespace"))
    refs = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_id"), F.expr(BOUND_NAMES).alias("name"), F.concat(F.lit("Brand#"), "c_nationkey").alias("file_path"), F.lit(None).cast("string").alias("preferred_label"))
    return resolve.resolve(refs, symbols, spaces.unionByName(names)).select("ref_id", "id", "strategy", "confidence")


@query("with h as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as target from pages) select page_id, target, count(*) as n from h group by all")
def html_link_edges(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


K, BANDS, WORDS = similarity.K, 32, 5


def _minhash_sql() -> str:
    minima = ", ".join(f"min(({a}::BIGINT * h + {b}) % {similarity.PRIME})" for a, b in similarity.permutations(K))
    equal = f"list_sum(list_transform(range(1, {K + 1}), lambda i: (x.sig[i] = y.sig[i])::INT)) / {K}"
    return f"""with w as (select doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as t from documents),
g as (select distinct id, array_to_string(t[i:i + {WORDS - 1}], ' ') as gram from (select id, t, unnest(range(1, len(t) - {WORDS - 2})) as i from w where len(t) >= {WORDS})),
hashed as (select id, ('0x' || substr(md5(gram), 1, 7))::BIGINT as h from g), sigs as (select id, [{minima}] as sig from hashed group by id),
classes as (select sig, min(id) as rep from sigs group by sig),
keyed as (select rep as id, band, [sig[2 * band + 1], sig[2 * band + 2]] as part from classes, range({BANDS}) r(band)),
pairs as (select distinct x.id as a, y.id as b from keyed x join keyed y on x.band = y.band and x.part = y.part and x.id < y.id)
select a, b, {equal} as jaccard from pairs join classes x on x.rep = a join classes y on y.rep = b where {equal} >= 0.8
union all select rep, id, 1.0 from sigs join classes using (sig) where id != rep"""


@query(_minhash_sql())
def minhash_near_dups(spark, sf_dir):
    """Five-word shingles, 64 minima in 32 bands, 0.8 or more: pairs of the least documents of classes with
    equal signatures, and each document with the least of its class. No bucket is passed over."""
    c = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text_search.tokens(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") >= WORDS)
    grams = c.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("t") - (WORDS - 1)), lambda i: F.array_join(F.slice("t", i, F.lit(WORDS)), " ")))).alias("gram"))
    return similarity.similar_pairs(cut(similarity.signatures(grams, "id", "gram", K)), "id", BANDS, 0.8, hot=None)  # texts are hashed once


def _phrase(words: list[str]) -> str:
    """BM25 of a phrase whose last word is a prefix, token by token."""
    token = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    at = " and ".join([f"tokens[i + {k}] = '{w}'" for k, w in enumerate(words[:-1])] + [f"starts_with(tokens[i + {len(words) - 1}], '{words[-1]}')"])
    return f"with t as (select doc_id, {token} as tokens from documents), c as (select doc_id, len(tokens) as dl, len(list_filter(range(1, len(tokens) + 1), lambda i: coalesce({at}, false))) as f from t), s as (select count(*) as n, avg(dl) as avgdl, count(*) filter (where f > 0) as df from c) select doc_id, round(- greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as rank from c, s where f > 0"


@query(_phrase(["of", "the"]))
def bm25_phrase(spark, sf_dir):
    return text_search.bm25(_docs(spark, sf_dir), text_search.query_terms("of_the")).select("doc_id", F.round("rank", 6).alias("rank"))


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(f"with q as (select embedding as e from embeddings where vec_id = 1) select vec_id, round({_dot('embedding', 'q.e')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('q.e', 'q.e')})), 6) as score from embeddings, q where vec_id != 1 order by score desc, vec_id limit 20")
def cosine_topk(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 1").select(F.col("embedding").alias("_q")).limit(1)
    scored = e.where("vec_id != 1").crossJoin(F.broadcast(asked)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("_q")), 6).alias("score"))  # one stated query
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


KEYWORDS = [[((i * 7 + 3) % 11 - 5) / 10 for i in range(64)], [((i * 5 + 1) % 13 - 6) / 10 for i in range(64)]]


@query("with " + ", ".join(f"q{i} as (select {k}::DOUBLE[] as e)" for i, k in enumerate(KEYWORDS)) + ", s as (select vec_id, least(" + ", ".join(f"{_dot('embedding', f'q{i}.e')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot(f'q{i}.e', f'q{i}.e')}))" for i in range(2)) + ") as score from embeddings, q0, q1) select vec_id, round(score, 6) as score from s where score > 0")
def vector_min_keyword(spark, sf_dir):
    return vectors.search(views.table(spark, sf_dir, "embeddings"), KEYWORDS).select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"with tok as (select vec_id, concat(label, '/', vec_id % 7) as token from embeddings), used as (select token from tok group by token having count(*) between 2 and 96), pairs as (select distinct a.vec_id as source, b.vec_id as target from tok a join tok b using (token) join used using (token) where a.vec_id != b.vec_id), scored as (select source, target, {_dot('x.embedding', 'y.embedding')} / (sqrt({_dot('x.embedding', 'x.embedding')}) * sqrt({_dot('y.embedding', 'y.embedding')})) as score from pairs join embeddings x on x.vec_id = source join embeddings y on y.vec_id = target), placed as (select *, row_number() over (partition by source order by score desc, target) as place from scored where score >= 0.45) select source, target, round(score, 6) as score, cast(place as int) as place from placed where place <= 6"
)
def related_top6(spark, sf_dir):
    """No token is passed over; the SQL's 96 is not reached on the given tables."""
    e = views.table(spark, sf_dir, "embeddings")
    tokens = e.select("vec_id", F.concat_ws("/", F.col("label").cast("string"), (F.col("vec_id") % 7).cast("string")).alias("token"))
    return vectors.related(tokens, e, "vec_id", "token", "embedding", hot=None).withColumn("score", F.round("score", 6))


@query("with was as (select o_orderkey as k, o_totalprice as size from orders where o_orderkey % 10 != 0), now as (select o_orderkey as k, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as size from orders where o_orderkey % 11 != 0) select case when was.k is null then 'new' when now.k is null then 'deleted' when was.size != now.size then 'changed' else 'same' end as state, count(*) as n from was full outer join now using (k) group by 1")
def file_delta_classify(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rel_path"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("mtime"))
    now = o.where("rel_path % 11 != 0").withColumn("size", F.when(F.col("rel_path") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return graph.histogram(incremental.classify(o.where("rel_path % 10 != 0"), now), "state")


@query("select time_bucket(interval '1 day', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_activity(spark, sf_dir):
    return watch.activity(views.table(spark, sf_dir, "events"))


@query("with e as (select event_id, user_id as source_id, event_id % 40 as target_id, event_type as type from events), known as (select user_id as id from events union select unnest(range(1, 30))), f as (select *, row_number() over (partition by source_id, target_id, type order by event_id) as place from e where source_id > 0 and target_id > 0) select event_id, source_id, target_id, type from f where place = 1 and source_id in (select id from known) and target_id in (select id from known)")
def edge_insert_whole(spark, sf_dir):
    """All events; the known nodes alone decide which edges go."""
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source_id"), (F.col("event_id") % 40).alias("target_id"), F.col("event_type").alias("type"))
    known = e.select(F.col("source_id").alias("id")).union(spark.range(1, 30)).distinct()
    return graph.inserted(e, known, "event_id")


@query("select concat('n', l_partkey) as qualified_name, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) as label, min(l_suppkey) filter (where l_suppkey > 0) as start_line, max(l_linenumber) as end_line from lineitem group by l_partkey")
def node_upsert(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), F.concat(F.lit("n"), "l_partkey").alias("qualified_name"), F.col("l_returnflag").alias("label"), F.lit("x").alias("name"), F.lit("f").alias("file_path"), F.col("l_suppkey").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.lit("").alias("properties"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_order"))
    return graph.upserted(rows, F.col("_order")).select("qualified_name", "label", F.nullif("start_line", F.lit(0)).alias("start_line"), "end_line")


@query("with p as (select distinct regexp_extract(url, '^https?://([^?#]+)', 1) as path from pages), s as (select path, string_split(path, '/') as parts from p where path != ''), c as (select path, unnest(range(1, len(parts) + 1)) as i, parts from s), n as (select distinct array_to_string(parts[1:i], '/') as node, array_to_string(parts[1:i - 1], '/') as parent, case when i = len(parts) then 'CONTAINS_FILE' else 'CONTAINS_FOLDER' end as type from c) select parent as source, node as target, type from n")
def folder_structure(spark, sf_dir):
    files = views.table(spark, sf_dir, "pages").select(F.lit("p").alias("project"), F.regexp_extract("url", r"^https?://([^?#]+)", 1).alias("file_path")).where("file_path != ''").distinct()
    return graph.structure(files)[1].select("source", "target", "type")


@query("with l as (select doc_id, unnest(string_split(replace(text, concat(chr(10), 'T'), concat(chr(10), '# T')), chr(10))) as s from documents where text is not null) select doc_id, count(*) as headings from l where starts_with(s, '#') group by doc_id")
def markdown_sections(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.size(text_search.sections(F.replace("text", F.lit("\nT"), F.lit("\n# T")))).cast("long").alias("headings"))
    return d.where("headings > 0")


@query(f"with {GRAPH} select 'driver' as project, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, 'ready' as status")
def project_status(spark, sf_dir):
    n = views.nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes"))
    e = views.edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(e).select(F.lit("driver").alias("project"), "nodes", "edges", F.when(F.col("nodes") > 0, "ready").otherwise("empty").alias("status"))  # two single rows
