"""Registered queries of the graph operators, each with the same question in SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import aggregates as A
from meshlark.functions import scalar as S
from meshlark.functions import temporal as TM
from meshlark.graph import BOTH, IN, OUT, PropertyGraph, has_label
from meshlark.operators import analytics, kernels, search, traversal
from meshlark.operators.aggregate import aggregate
from meshlark.operators.cluster import scratch_path
from meshlark.plans import sets
from meshlark.plans.match import match, over
from meshlark.sources.tables import NUMBER, SPACE, commerce_graph, key_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _key(var: str):
    return key_of(F.col(var))


def _money(c):
    return F.sum(F.round(c * 100).cast("long")).alias("cents")


# Scans and schema


@query("SELECT CAST(p_partkey AS BIGINT) AS key, p_name AS name FROM part WHERE p_size BETWEEN 10 AND 20")
def scan_range(spark, d):
    return commerce_graph(spark, d).range_scan("Part", "size", 10, 20).select("key", "name")


@query("SELECT CAST(c_custkey AS BIGINT) AS key, c_acctbal AS acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_seek(spark, d):
    return commerce_graph(spark, d).node_scan("Customer", segment="BUILDING").select("key", "acctbal")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN kind = 'S' THEN 1 ELSE 0 END) AS BIGINT) AS suppliers FROM (SELECT 'C' AS kind, c_acctbal AS b FROM customer UNION ALL SELECT 'S', s_acctbal FROM supplier) WHERE b < 0")
def scan_label_expression(spark, d):
    g = commerce_graph(spark, d)
    rows = g.node_scan((has_label("Customer") | has_label("Supplier")) & ~has_label("Part"), F.col("acctbal") < 0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.array_contains("labels", "Supplier").cast("int")).alias("suppliers"))


@query("SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
def schema_labels(spark, d):
    return commerce_graph(spark, d).labels()


@query("""SELECT 'IN_REGION' AS type, count(*) AS n, count(DISTINCT n_nationkey) AS n_sources, count(DISTINCT n_regionkey) AS n_targets FROM nation
UNION ALL SELECT 'IN_NATION', count(*), count(DISTINCT k), count(DISTINCT n) FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer UNION ALL SELECT -s_suppkey - 1, s_nationkey FROM supplier)
UNION ALL SELECT 'PLACED', count(*), count(DISTINCT o_custkey), count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'CONTAINS', count(*), count(DISTINCT l_orderkey), count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'SUPPLIED', count(*), count(DISTINCT l_suppkey), count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'DID', count(*), count(DISTINCT user_id), count(DISTINCT event_id) FROM events""")
def schema_rel_types(spark, d):
    return commerce_graph(spark, d).rel_types()


@query("SELECT degree, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1")
def degree_histogram(spark, d):
    g = commerce_graph(spark, d)
    degrees = g.degrees("PLACED").join(g.node_scan("Customer").select("id"), "id", "left_semi")
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


# Patterns


@query("SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1")
def hop_group(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer", props=("segment",)).hop("c", "PLACED", "o").node("o", "Order", F.col("total") > 100000, ("total",))
    return m.df.groupBy(F.col("c_segment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), _money(F.col("o_total")))


@query("SELECT r_name AS region, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def hop_chain(spark, d):
    m = match(commerce_graph(spark, d)).node("r", "Region", props=("name",)).hop("r", "IN_REGION", "n", IN).hop("n", "IN_NATION", "c", IN).hop("c", "PLACED", "o").node("o", "Order", props=("total",))
    return m.df.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"), _money(F.col("o_total")))


@query("SELECT n_name AS nation, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation) x ON k = n_nationkey GROUP BY 1")
def hop_undirected(spark, d):
    m = match(commerce_graph(spark, d)).node("n", "Nation", props=("name",)).hop("n", ["IN_NATION", "IN_REGION"], "x", BOTH)
    return m.df.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name AS nation, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem a ON a.l_orderkey = o_orderkey
JOIN lineitem b ON b.l_partkey = a.l_partkey JOIN supplier ON s_suppkey = b.l_suppkey AND s_nationkey = n_nationkey GROUP BY 1""")
def hop_cycle(spark, d):
    m = match(commerce_graph(spark, d)).node("n", "Nation", props=("name",)).hop("n", "IN_NATION", "c", IN).hop("c", "PLACED", "o").hop("o", "CONTAINS", "p")
    m = m.hop("p", "SUPPLIED", "s", IN).hop("s", "IN_NATION", "n")
    return m.df.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS brand, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey JOIN part ON p_partkey = a.l_partkey GROUP BY 1")
def different_edges(spark, d):
    m = match(commerce_graph(spark, d)).node("p", "Part", props=("brand",)).hop("p", "CONTAINS", "x", IN).hop("p", "CONTAINS", "y", IN)
    return m.df.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS brand, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN part ON p_partkey = a.l_partkey GROUP BY 1")
def repeatable_elements(spark, d):
    m = match(commerce_graph(spark, d), repeatable=True).node("p", "Part", props=("brand",)).hop("p", "CONTAINS", "x", IN).hop("p", "CONTAINS", "y", IN)
    return m.df.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS BIGINT) AS customer, o_priority AS priority FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority AS o_priority FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey")
def optional_match(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer")
    m = m.optional(["c"], lambda b: b.hop("c", "PLACED", "o").node("o", "Order", F.col("total") > 200000, ("priority",)))
    return m.df.select(_key("c").alias("customer"), F.col("o_priority").alias("priority"))


@query("SELECT CAST(c_custkey AS BIGINT) AS customer, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent, c_acctbal < 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS cold FROM customer")
def exists_subquery(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer", props=("acctbal",))
    m = m.exists("urgent", ["c"], lambda b: b.hop("c", "PLACED", "o").node("o", "Order", priority="1-URGENT")).exists("any", ["c"], lambda b: b.hop("c", "PLACED", "o"))
    return m.df.select(_key("c").alias("customer"), "urgent", ((F.col("c_acctbal") < 0) | ~F.col("any")).alias("cold"))


@query("SELECT CAST(c_custkey AS BIGINT) AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer").where_exists(["c"], lambda b: b.hop("c", "PLACED", "o"), negate=True)
    return m.df.select(_key("c").alias("customer"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS supplier, (SELECT count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size > 25) AS n FROM supplier")
def count_subquery(spark, d):
    m = match(commerce_graph(spark, d)).node("s", "Supplier")
    m = m.count("n", ["s"], lambda b: b.hop("s", "SUPPLIED", "p").node("p", "Part", F.col("size") > 25))
    return m.df.select(_key("s").alias("supplier"), "n")


@query("SELECT CAST(c_custkey AS BIGINT) AS customer, coalesce((SELECT string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS priorities FROM customer")
def collect_subquery(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer")
    m = m.collect("list", ["c"], lambda b: b.hop("c", "PLACED", "o").node("o", "Order", props=("priority",)), F.col("o_priority"), [F.col("o")])
    return m.df.select(_key("c").alias("customer"), F.array_join("list", "|").alias("priorities"))


@query("SELECT CAST(o_custkey AS BIGINT) AS customer, CAST(o_orderkey AS BIGINT) AS ord, o_totalprice AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey) WHERE r <= 2")
def call_per_row(spark, d):
    def largest(b):
        found = b.hop("c", "PLACED", "o").node("o", "Order", props=("total",)).table()
        return kernels.top_per_group(found, ["c"], [F.col("o_total").desc(), F.col("o")], 2)

    m = match(commerce_graph(spark, d)).node("c", "Customer").call(["c"], largest)
    return m.df.select(_key("c").alias("customer"), _key("o").alias("ord"), F.col("o_total").alias("total"))


@query("SELECT kind, r_name AS region, count(*) AS n FROM (SELECT 'C' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'S', s_nationkey FROM supplier) JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def trail_bounded(spark, d):
    m = match(commerce_graph(spark, d)).node("x", has_label("Customer") | has_label("Supplier"), props=("labels",)).trail("x", ["IN_NATION", "IN_REGION"], "r", 1, 3, path="way")
    m = m.node("r", "Region", props=("name",))
    return m.df.groupBy(F.substring(F.col("x_labels")[0], 1, 1).alias("kind"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name AS region, 1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey)
+ (SELECT count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n FROM region""")
def reach_unbounded(spark, d):
    m = match(commerce_graph(spark, d)).node("r", "Region", props=("name",)).reach("r", ["IN_REGION", "IN_NATION"], "x", 0, None, IN)
    return m.df.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0.0 ELSE 2.0 END::DOUBLE AS cost, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1 ELSE 3 END AS nodes FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def shortest_any(spark, d):
    g = commerce_graph(spark, d)
    nations = g.node_scan("Nation").select("id")
    pairs = nations.withColumnRenamed("id", "start").crossJoin(nations.withColumnRenamed("id", "target"))
    ways = traversal.any_shortest(pairs, g.rel_scan("IN_REGION", BOTH))
    return ways.select(_key("start").alias("a"), _key("target").alias("b"), "cost", F.size("nodes").alias("nodes"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(s_suppkey AS BIGINT) AS supplier, CAST(n_nationkey AS BIGINT) AS over FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def shortest_all(spark, d):
    g = commerce_graph(spark, d)
    pairs = g.node_scan("Region").select(F.col("id").alias("start")).crossJoin(g.node_scan("Supplier").select(F.col("id").alias("target")))
    ways = traversal.all_shortest(pairs, g.rel_scan(["IN_REGION", "IN_NATION"], IN))
    return ways.select(_key("start").alias("region"), _key("target").alias("supplier"), key_of(F.col("nodes")[1]).alias("over"))


@query("SELECT CAST(c_custkey AS BIGINT) AS customer, CAST(p AS BIGINT) AS part, cost FROM (SELECT o_custkey AS c_custkey, l_partkey AS p, min(l_quantity) + 1.0 AS cost FROM orders JOIN customer USING (c_custkey) JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)".replace("JOIN customer USING (c_custkey)", "JOIN customer ON c_custkey = o_custkey"))
def cheapest_ways(spark, d):
    g = commerce_graph(spark, d)
    edges = g.rel_scan(["PLACED", "CONTAINS"]).select("frm", "to", F.coalesce("quantity", F.lit(1.0)).alias("weight"))
    found = traversal.cheapest(g.node_scan("Customer").select(F.col("id").alias("start")), edges)
    return found.where(F.floor(F.col("node") / SPACE) == NUMBER["Part"]).select(_key("start").alias("customer"), _key("node").alias("part"), "cost")


# Projection, sets, expressions


@query("SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, round(avg(l_discount), 6) AS discount, round(stddev_samp(l_quantity), 6) AS spread, quantile_cont(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.25) AS quarter, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def aggregates(spark, d):
    rels = commerce_graph(spark, d).rel_scan("CONTAINS")
    return rels.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), A.exact_sum(F.col("quantity").cast("long")).alias("quantity"), F.round(A.average("discount"), 6).alias("discount"), F.round(A.stddev_sample("quantity"), 6).alias("spread"),
        A.percentile_continuous("quantity", 0.5).alias("median"), A.percentile_discrete("quantity", 0.25).alias("quarter"), A.least("price").alias("low"), A.most("price").alias("high"),
    )


@query("(SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    g = commerce_graph(spark, d)
    rich = lambda label: match(g).node("x", label, F.col("acctbal") > 9000).hop("x", "IN_NATION", "n").df.select(_key("n").cast("int").alias("nation"))
    out = match(g).node("r", "Region", F.col("key") == 0).hop("r", "IN_REGION", "n", IN).df.select(_key("n").cast("int").alias("nation"))
    return sets.minus(sets.union(rich("Customer"), rich("Supplier")), out)


@query("""SELECT CAST(p_partkey AS BIGINT) AS key, p_size // 7 AS quotient, p_size % 7 AS rest, substr(p_name, 3, 4) AS middle, right(p_name, 2) AS tail, CAST(ceil(p_retailprice) AS DOUBLE) AS up,
CASE WHEN p_size > 25 THEN 'large' WHEN p_size IS NULL THEN NULL ELSE 'small' END AS size_class, list_aggregate(range(1, CAST(p_size % 4 AS BIGINT) + 1), 'count') AS steps, upper(p_brand) AS brand, p_name LIKE '%1%' AS has_one FROM part""")
def expressions(spark, d):
    p = commerce_graph(spark, d).node_scan("Part")
    return p.select(
        "key", S.int_divide(F.col("size"), 7).alias("quotient"), S.modulo(F.col("size"), 7).alias("rest"), S.substring(F.col("name"), 2, 4).alias("middle"), S.right(F.col("name"), 2).alias("tail"), S.ceiling(F.col("price")).alias("up"),
        F.when(F.col("size") > 25, "large").when(F.col("size").isNotNull(), "small").alias("size_class"), F.size(S.number_range(1, F.col("size") % 4)).cast("long").alias("steps"), F.upper("brand").alias("brand"), F.contains("name", F.lit("1")).alias("has_one"),
    )


@query("SELECT CAST(p_partkey AS BIGINT) AS key, w AS word FROM part, LATERAL (SELECT unnest(string_split(p_type, ' ')) AS w)")
def unwind(spark, d):
    m = match(commerce_graph(spark, d)).node("p", "Part", props=("kind",)).unwind("word", F.split("p_kind", " "))
    return m.df.select(_key("p").alias("key"), "word")


@query("SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS due FROM orders")
def temporal(spark, d):
    o = commerce_graph(spark, d).node_scan("Order")
    return o.select("key", TM.component(F.col("placed"), "year").alias("y"), TM.component(F.col("placed"), "month").alias("m"), TM.render_date(TM.plus(F.col("placed"), TM.duration(months=1))).alias("due"))


# Algorithms

_PLACES = f"""nodes AS (SELECT {NUMBER['Region']} * {SPACE} + r_regionkey AS id FROM region UNION ALL SELECT {NUMBER['Nation']} * {SPACE} + n_nationkey FROM nation
UNION ALL SELECT {NUMBER['Customer']} * {SPACE} + c_custkey FROM customer UNION ALL SELECT {NUMBER['Supplier']} * {SPACE} + s_suppkey FROM supplier),
edges AS (SELECT {NUMBER['Nation']} * {SPACE} + n_nationkey AS frm, {NUMBER['Region']} * {SPACE} + n_regionkey AS dst FROM nation
UNION ALL SELECT {NUMBER['Customer']} * {SPACE} + c_custkey, {NUMBER['Nation']} * {SPACE} + c_nationkey FROM customer UNION ALL SELECT {NUMBER['Supplier']} * {SPACE} + s_suppkey, {NUMBER['Nation']} * {SPACE} + s_nationkey FROM supplier)"""


def _places(spark, d):
    g = commerce_graph(spark, d)
    nodes = g.node_scan(has_label("Region") | has_label("Nation") | has_label("Customer") | has_label("Supplier")).select("id")
    return nodes, g.rel_scan(["IN_NATION", "IN_REGION"]).select("frm", "to", "pos")


@query(f"""WITH {_PLACES}, home AS (SELECT n_nationkey, n_regionkey FROM nation) SELECT id AS node, {NUMBER['Region']} * {SPACE} + n_regionkey AS value FROM
(SELECT {NUMBER['Region']} * {SPACE} + r_regionkey AS id, r_regionkey AS n_regionkey FROM region UNION ALL SELECT {NUMBER['Nation']} * {SPACE} + n_nationkey, n_regionkey FROM nation
UNION ALL SELECT {NUMBER['Customer']} * {SPACE} + c_custkey, n_regionkey FROM customer JOIN home ON n_nationkey = c_nationkey UNION ALL SELECT {NUMBER['Supplier']} * {SPACE} + s_suppkey, n_regionkey FROM supplier JOIN home ON n_nationkey = s_nationkey)""")
def algo_wcc(spark, d):
    return analytics.wcc(*_places(spark, d))


@query(f"""WITH {_PLACES}, both_ways AS (SELECT frm, dst FROM edges UNION ALL SELECT dst, frm FROM edges), s AS (SELECT min(id) AS id FROM nodes),
d1 AS (SELECT DISTINCT dst AS id FROM both_ways JOIN s ON frm = s.id), d2 AS (SELECT DISTINCT dst AS id FROM both_ways JOIN d1 ON frm = d1.id)
SELECT id AS node, CASE WHEN id IN (SELECT id FROM s) THEN 0 WHEN id IN (SELECT id FROM d1) THEN 1 WHEN id IN (SELECT id FROM d2) THEN 2 ELSE 9223372036854775807 END AS value FROM nodes""")
def algo_bfs(spark, d):
    nodes, edges = _places(spark, d)
    return traversal.bfs(nodes, analytics.undirected(edges), NUMBER["Region"] * SPACE)


@query(f"""WITH {_PLACES}, both_ways AS (SELECT frm, dst FROM edges UNION ALL SELECT dst, frm FROM edges), s AS (SELECT min(id) AS id FROM nodes),
d1 AS (SELECT DISTINCT dst AS id FROM both_ways JOIN s ON frm = s.id), d2 AS (SELECT DISTINCT dst AS id FROM both_ways JOIN d1 ON frm = d1.id)
SELECT id AS node, CASE WHEN id IN (SELECT id FROM s) THEN 0.0::DOUBLE WHEN id IN (SELECT id FROM d1) THEN 1.5 WHEN id IN (SELECT id FROM d2) THEN 3.0 ELSE 'inf'::DOUBLE END AS value FROM nodes""")
def algo_sssp(spark, d):
    nodes, edges = _places(spark, d)
    return traversal.sssp(nodes, analytics.undirected(edges).withColumn("weight", F.lit(1.5)), NUMBER["Region"] * SPACE)


def _pagerank_sql(rounds: int) -> str:
    steps = ["pr0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS v FROM nodes)"]
    for i in range(1, rounds + 1):
        steps.append(f"""pr{i} AS (SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (SELECT coalesce(sum(v), 0) FROM pr{i - 1} WHERE id NOT IN (SELECT frm FROM edges)) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g, 0) AS v
FROM nodes n LEFT JOIN (SELECT dst, sum(v / deg) AS g FROM pr{i - 1} JOIN edges ON frm = id JOIN (SELECT frm AS f, count(*) AS deg FROM edges GROUP BY 1) ON f = id GROUP BY 1) ON dst = n.id)""")
    return f"WITH {_PLACES}, {', '.join(steps)} SELECT id AS node, round(v, 9) AS value FROM pr{rounds}"


@query(_pagerank_sql(5))
def algo_pagerank(spark, d):
    nodes, edges = _places(spark, d)
    return analytics.pagerank(nodes, edges, 0.85, 5).select("node", F.round("value", 9).alias("value"))


def _cdlp_sql(rounds: int) -> str:
    steps = ["b AS (SELECT frm, dst FROM edges UNION ALL SELECT dst, frm FROM edges)", "l0 AS (SELECT id, id AS v FROM nodes)"]
    for i in range(1, rounds + 1):
        steps.append(f"l{i} AS (SELECT o.id, coalesce(w.v, o.v) AS v FROM l{i - 1} o LEFT JOIN (SELECT frm, v FROM (SELECT frm, v, row_number() OVER (PARTITION BY frm ORDER BY count(*) DESC, v) AS r FROM b JOIN l{i - 1} ON id = dst GROUP BY frm, v) WHERE r = 1) w ON w.frm = o.id)")
    return f"WITH {_PLACES}, {', '.join(steps)} SELECT id AS node, v AS value FROM l{rounds}"


@query(_cdlp_sql(3))
def algo_cdlp(spark, d):
    nodes, edges = _places(spark, d)
    return analytics.cdlp(nodes, analytics.undirected(edges), 3)


@query(f"""WITH {_PLACES}, more AS (SELECT frm, dst FROM edges UNION ALL SELECT a.frm, b.dst FROM edges a JOIN edges b ON a.dst = b.frm), u AS (SELECT DISTINCT least(frm, dst) AS a, greatest(frm, dst) AS b FROM more WHERE frm <> dst),
nb AS (SELECT a AS x, b AS y FROM u UNION ALL SELECT b, a FROM u), t AS (SELECT p.x, count(*) AS links FROM nb p JOIN nb q ON p.x = q.x JOIN nb e ON e.x = p.y AND e.y = q.y GROUP BY 1), deg AS (SELECT x, count(*) AS k FROM nb GROUP BY 1)
SELECT id AS node, round(CASE WHEN k > 1 THEN coalesce(links, 0) / (k * (k - 1.0::DOUBLE)) ELSE 0.0 END, 9) AS value FROM nodes LEFT JOIN deg ON deg.x = id LEFT JOIN t ON t.x = id""")
def algo_lcc(spark, d):
    nodes, edges = _places(spark, d)
    two = edges.select("frm", F.col("to").alias("mid")).join(edges.select(F.col("frm").alias("mid"), "to"), "mid").select("frm", "to")
    return analytics.lcc(nodes, edges.select("frm", "to").unionAll(two)).select("node", F.round("value", 9).alias("value"))


@query(f"""WITH o AS (SELECT l_suppkey AS s, l_partkey AS p, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 16 + l_linenumber) AS place
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), claims AS (SELECT s, p, arg_min(q, place) AS v FROM o WHERE place <= 5 AND q > 0 GROUP BY 1, 2)
SELECT {NUMBER['Supplier']} * {SPACE} + s_suppkey AS node, 1.0::DOUBLE AS value, 1 AS depth FROM supplier
UNION ALL SELECT {NUMBER['Part']} * {SPACE} + p, round(sum(v), 6), 2 FROM claims GROUP BY p""")
def algo_propagate(spark, d):
    g = commerce_graph(spark, d)
    seeds = g.node_scan("Supplier").select(F.col("id").alias("node"), F.lit(1.0).alias("value"))
    out = analytics.propagate(seeds, g.rel_scan("SUPPLIED").select("frm", "to", "pos", "quantity"), "quantity", 2, ascending=False, truncate=5)
    return out.select("node", F.round("value", 6).alias("value"), "depth")


# Kernels


@query(f"SELECT CAST(c_custkey AS BIGINT) AS customer, {NUMBER['Region']} * {SPACE} + n_regionkey AS root FROM customer JOIN nation ON n_nationkey = c_nationkey")
def kernel_roots(spark, d):
    nodes, edges = _places(spark, d)
    found = kernels.roots(nodes, edges)
    return found.where(F.floor(F.col("node") / SPACE) == NUMBER["Customer"]).select(_key("node").alias("customer"), "root")


@query("SELECT least(c_mktsegment, o_orderpriority) AS x, greatest(c_mktsegment, o_orderpriority) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def kernel_fold(spark, d):
    g = commerce_graph(spark, d)
    groups = g.node_scan("Customer").select(F.col("id").alias("node"), F.col("segment").alias("group")).unionAll(g.node_scan("Order").select("id", "priority"))
    return kernels.fold_via(g.rel_scan("PLACED"), groups)


@query("SELECT a.p_brand AS x, b.p_brand AS y, count(*) AS n FROM lineitem l JOIN part a ON a.p_partkey = l.l_partkey JOIN lineitem m ON m.l_orderkey = l.l_orderkey JOIN part b ON b.p_partkey = m.l_partkey WHERE a.p_brand <> b.p_brand GROUP BY 1, 2")
def kernel_co_occurring(spark, d):
    m = match(commerce_graph(spark, d)).node("p", "Part", props=("brand",)).hop("p", "CONTAINS", "o", IN).df
    first = m.select(F.col("p_brand").alias("a"), F.col("o").alias("mid"))
    return kernels.co_occurring(first, first.select("mid", F.col("a").alias("b"))).withColumn("n", F.col("n").cast("long"))


@query("SELECT CAST(a.l_suppkey AS BIGINT) AS s, CAST(b.l_suppkey AS BIGINT) AS t, count(DISTINCT a.l_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) b ON a.l_partkey = b.l_partkey GROUP BY 1, 2")
def kernel_common_neighbors(spark, d):
    g = commerce_graph(spark, d)
    found = kernels.common_neighbor_counts(g.node_scan("Supplier").select("id"), g.rel_scan("SUPPLIED", BOTH))
    return found.select(_key("s").alias("s"), _key("t").alias("t"), "n")


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey) GROUP BY 1")
def kernel_walks(spark, d):
    g = commerce_graph(spark, d)
    found = kernels.hop_counts(g, g.node_scan("Part"), [("CONTAINS", IN), ("PLACED", IN), ("IN_NATION", OUT), ("IN_REGION", OUT)])
    return found.select(_key("node").alias("region"), F.col("n").cast("long").alias("n"))


# Grouped aggregation


@query("SELECT p_brand AS brand, (CASE WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END) + (CASE WHEN p_retailprice >= 1500 THEN 1 ELSE 0 END) AS price_bin, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sum_size FROM part WHERE p_size >= 10 GROUP BY 1, 2")
def fluent_bins(spark, d):
    return aggregate(commerce_graph(spark, d), "Part").filter("size", ">=", 10).by("brand").bin("price", 1000, 1500).sum("size").run()


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS placed_year, CAST(month(o_orderdate) AS BIGINT) AS placed_month, count(*) AS n FROM orders GROUP BY 1, 2")
def fluent_temporal(spark, d):
    return aggregate(commerce_graph(spark, d), "Order").temporal("placed", "year").temporal("placed", "month").run()


@query(f"SELECT {NUMBER['Nation']} * {SPACE} + k AS neighbor, label, count(*) AS n FROM (SELECT 'Customer' AS label, c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT 'Supplier', s_nationkey, s_acctbal FROM supplier) WHERE b > 0 GROUP BY 1, 2")
def fluent_through(spark, d):
    out = aggregate(commerce_graph(spark, d), "Customer", "Supplier").having("acctbal", ">", 0).by_label().through_rels("IN_NATION", OUT).run()
    return out


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def fluent_via(spark, d):
    g = commerce_graph(spark, d)
    names = [r["name"] for r in match(g).node("r", "Region", F.col("key") == 1).hop("r", "IN_REGION", "n", IN).node("n", "Nation", props=("name",)).df.select(F.col("n_name").alias("name")).collect()]
    return aggregate(g, "Customer").filter_via([("IN_NATION", OUT)], "name", *names).by("segment").run()


# Search


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, len(w)::DOUBLE AS l, len(list_filter(w, lambda x: x = 'idiot'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'pathetic'))::DOUBLE AS b FROM t),
s AS (SELECT count(*) AS n, avg(l) AS m, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM c, s WHERE a > 0 OR b > 0""")
def search_bm25(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").where("text is not null")
    return search.search_ranked(docs, "doc_id", "text", "Idiot, pathetic").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'mail1') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'com')")
def search_conjunctive(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return search.search_all(docs, "text", "mail1 com").select("doc_id")


_WHERE = "SELECT CAST(c_custkey AS BIGINT) AS key, (c_custkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (c_custkey * 53 % 3600) / 10.0::DOUBLE - 180 AS lon FROM customer"
_FAR = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({a}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({a})) * pow(sin((radians({o}) - radians(lon)) / 2), 2))))"


def _located(spark, d):
    c = commerce_graph(spark, d).node_scan("Customer")
    return c.select("key", ((F.col("key") * 37 % 1800) / 10 - 90).alias("lat"), ((F.col("key") * 53 % 3600) / 10 - 180).alias("lon"))


@query(f"SELECT key FROM ({_WHERE}) WHERE {_FAR.format(a='48.8566', o='2.3522')} <= 1500")
def geo_radius(spark, d):
    return search.within_radius(_located(spark, d), "lat", "lon", (48.8566, 2.3522), 1500).select("key")


@query(f"SELECT key FROM ({_WHERE}) WHERE lat BETWEEN -20 AND 30 AND (lon >= 160 OR lon <= -150)")
def geo_box(spark, d):
    return search.within_box(_located(spark, d), "lat", "lon", (-20, 160), (30, -150)).select("key")


@query(f"SELECT key, round({_FAR.format(a='10.0', o='20.0')}, 4) AS km FROM ({_WHERE}) ORDER BY {_FAR.format(a='10.0', o='20.0')}, key LIMIT 10")
def geo_nearest(spark, d):
    return search.nearest(_located(spark, d), "key", "lat", "lon", (10.0, 20.0), 10).select("key", F.round("km", 4).alias("km"))


# Edits


@query("SELECT (SELECT count(*) FROM customer) AS nodes, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT o_orderstatus = 'F') AS rels")
def edit_remove(spark, d):
    g = commerce_graph(spark, d)
    left = g.remove_nodes(g.node_scan("Order", status="F"))
    nodes = left.node_scan("Customer").agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.crossJoin(left.rel_scan("PLACED").agg(F.count(F.lit(1)).alias("rels")))


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, CASE WHEN s_acctbal < 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS acctbal FROM supplier")
def edit_update(spark, d):
    g = commerce_graph(spark, d)
    low = g.node_scan("Supplier", F.col("acctbal") < 0).select("id")
    writes = low.select("id", F.lit(-1.0).alias("value"), F.lit(1).alias("seq")).unionAll(low.select("id", F.lit(0.0), F.lit(2)))
    return g.update_property("acctbal", writes).node_scan("Supplier").select("key", "acctbal")


@query("SELECT user_id AS \"user\", event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def user_events(spark, d):
    g = commerce_graph(spark, d)
    m = over(g, g.node_scan("User").select(F.col("id").alias("u"))).hop("u", "DID", "e").node("e", "Event", props=("kind", "value"))
    return m.df.groupBy(_key("u").alias("user"), F.col("e_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(A.float_sum("e_value"), 4).alias("total"))


# Aggregates, sets and expressions over more types


@query("SELECT p_brand AS brand, min(p_name) AS first_name, max(p_type) AS last_type, quantile_disc(p_size, 0.5) AS middle, round(stddev_pop(p_retailprice), 6) AS spread, count(DISTINCT p_size) AS sizes, round(sum(p_retailprice), 4) AS total, CAST(min(p_size) AS BIGINT) AS least_size FROM part GROUP BY 1")
def aggregates_of_parts(spark, d):
    p = commerce_graph(spark, d).node_scan("Part")
    return p.groupBy("brand").agg(
        A.least("name").alias("first_name"), A.most("kind").alias("last_type"), A.percentile_discrete("size", 0.5).cast("int").alias("middle"), F.round(A.stddev_population("price"), 6).alias("spread"),
        F.count_distinct("size").alias("sizes"), F.round(A.float_sum("price"), 4).alias("total"), A.least("size").alias("least_size"),
    )


@query("SELECT c_mktsegment AS segment, array_to_string(list_sort(list(DISTINCT n_name)), '|') AS nations FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def collect_distinct(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer", props=("segment",)).hop("c", "IN_NATION", "n").node("n", "Nation", props=("name",))
    return m.df.groupBy(F.col("c_segment").alias("segment")).agg(F.array_join(A.collect("n_name", distinct=True), "|").alias("nations"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal > 9000")
def union_all(spark, d):
    g = commerce_graph(spark, d)
    rich = lambda label: match(g).node("x", label, F.col("acctbal") > 9000).hop("x", "IN_NATION", "n").df.select(_key("n").alias("nation"))
    return sets.union_all(rich("Customer"), rich("Supplier"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal > 5000")
def intersection(spark, d):
    g = commerce_graph(spark, d)
    rich = lambda label, least: match(g).node("x", label, F.col("acctbal") > least).hop("x", "IN_NATION", "n").df.select(_key("n").alias("nation"))
    return sets.intersection(rich("Customer", 9000), rich("Supplier", 5000))


def _few():
    return S.is_in(F.when(F.col("size") <= 40, F.col("size")), F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)]))


@query("""SELECT CAST(p_partkey AS BIGINT) AS key, (p_size > 10) <> (p_size < 20) AS either, coalesce(CASE WHEN p_size > 40 THEN NULL ELSE p_size END IN (1, 2, 3), false) AS few, p_size > 40 AS unknown, p_name || '/' || p_brand AS both_names, trim(p_type) AS kind,
string_split(p_type, ' ')[1] AS first_word, string_split(p_type, ' ')[-1] AS last_word, CAST(sign(p_size - 25) AS BIGINT) AS side, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS again FROM part""")
def expressions_of_parts(spark, d):
    p = commerce_graph(spark, d).node_scan("Part")
    words = F.split("kind", " ")
    return p.select(
        "key", S.xor(F.col("size") > 10, F.col("size") < 20).alias("either"), S.is_true(_few()).alias("few"), _few().isNull().alias("unknown"), S.concat(S.concat(F.col("name"), F.lit("/")), F.col("brand")).alias("both_names"),
        S.trim(F.col("kind")).alias("kind"), S.head(words).alias("first_word"), S.last(words).alias("last_word"), S.sign(F.col("size") - 25).cast("long").alias("side"), F.round(S.square_root(F.col("price")), 6).alias("root"), F.round(S.guarded("ln", F.col("price")), 6).alias("log"), S.to_integer(F.col("size").cast("string"), text=True).alias("again"),
    )


# More of patterns


@query("SELECT r_name AS region, s_name AS supplier FROM region, supplier WHERE r_regionkey < 2 AND s_acctbal > 9000")
def disconnected_pattern(spark, d):
    m = match(commerce_graph(spark, d)).node("r", "Region", F.col("key") < 2, ("name",)).node("s", "Supplier", F.col("acctbal") > 9000, ("name",))
    return m.df.select(F.col("r_name").alias("region"), F.col("s_name").alias("supplier"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS ord, count(*) AS n, CAST(sum(twice) AS BIGINT) AS twice FROM (SELECT o_orderkey, CAST(l_quantity AS BIGINT) * 2 AS twice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45) GROUP BY 1 HAVING count(*) > 1")
def let_and_having(spark, d):
    m = match(commerce_graph(spark, d)).node("o", "Order").hop("o", "CONTAINS", "p", rel="l", props=("quantity",), where=F.col("quantity") > 45)
    m = m.let(twice=F.col("l_quantity").cast("long") * 2)
    return m.df.groupBy(_key("o").alias("ord")).agg(F.count(F.lit(1)).alias("n"), A.exact_sum("twice").alias("twice")).where("n > 1")


@query("""SELECT CAST(c_custkey AS BIGINT) AS customer, CAST(p_partkey AS BIGINT) AS part, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_mktsegment = 'BUILDING' AND l_quantity >= 48 GROUP BY 1, 2""")
def trail_acyclic(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer", segment="BUILDING")
    m = m.trail("c", ["PLACED", "CONTAINS"], "p", 2, 2, each=F.coalesce(F.col("quantity"), F.lit(50.0)) >= 48, acyclic=True, path="way").node("p", "Part")
    return m.df.where("size(way.nodes) = 3 and size(way.rels) = 2").groupBy(_key("c").alias("customer"), _key("p").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(a.l_suppkey AS BIGINT) AS first_supplier, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND b.l_suppkey <> a.l_suppkey AND b.l_quantity >= a.l_quantity JOIN part ON p_partkey = a.l_partkey WHERE p_size = 7 GROUP BY 1""")
def trail_rising(spark, d):
    g = commerce_graph(spark, d)
    parts = g.node_scan("Part", size=7).select("id")
    near = PropertyGraph(g.nodes, g.rel_scan("SUPPLIED").join(parts.withColumnRenamed("id", "to"), "to", "left_semi").drop("frm", "to"))
    m = over(near, g.node_scan("Supplier").select(F.col("id").alias("s"))).trail("s", "SUPPLIED", "t", 2, 2, BOTH, rising="quantity", acyclic=True)
    return m.df.groupBy(_key("s").alias("first_supplier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT x.kind, count(*) AS n FROM (SELECT CASE WHEN label = 'Supplier' THEN true ELSE false END AS kind FROM (SELECT 'Customer' AS label FROM customer UNION ALL SELECT 'Supplier' FROM supplier)) x GROUP BY 1")
def is_labelled(spark, d):
    g = commerce_graph(spark, d)
    m = match(g).node("n", "Nation").hop("n", "IN_NATION", "x", IN).labelled("x", "kind", "Supplier")
    return m.df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS nation, (SELECT count(*) FROM region) AS regions FROM nation")
def call_once(spark, d):
    m = match(commerce_graph(spark, d)).node("n", "Nation", props=("name",)).call([], lambda b: b.node("r", "Region").df.agg(F.count(F.lit(1)).alias("regions")))
    return m.df.select(F.col("n_name").alias("nation"), "regions")


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, coalesce(min(s_acctbal), 0.0) AS least_balance, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def kernel_neighbor_fold(spark, d):
    g = commerce_graph(spark, d)
    edges, suppliers = g.rel_scan("IN_NATION", IN), g.node_scan("Supplier")
    least = kernels.neighbor_fold(edges, suppliers.select("id", "acctbal"), F.min("acctbal"))
    many = kernels.neighbors_in(edges, suppliers.select("id")).groupBy(F.col("frm").alias("node")).agg(F.count(F.lit(1)).alias("suppliers"))
    return least.join(many, "node").select(_key("node").alias("nation"), F.col("value").alias("least_balance"), "suppliers")


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region, count(*) AS size FROM nation JOIN (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey WHERE n_regionkey > 0 GROUP BY 1, 2")
def kernel_neighbor_groups(spark, d):
    g = commerce_graph(spark, d)
    found = kernels.neighbor_groups(g, g.node_scan("Nation").select("id"), ("IN_NATION", IN), [("IN_NATION", OUT), ("IN_REGION", OUT)])
    return found.where(_key("group") > 0).select(_key("source").alias("nation"), _key("group").alias("region"), "size")


@query("SELECT CAST(l_partkey AS BIGINT) AS part, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 5000 GROUP BY 1")
def kernel_neighbor_counts(spark, d):
    g = commerce_graph(spark, d)
    return kernels.neighbor_counts(g.node_scan("Supplier", F.col("acctbal") > 5000).select("id"), g.rel_scan("SUPPLIED")).select(_key("node").alias("part"), "n")


# More of grouped aggregation


@query("SELECT label, CASE WHEN label = 'Supplier' THEN 1 ELSE 0 END AS \"is_Supplier\", count(*) AS n FROM (SELECT 'Customer' AS label, c_acctbal AS b FROM customer UNION ALL SELECT 'Supplier', s_acctbal FROM supplier) WHERE b IS NOT NULL GROUP BY 1, 2")
def fluent_membership(spark, d):
    return aggregate(commerce_graph(spark, d), "Customer", "Supplier").require_present("acctbal").by_label().by_membership("Supplier").run()


@query(f"SELECT {NUMBER['Nation']} * {SPACE} + c_nationkey AS node, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 150000 GROUP BY 1")
def fluent_hop(spark, d):
    return aggregate(commerce_graph(spark, d), "Order").filter("total", ">", 150000).hop("PLACED", IN).hop("IN_NATION", OUT).run().withColumn("n", F.col("n").cast("long"))


@query(f"SELECT c_mktsegment AS segment, {NUMBER['Nation']} * {SPACE} + c_nationkey AS neighbor, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1, 2")
def fluent_only_neighbors(spark, d):
    g = commerce_graph(spark, d)
    only = match(g).node("r", "Region", F.col("key") == 1).hop("r", "IN_REGION", "n", IN).df.select(F.col("n").alias("id"))
    return aggregate(g, "Customer").by("segment").through_rels("IN_NATION", OUT, only).run()


# Algorithms over the whole trade: customers, orders, parts and suppliers, with cycles and weights

_TRADE = f"""nodes AS (SELECT {NUMBER['Customer']} * {SPACE} + c_custkey AS id FROM customer UNION ALL SELECT {NUMBER['Order']} * {SPACE} + o_orderkey FROM orders
UNION ALL SELECT {NUMBER['Part']} * {SPACE} + p_partkey FROM part UNION ALL SELECT {NUMBER['Supplier']} * {SPACE} + s_suppkey FROM supplier),
one_way AS (SELECT {NUMBER['Customer']} * {SPACE} + o_custkey AS a, {NUMBER['Order']} * {SPACE} + o_orderkey AS b, 1.0::DOUBLE AS w FROM orders
UNION ALL SELECT {NUMBER['Order']} * {SPACE} + l_orderkey, {NUMBER['Part']} * {SPACE} + l_partkey, l_quantity FROM lineitem UNION ALL SELECT {NUMBER['Supplier']} * {SPACE} + l_suppkey, {NUMBER['Part']} * {SPACE} + l_partkey, l_quantity FROM lineitem),
edges AS MATERIALIZED (SELECT a AS frm, b AS dst, w FROM one_way UNION ALL SELECT b, a, w FROM one_way)"""


def _trade(spark, d, way=BOTH):
    g = commerce_graph(spark, d)
    nodes = g.node_scan(has_label("Customer") | has_label("Order") | has_label("Part") | has_label("Supplier")).select("id")
    return nodes, g.rel_scan(["PLACED", "CONTAINS", "SUPPLIED"], way).select("frm", "to", "pos", F.when(F.col("type") == "PLACED", 1.0).otherwise(F.col("quantity")).alias("weight"))


def _rounds(first: str, step: str, rounds: int) -> str:
    """`first` as r0, then `step` over the round before, each kept once."""
    parts = [f"r0 AS MATERIALIZED ({first})", *[f"r{i} AS MATERIALIZED ({step.format(p=f'r{i - 1}')})" for i in range(1, rounds + 1)]]
    return f"WITH {_TRADE}, deg AS (SELECT frm AS f, count(*) AS k FROM edges GROUP BY 1), {', '.join(parts)}"


@query(_rounds("SELECT id, id AS v FROM nodes", "SELECT o.id, least(o.v, coalesce(m, o.v)) AS v FROM {p} o LEFT JOIN (SELECT dst, min(v) AS m FROM {p} JOIN edges ON frm = id GROUP BY 1) ON dst = o.id", 12) + " SELECT id AS node, v AS value FROM r12")
def trade_wcc(spark, d):
    return analytics.wcc(*_trade(spark, d, OUT))  # a component has no direction


@query(f"""WITH RECURSIVE {_TRADE}, r(i, id, v, fell) AS (SELECT 0, id, CASE WHEN id = {NUMBER['Supplier']} * {SPACE} + 1 THEN 0.0::DOUBLE END, true FROM nodes
UNION ALL SELECT o.i + 1, o.id, least(o.v, m), m IS NOT NULL AND (o.v IS NULL OR m < o.v) FROM r o LEFT JOIN (SELECT dst, min(v + w) AS m FROM r JOIN edges ON frm = id WHERE v IS NOT NULL GROUP BY 1) ON dst = o.id WHERE (SELECT bool_or(fell) FROM r))
SELECT id AS node, coalesce(v, 'inf'::DOUBLE) AS value FROM r WHERE i = (SELECT max(i) FROM r)""")
def trade_sssp(spark, d):
    return traversal.sssp(*_trade(spark, d, OUT), NUMBER["Supplier"] * SPACE + 1, both=True)


@query(_rounds(f"SELECT id, CASE WHEN id = {NUMBER['Customer']} * {SPACE} + 1 THEN 0 END AS v FROM nodes", "SELECT o.id, coalesce(o.v, m) AS v FROM {p} o LEFT JOIN (SELECT dst, min(v) + 1 AS m FROM {p} JOIN edges ON frm = id WHERE v IS NOT NULL GROUP BY 1) ON dst = o.id", 12) + " SELECT id AS node, CAST(coalesce(v, 9223372036854775807) AS BIGINT) AS value FROM r12")
def trade_bfs(spark, d):
    nodes, edges = _trade(spark, d)
    return traversal.bfs(nodes, edges.select("frm", "to"), NUMBER["Customer"] * SPACE + 1)


@query(_rounds("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS v FROM nodes", "SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (SELECT coalesce(sum(v), 0) FROM {p} WHERE id NOT IN (SELECT f FROM deg)) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g, 0) AS v FROM nodes n LEFT JOIN (SELECT dst, sum(v / k) AS g FROM {p} JOIN edges ON frm = id JOIN deg ON f = id GROUP BY 1) ON dst = n.id", 20) + " SELECT id AS node, round(v, 9) AS value FROM r20")
def trade_pagerank(spark, d):
    nodes, edges = _trade(spark, d)
    return analytics.pagerank(nodes, edges).select("node", F.round("value", 9).alias("value"))


@query(_rounds("SELECT id, id AS v FROM nodes", "SELECT o.id, coalesce(x.v, o.v) AS v FROM {p} o LEFT JOIN (SELECT frm, v FROM (SELECT frm, v, row_number() OVER (PARTITION BY frm ORDER BY count(*) DESC, v) AS r FROM edges JOIN {p} ON id = dst GROUP BY frm, v) WHERE r = 1) x ON x.frm = o.id", 4) + " SELECT id AS node, v AS value FROM r4")
def trade_cdlp(spark, d):
    nodes, edges = _trade(spark, d)
    return analytics.cdlp(nodes, edges, 4)


@query(f"""SELECT {NUMBER['Customer']} * {SPACE} + c_custkey AS start, {NUMBER['Part']} * {SPACE} + l_partkey AS target, min(l_quantity) + 1.0 AS cost FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_custkey <= 20 GROUP BY 1, 2""")
def shortest_weighted(spark, d):
    g = commerce_graph(spark, d)
    edges = g.rel_scan(["PLACED", "CONTAINS"]).select("frm", "to", "quantity")
    m = match(g).node("c", "Customer", F.col("key") <= 20).hop("c", "PLACED", "o").hop("o", "CONTAINS", "p")
    ways = traversal.any_shortest(m.df.select(F.col("c").alias("start"), F.col("p").alias("target")), edges, weight="quantity")
    return ways.where("size(nodes) = 3").select("start", "target", "cost")


# Relationships of ways, an index, counts that meet, types and durations


@query(f"""WITH l AS (SELECT l_orderkey, l_partkey, l_quantity, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_custkey <= 20),
best AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS r FROM l)
SELECT CAST(o_custkey AS BIGINT) AS customer, CAST(l_partkey AS BIGINT) AS part, l_quantity AS quantity, 2 AS rels FROM best WHERE r = 1""")
def shortest_rels(spark, d):
    g = commerce_graph(spark, d)
    edges = g.rel_scan(["PLACED", "CONTAINS"]).select("frm", "to", "pos", "quantity")
    m = match(g).node("c", "Customer", F.col("key") <= 20).hop("c", "PLACED", "o").hop("o", "CONTAINS", "p")
    ways = traversal.any_shortest(m.df.select(F.col("c").alias("start"), F.col("p").alias("target")), edges, weight="quantity", rels=True)
    last = g.rel_scan("CONTAINS").select(F.col("frm").alias("_o"), F.col("to").alias("target"), F.col("pos").alias("_last"), "quantity")
    found = ways.select("start", "target", "rels", F.col("nodes")[1].alias("_o"), F.element_at("rels", -1).alias("_last")).join(last, ["_o", "target", "_last"])
    return found.select(_key("start").alias("customer"), _key("target").alias("part"), "quantity", F.size("rels").alias("rels"))


@query(SQL["search_bm25"])
def search_index(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").where("text is not null")
    index = search.TextIndex.write(docs, "doc_id", "text", scratch_path(spark, "text-index"))
    return index.ranked("Idiot, pathetic").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(SQL["hop_cycle"])
def joined_cycle(spark, d):
    g = commerce_graph(spark, d)
    sold = match(g).node("n", "Nation", props=("name",)).hop("n", "IN_NATION", "c", IN).hop("c", "PLACED", "o").hop("o", "CONTAINS", "p").df.select("n_name", "p")
    made = match(g).node("n", "Nation", props=("name",)).hop("n", "IN_NATION", "s", IN).hop("s", "SUPPLIED", "p").df.select("n_name", "p")
    return kernels.joined_counts(sold, made, ["n_name", "p"]).groupBy(F.col("n_name").alias("nation")).agg(F.sum("n").alias("n"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS customer, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def reach_after_hop(spark, d):
    m = match(commerce_graph(spark, d)).node("c", "Customer").hop("c", "IN_NATION", "n").reach_count("suppliers", "n", "IN_NATION", 1, 1, IN, label="Supplier")
    return m.df.where("suppliers > 0").groupBy(_key("c").alias("customer")).agg(F.sum("suppliers").alias("suppliers"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS key, 3 AS months, -6 AS days, CAST(3 * (o_orderkey % 100) // 2 AS BIGINT) AS millis, CAST(o_orderkey % 2 = 0 AS BOOLEAN) AS even, true AS typed, CAST(o_orderkey AS VARCHAR) AS text FROM orders""")
def durations_and_types(spark, d):
    o = commerce_graph(spark, d).node_scan("Order")
    one = TM.add_durations(TM.duration(months=1, days=-2), TM.duration(milliseconds=F.col("key") % 100))
    three = TM.scale_duration(one, 3)
    return o.select("key", three["months"].cast("int").alias("months"), three["days"].cast("int").alias("days"), TM.divide_duration(three, 2)["millis"].alias("millis"), (F.col("key") % 2 == 0).alias("even"), S.is_typed(F.col("key"), "integer").alias("typed"), S.element_id(F.col("key")).alias("text"))
