"""Steps whose work once grew faster than their input, or whose results parted from SQL on longer ways."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meshlark import queries
from meshlark.graph import BOTH, IN, OUT, PropertyGraph
from meshlark.operators import analytics, blocks, kernels, search
from meshlark.operators.cluster import bucketed
from meshlark.operators.components import connected_components, contracted
from meshlark.plans.match import match


def test_postings_of_a_text_of_many_tokens(spark, tmp_path):
    n = 100_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ")
    docs = spark.range(1).select("id", F.concat(text, F.lit(" w7 w7 w9")).alias("t")).unionByName(spark.range(1, 3).select("id", F.lit("").alias("t"))).unionByName(spark.range(3, 4).select("id", F.lit(None).cast("string").alias("t")))
    began = time.monotonic()
    index = search.TextIndex.write(docs, "id", "t", f"file://{tmp_path}/index", buckets=4)
    assert {r.term: r.tf for r in index.hits(["w7", "w9", "w100000"]).collect()} == {"w7": 3, "w9": 2, "w100000": 1}
    assert time.monotonic() - began < 60  # n^2 comparisons take minutes
    assert index.postings.count() == n
    assert tuple(index.stats.select("n", "mean").first()) == (4, (n + 3) / 4)
    counts = {r.term: (r.docs, r.occurrences) for r in search.term_counts(docs, "t").where("term in ('w7', 'w8')").collect()}
    assert counts == {"w7": (1, 3), "w8": (1, 1)}


def _graph(spark):
    nodes = [("A", spark.createDataFrame([(i,) for i in range(1, 7)], "id long")), ("B", spark.createDataFrame([(i,) for i in range(7, 10)], "id long"))]
    pairs = [(1, 7), (1, 7), (2, 7), (3, 8), (4, 8), (8, 9), (9, 8), (5, 5), (7, 1), (6, 9)]
    rels = [("R", spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pos long, src long, dst long"))]
    return PropertyGraph.from_parts(nodes, rels, blanks=False)


def test_reach_count_counts_what_reach_lists(spark):
    g = _graph(spark)
    for to, low, high, label, way in ((OUT, 1, 1, None, OUT), (IN, 1, 1, "A", OUT), (BOTH, 1, 1, None, BOTH), (IN, 0, 1, "A", OUT)):
        first = match(g).node("x").hop("x", "R", "y", way)
        listed = first.reach("y", "R", "z", low, high, to)
        listed = (listed.node("z", label) if label else listed).df.select("x", "y", "z").distinct().groupBy("x", "y").count()
        counted = first.reach_count("n", "y", "R", low, high, to, label=label).df.select("x", "y", "n").distinct()
        assert {(r.x, r.y): r.n for r in counted.collect() if r.n} == {(r.x, r.y): r["count"] for r in listed.collect()}, (to, low, high, label)


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE), reason="no test tables here")
def test_sssp_over_longer_ways_than_its_sql_has_rounds(spark, tmp_path):
    """Suppliers and parts in a chain of 36 relationships, and one of which the quantity is null."""
    c = duckdb.connect()
    row = "row_number() over ()"
    made = {
        "lineitem": f"select * replace (n as l_orderkey, case when n = 37 then 3 else 1 + (n - 1) // 2 end as l_partkey, case when n = 37 then 20 else 1 + n // 2 end as l_suppkey, case when n = 37 then null else 1 + n % 3 end as l_quantity) from (select *, {row} as n from t limit 37)",
        "orders": f"select * replace (n as o_orderkey, n as o_custkey) from (select *, {row} as n from t limit 37)",
        "part": f"select * replace (n as p_partkey) from (select *, {row} as n from t limit 18)",
        "customer": f"select * replace (n as c_custkey) from (select *, {row} as n from t limit 37)",
        "supplier": f"select * replace (n as s_suppkey) from (select r.* exclude (r, k), r.r as n from (select * from range(1, 21) q(r), (select *, {row} as k from t) where k = 1) r)",
    }
    for name in ("region", "nation", "events", *made):
        sql = made.get(name, "select * from t").replace(" t ", f" '{entry.SMOKE}/{name}.parquet' ").replace(" t)", f" '{entry.SMOKE}/{name}.parquet')")
        sql = sql if name in made else f"select * from '{entry.SMOKE}/{name}.parquet'"
        kinds = {"lineitem": "l_orderkey l_partkey l_suppkey", "orders": "o_orderkey o_custkey", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}.get(name, "").split()
        casts = ", ".join([f"{k}::bigint as {k}" for k in kinds] + (["l_quantity::double as l_quantity"] if name == "lineitem" else []))
        c.execute(f"copy (select * {f'replace ({casts})' if casts else ''} from ({sql})) to '{tmp_path}/{name}.parquet' (format parquet)")
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = c.execute(queries.SQL["trade_sssp"]).fetchall()
    got = queries.QUERIES["trade_sssp"](spark, str(tmp_path)).collect()
    assert sorted((r.node, r.value) for r in got) == sorted(want)
    assert 10 < sum(v == float("inf") for _, v in want) < 100


def test_contracted_edges_connect_the_same_and_are_few(spark):
    pairs = [(i, i - 1) for i in range(2, 400)] + [(i, 1000) for i in range(1001, 1400)] + [(1399, 1001)] * 3000
    edges = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    few = contracted(edges, 10_000).collect()
    assert sorted((r.a, r.b) for r in few) == [(i, 1) for i in range(2, 400)] + [(i, 1000) for i in range(1001, 1400)]
    assert {r.component for r in connected_components(contracted(edges, 700)).collect()} == {1, 1000}


def test_walks_over_a_middle_node_are_not_shuffled(spark):
    """Sources in several blocks, a source that is a middle node too, parallel edges, one node that is no source."""
    pairs = [(s, 5000 + m) for m in range(4) for s in range(0, 3000, 7 + m)] + [(0, 5000)] * 3 + [(4999, 5001), (5002, 7)]
    edges = analytics.undirected(spark.createDataFrame(pairs, "frm long, to long"))
    found = kernels.common_neighbor_counts(spark.range(3000), edges)
    assert "hashpartitioning(s" not in found._jdf.queryExecution().executedPlan().toString()
    of = {}
    for a, b in pairs:
        of.setdefault(a, set()).add(b)
        of.setdefault(b, set()).add(a)
    want = {}
    for s in range(3000):
        for m in of.get(s, ()):
            for t in of[m]:
                want[s, t] = want.get((s, t), 0) + 1
    assert {(r.s, r.t): r.n for r in found.collect()} == want


def test_label_rounds_do_not_shuffle_the_links_again(spark):
    frame = bucketed(spark.range(1000).select(F.col("id").alias("to"), (F.col("id") % 7).alias("frm")), "test-links", "to")
    plan = frame.groupBy("to").count()._jdf.queryExecution().executedPlan().toString()
    assert frame.count() == 1000 and "Exchange" not in plan


def test_pagerank_sends_a_value_a_shared_node_not_an_edge(spark):
    """Blocks of about 40 edges, a hub that fills several, nodes without ways out or without edges, repeated nodes, ends that are no nodes or null."""
    pairs = [(i, i + 1) for i in range(0, 150)] + [(i + 1, i) for i in range(0, 150, 2)] + [(500, i) for i in range(0, 150)] + [(i, 500) for i in range(0, 90)]
    pairs += [(3, 3), (7, 8), (7, 8), (9, 700), (701, 4), (10, None), (None, 5), (11, 160), (12, 160)]
    ids = [*range(0, 151), 160, 161, 162, 500, 20, None]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    edges = spark.createDataFrame(pairs, "frm long, to long")
    listed = sorted((str(r.node), r.value) for r in analytics.pagerank(nodes, edges, iterations=4).collect())
    blocked = sorted((str(r.node), r.value) for r in analytics.pagerank(nodes, edges, iterations=4, size=40, few=0).collect())
    assert [k for k, _ in blocked] == [k for k, _ in listed]
    assert [v for _, v in blocked] == pytest.approx([v for _, v in listed], rel=1e-12)
    near = spark.createDataFrame([(i, j) for i in range(400) for j in (i ^ 1, i ^ 2, i ^ 3)], "frm long, to long")
    found = blocks.cut(spark.range(400), near, 120)
    assert found.blocks.count() == 10 and found.outer.count() < 40  # most of the 400 nodes stay with their blocks
