"""Algorithms and kernels with known values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from meshlark.graph import BOTH, IN, OUT, PropertyGraph
from meshlark.operators import analytics, kernels, search, traversal
from meshlark.operators.aggregate import aggregate
from meshlark.operators.components import connected_components
from tests import graphs


def as_map(df):
    return {r[0]: r[1] for r in df.collect()}


def values(df):
    return [v for _, v in sorted(as_map(df).items())]


def edges_of(g, direction=OUT):
    return g.rel_scan(None, direction)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 200) for i in range(50)] + [(300, 300), (None, 5)]
    got = as_map(connected_components(spark.createDataFrame(chain, "a long, b long")))
    assert all(got[i] == 0 for i in range(41)) and {got[100 + i] for i in range(50)} == {100} and got[200] == 100 and 300 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wcc_and_directed_flood(spark):
    g = graphs.plain(spark, 5, [(0, 1), (1, 2), (3, 4)])
    assert values(analytics.wcc(g.nodes, edges_of(g))) == [0, 0, 0, 3, 3]
    back = graphs.plain(spark, 3, [(2, 0), (2, 1)])
    assert values(analytics.least_source(back.nodes, edges_of(back))) == [0, 1, 2]
    assert values(analytics.least_source(back.nodes, edges_of(back, IN))) == [0, 1, 0]


def test_sssp_and_bfs(spark):
    g = graphs.plain(spark, 4, [(0, 1, 2.0), (1, 2, 3.0), (0, 2, 10.0)], "src long, dst long, weight double")
    assert values(traversal.sssp(g.nodes, edges_of(g), 0)) == [0, 2, 5, math.inf]
    assert values(traversal.bfs(g.nodes, edges_of(g), 0)) == [0, 1, 1, traversal.FAR]
    odd = edges_of(g).withColumn("weight", F.when(F.col("frm") == 1, F.lit(-1.0)).otherwise(F.col("weight")))
    assert values(traversal.sssp(g.nodes, odd, 0)) == [0, 2, 10, math.inf]


def test_pagerank(spark):
    ring = graphs.plain(spark, 3, [(0, 1), (1, 2), (2, 0)])
    assert values(analytics.pagerank(ring.nodes, edges_of(ring))) == pytest.approx([1 / 3] * 3)
    pair = graphs.plain(spark, 2, [(0, 1)])
    assert values(analytics.pagerank(pair.nodes, edges_of(pair), iterations=1)) == pytest.approx([0.2875, 0.7125])
    assert values(analytics.pagerank(pair.nodes, edges_of(pair), iterations=0)) == [0.5, 0.5]


def test_cdlp(spark):
    ring = graphs.plain(spark, 3, [(0, 1), (1, 2), (2, 0)])
    both = analytics.undirected(edges_of(ring))
    assert values(analytics.cdlp(ring.nodes, both, 2)) == [0, 0, 0]
    seeded = ring.nodes.withColumn("seed", (F.col("id") + 1) * 10)
    assert values(analytics.cdlp(seeded, both, 2, "seed")) == [10, 10, 10]


def test_lcc(spark):
    g = graphs.plain(spark, 4, [(0, 1), (1, 2), (2, 0), (0, 3)])
    assert values(analytics.lcc(g.nodes, edges_of(g))) == pytest.approx([1 / 3, 1, 1, 0])
    assert values(analytics.lcc(g.nodes, edges_of(g), directed=True)) == pytest.approx([1 / 6, 1 / 2, 1 / 2, 0])


def propagated(spark, **more):
    g = graphs.flow(spark)
    seeds = spark.createDataFrame([(0, 10.0)], "node long, value double")
    return {r.node: (r.value, r.depth) for r in analytics.propagate(seeds, edges_of(g), "amt", 3, **more).collect()}


def test_propagate(spark):
    assert propagated(spark) == {0: (10, 1), 1: (5, 2), 2: (3, 2), 3: (2, 3)}
    assert propagated(spark, ascending=False)[3] == (7, 3)
    cut = propagated(spark, truncate=2)
    assert 1 not in cut and 4 not in cut and cut[2] == (3, 2) and cut[3] == (2, 3)
    assert set(propagated(spark, truncate=1)) == {0}
    g = graphs.flow(spark)
    two = analytics.propagate(spark.createDataFrame([(1, 5.0), (2, 3.0)], "node long, value double"), edges_of(g).where("frm in (1, 2) and to = 3"), "amt", 2)
    assert {r.node: (r.value, r.depth) for r in two.collect()} == {1: (5, 1), 2: (3, 1), 3: (9, 2)}


def test_shortest(spark):
    g = graphs.social(spark)
    knows = g.rel_scan("KNOWS")
    pairs = spark.createDataFrame([(0, 3), (0, 0), (4, 0)], "start long, target long")
    assert sorted(tuple(r.nodes) for r in traversal.all_shortest(pairs, knows).collect()) == [(0,), (0, 1, 3), (0, 2, 3)]
    assert sorted((r.cost, tuple(r.nodes)) for r in traversal.any_shortest(pairs, knows).collect()) == [(0.0, (0,)), (2.0, (0, 1, 3))]
    w = graphs.plain(spark, 4, [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0), (0, 3, 10.0)], "src long, dst long, w double")
    ways = traversal.any_shortest(spark.createDataFrame([(0, 3)], "start long, target long"), edges_of(w), weight="w").collect()
    assert [(r.cost, r.nodes) for r in ways] == [(6.0, [0, 1, 2, 3])]
    assert traversal.cheapest(spark.createDataFrame([(0,)], "start long"), edges_of(w).withColumnRenamed("w", "weight"), 1).where("node = 3").first().cost == 10.0
    assert traversal.can_reach(0, 3, knows) and not traversal.can_reach(4, 0, knows)
    assert {r.node for r in traversal.neighborhood(0, knows, 2, 2).collect()} == {3}
    assert {r.node for r in traversal.meeting(0, 3, knows).collect()} == {0, 1, 2, 3}
    assert traversal.visited_rels(0, knows, 1).count() == 2


def thread(spark):
    nodes = [(i, ["Message"], d) for i, d in enumerate([1, 1, 2, 2, 1])] + [(10, ["Person"], None), (11, ["Person"], None)]
    rels = [(2, 0, "REPLY_OF"), (3, 2, "REPLY_OF"), (4, 1, "REPLY_OF")] + [(m, p, "CREATOR") for m, p in ((0, 10), (1, 11), (2, 11), (3, 10), (4, 10))]
    return PropertyGraph.from_frames(spark.createDataFrame(nodes, "id long, labels array<string>, day long"), spark.createDataFrame(rels, "src long, dst long, type string"))


def test_chain_kernels(spark):
    g = thread(spark)
    assert as_map(kernels.roots(g.nodes, g.rel_scan("REPLY_OF"))) == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 10: 10, 11: 11}
    ends = kernels.follow(g, g.node_scan("Message"), [("REPLY_OF", OUT), ("CREATOR", OUT)])
    assert as_map(ends) == {2: 10, 3: 11, 4: 11}
    creators = g.rel_scan("CREATOR").select(F.col("frm").alias("node"), F.col("to").alias("group"))
    assert [tuple(r) for r in kernels.fold_via(g.rel_scan("REPLY_OF"), creators).collect()] == [(10, 11, 3)]
    walks = kernels.hop_counts(g, g.node_scan("Message"), [("CREATOR", OUT), ("CREATOR", IN)])
    assert as_map(walks) == {0: 3, 3: 3, 4: 3, 1: 2, 2: 2}
    groups = kernels.neighbor_groups(g, g.node_scan("Person"), ("CREATOR", IN), [("REPLY_OF", OUT)])
    assert sorted(map(tuple, groups.collect())) == [(10, 1, 1), (10, 2, 1), (11, 0, 1)]
    assert [r.source for r in kernels.top_by_size(groups, 1).collect()] == [10]


def test_neighbor_kernels(spark):
    g = graphs.plain(spark, 4, [(0, 2), (0, 3), (1, 2), (1, 3), (0, 2)])
    e = edges_of(g)
    assert {r.node for r in kernels.common_neighbors(e, 0, 1).collect()} == {2, 3}
    assert as_map(kernels.neighbor_counts(spark.createDataFrame([(0,)], "id long"), e)) == {2: 2, 3: 1}
    shared = {(r.s, r.t): r.n for r in kernels.common_neighbor_counts(spark.createDataFrame([(0,)], "id long"), edges_of(g, BOTH)).collect()}
    assert shared == {(0, 0): 2, (0, 1): 2}
    assert kernels.rels_between(g, 0, 2).count() == 2 and kernels.has_rel(g, 2, 0, None, IN) and not kernels.has_rel(g, 2, 0)
    assert kernels.neighbors(g, 0).count() == 3
    assert {r.id for r in kernels.nodes_with_neighbor(e, spark.createDataFrame([(3,)], "id long")).collect()} == {0, 1}
    assert as_map(kernels.neighbor_fold(e, g.nodes, F.max("name"))) == {0: "n3", 1: "n3"}
    first = spark.createDataFrame([(1, 9), (1, 9), (2, 9)], "a long, mid long")
    pairs = {(r.x, r.y): r.n for r in kernels.co_occurring(first, first.select("mid", F.col("a").alias("b"))).collect()}
    assert pairs == {(1, 2): 2, (2, 1): 2}  # no end occurs with itself


def people(spark):
    rows = [(i, ["Person"], a, i + 1, c) for i, (a, c) in enumerate(zip([25, 30, 35, 40, 45, 50], ["oslo", "oslo", "bergen", "bergen", "oslo", "bergen"], strict=True))]
    rows += [(6, ["Bot"], 99, None, None), (7, ["Bot", "Person"], 98, 2**62, "oslo")]
    nodes = spark.createDataFrame([(*r, 1268638245000 if r[0] == 0 else None) for r in rows], "id long, labels array<string>, age long, score long, city string, created long")
    return PropertyGraph.from_frames(nodes, spark.createDataFrame([(0, 1, "LIKES"), (0, 2, "LIKES"), (1, 2, "LIKES"), (3, 2, "LIKES"), (3, 2, "LIKES")], "src long, dst long, type string"))


def test_grouped_aggregation(spark):
    g = people(spark)
    young = aggregate(g, "Person").filter("age", ">=", 30).filter("age", "<", 98)
    assert young.total() == 5
    got = {r.age_bin: (r.n, r.sum_score) for r in young.bin("age", 35, 45).sum("score").run().collect()}
    assert got == {0: (1, 2), 1: (2, 7), 2: (2, 11)}
    assert aggregate(g, "Person", "Bot").total() == 9
    assert aggregate(g, "Person").require_present("created").temporal("created", "year").run().collect()[0].created_year == 2010
    with pytest.raises(Exception, match="no city"):
        aggregate(g, "Bot").by("city").run().collect()
    over = aggregate(g, "Person").filter("age", "==", 98)
    assert over.sum("score").run().collect()[0].sum_score == 2**62
    twice = aggregate(g, "Person", "Bot").filter("age", "==", 98).sum("score").run().collect()[0]
    assert twice.n == 2 and twice.sum_score is None
    through = {r.neighbor: (r.n, r.sum_score) for r in aggregate(g, "Person").through_rels("LIKES", OUT).sum("score").run().collect()}
    assert through == {1: (1, 1), 2: (4, 7)}
    assert {r.is_Bot: r.n for r in aggregate(g, "Person").by_membership("Bot").run().collect()} == {0: 6, 1: 1}
    assert as_map(aggregate(g, "Person").hop("LIKES", OUT).run()) == {1: 1, 2: 4}
    via = aggregate(g, "Person").filter_via([("LIKES", OUT)], "city", "bergen").run().collect()[0].n
    assert via == 2  # first neighbours of 0, 1, 3 are 1, 2, 2


def test_search(spark):
    docs = spark.createDataFrame([(1, "The Quick, quick fox"), (2, "lazy dog"), (3, "quick Dog É"), (4, None)], "id long, t string")
    assert {r.id for r in search.search_all(docs, "t", "QUICK").collect()} == {1, 3}
    assert search.search_all(docs, "t", " ,").count() == 0
    ranked = [r.id for r in search.search_ranked(docs.where("t is not null"), "id", "t", "quick dog").orderBy(F.col("score").desc(), "id").collect()]
    assert ranked[0] == 3 and set(ranked) == {1, 2, 3}
    assert {r.term: (r.docs, r.occurrences) for r in search.term_counts(docs, "t").collect()}["quick"] == (2, 3)


def test_geo(spark):
    towns = spark.createDataFrame([("Paris", 48.8566, 2.3522), ("Versailles", 48.8049, 2.1204), ("Lyon", 45.7640, 4.8357), ("Nowhere", 95.0, 0.0), ("Fiji", -17.0, 179.5)], "name string, lat double, lon double")
    at = (48.8566, 2.3522)
    assert {r.name for r in search.within_radius(towns, "lat", "lon", at, 25).collect()} == {"Paris", "Versailles"}
    assert [r.name for r in search.nearest(towns, "name", "lat", "lon", at, 2).collect()] == ["Paris", "Versailles"]
    assert {r.name for r in search.within_box(towns, "lat", "lon", (-30, 170), (0, -170)).collect()} == {"Fiji"}
    km = towns.where("name = 'Lyon'").select(search.haversine_km(F.col("lat"), F.col("lon"), *at).alias("km")).first().km
    assert km == pytest.approx(391.5, abs=1)


def test_relationships_of_shortest_ways(spark):
    twice = graphs.plain(spark, 4, [(0, 1, 2.0), (0, 1, 1.0), (1, 3, 1.0), (0, 2, 9.0), (2, 3, 1.0)], "src long, dst long, w double")
    edges = twice.rel_scan("E").select("frm", "to", "pos", "w")
    at = {(r.src, r.dst, r.w): r.pos for r in twice.rels.collect()}
    pairs = spark.createDataFrame([(0, 3), (2, 2)], "start long, target long")
    light = {(r.start, r.target): r.rels for r in traversal.any_shortest(pairs, edges, weight="w", rels=True).collect()}
    assert light == {(0, 3): [at[0, 1, 1.0], at[1, 3, 1.0]], (2, 2): []}
    every = sorted((r.nodes, r.rels) for r in traversal.all_shortest(pairs, edges, rels=True).collect())
    first = min(at[0, 1, 1.0], at[0, 1, 2.0])
    assert every == [([0, 1, 3], [first, at[1, 3, 1.0]]), ([0, 2, 3], [at[0, 2, 9.0], at[2, 3, 1.0]]), ([2], [])]


def test_text_index_answers_as_the_search_does(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "lazy dog, lazy DOG"), (3, "quick dog"), (4, ""), (5, None)], "id long, t string")
    search.TextIndex.write(docs, "id", "t", f"file://{tmp_path}/index", buckets=4)
    index = search.TextIndex.open(spark, f"file://{tmp_path}/index")
    for asked in ("quick dog", "lazy lazy dog", "absent", ""):
        want = {r.id: round(r.score, 9) for r in search.search_ranked(docs.fillna(""), "id", "t", asked).collect()} if asked else {}
        assert {r.key: round(r.score, 9) for r in index.ranked(asked).collect()} == want
        assert sorted(r.key for r in index.having_all(asked).collect()) == sorted(r.id for r in search.search_all(docs, "t", asked).collect())
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", index.hits(["dog"])._jdf.queryExecution().toString())
    assert "bucket#" in filters.group(1)


def test_joined_counts(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,), (1,), (3,)], "k int")
    assert [tuple(r) for r in kernels.joined_counts(a, b, ["k"]).collect()] == [(1, 6)]
