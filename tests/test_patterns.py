"""Patterns, clauses and subqueries on small graphs."""

import pytest
from pyspark.sql import functions as F

from meshlark.graph import BOTH, IN, SchemaError, has_label
from meshlark.operators.kernels import top_per_group
from meshlark.plans import sets
from meshlark.plans.match import match
from tests import graphs


@pytest.fixture(scope="module")
def g(spark):
    found = graphs.social(spark)
    found.nodes.cache()
    found.rels.cache()
    return found


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scans(g):
    assert [r.id for r in g.find("name", "Bob").collect()] == [1]
    assert g.node_scan("Person", F.col("age") > 30).count() == 2
    assert g.node_scan("%").count() == 6 and g.node_scan("Ghost").count() == 0
    assert g.node_scan(has_label("Person") & ~has_label("Company")).count() == 4
    assert {r.id for r in g.range_scan("Person", "age", 30, 40, with_low=False).collect()} == {1, 2}
    assert g.node_scan("Person", city=None or "LA").count() == 1
    with pytest.raises(SchemaError):
        g.node_scan("Person", shoe=1)


def test_empty_strings_are_absent(g):
    assert g.node_scan("Person", F.col("city").isNull()).count() == 2


def test_positions_follow_source_then_staging(g):
    got = [(r.pos, r.src, r.dst) for r in g.rels.orderBy("pos").collect()]
    assert [p for p, _, _ in got] == list(range(10)) and [s for _, s, _ in got] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_hops_in_every_direction(g):
    a = match(g).node("a", "Person", name="Alice")
    assert rows(a.hop("a", "KNOWS", "b").select("b")) == [(1,), (2,)]
    assert rows(a.hop("a", "KNOWS", "b", IN).select("b")) == [(3,)]
    assert rows(a.hop("a", None, "b", BOTH).select("b")) == [(1,), (2,), (3,), (4,)]
    assert rows(a.hop("a", "NONE", "b").select("b")) == []


def test_parallel_relationships_multiply_and_cannot_close_on_themselves(spark):
    p = graphs.parallel(spark)
    assert match(p).node("a").hop("a", "E", "b").df.count() == 2
    back = match(p).node("a").hop("a", "E", "b").hop("b", "E", "a", IN)
    assert back.df.count() == 0
    assert match(p, repeatable=True).node("a").hop("a", "E", "b").hop("b", "E", "a", IN).df.count() == 4
    assert match(p).node("a").hop("a", "E", "b").next_clause().hop("b", "E", "a", IN).df.count() == 4


def test_triangles(g):
    m = match(g).node("a", "Person").hop("a", "KNOWS", "b").hop("b", "KNOWS", "c").hop("c", "KNOWS", "a")
    assert m.df.count() == 6  # 0-1-3 and 0-2-3, each from three starts
    assert {tuple(sorted(r)) for r in m.select("a", "b", "c").collect()} == {(0, 1, 3), (0, 2, 3)}


def test_trails(g):
    a = match(g).node("a", name="Alice")
    assert rows(a.trail("a", "KNOWS", "b", 2, 2).select("b")) == [(1,), (2,), (3,), (3,)]
    longest = a.trail("a", "KNOWS", "b", 1, 7, path="p").select(F.size("p.rels").alias("n"), F.size("p.nodes").alias("m"))
    assert all(r.m == r.n + 1 for r in longest.collect())
    assert a.trail("a", "KNOWS", "b", 1, 4, acyclic=True).df.where("b = 0").count() == 0
    with pytest.raises(ValueError):
        a.trail("a", "KNOWS", "b", 3, 2)


def test_trail_and_hop_do_not_share_a_relationship(spark):
    line = graphs.plain(spark, 3, [(0, 1), (1, 2)])
    m = match(line).node("a", name="n0").trail("a", "E", "b", 1, 2).hop("b", "E", "c", BOTH)
    assert rows(m.select("b", "c")) == [(1, 2)]


def test_rising_trails(spark):
    steps = graphs.plain(spark, 4, [(0, 1, 5), (1, 2, 7), (1, 3, 1)], "src long, dst long, at long")
    m = match(steps).node("a", name="n0").trail("a", "E", "b", 2, 2, rising="at")
    assert rows(m.select("b")) == [(2,)]
    only = match(steps).node("a", name="n0").trail("a", "E", "b", 1, 2, each=F.col("at") > 4)
    assert rows(only.select("b")) == [(1,), (2,)]


def test_reach(g):
    a = match(g).node("a", name="Alice")
    assert rows(a.reach("a", "KNOWS", "b", 1).select("b")) == [(0,), (1,), (2,), (3,)]
    assert rows(a.reach("a", "KNOWS", "b", 0, 1).select("b")) == [(0,), (1,), (2,)]
    assert rows(a.reach("a", "WORKS_AT", "b").select("b")) == [(0,), (4,)]


def test_optional_keeps_rows(g):
    m = match(g).node("p", "Person").optional(["p"], lambda b: b.hop("p", "WORKS_AT", "c").node("c", props=("name",)))
    assert rows(m.df.select("p", "c_name")) == [(0, "Acme"), (1, "Acme"), (2, "Globex"), (3, None)]
    again = m.optional(["c"], lambda b: b.hop("c", "WORKS_AT", "q", IN))
    assert again.df.where("c is null").count() == 1
    assert m.exists("e", ["c"], lambda b: b.hop("c", "WORKS_AT", "q", IN)).df.where("not e").count() == 1


def test_subqueries(g):
    m = match(g).node("p", "Person")
    m = m.exists("works", ["p"], lambda b: b.hop("p", "WORKS_AT", "c")).count("friends", ["p"], lambda b: b.hop("p", "KNOWS", "f"))
    m = m.collect("cities", ["p"], lambda b: b.hop("p", "KNOWS", "f").node("f", props=("city",)), F.col("f_city"), [F.col("f")])
    assert rows(m.df.select("p", "works", "friends", "cities")) == [(0, True, 2, [None, "LA"]), (1, True, 2, ["LA", None]), (2, True, 2, [None, None]), (3, False, 1, ["NYC"])]
    assert rows(m.where_exists(["p"], lambda b: b.hop("p", "WORKS_AT", "c"), negate=True).df.select("p")) == [(3,)]


def test_walks_inside_subqueries_may_repeat_relationships(g):
    m = match(g).node("p", "Person", name="Dave").count("n", ["p"], lambda b: b.hop("p", "KNOWS", "a").hop("a", "KNOWS", "p", IN))
    assert m.df.collect()[0].n == 1


def test_call(g):
    def eldest(b):
        return top_per_group(b.hop("p", "KNOWS", "f").node("f", props=("age",)).table(), ["p"], [F.col("f_age").desc()], 1)

    m = match(g).node("p", "Person").call(["p"], eldest)
    assert rows(m.df.select("p", "f")) == [(0, 2), (1, 2), (2, 1), (3, 0)]
    with pytest.raises(ValueError):
        m.call(["p"], eldest)
    once = match(g).node("p", "Person").call([], lambda b: b.node("c", "Company").df.agg(F.count("*").alias("n")))
    assert {r.n for r in once.df.collect()} == {2}


def test_unwind_let_and_labels(g):
    m = match(g).node("p", "Person").let(xs=F.array(F.lit(1), F.lit(2))).unwind("x", F.col("xs"))
    assert m.df.count() == 8
    assert match(g).node("p").unwind("y", F.lit(3), scalar=True).df.count() == 6
    assert match(g).node("p").unwind("y", F.lit(None).cast("array<int>")).df.count() == 0
    assert match(g).node("p").labelled("p", "firm", "Company").df.where("firm").count() == 2
    assert match(g).node("a", "Company").node("b", "Company").df.count() == 4


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2, None], [2, 3, None]))
    assert rows(sets.union_all(a, b)) == [(1,), (1,), (2,), (2,), (3,), (None,), (None,)]
    assert rows(sets.union(a, b)) == [(1,), (2,), (3,), (None,)]
    assert rows(sets.minus(a, b)) == [(1,)] and rows(sets.intersection(a, b)) == [(2,), (None,)]
    with pytest.raises(ValueError):
        sets.union(a, b.withColumnRenamed("x", "y"))
    assert sets.profile(a) == {"rows": 4} and sets.explain(a).count() > 3


def test_edits(spark, g):
    left = g.remove_nodes(spark.createDataFrame([(0,)], "id long"))
    assert left.node_count() == 5 and left.rel_count() == 6
    again = left.add_nodes(spark.createDataFrame([(0, ["Person"], "Ann")], "id long, labels array<string>, name string"))
    assert again.node_scan("Person", name="Ann").count() == 1 and again.rel_count("KNOWS") == 4
    assert g.remove_rels(g.rel_scan("KNOWS").select("pos")).rel_count() == 3
    writes = spark.createDataFrame([(0, 31, 1), (0, 32, 2), (1, None, 1)], "id long, value long, seq long")
    ages = {r.id: r.age for r in g.update_property("age", writes).nodes.collect()}
    assert ages[0] == 32 and ages[1] is None and ages[2] == 40
    since = g.update_rel_property("since", spark.createDataFrame([(0, 1999, 1), (0, 2001, 2)], "pos long, value long, seq long"))
    assert [r.since for r in since.rels.orderBy("pos").limit(2).collect()] == [2001, None]
    assert {r.degree for r in g.degrees("WORKS_AT").collect()} == {0, 1}
    assert g.average_degree("KNOWS", label="Person").collect()[0].avg_degree == 7 / 4


def test_trails_without_end(g):
    a = match(g).node("a", "Person", name="Alice")
    assert rows(a.trail("a", "KNOWS", "b", 1, None).select("b")) == rows(a.trail("a", "KNOWS", "b", 1, 7).select("b"))
    assert rows(a.trail("a", "WORKS_AT", "b", 0, None).select("b")) == [(0,), (4,)]
    assert rows(a.trail("a", "NONE", "b", 1, None).select("b")) == []


def test_reach_leaves_out_relationships_of_the_clause(spark):
    line = graphs.plain(spark, 4, [(0, 1), (1, 2), (2, 0), (2, 3)])
    m = match(line).node("a", name="n0").hop("a", "E", "b")
    assert rows(m.reach("b", "E", "c", 1).select("c")) == [(0,), (2,), (3,)]
    assert rows(m.reach("b", "OTHER", "c", 0).select("c")) == [(1,)]
    assert rows(m.next_clause().reach("b", "E", "c", 1).select("c")) == [(0,), (1,), (2,), (3,)]
    assert rows(match(line, repeatable=True).node("a", name="n0").hop("a", "E", "b").reach("b", "E", "c", 1).select("c")) == [(0,), (1,), (2,), (3,)]
    with pytest.raises(ValueError):
        match(line).node("a", name="n0").reach("a", "E", "b", 1).hop("b", "E", "c")
    kept = match(line).node("a", name="n0").trail("a", "E", "b", 1, None).hop("b", "E", "c")
    assert rows(kept.select("b", "c")) == [(0, 1)] * 0 + [(1, 2), (2, 0), (2, 3)]
    assert match(line).node("a", name="n0").reach("a", "E", "b", 1).next_clause().hop("b", "E", "c").df.count() == 4


def test_rows_of_each_operator(spark):
    found = sets.profile_operators(spark.range(10).where("id > 6").groupBy((F.col("id") % 2).alias("k")).count()).collect()
    assert [r.rows for r in found if r.operator == "Filter"] == [3] and [r.rows for r in found if r.operator == "HashAggregate"][0] == 2
