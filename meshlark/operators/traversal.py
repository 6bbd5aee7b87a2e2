"""Breadth-first searches and shortest paths as loops over frontiers.

A search runs for all its sources at once; one level is one join of the
frontier with the edges. What a level found is written to the shared folder, so
lineage stays one level long, and the loop ends when nothing new is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.operators.cluster import is_empty, materialize
from meshlark.operators.ways import distances

FAR = 2**63 - 1


def reachable(starts: DataFrame, edges: DataFrame, low: int = 0, high: int | None = None, free: Column | None = None) -> DataFrame:
    """start, node, depth: nodes met from each start at depth low..high, each once, at the least such depth.

    starts: start, and node where a start is not a node itself. edges: frm, to.
    free: which edges a start may take, over start, frm and to. Nodes are expanded when first met; one that is
    met again, the start through a cycle among them, is still emitted if it was
    not before.
    """
    starts = starts.select("start", F.col("node" if "node" in starts.columns else "start").alias("node"))
    frontier = materialize(starts, "reach")
    expanded = frontier
    emitted = [frontier.withColumn("depth", F.lit(0))] if low == 0 else []
    depth = 0
    while high is None or depth < high:
        depth += 1
        on = F.col("node") == F.col("frm")
        met = materialize(frontier.join(edges, on if free is None else on & free).select("start", F.col("to").alias("node")).distinct(), "reach-met", True)
        if is_empty(met):
            break
        if depth >= low:
            new = met.withColumn("depth", F.lit(depth))
            for earlier in emitted:
                new = new.join(earlier.select("start", "node"), ["start", "node"], "left_anti")
            emitted.append(materialize(new, "reach-emitted"))
            if len(emitted) > 8:
                emitted = [materialize(reduce(DataFrame.unionByName, emitted), "reach-emitted")]
        frontier = materialize(met.join(expanded, ["start", "node"], "left_anti"), "reach", True)
        if is_empty(frontier):
            break
        expanded = materialize(expanded.unionByName(frontier), "reach-expanded")
    empty = starts.select("start", "node", F.lit(0).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, emitted, empty)


def bfs_distances(sources: DataFrame, edges: DataFrame, high: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """start, node, dist, parent: least number of steps, and of the nodes one step nearer the least. sources: start. targets: start, target; a start is left off once its targets are met."""
    found = materialize(sources.select("start", F.col("start").alias("node"), F.lit(0).alias("dist"), F.lit(None).cast("long").alias("parent")).distinct(), "bfs")
    frontier, depth = found, 0
    while high is None or depth < high:
        depth += 1
        live = frontier
        if targets is not None:
            open_starts = targets.join(found.select("start", F.col("node").alias("target")), ["start", "target"], "left_anti").select("start").distinct()
            live = live.join(open_starts, "start", "left_semi")
        met = live.join(edges, F.col("node") == F.col("frm")).groupBy("start", F.col("to").alias("_to")).agg(F.min("node").alias("parent"))
        new = met.select("start", F.col("_to").alias("node"), F.lit(depth).alias("dist"), "parent").join(found.select("start", "node"), ["start", "node"], "left_anti")
        frontier = materialize(new, "bfs", True)
        if is_empty(frontier):
            break
        found = materialize(found.unionByName(frontier), "bfs-found")
    return found


def bfs(nodes: DataFrame, edges: DataFrame, source: int) -> DataFrame:
    """node, value: steps from the source, FAR where it does not reach. nodes: id."""
    spark = nodes.sparkSession
    found = bfs_distances(spark.createDataFrame([(source,)], "start long"), edges)
    return nodes.select(F.col("id").alias("node")).join(found.select("node", F.col("dist").cast("long")), "node", "left").select("node", F.coalesce("dist", F.lit(FAR)).alias("value"))


def cheapest(sources: DataFrame, edges: DataFrame, most_hops: int | None = None) -> DataFrame:
    """start, node, cost, parent: least total weight. edges: frm, to, weight; negative, NaN and infinite weights bar an edge.

    Rounds of relaxation over the nodes whose cost fell, until none does. Of
    equally cheap ways the one over the least parent stands. With most_hops the
    cost is the least over ways of at most that many edges.
    """
    edges = edges.where(_open(F.col("weight")))
    best = materialize(sources.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("parent")).distinct(), "relax")
    changed, hops = best, 0
    while most_hops is None or hops < most_hops:
        hops += 1
        offers = changed.join(edges, F.col("node") == F.col("frm")).select("start", F.col("to").alias("_to"), F.struct((F.col("cost") + F.col("weight")).alias("cost"), F.col("node").alias("parent")).alias("_offer"))
        offers = offers.groupBy("start", "_to").agg(F.min("_offer").alias("_offer")).select("start", F.col("_to").alias("node"), F.col("_offer.cost").alias("new_cost"), F.col("_offer.parent").alias("new_parent"))
        merged = best.join(offers, ["start", "node"], "full")
        better = F.col("new_cost").isNotNull() & (F.col("cost").isNull() | (F.col("new_cost") < F.col("cost")))
        merged = merged.select("start", "node", F.when(better, F.col("new_cost")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("new_parent")).otherwise(F.col("parent")).alias("parent"), better.alias("fell"))
        merged = materialize(merged, "relax")
        best, changed = merged.drop("fell"), merged.where("fell").drop("fell")
        if changed.isEmpty():
            break
    return best


def sssp(nodes: DataFrame, edges: DataFrame, source: int, both: bool = False) -> DataFrame:
    """node, value: cost from the source, infinite where it does not reach, over ways of any length through nodes of the graph.

    edges: frm, to, weight; both: they lead both ways. Negative, NaN, null and infinite weights bar an edge.
    """
    found = distances(nodes, edges.where(_open(F.col("weight"))), source, both)
    return nodes.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("value", F.lit(float("inf"))).alias("value"))


def paths_back(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """start, target, nodes: the way to each target along parents. found: start, node, parent; pairs: start, target."""
    way = pairs.join(found.select("start", F.col("node").alias("target"), "parent"), ["start", "target"])
    way = materialize(way.select("start", "target", F.array("target").alias("nodes"), "parent"), "paths")
    done = way.where("parent is null")
    open_ways = way.where("parent is not null")
    while not open_ways.isEmpty():
        step = open_ways.join(found.select("start", F.col("node").alias("parent"), F.col("parent").alias("_up")), ["start", "parent"])
        way = materialize(step.select("start", "target", F.array_prepend("nodes", F.col("parent")).alias("nodes"), F.col("_up").alias("parent")), "paths")
        done, open_ways = done.unionByName(way.where("parent is null")), way.where("parent is not null")
    return done.drop("parent")


def with_rels(ways: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Ways with `rels`, the positions of their relationships in order; of parallel ones the lightest, then the least position.

    ways: start, target, nodes, each once. edges: frm, to, pos, and `weight` if named.
    """
    hops = F.zip_with(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda a, b: F.struct(a.alias("frm"), b.alias("to")))
    steps = ways.select("start", "target", "nodes", F.posexplode(hops).alias("_i", "_hop")).select("start", "target", "nodes", "_i", "_hop.frm", "_hop.to")
    load = _load(weight) if weight else F.lit(1.0)
    chosen = edges.where(_open(load)).groupBy("frm", "to").agg(F.min(F.struct(load.alias("w"), F.col("pos").alias("pos")))["pos"].alias("pos"))
    listed = steps.join(chosen, ["frm", "to"]).groupBy("start", "target", "nodes").agg(F.array_sort(F.collect_list(F.struct("_i", "pos")))["pos"].alias("rels"))
    return ways.join(listed, ["start", "target", "nodes"], "left").withColumn("rels", F.coalesce("rels", F.expr("cast(array() as array<bigint>)")))


def _load(weight: str) -> Column:
    return F.coalesce(F.col(weight).cast("double"), F.lit(1.0))


def _open(weight: Column) -> Column:
    return weight.isNotNull() & ~F.isnan(weight) & (weight >= 0) & (weight < float("inf"))


def any_shortest(pairs: DataFrame, edges: DataFrame, high: int | None = None, weight: str | None = None, rels: bool = False) -> DataFrame:
    """start, target, nodes, cost: one shortest way for each pair that has one; of equals that over least parents.

    rels: also the positions of its relationships, for which edges need `pos`. Without `weight` the cost is the number of steps. A node reaches itself by
    the way of no step.
    """
    pairs = pairs.select("start", "target").where("start is not null and target is not null").distinct()
    sources = pairs.select("start").distinct()
    if weight:
        found = cheapest(sources, edges.withColumn("weight", _load(weight)), high)
    else:
        found = bfs_distances(sources, edges, high, pairs).withColumn("cost", F.col("dist").cast("double"))
    ways = paths_back(found, pairs)
    ways = with_rels(ways, edges, weight) if rels else ways
    return ways.join(found.select("start", F.col("node").alias("target"), "cost"), ["start", "target"])


def all_shortest(pairs: DataFrame, edges: DataFrame, high: int | None = None, rels: bool = False) -> DataFrame:
    """start, target, nodes: every shortest chain of nodes for each pair; parallel relationships count once. rels: their positions too, for which edges need `pos`."""
    pairs = pairs.select("start", "target").where("start is not null and target is not null").distinct()
    found = bfs_distances(pairs.select("start").distinct(), edges, high, pairs).select("start", "node", "dist")
    steps = edges.select("frm", "to").distinct()
    way = materialize(pairs.join(found.withColumnRenamed("node", "target"), ["start", "target"]).withColumn("nodes", F.array("target")), "chains")
    done, open_ways = way.where("dist = 0"), way.where("dist > 0")
    while not open_ways.isEmpty():
        back = open_ways.join(steps, F.col("nodes")[0] == F.col("to")).select("start", "target", "nodes", (F.col("dist") - 1).alias("dist"), F.col("frm").alias("node"))
        back = back.join(found, ["start", "node", "dist"]).select("start", "target", "dist", F.array_prepend("nodes", F.col("node")).alias("nodes"))
        way = materialize(back, "chains")
        done, open_ways = done.unionByName(way.where("dist = 0")), way.where("dist > 0")
    done = done.select("start", "target", "nodes")
    return with_rels(done, edges) if rels else done


def neighborhood(source: int, edges: DataFrame, low: int, high: int) -> DataFrame:
    """node, dist of the nodes whose distance from the source lies in low..high."""
    spark = edges.sparkSession
    return bfs_distances(spark.createDataFrame([(source,)], "start long"), edges, high).where(F.col("dist").between(low, high)).select("node", "dist")


def can_reach(source: int, target: int, edges: DataFrame) -> bool:
    spark = edges.sparkSession
    pairs = spark.createDataFrame([(source, target)], "start long, target long")
    return not bfs_distances(pairs.select("start"), edges, None, pairs).where(F.col("node") == target).isEmpty()


def visited_rels(source: int, edges: DataFrame, high: int | None = None) -> DataFrame:
    """pos of the edges over which a search from the source first meets nodes or comes back to ones it has met. edges: frm, to, pos."""
    spark = edges.sparkSession
    found = bfs_distances(spark.createDataFrame([(source,)], "start long"), edges, high)
    inner = found if high is None else found.where(F.col("dist") < high)
    return edges.join(inner.select(F.col("node").alias("frm")), "frm", "left_semi").select("pos").distinct()


def meeting(source: int, target: int, edges: DataFrame, high: int | None = None) -> DataFrame:
    """node, there, back: nodes on shortest ways from source to target, with their distances to both."""
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "start long")
    there = bfs_distances(one(source), edges, high).select("node", F.col("dist").alias("there"))
    turned = edges.select(F.col("to").alias("frm"), F.col("frm").alias("to"))
    back = bfs_distances(one(target), turned, high).select("node", F.col("dist").alias("back"))
    both = materialize(there.join(back, "node"), "meeting")
    least = both.agg(F.min(F.col("there") + F.col("back")).alias("d"))
    return both.crossJoin(F.broadcast(least)).where(F.col("there") + F.col("back") == F.col("d")).select("node", "there", "back")
