"""Neighbourhood and co-occurrence kernels over edge tables (frm, to, pos)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.graph import PropertyGraph
from meshlark.operators.cluster import materialize

#: Ranges of ids that the sources of `common_neighbor_counts` are cut into, about, and the sources of a range at least.
BLOCKS = 1024
WIDTH = 64
#: Counts and walks that are held at a time.
CELLS = 1 << 21

Step = tuple[str | list[str] | None, str]


def first_neighbor(edges: DataFrame) -> DataFrame:
    """node, neighbor: over each node's edge with the least pos."""
    return edges.groupBy(F.col("frm").alias("node")).agg(F.min_by("to", "pos").alias("neighbor"))


def follow(graph: PropertyGraph, starts: DataFrame, steps: list[Step]) -> DataFrame:
    """start, node: first neighbour of first neighbour and so on; starts whose chain breaks are left out. starts: id."""
    out = starts.select(F.col("id").alias("start"), F.col("id").alias("node"))
    for types, direction in steps:
        out = out.join(first_neighbor(graph.rel_scan(types, direction)), "node").select("start", F.col("neighbor").alias("node"))
    return out


def roots(nodes: DataFrame, edges: DataFrame, most_steps: int = 64) -> DataFrame:
    """node, root: where following first neighbours ends; a node without one is its own root.

    Each round doubles the length of the jumps, so a chain of n takes log2(n)
    rounds. A cycle has no end: after 2^most_steps steps the node met stands.
    """
    jump = nodes.select(F.col("id").alias("node")).join(first_neighbor(edges), "node", "left")
    jump = materialize(jump.select("node", F.coalesce("neighbor", "node").alias("root")), "roots")
    for _ in range(most_steps):
        ahead = jump.select(F.col("node").alias("root"), F.col("root").alias("further"))
        following = materialize(jump.join(ahead, "root", "left").select("node", F.coalesce("further", "root").alias("new"), "root"), "roots")
        moved = not following.where("new <> root").isEmpty()
        jump = following.select("node", F.col("new").alias("root"))
        if not moved:
            break
    return jump


def neighbor_counts(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n: how many edges lead from the sources (id) to each node."""
    return edges.join(sources.select(F.col("id").alias("frm")).distinct(), "frm").groupBy(F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("n"))


def common_neighbors(edges: DataFrame, u: int, v: int) -> DataFrame:
    """node: neighbours of both."""
    of = lambda x: edges.where(F.col("frm") == x).select(F.col("to").alias("node"))
    return of(u).intersect(of(v))


def common_neighbor_counts(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """s, t, n: distinct middle nodes between a source (id) and every node two steps on, itself among them.

    A middle node's neighbours go as a list to each block of sources that has it; walks are counted there in arrays and are neither
    listed as rows nor shuffled. A block is a range of ids with about 1 / BLOCKS of the sources, so
    where ids near one another share neighbours a list travels few times.
    """
    ids = sources.select("id").distinct()
    width = max(WIDTH, ids.count() // BLOCKS)
    block = F.floor(F.col("s") / width).alias("block")
    steps = materialize(edges.where("frm is not null and to is not null").select("frm", "to").distinct(), "common-steps")
    first = steps.join(ids.select(F.col("id").alias("frm")), "frm").select(F.col("frm").alias("s"), F.col("to").alias("mid"))
    first = first.groupBy("mid", block).agg(F.collect_list("s").alias("ss"))
    lists = steps.groupBy(F.col("frm").alias("mid")).agg(F.collect_list("to").alias("ts"))
    met = first.join(lists, "mid").select("block", "ss", "ts")
    return met.groupBy("block").applyInArrow(_counted, "s long, t long, n long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """s, t, n of a block: rows ss and ts are the sources and the ends of the walks over a middle node."""
    parts = [[], [], [], []]
    for batch in batches:
        for i, name in enumerate(("ss", "ts")):
            lists = batch.column(name)
            parts[2 * i].append(lists.flatten().to_numpy())
            parts[2 * i + 1].append(np.diff(lists.offsets.to_numpy()))
    sources, many, ends, width = map(np.concatenate, parts)
    starts = np.cumsum(width) - width
    mid = np.repeat(np.arange(len(many)), many)
    order = np.argsort(sources, kind="stable")
    sources, mid = sources[order], mid[order]
    s_ids, first = np.unique(sources, return_index=True)
    t_ids, ends = np.unique(ends, return_inverse=True)
    first = np.append(first, len(sources))
    step = max(1, CELLS // len(t_ids))
    for low in range(0, len(s_ids), step):
        high = min(low + step, len(s_ids))
        n = np.zeros((high - low) * len(t_ids), np.int64)
        for row, past in _pieces(width[mid], int(first[low]), int(first[high])):
            k = width[mid[row:past]]
            at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[mid[row:past]], k)
            of = np.searchsorted(s_ids, sources[row:past]) - low
            n += np.bincount(np.repeat(of * len(t_ids), k) + ends[at], minlength=len(n))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(s_ids[low + met // len(t_ids)]), pa.array(t_ids[met % len(t_ids)]), pa.array(n[met])], ["s", "t", "n"])


def _pieces(sizes: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Ranges of low..high whose sizes sum up to about CELLS."""
    ends = np.cumsum(sizes[low:high])
    cuts = np.searchsorted(ends, np.arange(CELLS, int(ends[-1]), CELLS)) + 1
    bounds = np.unique(np.concatenate([[0], cuts, [high - low]])) + low
    return zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def fold_via(links: DataFrame, projection: DataFrame) -> DataFrame:
    """x, y, n: links (frm, to) between what their ends project to (node, group), as unordered pairs, none with itself."""
    a = projection.select(F.col("node").alias("frm"), F.col("group").alias("ga"))
    b = projection.select(F.col("node").alias("to"), F.col("group").alias("gb"))
    pairs = links.join(a, "frm").join(b, "to").where("ga <> gb")
    return pairs.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def co_occurring(first: DataFrame, second: DataFrame, distinct: str | None = None) -> DataFrame:
    """x, y, n: walks from a through a shared node to another b, first (a, mid) and second (mid, b), or distinct values of a column on the way.

    An end does not occur with itself.

    Each side is counted by its ends before they meet, so a shared node with
    very many ends gives a row per pair of ends, not per pair of walks.
    """
    if distinct:
        walks = first.join(second, "mid").where("a <> b")
        return walks.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.countDistinct(distinct).alias("n"))
    left = first.groupBy("a", "mid").agg(F.count(F.lit(1)).alias("m"))
    right = second.groupBy("mid", "b").agg(F.count(F.lit(1)).alias("k"))
    return left.join(right, "mid").where("a <> b").groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.sum(F.col("m") * F.col("k")).alias("n"))


def neighbor_groups(graph: PropertyGraph, sources: DataFrame, members: Step, project: list[Step]) -> DataFrame:
    """source, group, size: members of each source (id) by what they project to; members without a projection are left out."""
    reached = graph.rel_scan(*members).select(F.col("frm").alias("source"), F.col("to").alias("id"))
    reached = reached.join(sources.select(F.col("id").alias("source")).distinct(), "source")
    ends = follow(graph, reached.select("id").distinct(), project)
    return reached.join(ends, F.col("id") == F.col("start")).groupBy("source", F.col("node").alias("group")).agg(F.count(F.lit(1)).alias("size"))


def top_by_size(groups: DataFrame, n: int, tie: Column | str = "source") -> DataFrame:
    """The n sources with the largest single group: source, size."""
    return groups.groupBy("source").agg(F.max("size").alias("size")).orderBy(F.col("size").desc(), tie).limit(n)


def hop_counts(graph: PropertyGraph, starts: DataFrame, steps: list[Step]) -> DataFrame:
    """node, n: number of walks along the steps that end in a node. Counts are summed at every step, so no walk is listed."""
    out = starts.select("id").groupBy(F.col("id").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    for types, direction in steps:
        edges = graph.rel_scan(types, direction).groupBy("frm", "to").agg(F.count(F.lit(1)).alias("k"))
        out = out.join(edges, F.col("node") == F.col("frm")).groupBy(F.col("to").alias("node")).agg(F.sum(F.col("n") * F.col("k")).alias("n"))
    return out


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: a LIMIT inside a per-row subquery."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def rels_between(graph: PropertyGraph, u: int, v: int, types: str | list[str] | None = None, direction: str = "out") -> DataFrame:
    """pos of every relationship from u to v; their number is the count of parallel ones."""
    return graph.rel_scan(types, direction, None).where((F.col("frm") == u) & (F.col("to") == v)).select("pos")


def has_rel(graph: PropertyGraph, u: int, v: int, types: str | list[str] | None = None, direction: str = "out") -> bool:
    return not rels_between(graph, u, v, types, direction).isEmpty()


def neighbors(graph: PropertyGraph, node: int, types: str | list[str] | None = None, direction: str = "out") -> DataFrame:
    """node, once for each relationship that leads to it."""
    return graph.rel_scan(types, direction).where(F.col("frm") == node).select(F.col("to").alias("node"))


def neighbors_in(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """frm, to: edges that lead into a set of nodes (id)."""
    return edges.join(wanted.select(F.col("id").alias("to")).distinct(), "to", "left_semi").select("frm", "to")


def nodes_with_neighbor(edges: DataFrame, fitting: DataFrame) -> DataFrame:
    """id of the nodes with a neighbour among `fitting` (id)."""
    return neighbors_in(edges, fitting).select(F.col("frm").alias("id")).distinct()


def neighbor_fold(edges: DataFrame, values: DataFrame, fold: Column) -> DataFrame:
    """node, value: an aggregate over the values of all neighbours. values: id and columns that `fold` reads."""
    named = values.withColumnRenamed("id", "to")
    return edges.select("frm", "to").join(named, "to").groupBy(F.col("frm").alias("node")).agg(fold.alias("value"))


def joined_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """on, n: rows that joining left and right on these columns would have, for each value.

    Each side is counted before they meet, so the walks over a hub are multiplied
    and never listed.
    """
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, on).select(*on, (F.col("_a") * F.col("_b")).alias("n"))
