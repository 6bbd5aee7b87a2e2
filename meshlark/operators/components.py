"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.cluster import discard, materialize
from meshlark.operators.skew import join_hot


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


#: Edge tables below this are joined plainly: one node's edges fit a task.
FEW_EDGES = 100_000


def star_round(edges: DataFrame, n_edges: int) -> DataFrame:
    """One large star and one small star over edges (a, b) with a > b; n_edges: their number.

    Only minima are grouped, and they come back by a join in which the nodes
    with very many neighbours, bounded in number, are broadcast: no node's edges
    are gathered in one task unless the whole table has fewer than FEW_EDGES.
    """

    def with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return pairs.join(least.drop("n"), "a") if n_edges < FEW_EDGES else join_hot(pairs, least, "a", 2 * n_edges)

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    large = with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = with_least(large, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


#: Edges that a task contracts at a time.
CHUNK = 1 << 20


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b), a > b, that connect what those of `edges` (a, b) connect.

    Tasks read chunks of their edges and give each node of a chunk an edge to
    the least node that the chunk connects it with: fewer edges than the chunk
    has nodes, however many it had, and nothing is shuffled.
    """

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            apart = low < high
            x, y = x[apart], y[apart]
            np.minimum.at(root, high[apart], low[apart])
            while not np.array_equal(further := root[root], root):
                root = further
        bound = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[bound]), pa.array(ids[root[bound]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= chunk:
                yield stars(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))

    return edges.select("a", "b").mapInArrow(run, f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['b'].dataType.simpleString()}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """`node`, `component`: for every node with an edge to another, the smallest node it reaches.

    Rows with a null end and self-loops bind nothing; repeated edges count once.
    Each round is written to the shared folder; the round before is removed.
    """
    x, y = F.col(a), F.col(b)
    current = materialize(contracted(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))).distinct(), "edges")
    state = _state(current)
    for _ in range(most_rounds):
        if not state[0]:
            break
        following = materialize(star_round(current, state[0]), "edges")
        discard(current)
        current, before = following, state
        state = _state(current)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
