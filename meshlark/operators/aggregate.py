"""Grouped aggregation over labelled nodes, described step by step, run as one groupBy."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.functions.aggregates import exact_sum
from meshlark.functions.temporal import component
from meshlark.graph import PropertyGraph, SchemaError
from meshlark.operators.kernels import Step, follow, hop_counts

OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


@dataclass(frozen=True)
class Aggregate:
    """Steps return a new description; `run` gives the rows, `total` the size of the population.

    A node with two of the labels counts twice. Filters drop absent values. The
    population is what the filters leave; `having` drops rows after that.
    """

    graph: PropertyGraph
    labels: tuple[str, ...]
    filters: tuple[Column, ...] = ()
    vias: tuple[tuple[tuple[Step, ...], str, tuple], ...] = ()
    havings: tuple[Column, ...] = ()
    keys: tuple[tuple[str, Column], ...] = ()
    needed: tuple[str, ...] = ()
    summed: str | None = None
    through: tuple | None = None
    hops: tuple[Step, ...] = field(default=())

    def filter(self, key: str, op: str, value) -> Aggregate:
        return replace(self, filters=(*self.filters, OPS[op](F.col(key), F.lit(value))))

    def filter_via(self, steps: list[Step], key: str, *allowed) -> Aggregate:
        """Keep nodes whose first neighbour along the steps has one of the allowed values."""
        return replace(self, vias=(*self.vias, (tuple(steps), key, allowed)))

    def having(self, key: str, op: str, value) -> Aggregate:
        return replace(self, havings=(*self.havings, OPS[op](F.col(key), F.lit(value))))

    def require_present(self, key: str) -> Aggregate:
        return replace(self, filters=(*self.filters, F.col(key).isNotNull()))

    def _by(self, name: str, value: Column) -> Aggregate:
        return replace(self, keys=(*self.keys, (name, value)))

    def by_label(self) -> Aggregate:
        return self._by("label", F.col("_label"))

    def by(self, key: str) -> Aggregate:
        """Group by a value; a row that lacks it fails the run."""
        return replace(self._by(key, F.col(key)), needed=(*self.needed, key))

    def bin(self, key: str, *bounds) -> Aggregate:
        """Group by how many bounds are at or below the value; absent values are in the last bin."""
        n = reduce(lambda a, b: a + b, [(F.col(key) >= F.lit(b)).cast("int") for b in bounds])
        return self._by(f"{key}_bin", F.coalesce(n, F.lit(len(bounds))))

    def temporal(self, key: str, unit: str) -> Aggregate:
        """Group by a component of epoch milliseconds, in UTC."""
        return self._by(f"{key}_{unit}", component(F.col(key), unit))

    def by_membership(self, label: str) -> Aggregate:
        return self._by(f"is_{label}", F.array_contains("labels", label).cast("int"))

    def sum(self, key: str) -> Aggregate:
        return replace(self, summed=key)

    def through_rels(self, types, direction: str, only: DataFrame | None = None) -> Aggregate:
        """Count relationships by the node they lead to (of `only`: id); sums take each distinct pair once."""
        return replace(self, through=(types, direction, only))

    def hop(self, types, direction: str) -> Aggregate:
        """Count walks by their last node; goes with filters only."""
        return replace(self, hops=(*self.hops, (types, direction)))

    def population(self) -> DataFrame:
        for label in self.labels:
            if not isinstance(label, str):
                raise SchemaError("labels are names")
        scans = [self.graph.node_scan(label).withColumn("_label", F.lit(label)) for label in self.labels]
        out = reduce(DataFrame.unionByName, scans)
        for condition in self.filters:
            out = out.where(condition)
        for steps, key, allowed in self.vias:
            ends = follow(self.graph, out.select("id").distinct(), list(steps))
            fit = self.graph.node_scan(None, F.col(key).isin(*allowed)).select(F.col("id").alias("node"))
            out = out.join(ends.join(fit, "node").select(F.col("start").alias("id")), "id", "left_semi")
        return out

    def total(self) -> int:
        return self.population().count()

    def run(self) -> DataFrame:
        """Keys, n, and sum_<key> if a sum was asked for; null where it leaves 64 bits."""
        out = self.population()
        if self.hops:
            if self.keys or self.havings or self.summed or self.through:
                raise ValueError("hops go with filters only")
            return hop_counts(self.graph, out, list(self.hops))
        for condition in self.havings:
            out = out.where(condition)
        for key in self.needed:
            out = out.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row has no {key} to group by"))).otherwise(F.col(key)))
        out = out.withColumns(dict(self.keys)) if self.keys else out
        names = [k for k, _ in self.keys]
        if self.through:
            types, direction, only = self.through
            edges = self.graph.rel_scan(types, direction).select(F.col("frm").alias("id"), F.col("to").alias("neighbor"))
            if only is not None:
                edges = edges.join(only.select(F.col("id").alias("neighbor")).distinct(), "neighbor", "left_semi")
            out, names = out.join(edges, "id"), [*names, "neighbor"]
            if self.summed:
                sums = out.select("id", *names, self.summed).distinct().groupBy(*names).agg(exact_sum(self.summed).alias(f"sum_{self.summed}"))
                return out.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).join(sums, names)
        aggregates = [F.count(F.lit(1)).alias("n"), *([exact_sum(self.summed).alias(f"sum_{self.summed}")] if self.summed else [])]
        return out.groupBy(*names).agg(*aggregates)


def aggregate(graph: PropertyGraph, *labels: str) -> Aggregate:
    return Aggregate(graph, labels)
