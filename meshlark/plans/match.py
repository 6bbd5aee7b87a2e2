"""Graph patterns as DataFrame joins.

A `Bindings` is a table of matches: a node variable `a` is the column `a` (its
id), a relationship variable the column of its pos, and properties asked for
stand beside them as `a_name`. Every step adds joins and filters and leaves
their order and strategy to the optimizer.

Within one clause a relationship is not used twice: hops whose types can meet
must differ in their endpoint pair (directed as stored, undirected unordered).
`next_clause()` ends the scope; `repeatable=True` drops the rule.

Optional parts, subqueries and per-row calls are never run row by row: the
distinct values of the variables they depend on are matched once, and the
result is joined back, null-safely.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.graph import BOTH, IN, OUT, PropertyGraph, label_is
from meshlark.operators.cluster import is_empty, materialize
from meshlark.operators.traversal import reachable

Block = Callable[["Bindings"], "Bindings"]


def _pair(frm: str, to: str, direction: str) -> Column:
    a, b = F.col(frm), F.col(to)
    if direction == BOTH:
        return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return F.struct((a if direction == OUT else b).alias("a"), (b if direction == OUT else a).alias("b"))


def _meet(x: set | None, y: set | None) -> bool:
    return x is None or y is None or bool(x & y)


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that takes null keys as equal; the keys of `right` go."""
    named = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], how).drop(*[f"_on_{c}" for c in on])


class Bindings:
    """Matches so far. Steps return new Bindings.

    unique: a variable of which no two rows have the same value, if one is known;
    subqueries that depend on it need no DISTINCT.
    """

    def __init__(self, graph: PropertyGraph, df: DataFrame | None, hops: tuple = (), repeatable: bool = False, unique: str | None = None):
        self.graph, self.df, self.hops, self.repeatable, self.unique = graph, df, hops, repeatable, unique

    def _with(self, df: DataFrame, hops: tuple | None = None, unique: str | None = None) -> Bindings:
        return Bindings(self.graph, df, self.hops if hops is None else hops, self.repeatable, unique)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # Patterns

    def node(self, var: str, label: str | Column | None = None, where: Column | None = None, props: tuple[str, ...] = (), **values) -> Bindings:
        """Bind a node, or ask more of a bound one. `where` speaks of the node's properties by name."""
        found = self.graph.node_scan(label, where, **values)
        found = found.select(F.col("id").alias(var), *[F.col(p).alias(f"{var}_{p}") for p in props])
        if self.df is None:
            return self._with(found, unique=var)
        if var in self.df.columns:
            if not props and label is None and where is None and not values:
                return self
            return self._with(self.df.drop(*[f"{var}_{p}" for p in props]).join(found, var), unique=self.unique)
        return self._with(self.df.crossJoin(found))

    def props(self, var: str, *names: str) -> Bindings:
        """Properties of a bound node; a null node, from an optional part, has null properties."""
        found = self.graph.nodes.select(F.col("id").alias(var), *[F.col(p).alias(f"{var}_{p}") for p in names])
        return self._with(self.df.join(found, var, "left"), unique=self.unique)

    def hop(self, frm: str, types: str | list[str] | None, to: str, direction: str = OUT, rel: str | None = None, props: tuple[str, ...] = (), where: Column | None = None, label: str | Column | None = None, **values) -> Bindings:
        """One relationship from a bound node; to a new node or, closing a cycle, to a bound one. Parallel relationships give a row each."""
        kinds = None if types is None else {types} if isinstance(types, str) else set(types)
        rels = self.graph.rel_scan(types, direction, where)
        name = rel or f"_r{len(self.hops)}"
        rels = rels.select(F.col("frm").alias("_frm"), F.col("to").alias("_to"), F.col("pos").alias(name), *[F.col(p).alias(f"{name}_{p}") for p in props])
        on = F.col(frm) == F.col("_frm")
        if to in self.df.columns:
            out = self.df.join(rels, on & (F.col(to) == F.col("_to"))).drop("_frm", "_to")
        else:
            out = self.df.join(rels, on).drop("_frm").withColumnRenamed("_to", to)
        pair = f"_p{len(self.hops)}"
        out = out.withColumn(pair, _pair(frm, to, direction))
        out = self._distinct_from_earlier(out, kinds, pair, False)
        if rel is None:
            out = out.drop(name)
        found = self._with(out, (*self.hops, (kinds, pair, False)))
        return found.node(to, label, None, (), **values) if label is not None or values else found

    def _distinct_from_earlier(self, df: DataFrame, kinds: set | None, pair: str, many: bool) -> DataFrame:
        if not self.repeatable:
            for other, earlier, was_many in self.hops:
                if _meet(kinds, other):
                    if earlier is None:
                        raise ValueError("a reach keeps no relationships; for a later hop over its types use trail(low, None)")
                    a, b = F.col(pair), F.col(earlier)
                    clash = F.arrays_overlap(a, b) if many and was_many else F.array_contains(a, b) if many else F.array_contains(b, a) if was_many else a == b
                    df = df.where(~F.coalesce(clash, F.lit(False)))
        return df

    def trail(self, frm: str, types: str | list[str] | None, to: str, low: int, high: int | None, direction: str = OUT, each: Column | None = None, acyclic: bool = False, rels: str | None = None, path: str | None = None, rising: str | None = None) -> Bindings:
        """Every trail of low..high relationships: one row each, no endpoint pair twice in a trail. Without `high` it goes on until no trail can grow.

        each: what every relationship must keep to. acyclic: no node twice.
        rising: a relationship property that must not fall along the trail; both
        are checked as the trail grows. rels, path: columns for the positions
        and for a struct of nodes and positions.
        """
        if low < 0 or high is not None and high < max(low, 1):
            raise ValueError("a trail needs 0 <= low <= high")
        kinds = None if types is None else {types} if isinstance(types, str) else set(types)
        edges = self.graph.rel_scan(types, direction, each).select("frm", "to", "pos", *([F.col(rising).alias("_key")] if rising else []))
        start = self.df.withColumns({"_at": F.col(frm), "_pairs": F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), "_rels": F.expr("cast(array() as array<bigint>)"), "_nodes": F.array(frm)})
        level, found = start, [start] if low == 0 else []
        for depth in count(1) if high is None else range(1, high + 1):
            step = edges if depth == 1 or not rising else edges.withColumnRenamed("_key", "_next_key")
            level = level.join(step, F.col("_at") == F.col("frm"))
            pair = F.struct(F.least("frm", "to").alias("a"), F.greatest("frm", "to").alias("b")) if direction == BOTH else F.struct(F.col("frm").alias("a"), F.col("to").alias("b")) if direction == OUT else F.struct(F.col("to").alias("a"), F.col("frm").alias("b"))
            level = level.withColumn("_pair", pair).where(~F.array_contains("_pairs", F.col("_pair")))
            if acyclic:
                level = level.where(~F.array_contains("_nodes", F.col("to")))
            if rising and depth > 1:
                level = level.where(F.col("_next_key") >= F.col("_key")).drop("_key").withColumnRenamed("_next_key", "_key")
            level = level.withColumns({"_pairs": F.array_append("_pairs", F.col("_pair")), "_rels": F.array_append("_rels", F.col("pos")), "_nodes": F.array_append("_nodes", F.col("to")), "_at": F.col("to")}).drop("frm", "to", "pos", "_pair")
            if high is None:
                level = materialize(level, "trail", True)
                if is_empty(level):
                    break
            if depth >= low:
                found.append(level)
        out = reduce(lambda a, b: a.unionByName(b, True), found or [level])
        out = out.where(F.col(to) == F.col("_at")).drop("_at") if to in self.df.columns else out.withColumnRenamed("_at", to)
        if rels:
            out = out.withColumn(rels, F.col("_rels"))
        if path:
            out = out.withColumn(path, F.struct(F.col("_nodes").alias("nodes"), F.col("_rels").alias("rels")))
        name = f"_p{len(self.hops)}"
        out = out.withColumnRenamed("_pairs", name).drop("_rels", "_nodes", *(["_key"] if rising else []))
        return self._with(self._distinct_from_earlier(out, kinds, name, True), (*self.hops, (kinds, name, True)))

    def reach(self, frm: str, types: str | list[str] | None, to: str, low: int = 0, high: int | None = None, direction: str = OUT, each: Column | None = None) -> Bindings:
        """Distinct nodes that can be reached in low.. steps, one row for each: the quantifiers `*`, `+`, `{n,}`.

        Relationships that earlier hops of the clause have used are left out. A
        later hop over the same types needs the trails themselves: see `trail`.
        """
        kinds = None if types is None else {types} if isinstance(types, str) else set(types)
        taken = [] if self.repeatable else [F.col(p) if many else F.array(p) for other, p, many in self.hops if p and _meet(kinds, other)]
        done = (*self.hops, (kinds, None, False))
        if taken:
            edges = self.graph.rel_scan(types, direction, each).select("frm", "to")
            rows = self.df.withColumn("_from", F.struct(F.col(frm).alias("node"), F.concat(*taken).alias("taken")))
            starts = rows.where(F.col(frm).isNotNull()).select(F.col("_from").alias("start"), F.col(frm).alias("node")).distinct()
            ends = reachable(starts, edges, low, high, ~F.array_contains("start.taken", _pair("frm", "to", direction)))
            out = rows.join(ends.select(F.col("start").alias("_from"), F.col("node").alias("_end")), "_from").drop("_from")
            return self._with(out.where(F.col(to) == F.col("_end")).drop("_end") if to in self.df.columns else out.withColumnRenamed("_end", to), done)
        starts = self.df.select(F.col(frm).alias("start")).where("start is not null").distinct()
        edges = self.graph.rel_scan(types, direction, each).select("frm", "to")
        ends = reachable(starts, edges, low, high).select(F.col("start").alias("_start"), F.col("node").alias("_end"))
        on = F.col(frm) == F.col("_start")
        if to in self.df.columns:
            return self._with(self.df.join(ends, on & (F.col(to) == F.col("_end"))).drop("_start", "_end"), done)
        return self._with(self.df.join(ends, on).drop("_start").withColumnRenamed("_end", to), done)

    def reach_count(self, name: str, frm: str, types: str | list[str] | None, low: int = 0, high: int | None = None, direction: str = OUT, each: Column | None = None, label: str | Column | None = None) -> Bindings:
        """A column with the number of nodes, of a label if one is given, that `reach` would list for the row; 0 for a null node.

        One step (low = high = 1) is counted once a start and lessened by the
        row's own relationships, which are looked up: no pair of row and node is
        listed. Longer reaches out of relationships used before are listed a
        distinct start and set of those, as what they leave out may cut off any part.
        """
        kinds = None if types is None else {types} if isinstance(types, str) else set(types)
        taken = [] if self.repeatable else [F.col(p) if many else F.array(p) for other, p, many in self.hops if p and _meet(kinds, other)]
        done = (*self.hops, (kinds, None, False))
        edges = self.graph.rel_scan(types, direction, each).select("frm", "to")
        one = (low, high) == (1, 1)
        used = F.concat(*taken) if taken else F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
        rows = self.df.withColumn("_from", F.struct(F.col(frm).alias("node"), used.alias("taken")))
        keys = rows.where(F.col(frm).isNotNull()).select("_from").distinct()
        fits = self.graph.node_scan(label).select(F.col("id").alias("_end")).distinct() if label is not None else None

        def fitting(ends: DataFrame) -> DataFrame:
            return ends if fits is None else ends.join(fits, "_end", "left_semi")

        if one or not taken:
            starts = keys.select(F.col("_from.node").alias("start")).distinct()
            if one:
                ends = edges.select(F.col("frm").alias("start"), F.col("to").alias("_end")).distinct().join(starts, "start", "left_semi")
            else:
                ends = reachable(starts, edges, low, high).select("start", F.col("node").alias("_end"))
            ends = fitting(ends)
            counts = keys.join(ends.groupBy("start").agg(F.count(F.lit(1)).alias("_n")), F.col("_from.node") == F.col("start")).select("_from", "_n")
            if taken:
                here, t = F.col("_from.node"), F.col("_t")
                out = F.when(t["a"] == here, t["b"])
                back = F.when(t["b"] == here, t["a"])
                other = {OUT: out, IN: back, BOTH: F.coalesce(out, back)}[direction]
                own = keys.select("_from", F.explode("_from.taken").alias("_t")).select("_from", here.alias("start"), other.alias("_end")).where("_end is not null").distinct()
                lost = own.join(ends, ["start", "_end"]).groupBy("_from").agg(F.count(F.lit(1)).alias("_lost"))
                counts = counts.join(lost, "_from", "left").select("_from", (F.col("_n") - F.coalesce("_lost", F.lit(0))).alias("_n"))
        else:
            starts = keys.select(F.col("_from").alias("start"), F.col("_from.node").alias("node"))
            ends = reachable(starts, edges, low, high, ~F.array_contains("start.taken", _pair("frm", "to", direction)))
            counts = fitting(ends.select(F.col("start").alias("_from"), F.col("node").alias("_end"))).groupBy("_from").agg(F.count(F.lit(1)).alias("_n"))
        out = rows.join(counts, "_from", "left").withColumn(name, F.coalesce("_n", F.lit(0).cast("long"))).drop("_from", "_n")
        return self._with(out, done, self.unique)

    # Clauses

    def where(self, condition: Column) -> Bindings:
        """Rows for which the condition holds; null does not."""
        return self._with(self.df.where(condition), unique=self.unique)

    def let(self, **columns: Column) -> Bindings:
        """New columns; all see the columns before."""
        return self._with(self.df.withColumns(columns), unique=None if self.unique in columns else self.unique)

    def unwind(self, var: str, values: Column, scalar: bool = False) -> Bindings:
        """A row for each element; none for a null or empty list. A scalar is one element, unless null."""
        if scalar:
            return self._with(self.df.withColumn(var, values).where(F.col(var).isNotNull()))
        return self._with(self.df.withColumn("_list", values).withColumn(var, F.explode("_list")).drop("_list"))

    def next_clause(self) -> Bindings:
        """From here on relationships may be used again."""
        return self._with(self.df.drop(*[p for _, p, _ in self.hops if p]), ())

    def _keys(self, on: list[str], repeatable: bool | None = None) -> Bindings:
        keys = self.df.select(*on)
        return Bindings(self.graph, keys if self.unique in on else keys.distinct(), (), self.repeatable if repeatable is None else repeatable)

    def optional(self, on: list[str], block: Block) -> Bindings:
        """Left join of what `block` makes of the distinct values of `on`; without a match its variables are null. A condition of the block belongs inside it."""
        inner = block(self._keys([*on])).next_clause().df
        return self._with(null_safe(self.df, inner, on, "left"))

    def exists(self, name: str, on: list[str], block: Block) -> Bindings:
        """A boolean column, never null: it can stand under NOT, OR and CASE. A null node matches nothing."""
        inner = block(self._keys(on, True)).df.select(*on).distinct().withColumn("_there", F.lit(True))
        out = null_safe(self.df, inner, on, "left")
        return self._with(out.withColumn(name, F.coalesce("_there", F.lit(False))).drop("_there"), unique=self.unique)

    def where_exists(self, on: list[str], block: Block, negate: bool = False) -> Bindings:
        """Semi-join, or anti-join, with what the block matches."""
        inner = block(self._keys(on, True)).df.select(*on).distinct()
        return self._with(null_safe_semi(self.df, inner, on, "left_anti" if negate else "left_semi"), unique=self.unique)

    def count(self, name: str, on: list[str], block: Block) -> Bindings:
        """Number of matches of the block, 0 if there are none."""
        inner = block(self._keys(on, True)).df
        inner = inner.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        return self._with(null_safe(self.df, inner, on, "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n"), unique=self.unique)

    def collect(self, name: str, on: list[str], block: Block, value: Column, order: list[Column] | None = None) -> Bindings:
        """List of a value over the block's matches, nulls kept, in the given order (else by value)."""
        inner = block(self._keys(on, True)).df
        inner = inner.withColumn("_v", value).withColumn("_o", F.struct(*(order or [F.col("_v")])))
        listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_v").alias("v")))), lambda s: s["v"])
        inner = inner.groupBy(*on).agg(listed.alias("_l"))
        kind = inner.schema["_l"].dataType.simpleString()
        return self._with(null_safe(self.df, inner, on, "left").withColumn(name, F.coalesce("_l", F.expr(f"cast(array() as {kind})"))).drop("_l"), unique=self.unique)

    def call(self, on: list[str], block: Callable[[Bindings], DataFrame]) -> Bindings:
        """Per-row subquery: `block` gets the distinct values of `on` and returns a frame with them and new columns; rows without a result go.

        With an empty `on` the subquery runs once and is crossed with all rows.
        """
        if not on:
            return self._with(self.df.crossJoin(block(Bindings(self.graph, None))))
        inner = block(self._keys(on))
        clash = [c for c in inner.columns if c not in on and c in self.df.columns]
        if clash:
            raise ValueError(f"already bound: {clash}")
        return self._with(null_safe(self.df, inner, on, "inner"))

    def labelled(self, var: str, name: str, label: str | Column) -> Bindings:
        """A boolean column: whether a bound node keeps to a label expression; null for a null node."""
        found = self.graph.nodes.select(F.col("id").alias(var), label_is(label).alias(name))
        return self._with(self.df.join(found, var, "left"))

    def select(self, *columns: str | Column) -> DataFrame:
        return self.df.select(*columns)

    def table(self) -> DataFrame:
        """All variables, without what only the uniqueness rule uses."""
        return self.next_clause().df


def null_safe_semi(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    named = right.select(*[F.col(c).alias(f"_on_{c}") for c in on])
    return left.join(named, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on], how)


def match(graph: PropertyGraph, repeatable: bool = False) -> Bindings:
    """An empty pattern to start from."""
    return Bindings(graph, None, (), repeatable)


def over(graph: PropertyGraph, df: DataFrame, repeatable: bool = False) -> Bindings:
    """A pattern that goes on from a table of bindings."""
    return Bindings(graph, df, (), repeatable)


__all__ = ["BOTH", "IN", "OUT", "Bindings", "match", "null_safe", "over"]
