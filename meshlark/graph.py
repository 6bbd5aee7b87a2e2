"""The property graph: a table of nodes and a table of relationships.

nodes(id long, labels array<string>, one column a property), rels(pos long, src
long, dst long, type string, one column a property). A property that is absent
is null; an empty string counts as absent. `pos` tells parallel relationships
apart. Frames may be unions with literal labels and types: a scan of one label
then reads that branch alone, as the filter on a literal folds away.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.operators.cluster import materialize
from meshlark.operators.ranks import sharded_running

OUT, IN, BOTH = "out", "in", "both"
NODE_COLUMNS, REL_COLUMNS = ("id", "labels"), ("pos", "src", "dst", "type")


class SchemaError(ValueError):
    """A label, type or property that the graph does not have."""


def _blank_is_absent(df: DataFrame, but: tuple[str, ...]) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in but]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts}) if texts else df


def label_is(expression: str | Column | None, labels: Column | str = "labels") -> Column:
    """A label predicate: a name, `%` for any label, or a Column built of `has_label`."""
    if isinstance(expression, Column):
        return expression
    if expression is None:
        return F.lit(True)
    return F.size(labels) > 0 if expression == "%" else F.array_contains(labels, expression)


def has_label(name: str) -> Column:
    """For label expressions: has_label("A") & ~has_label("B") | has_label("C")."""
    return label_is(name)


class PropertyGraph:
    """Immutable; every edit gives a new graph over new frames."""

    def __init__(self, nodes: DataFrame, rels: DataFrame, version: str | None = None):
        self.nodes, self.rels, self.version = nodes, rels, version

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @classmethod
    def from_frames(cls, nodes: DataFrame, rels: DataFrame, version: str | None = None) -> PropertyGraph:
        """From plain frames: labels become sorted, empty strings absent, and `pos` is dealt by (src, staging order) where it is missing.

        Dealt positions are written to the shared folder: they stay what they are however often the graph is read.
        """
        nodes = _blank_is_absent(nodes, NODE_COLUMNS).withColumn("labels", F.array_sort("labels"))
        rels = _blank_is_absent(rels, REL_COLUMNS)
        if "pos" not in rels.columns:
            staged = rels.withColumn("_staged", F.monotonically_increasing_id()).withColumn("_all", F.lit(0))
            bounds = F.floor(F.col("src") / 4096)
            rels = sharded_running(staged.withColumn("_shard", bounds), ["_all"], "_shard", [F.col("src"), F.col("_staged")], F.lit(1), "pos").drop("_staged", "_all", "_shard")
            rels = materialize(rels, "staged-rels")
        return cls(nodes, rels, version)

    @classmethod
    def from_parts(cls, nodes: list[tuple[str | list[str], DataFrame]], rels: list[tuple[str, DataFrame]], version: str | None = None, blanks: bool = True) -> PropertyGraph:
        """From a frame for each label (id, properties) and each type (pos, src, dst, properties); names are unioned.

        blanks=False takes texts as they are: equality on them then reaches the scan.
        """
        labelled = [df.withColumn("labels", F.array(*[F.lit(x) for x in sorted([names] if isinstance(names, str) else names)])) for names, df in nodes]
        typed = [df.withColumn("type", F.lit(name)) for name, df in rels]
        union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        nodes_, rels_ = union(labelled), union(typed)
        return cls(_blank_is_absent(nodes_, NODE_COLUMNS), _blank_is_absent(rels_, REL_COLUMNS), version) if blanks else cls(nodes_, rels_, version)

    # Scans

    def node_scan(self, label: str | Column | None = None, where: Column | None = None, **props) -> DataFrame:
        """Nodes of a label (or label expression) with the given property values; a node id is `id=`."""
        out = self.nodes.where(label_is(label)) if label is not None else self.nodes
        for key, value in props.items():
            out = out.where(F.col(self._key(key, self.nodes)) == F.lit(value))
        return out.where(where) if where is not None else out

    def rel_scan(self, types: str | list[str] | None = None, direction: str = OUT, where: Column | None = None) -> DataFrame:
        """Relationships as (frm, to, ...): out as stored, in swapped, both the one after the other, so a self-loop comes twice."""
        rels = self.rels
        if types is not None:
            rels = rels.where(F.col("type").isin([types] if isinstance(types, str) else list(types)))
        if where is not None:
            rels = rels.where(where)
        out = rels.withColumns({"frm": F.col("src"), "to": F.col("dst")})
        back = rels.withColumns({"frm": F.col("dst"), "to": F.col("src")})
        return {OUT: out, IN: back}[direction] if direction != BOTH else out.unionAll(back)

    @staticmethod
    def _key(key: str, df: DataFrame) -> str:
        if key not in df.columns:
            raise SchemaError(f"no property {key}")
        return key

    def find(self, key: str, value, label: str | None = None) -> DataFrame:
        """Nodes with a property value; without a label only the least id, as a lookup by a unique key gives it."""
        found = self.node_scan(label, **{key: value})
        return found if label is not None else found.orderBy("id").limit(1)

    def range_scan(self, label: str, key: str, low=None, high=None, with_low: bool = True, with_high: bool = True) -> DataFrame:
        """Nodes whose property lies in a range; both bounds reach the scan."""
        c, out = F.col(self._key(key, self.nodes)), self.node_scan(label)
        if low is not None:
            out = out.where(c >= low if with_low else c > low)
        if high is not None:
            out = out.where(c <= high if with_high else c < high)
        return out

    # What the graph is made of

    def labels(self) -> DataFrame:
        """label, n."""
        return self.nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def rel_types(self) -> DataFrame:
        """type, n, n_sources, n_targets."""
        return self.rels.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))

    def property_keys(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in NODE_COLUMNS]

    def node_count(self) -> int:
        return self.nodes.count()

    def rel_count(self, types: str | list[str] | None = None) -> int:
        return self.rel_scan(types).count()

    def degrees(self, types: str | list[str] | None = None, direction: str = OUT) -> DataFrame:
        """id, degree; nodes without relationships have 0."""
        n = self.rel_scan(types, direction).groupBy(F.col("frm").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def average_degree(self, types: str | list[str] | None = None, direction: str = OUT, label: str | None = None) -> DataFrame:
        """avg_degree over the nodes of a label."""
        nodes = self.node_scan(label).select("id")
        n = self.rel_scan(types, direction).select(F.col("frm").alias("id")).join(nodes, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
        return n.crossJoin(nodes.agg(F.count(F.lit(1)).alias("m"))).select((F.col("n") / F.nullif(F.col("m"), F.lit(0))).alias("avg_degree"))

    # Edits

    def _removed(self, nodes: DataFrame, rels: DataFrame) -> PropertyGraph:
        return PropertyGraph(nodes, rels, self.version)

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Without the nodes of `ids` (id) and the relationships at them."""
        gone = ids.select("id").distinct()
        rels = self.rels.join(gone, self.rels.src == gone.id, "left_anti")
        again = ids.select(F.col("id").alias("gone")).distinct()
        return self._removed(self.nodes.join(gone, "id", "left_anti"), rels.join(again, F.col("dst") == F.col("gone"), "left_anti"))

    def remove_rels(self, positions: DataFrame) -> PropertyGraph:
        """Without the relationships of `positions` (pos)."""
        return self._removed(self.nodes, self.rels.join(positions.select("pos").distinct(), "pos", "left_anti"))

    def add_nodes(self, nodes: DataFrame) -> PropertyGraph:
        """With more nodes; a node added under the id of a removed one is a new node."""
        return self._removed(self.nodes.unionByName(_blank_is_absent(nodes, NODE_COLUMNS), allowMissingColumns=True), self.rels)

    def add_rels(self, rels: DataFrame) -> PropertyGraph:
        return self._removed(self.nodes, self.rels.unionByName(_blank_is_absent(rels, REL_COLUMNS), allowMissingColumns=True))

    @staticmethod
    def _updated(df: DataFrame, by: str, key: str, writes: DataFrame) -> DataFrame:
        last = Window.partitionBy(by).orderBy(F.col("seq").desc())
        final = writes.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").select(by, F.col("value").alias("_new"), F.lit(True).alias("_written"))
        old = F.col(key) if key in df.columns else F.lit(None)
        return df.join(final, by, "left").withColumn(key, F.when(F.col("_written"), F.col("_new")).otherwise(old)).drop("_new", "_written")

    def update_property(self, key: str, writes: DataFrame) -> PropertyGraph:
        """Node property `key` from writes (id, value, seq): the write with the highest seq wins; a null value removes."""
        return self._removed(_blank_is_absent(self._updated(self.nodes, "id", key, writes), NODE_COLUMNS), self.rels)

    def update_rel_property(self, key: str, writes: DataFrame) -> PropertyGraph:
        """Relationship property `key` from writes (pos, value, seq), likewise."""
        return self._removed(self.nodes, _blank_is_absent(self._updated(self.rels, "pos", key, writes), REL_COLUMNS))
