"""Set operations over results, left to right and of equal precedence, and plan reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _alike(a: DataFrame, b: DataFrame) -> None:
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    _alike(a, b)
    return a.unionAll(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    _alike(a, b)
    return a.unionAll(b).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b does not have."""
    _alike(a, b)
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    _alike(a, b)
    return a.intersect(b)


def explain(df: DataFrame) -> DataFrame:
    """The formatted plan as one column `plan`, a row a line."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return df.sparkSession.createDataFrame([(x,) for x in text.split("\n")], "plan string")


def profile(df: DataFrame) -> dict[str, int]:
    """Run the query for its effort alone: rows that it returns."""
    seen = Observation("profile")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return seen.get


def profile_operators(df: DataFrame) -> DataFrame:
    """Run the query for its effort alone: step, depth, operator, rows, in the order of the plan; rows is null where an operator does not count them."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    found: list[tuple] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        if name.endswith("QueryStage"):
            return walk(node.plan(), depth)
        if name != "InputAdapter" and not name.startswith("WholeStageCodegen"):
            rows = node.metrics().get("numOutputRows")
            found.append((len(found), depth, name, rows.get().value() if rows.isDefined() else None))
            depth += 1
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), depth)

    walk(execution.executedPlan(), 0)
    return df.sparkSession.createDataFrame(found, "step int, depth int, operator string, rows long")
