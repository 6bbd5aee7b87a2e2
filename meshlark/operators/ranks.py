"""Dense row numbers and running sums inside groups of any size.

A plain window over a group puts the whole group in one task. Here each group
is cut into shards that follow the wanted order; a small table of counts per
(group, shard) gives each shard its offset, and only rows of one shard meet in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharded_running(df: DataFrame, group: list[str], shard: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Add `out`: the sum of `amount` over the rows of the group that come before.

    `shard` must not decrease along `order`; `amount` must not be null. With
    `F.lit(1)` as the amount `out` is the row's index from 0.
    """
    keys = [*group, shard]
    df = df.withColumn("_amount", amount.cast("long"))
    totals = df.groupBy(*keys).agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_local", F.coalesce(F.sum("_amount").over(local), F.lit(0)))
    return inner.join(starts, keys).withColumn(out, F.col("_start") + F.col("_local")).drop("_amount", "_local", "_start")
