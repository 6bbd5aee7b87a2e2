"""Joins on keys of which one may hold any part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one in HOT of all rows are hot: there are fewer than HOT of them.
HOT = 1000


def join_hot(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of `many` with `one`, which has a row a key and says in `n` how many of the `total` rows of `many` hold it.

    The rows of `one` for hot keys, fewer than HOT, are broadcast, so the rows
    of such a key stay where they are; all others are shuffled. `n` is left out.
    """
    most = max(1, total // HOT)
    hot, rest = one.where(F.col("n") > most).drop("n"), one.where(F.col("n") <= most).drop("n")
    stay = many.join(F.broadcast(hot), key)
    move = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return stay.unionByName(move)
