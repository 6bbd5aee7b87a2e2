"""Aggregates with the semantics of graph queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEAST, _MOST = -(2**63), 2**63 - 1


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c) -> Column:
    """Sum of integers: 0 of none, null where the true total leaves 64 bits, whatever the order."""
    total = F.sum(_col(c).cast("decimal(38,0)"))
    return F.when(F.count(_col(c)) == 0, F.lit(0).cast("long")).when(total.between(F.lit(_LEAST).cast("decimal(38,0)"), F.lit(_MOST).cast("decimal(38,0)")), total.cast("long"))


def float_sum(c) -> Column:
    """Sum of floats, 0 of none."""
    return F.coalesce(F.sum(_col(c).cast("double")), F.lit(0.0))


def average(c) -> Column:
    return F.avg(_col(c).cast("double"))


def _but_nan(c) -> Column:
    """The value, null for NaN. The test of the type is folded away: only floats are looked at."""
    c = _col(c)
    return F.when(F.typeof(c).isin("double", "float") & (c.cast("string") == "NaN"), F.lit(None)).otherwise(c)


def least(c) -> Column:
    """Minimum of values of any ordered type; NaN compares with nothing and is left out."""
    return F.min(_but_nan(c))


def most(c) -> Column:
    """Maximum, likewise."""
    return F.max(_but_nan(c))


def stddev_sample(c) -> Column:
    """0.0 of fewer than two values."""
    return F.coalesce(F.nanvl(F.stddev_samp(_col(c).cast("double")), F.lit(0.0)), F.lit(0.0))


def stddev_population(c) -> Column:
    """0.0 of none."""
    return F.coalesce(F.stddev_pop(_col(c).cast("double")), F.lit(0.0))


def percentile_continuous(c, p: float) -> Column:
    """Interpolated percentile; null of none and for a p outside 0..1."""
    return F.percentile(_col(c).cast("double"), p) if 0 <= p <= 1 else F.lit(None).cast("double")


def percentile_discrete(c, p: float) -> Column:
    """The value of nearest rank ceil(p n), the first for 0; null for a p outside 0..1.

    For a column's name the engine counts equal values; a computed Column has its
    group's values in one array, so give a name where groups are large.
    """
    if isinstance(c, str) and 0 <= p <= 1:
        return F.expr(f"percentile_disc({float(p)!r}) within group (order by `{c}`)")
    values = F.array_sort(F.collect_list(_col(c)))
    rank = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(float(p))).cast("int"))
    return F.try_element_at(values, rank) if 0 <= p <= 1 else F.lit(None)


def collect(c, order: list | None = None, distinct: bool = False) -> Column:
    """List of the values in the given order, nulls left out; without an order by value."""
    v = _col(c)
    if distinct:
        return F.array_sort(F.collect_set(v))
    if not order:
        return F.array_sort(F.collect_list(v))
    kept = F.collect_list(F.when(v.isNotNull(), F.struct(F.struct(*order).alias("o"), v.alias("v"))))
    return F.transform(F.array_sort(kept), lambda s: s["v"])
