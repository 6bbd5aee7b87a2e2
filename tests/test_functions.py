"""Expressions and aggregates where Spark's defaults differ."""

import pytest
from pyspark.sql import functions as F

from meshlark.functions import aggregates as A
from meshlark.functions import scalar as S
from meshlark.functions import temporal as T

BIG, SMALL = 2**63 - 1, -(2**63)


def lit(x):
    return F.lit(x)


def cases():
    NULL, L, WITH_NULL = F.lit(None), F.array(*[F.lit(x) for x in (10, 20, 30)]), F.array(F.lit(1), F.lit(None).cast("int"))
    return [
        (S.compare("=", lit(float("nan")), lit(1.0), floats=True), None),
        (S.compare("<", lit(1), lit(2)), True),
        (S.int_divide(7, -2), -3), (S.int_divide(1, 0), None), (S.int_divide(SMALL, -1), None), (S.int_divide(BIG, 1), BIG),
        (S.modulo(-7, 3), -1), (S.modulo(1, 0), None), (S.add(lit(BIG), lit(1)), None), (S.divide(1, 0), None), (S.divide(1, 4), 0.25),
        (S.negate(lit(SMALL)), None), (S.absolute(lit(SMALL)), None), (S.absolute(lit(-3)), 3), (S.ceiling(1.2), 2.0), (S.round_half_away(-2.5), -3.0), (S.sign(-4.2), -1),
        (S.guarded("asin", 2.0), None), (S.guarded("exp", 1000.0), None), (S.guarded("ln", 0.0), None), (S.guarded("sin", 0.0), 0.0),
        (S.left(lit("abc"), -1), None), (S.left(lit("abc"), 2), "ab"), (S.right(lit("abc"), 2), "bc"), (S.right(lit("abc"), 0), ""), (S.right(lit("abc"), -1), None),
        (S.substring(lit("abcdef"), 2, 3), "cde"), (S.substring(lit("abc"), 9), ""), (S.substring(lit("abc"), -1), None), (S.substring(lit("abc"), 1), "bc"),
        (S.trim(lit("\t  x　")), "x"), (S.trim_left(lit(" \tx ")), "x "), (S.trim_right(lit("x　 \n")), "x　"),
        (S.normalize(lit("é")), "é"), (S.normalize(lit("x"), "ABC"), None), (S.is_normalized(lit("é")), False),
        (S.item(L, 0), 10), (S.item(L, -1), 30), (S.item(L, 3), None), (S.item(L, -4), None),
        (S.items(L, 1), [20, 30]), (S.items(L, None, 2), [10, 20]), (S.items(L, -2, 99), [20, 30]), (S.items(L, 2, 1), []),
        (S.number_range(1, 5, 2), [1, 3, 5]), (S.number_range(5, 1), []), (S.number_range(5, 1, -2), [5, 3, 1]), (S.number_range(1, 5, 0), None),
        (S.head(L), 10), (S.last(L), 30), (S.tail(L), [20, 30]), (S.tail(F.expr("cast(array() as array<int>)")), []),
        (S.is_in(3, WITH_NULL), None), (S.is_in(1, WITH_NULL), True), (S.is_in(3, [1, 2]), False),
        (S.list_equal(WITH_NULL, WITH_NULL), None), (S.list_equal(L, L), True), (S.list_equal(L, F.array(lit(1))), False),
        (S.single(L, lambda x: x > 20), True), (S.single(L, lambda x: x > 5), False), (S.single(WITH_NULL, lambda x: x == 1), None), (S.all_of(WITH_NULL, lambda x: x == 1), None), (S.none_of(L, lambda x: x > 99), True),
        (S.equatable("<>", F.struct(lit(1)), F.struct(lit(2))), None), (S.equatable("=", F.struct(lit(1)), F.struct(lit(1))), True),
        (S.is_true(NULL.cast("boolean")), False), (S.is_false(lit(False)), True), (S.xor(lit(True), NULL.cast("boolean")), None),
        (S.to_integer(lit(" 12.9 "), text=True), 12), (S.to_integer(lit("x"), text=True), None), (S.to_float(lit(" 1.5"), text=True), 1.5), (S.to_boolean(lit(" TRUE ")), True), (S.to_boolean(lit("yes")), None),
        (S.float_text(1.0), "1.0"), (S.float_text(1.5e10), "15000000000.0"), (S.float_text(1.25e-5), "0.0000125"), (S.float_text(-1e22), "-10000000000000000000000.0"), (S.float_text(1.2345678901234567e10), "12345678901.234568"), (S.float_text(float("inf")), "inf"), (S.float_text(float("nan")), "NaN"),
        (T.parse_iso(lit("2020-02-29T12:30:05.5+02:00")), 1582979405500), (T.parse_iso(lit("2020-02-29")), 1582934400000), (T.parse_iso(lit("2020-13-01")), None), (T.parse_iso(lit("x")), None),
        (T.render_datetime(lit(1582979405500)), "2020-02-29T12:30:05.500"), (T.render_datetime(lit(-1)), "1969-12-31T23:59:59.999"), (T.render_date(lit(0)), "1970-01-01"),
        (T.component(lit(-1), "second"), 59), (T.component(lit(1268638245000), "month"), 3), (T.date_of(lit(-1)), -86400000),
        (T.plus(T.parse_iso(lit("2020-01-31")), T.duration(months=1)), 1582934400000), (T.duration_component(T.parse_duration(lit("P1Y2M10DT2.5S")), "months"), 14),
        (T.duration_component(T.parse_duration(lit("-P3W")), "days"), -21), (T.duration_component(T.parse_duration(lit("PT90M")), "hours"), 1), (T.duration_component(T.duration(milliseconds=lit(-1500)), "seconds"), -1),
        (T.parse_iso(lit("-0044-03-15")), -63549360000000), (T.parse_iso(lit("12345-06-07T08:09:10")), 327416976550000), (T.render_datetime(T.parse_iso(lit("123456-12-31T23:59:59.001"))), "123456-12-31T23:59:59.001"), (T.render_date(T.parse_iso(lit("-0044-03-15"))), "-044-03-15"),
        (T.from_parts(300_000_000, 1, 1), None), (T.from_parts(300_000_001, 1, 1), None), (T.component(T.from_parts(200_000_000, 2, 29), "year"), 200_000_000), (T.component(T.from_parts(-200_000_000, 2, 29), "day"), 29),
        (T.render_date(T.plus(T.parse_iso(lit("9999-12-31")), T.duration(months=2))), "10000-02-29"), (T.render_date(T.plus(T.parse_iso(lit("2020-02-29")), T.duration(years=-800))), "1220-02-29"), (T.render_date(F.lit(None).cast("long")), None),
        (T.add_durations(T.duration(months=1), T.duration(days=2)), (1, 2, 0)), (T.subtract_durations(T.duration(months=1), T.duration(days=2)), (1, -2, 0)), (T.scale_duration(T.duration(months=1, days=-2), 3), (3, -6, 0)),
        (T.divide_duration(T.duration(months=7, days=-7, milliseconds=5), 2), (3, -3, 2)), (T.divide_duration(T.duration(days=1), 0), None), (T.scale_duration(T.duration(days=lit(BIG)), 2), None),
        (S.is_typed(lit(1), "INTEGER"), True), (S.is_typed(lit(1.5), "integer"), False), (S.is_typed(lit(1.5), "float"), True), (S.is_typed(L, "list"), True), (S.is_typed(lit("x"), "string"), True), (S.is_typed(NULL.cast("int"), "integer"), False),
        (S.element_id(lit(7)), "7"), (S.element_id(lit(7), rel=True), "r7"),
        (T.parse_duration(lit("P")).isNull(), True), (T.duration_component(T.between(lit(5), lit(2)), "milliseconds"), 3),
    ]

def test_expressions(spark):
    CASES = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(CASES)]).first()
    wrong = [(i, str(CASES[i][0])[:80], got, want) for i, (got, (_, want)) in enumerate(zip(row, CASES, strict=True)) if (tuple(got) if isinstance(want, tuple) and got is not None else got) != want]
    assert not wrong


def test_aggregates(spark):
    df = spark.createDataFrame([(1, BIG, 1.0), (1, 1, 2.0), (1, -1, float("nan")), (2, BIG, 3.0), (2, 1, None), (3, None, None)], "g int, i long, f double")
    got = {r.g: r for r in df.groupBy("g").agg(A.exact_sum("i").alias("s"), A.stddev_sample("f").alias("d"), A.least("f").alias("lo"), A.percentile_discrete("i", 0.5).alias("p"), A.collect("i").alias("l"), A.percentile_continuous("f", 2).alias("q"), A.float_sum("f").alias("fs")).collect()}
    assert got[1].s == BIG and got[2].s is None and got[3].s == 0
    assert got[2].d == 0.0 and got[3].d == 0.0 and got[1].lo == 1.0 and got[1].p == 1 and got[3].p is None and got[3].l == [] and got[2].q is None and got[3].fs == 0.0


@pytest.mark.parametrize("p, want", [(0.0, 1), (0.25, 1), (0.5, 2), (1.0, 4)])
def test_discrete_percentile(spark, p, want):
    df = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "x long")
    assert df.agg(A.percentile_discrete("x", p).alias("p")).first().p == want


def test_order_of_nulls(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in df.orderBy(S.ascending("x")).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(S.descending("x")).collect()] == [None, 2, 1]
