"""Mixing: targets against stepwise resharing, and what a mix must keep to."""

import pytest
from pyspark.sql import functions as F

from meshlark.llm import mixing


def reshared(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by handing out what capped sources leave over, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), list(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.remove(s)
    return target


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 5, "b": 1000, "c": 70, "d": 1, None: 400},
    {f"s{i}": 50 + 37 * i % 91 for i in range(20)},
    {"a": 0, "b": 10},
    {"one": 7},
    {"a": 0},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_equal_stepwise_resharing(spark, sizes):
    docs = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(docs).collect()}
    assert got == pytest.approx(reshared(sizes), abs=1e-6)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_mix_takes_near_targets_and_never_more_than_twice(spark):
    rows = [(i, "w " * (1 + i * 37 % 900), f"s{i % 4}" if i % 3 else "hot", "clash") for i in range(600)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken, target = by.get(r.source, (0, r.target))
        by[r.source] = taken + r.taken, target
    for taken, target in by.values():
        assert abs(taken - target) <= 2 * mixing.BLOCK_TOKENS
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c", None, None), (1, "a b c", None, None), (None, None, "x", None), (2, "", "x", None), (3, "one\ttwo still", "", None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in mixing.mix(documents(spark, rows)).collect())
    assert got == [(False, 1, 3), (False, 1, 3), (False, 2, 0), (False, 3, 2), (True, 0, 0)]
    assert mixing.mix(documents(spark, [])).count() == 0


def test_reruns_agree_with_repeated_and_null_ids_in_any_order_and_partitions(spark):
    rows = [(7 if i % 2 else None, "w " * (1 + i * 53 % 400) + str(i % 30), "a" if i % 5 else None, None) for i in range(120)]
    got = sorted(map(repr, mixing.mix(documents(spark, rows)).collect()))
    assert len(got) == 120
    for parts, order in ((1, rows[::-1]), (7, rows[60:] + rows[:60])):
        again = mixing.mix(documents(spark, order).repartition(parts)).collect()
        assert sorted(map(repr, again)) == got


def test_golden_points_are_exact(spark):
    slots = [0, 1, 65535, 65536, 2**31, 2**33 + 5]
    rows = spark.createDataFrame([(t,) for t in slots], "t long").select("t", mixing.golden(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == {t: t * mixing.GOLDEN % 2**32 for t in slots}
