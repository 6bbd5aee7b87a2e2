"""Queries that once left part of their work out, against plain loops or SQL on small inputs."""

import heapq
import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from meshlark import queries
from meshlark.operators import blocks, kernels, traversal, ways
from meshlark.sources.tables import NUMBER, SPACE


def dijkstra(ids, edges, source):
    out = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    best, heap = {}, [(0.0, source)] if source in ids else []
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for to, w in out.get(node, ()) if node in ids else ():
                heapq.heappush(heap, (cost + w, to))
    return {i: best.get(i, float("inf")) for i in ids}


def chain(folder, n):
    """Supplier 1 and parts and suppliers behind one another: a line of n relationships; the last line names an order and a part that no table holds."""
    c = duckdb.connect()
    lines = f"select r + 1 as l_orderkey, 1 + r // 2 as l_partkey, 1 + (r + 1) // 2 as l_suppkey, 1 as l_linenumber, (1 + r % 3)::double as l_quantity from range({n}) q(r)"
    made = {
        "lineitem": f"{lines} union all select 9000, 1, 1, 1, 1.0 union all select 9000, 500, 500, 1, 1.0",
        "orders": f"select r + 1 as o_orderkey, r + 1 as o_custkey from range({n}) q(r)",
        "customer": f"select r + 1 as c_custkey from range({n}) q(r)",
        "part": f"select r + 1 as p_partkey from range({n // 2}) q(r) union all select 500",
        "supplier": f"select r + 1 as s_suppkey from range({n // 2 + 1}) q(r)",
        "region": "select 0::int as r_regionkey", "nation": "select 0::int as n_nationkey", "events": "select 0 as event_id, 0 as user_id",
    }
    for name, sql in made.items():
        c.execute(f"copy (select columns(*) from ({sql})) to '{folder}/{name}.parquet' (format parquet)")
        c.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return c


def test_trade_sssp_goes_on_until_nothing_falls(spark, tmp_path):
    c = chain(tmp_path, 60)
    want = c.execute(queries.SQL["trade_sssp"]).fetchall()
    got = queries.QUERIES["trade_sssp"](spark, str(tmp_path)).collect()
    assert sorted((r.node, r.value) for r in got) == sorted(want)
    far = dict(want)[NUMBER["Part"] * SPACE + 30]  # 59 relationships away; orders give no shorter way
    assert far == sum(1 + r % 3 for r in range(59))
    assert [k for k, v in want if v == float("inf")] == [NUMBER["Part"] * SPACE + 500]  # only an order that no table holds leads there


@pytest.mark.parametrize("both", [False, True])
def test_distances_over_many_blocks(spark, both):
    deal = random.Random(7)
    ids = [i for i in range(300) if i % 29]
    edges = [(deal.randrange(300), deal.randrange(300), deal.choice([0.0, 0.1, 0.25, 3.7])) for _ in range(420)] + [(1000 + i, 1001 + i, 0.1) for i in range(4)] + [(1, 1000, 0.3)]
    ids += range(1000, 1005)
    frame = spark.createDataFrame(edges, "frm long, to long, weight double").repartition(3)
    nodes = spark.createDataFrame([(i,) for i in [*ids, 2, None]], "id long")
    every = edges + [(b, a, w) for a, b, w in edges] if both else edges
    want = dijkstra(set(ids), every, 1)
    found = {r.node: r.value for r in ways.distances(nodes, frame, 1, both, 120).collect()}
    assert {k: v for k, v in found.items() if k in want} == {k: v for k, v in want.items() if v < float("inf")}
    listed = traversal.sssp(nodes, frame, 1, both).collect()
    assert len(listed) == len(ids) + 2 and {r.node: r.value for r in listed if r.node is not None} == want
    assert not ways.distances(nodes, frame, 29, both, 120).count()  # the source is no node


def test_walks_over_middle_nodes_are_counted_not_listed(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b) for s in range(70) for a, b in ((s, 100 + s % 3), (100 + s % 3, s), (s, 110), (110, s))], "frm long, to long")
    assert "Generate" not in kernels.common_neighbor_counts(spark.range(70), edges)._jdf.queryExecution().executedPlan().toString()
    rows = pa.table({"ss": [[5, 2], [2], [7]], "ts": [[2, 5, 9], [9, 2], [9]]}).to_batches()
    for cells in (1 << 21, 4, 1):
        monkeypatch.setattr(kernels, "CELLS", cells)
        found = [tuple(r.values()) for b in kernels._counted(iter(rows)) for r in b.to_pylist()]
        assert sorted(found) == [(2, 2, 2), (2, 5, 1), (2, 9, 2), (5, 2, 1), (5, 5, 1), (5, 9, 1), (7, 9, 1)]


def test_trade_wcc_reads_each_relationship_once(spark, tmp_path, monkeypatch):
    chain(tmp_path, 10)
    seen = []
    monkeypatch.setattr(queries.analytics, "wcc", lambda nodes, edges: seen.append(edges.count()))
    queries.QUERIES["trade_wcc"](spark, str(tmp_path))
    assert seen == [10 + 2 * 12]


def test_blocks_of_edges_are_written_and_read_one_at_a_time(spark):
    near = spark.createDataFrame([(i, j) for i in range(400) for j in (i ^ 1, i ^ 2, i ^ 3)], "frm long, to long")
    found = blocks.cut(spark.range(400), near, 120)
    for table in (found.blocks, found.known):
        files = [pq.ParquetFile(f).metadata for f in Path(table._meshlark_path.removeprefix("file:")).glob("*.parquet")]
        assert sum(f.num_rows for f in files) == sum(f.num_row_groups for f in files) == 10
