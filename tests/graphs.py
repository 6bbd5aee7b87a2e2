"""Small graphs with known answers."""

from meshlark.graph import PropertyGraph


def social(spark):
    people = [(0, "Alice", 30, "NYC"), (1, "Bob", 35, None), (2, "Carol", 40, "LA"), (3, "Dave", 25, "")]
    nodes = [(i, ["Person"], n, a, c) for i, n, a, c in people] + [(4, ["Company"], "Acme", None, None), (5, ["Company"], "Globex", None, None)]
    rels = [(a, b, "KNOWS") for a, b in ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 1), (3, 0))] + [(a, b, "WORKS_AT") for a, b in ((0, 4), (1, 4), (2, 5))]
    return PropertyGraph.from_frames(spark.createDataFrame(nodes, "id long, labels array<string>, name string, age long, city string"), spark.createDataFrame(rels, "src long, dst long, type string"))


def plain(spark, n, edges, columns="src long, dst long", kind="E"):
    nodes = spark.createDataFrame([(i, ["N"], f"n{i}") for i in range(n)], "id long, labels array<string>, name string")
    rels = spark.createDataFrame([(*e, kind) for e in edges], f"{columns}, type string")
    return PropertyGraph.from_frames(nodes, rels)


def parallel(spark):
    return plain(spark, 2, [(0, 1), (0, 1)])


def flow(spark):
    """s 0, a 1, b 2, c 3, d 4."""
    return plain(spark, 5, [(0, 1, 5.0, 100), (0, 2, 3.0, 200), (1, 3, 7.0, None), (2, 3, 2.0, None), (0, 4, 0.0, None), (2, 0, 4.0, None)], "src long, dst long, amt double, ts long", "flow")
