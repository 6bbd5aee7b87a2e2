"""Benchmark graphs as text: `<name>.v` with an id a line, `<name>.e` with `src dst [weight]`, `<name>.properties` with parameters."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshlark.graph import PropertyGraph
from meshlark.operators.cluster import path_exists

#: Ends of keys, and how their values are read.
_READ = {
    "directed": lambda v: v.lower() == "true",
    "algorithms": lambda v: [a.strip().lower() for a in v.split(",") if a.strip()],
    "bfs.source-vertex": int,
    "sssp.source-vertex": int,
    "pr.damping-factor": float,
    "pr.num-iterations": int,
    "cdlp.max-iterations": int,
}


def read_graph(spark: SparkSession, base: str, weighted: bool = False) -> PropertyGraph:
    """Nodes of label V, relationships of type e, with `weight` if the file has it."""
    nodes = spark.read.schema("id long").csv(f"{base}.v", sep=" ").withColumn("labels", F.array(F.lit("V")))
    schema = "src long, dst long" + ", weight double" * weighted
    rels = spark.read.schema(schema).csv(f"{base}.e", sep=" ").withColumn("type", F.lit("e"))
    return PropertyGraph.from_frames(nodes, rels)


def read_parameters(spark: SparkSession, base: str) -> dict:
    """Parameters by the end of their key, such as `bfs.source-vertex`; none without a file, and without those whose value cannot be read."""
    path = f"{base}.properties"
    if not path_exists(spark, path):
        return {}
    line = F.trim("value")
    wanted = spark.read.text(path).where(~line.startswith("#") & line.rlike(rf"\.({'|'.join(_READ)})\s*="))
    found = {}
    for (text,) in wanted.collect():  # a line for each parameter
        key, value = (part.strip() for part in text.split("=", 1))
        name = next(end for end in _READ if key.endswith(f".{end}"))
        try:
            found[name] = _READ[name](value)
        except ValueError:
            continue
    return found
