"""Relationships that arrive as a stream, kept as a table and matched as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from meshlark.graph import PropertyGraph


def append_rels(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of relationships (pos, src, dst, type, ...) into a store's folder, a file set a batch, until nothing is left."""
    return stream.writeStream.format("parquet").partitionBy("type").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def match_hop(stream: DataFrame, graph: PropertyGraph, props: tuple[str, ...] = ()) -> DataFrame:
    """Each arriving relationship with properties of the node it starts at: a stream-static join."""
    nodes = graph.nodes.select("id", *props)
    return stream.join(nodes, stream.src == nodes.id).drop("id")
