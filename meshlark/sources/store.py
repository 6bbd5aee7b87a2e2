"""Graphs as Parquet: a folder a version, nodes and relationships apart, relationships partitioned by type.

A save writes a new folder inside the version's and marks it done at the end; a
load reads the last one done. So a version can be saved onto itself, a save that
breaks off leaves the version as it was, and readers of the one before go on
until `tidy` removes what is no longer the last.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshlark.graph import PropertyGraph


class GraphStore:
    """Versions of a graph under one folder that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, version: str) -> str:
        if not re.fullmatch(r"[\w.-]+", version):
            raise ValueError("a version is a plain name")
        return f"{self.folder}/{version}"

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _saves(self, version: str) -> list[str]:
        """Names of the finished saves of a version, oldest first."""
        fs, path = self._hadoop(self._path(version))
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
        return sorted(n for n in found if fs.exists(self._hadoop(f"{self._path(version)}/{n}/_DONE")[1]))

    def save(self, graph: PropertyGraph, version: str | None = None, spread: int = 16) -> str:
        """spread: the number of parts that each type's relationships are dealt to, by their source."""
        version = version or graph.version or "latest"
        path = f"{self._path(version)}/save-{time.time_ns():020d}"
        graph.nodes.write.parquet(f"{path}/nodes")
        part = F.pmod(F.xxhash64("src"), F.lit(spread))
        graph.rels.repartition("type", part).write.partitionBy("type").parquet(f"{path}/rels")
        fs, done = self._hadoop(f"{path}/_DONE")
        fs.create(done).close()
        return version

    def tidy(self, version: str) -> None:
        """Remove all saves of a version but the last; nothing must read them any more."""
        for name in self._saves(version)[:-1]:
            fs, path = self._hadoop(f"{self._path(version)}/{name}")
            fs.delete(path, True)

    def load(self, version: str = "latest") -> PropertyGraph:
        """A scan of one type reads that type's files alone."""
        saves = self._saves(version)
        if not saves:
            raise FileNotFoundError(f"no version {version}")
        path = f"{self._path(version)}/{saves[-1]}"
        rels = self.spark.read.parquet(f"{path}/rels").withColumn("type", F.col("type").cast("string"))
        return PropertyGraph(self.spark.read.parquet(f"{path}/nodes"), rels, version)

    def versions(self) -> list[str]:
        fs, path = self._hadoop(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def remove(self, version: str) -> bool:
        fs, path = self._hadoop(self._path(version))
        return fs.delete(path, True)
