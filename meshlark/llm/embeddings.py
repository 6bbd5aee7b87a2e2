"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are rotated to the principal axes of a sample, which keeps cosines and
moves what tells vectors apart to the leading dimensions. Two unit vectors have
cosine = (product over the leading dimensions) + (product over the others), and
the latter is at most the product of the norms of the suffixes. A tile first
multiplies the leading dimensions and the suffix norms in one go; pairs whose
bound stays below the threshold are done, the few others take in more
dimensions, and so on. Whole tiles are passed over when the ranges of their
leading coordinates already keep every pair below the threshold.

Before anything is shuffled, the medians of a sample cut the leading axes into
regions, and a pass over all rows takes the box of each region's leading
coordinates and its longest suffix. By the same bound two regions whose boxes
keep every pair below the threshold are never dealt to each other. Rows of a
region go by hash to blocks of about BLOCK_ROWS rows and pairs of blocks of
regions that can meet to the cells of a triangular grid, so no cell holds more
than two blocks, however alike the vectors are. What is dealt falls where the
leading axes tell vectors apart; where no axis stands out, as with random
directions, all regions can meet and the work is the square of the rows. A cell
returns a row for each vector that has a link there: how many, and a vector it
is connected to; pairs are never written out. The comparison is exact: pairs
within 1e-9 of the threshold are decided on the original components in double
precision.

The sample for axes and cuts has at most SAMPLE rows; they change the speed only.
The driver holds a row for each region, at most one for REGION_ROWS sampled rows
and one for each length of vectors.
Vectors that are null, zero or hold null or non-finite components, and vectors
of different lengths, link with nothing. Null ids are returned; a component
without any id has a null component_id, and kept is then false. Repeated rows
are vectors of their own and link with each other. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.cluster import materialize
from meshlark.operators.components import connected_components
from meshlark.operators.skew import join_hot

THRESHOLD = 0.9
BLOCK_ROWS = 8192
LEAST_BLOCKS = 6
TILE = 512
SAMPLE = 4096
REGION_ROWS = 16
LEAD = 8
NEAR = 1e-9


def usable(values) -> np.ndarray | None:
    """The vector in double precision, None if it links with nothing."""
    if values is None or not len(values):
        return None
    x = np.array(values, dtype=np.float64)  # a null component becomes NaN
    if not np.isfinite(x).all() or not x.any():
        return None
    return x


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [usable(v) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary()), pa.array([0 if v is None else len(v) for v in vectors], pa.int32())], ["vec_id", "vector", "dim"])


class Space:
    """Principal axes for vectors of one length, axes of most variance first, and the cuts of the regions."""

    def __init__(self, axes: np.ndarray, cuts: tuple[np.ndarray, ...] = ()):
        self.axes, self.cuts = axes, cuts

    @classmethod
    def of_sample(cls, raw: np.ndarray, levels: int) -> Space:
        unit = _unit(raw)
        axes = np.ascontiguousarray(np.linalg.eigh(unit.T @ unit)[1][:, ::-1])
        lead, cuts = unit @ axes, []
        levels = min(levels, raw.shape[1], max(0, int(np.log2(len(raw) / REGION_ROWS))) if len(raw) >= REGION_ROWS else 0)
        region = np.zeros(len(raw), np.int64)
        for level in range(levels):
            cut = np.array([np.median(lead[region == r, level]) if (region == r).any() else 0.0 for r in range(1 << level)])
            cuts.append(cut)
            region = region * 2 + (lead[:, level] > cut[region])
        return cls(axes, tuple(cuts))

    def regions(self, lead: np.ndarray) -> np.ndarray:
        region = np.zeros(len(lead), np.int64)
        for level, cut in enumerate(self.cuts):
            region = region * 2 + (lead[:, level] > cut[region])
        return region


def spaces(vectors: DataFrame, blocks: int, sample: int = SAMPLE) -> dict[int, Space]:
    """A space for each length met in the sample, with about as many regions as blocks."""
    rows = vectors.where("dim > 0").orderBy(F.xxhash64("row_id"), "row_id").limit(sample).select("vector").collect()
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in rows:
        v = np.frombuffer(r["vector"])
        by_dim.setdefault(len(v), []).append(v)
    return {d: Space.of_sample(np.array(v), int(np.ceil(np.log2(blocks)))) for d, v in by_dim.items()}


def _turned(batch: pa.RecordBatch, found: dict[int, Space]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """dim, rows, turned unit vectors, regions for each length in a batch of (vector, dim, ...)."""
    dims, vectors = batch.column("dim").to_numpy(), batch.column("vector")
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        raw = np.frombuffer(b"".join(vectors.take(pa.array(rows)).to_pylist())).reshape(-1, dim)
        space = found.get(int(dim)) or Space(np.eye(dim))
        unit = _unit(raw) @ space.axes
        yield int(dim), rows, unit, space.regions(unit)


def region_boxes(vectors: DataFrame, found) -> list:
    """dim, region, n, low, high, rest: the box of all rows of each region. found: broadcast spaces."""

    def run(batches):
        for batch in batches:
            out = []
            for dim, _, unit, region in _turned(batch, found.value):
                lead = np.zeros((len(unit), LEAD))
                lead[:, : min(LEAD, dim)] = unit[:, :LEAD]
                rest = np.sqrt((unit[:, LEAD:] ** 2).sum(1))
                for r in np.unique(region):
                    own = region == r
                    out.append({"dim": dim, "region": int(r), "n": int(own.sum()), "low": lead[own].min(0).tolist(), "high": lead[own].max(0).tolist(), "rest": float(rest[own].max())})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("dim", pa.int32()), ("region", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("rest", pa.float64())]))

    parts = vectors.select("vector", "dim").mapInArrow(run, "dim int, region long, n long, low array<double>, high array<double>, rest double")
    low = F.array(*[F.min(F.col("low")[i]) for i in range(LEAD)]).alias("low")
    high = F.array(*[F.max(F.col("high")[i]) for i in range(LEAD)]).alias("high")
    return parts.groupBy("dim", "region").agg(F.sum("n").alias("n"), low, high, F.max("rest").alias("rest")).orderBy("dim", "region").collect()


def block_plan(boxes: list, threshold: float, block_rows: int) -> list[tuple]:
    """dim, region, first, blocks, partners: a region's blocks, and the ranges of blocks that its rows may link with. Regions of one length only meet."""
    out = []
    for dim in sorted({b["dim"] for b in boxes}):
        own = [b for b in boxes if b["dim"] == dim]
        low, high, rest = np.array([b["low"] for b in own]), np.array([b["high"] for b in own]), np.array([b["rest"] for b in own])
        blocks = np.array([-(-b["n"] // block_rows) for b in own])
        if blocks.sum() < LEAST_BLOCKS:
            blocks = -(-blocks * LEAST_BLOCKS // blocks.sum())
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        for r in range(len(own)):
            corners = np.maximum.reduce([low[r] * low, low[r] * high, high[r] * low, high[r] * high])
            meet = corners.sum(1) + rest[r] * rest >= threshold - NEAR
            meet[r] = True
            out.append((dim, own[r]["region"], int(first[r]), int(blocks[r]), [(int(first[q]), int(first[q] + blocks[q] - 1)) for q in np.flatnonzero(meet)]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Product over the product of the norms; scaled first where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
    odd = ~np.isfinite(out)
    if odd.any():
        out[odd] = (_unit(p[odd]) * _unit(q[odd])).sum(1)
    return out


def steps(dim: int) -> list[int]:
    """Numbers of leading dimensions after which pairs are let go."""
    return sorted({max(1, dim * 3 // 8), max(1, dim * 5 // 8), dim})


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; label[x] is the least member of x's class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


class Tiles:
    """Rows of a block in order of their first coordinate, cut into tiles with their bounds."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray, base: int):
        unit = _unit(raw) @ axes
        order = np.argsort(unit[:, 0], kind="stable")
        self.raw, self.unit, self.rows = raw[order], unit[order], base + order
        self.steps = steps(raw.shape[1])
        squares = np.cumsum((self.unit * self.unit)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = {m: np.sqrt(squares[:, m]) if m < raw.shape[1] else np.zeros(len(raw)) for m in self.steps}
        self.lead = min(4, raw.shape[1])
        self.lead_suffix = np.sqrt(squares[:, self.lead]) if self.lead < raw.shape[1] else np.zeros(len(raw))
        self.spans = [(i, min(i + TILE, len(raw))) for i in range(0, len(raw), TILE)]
        self.bounds = [(self.unit[i:j, : self.lead].min(0), self.unit[i:j, : self.lead].max(0), self.lead_suffix[i:j].max()) for i, j in self.spans]
        m = self.steps[0]
        self.first = np.concatenate([self.unit[:, :m], self.suffix[m][:, None]], axis=1)


def tile_links(a: Tiles, i: int, b: Tiles, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of two tiles, as positions in a and b; of one tile with itself each pair once."""
    none = np.zeros(0, np.intp)
    (low_a, high_a, rest_a), (low_b, high_b, rest_b) = a.bounds[i], b.bounds[j]
    most = np.maximum.reduce([low_a * low_b, low_a * high_b, high_a * low_b, high_a * high_b]).sum() + rest_a * rest_b
    if most < threshold - NEAR:
        return none, none
    (a0, a1), (b0, b1) = a.spans[i], b.spans[j]
    possible = a.first[a0:a1] @ b.first[b0:b1].T >= threshold - NEAR
    r, c = np.nonzero(possible)
    r, c = r + a0, c + b0
    if a is b and i == j:
        upper = r < c
        r, c = r[upper], c[upper]
    if not len(r):
        return none, none
    out_r, out_c = [], []
    for at in range(0, len(r), 65536):
        x, y = r[at : at + 65536], c[at : at + 65536]
        total, done = np.zeros(len(x)), 0
        for m in a.steps:
            total += np.einsum("ij,ij->i", a.unit[x, done:m], b.unit[y, done:m])
            alive = total + a.suffix[m][x] * b.suffix[m][y] >= threshold - NEAR
            x, y, total, done = x[alive], y[alive], total[alive], m
        close = np.flatnonzero(np.abs(total - threshold) <= NEAR)
        if len(close):
            total[close] = _cosine(a.raw[x[close]], b.raw[y[close]])
        linked = total >= threshold
        out_r.append(x[linked])
        out_c.append(y[linked])
    return np.concatenate(out_r), np.concatenate(out_c)


def cell_links(left: np.ndarray, right: np.ndarray | None, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of a cell, and the least row it is connected to; rows of `right` follow those of `left`. None: left with itself."""
    a = Tiles(left, axes, 0)
    b = a if right is None else Tiles(right, axes, len(left))
    n = len(left) + (0 if right is None else len(right))
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i in range(len(a.spans)):
        for j in range(i if b is a else 0, len(b.spans)):
            r, c = tile_links(a, i, b, j, threshold)
            if len(r):
                r, c = a.rows[r], b.rows[c]
                links += np.bincount(r, minlength=n) + np.bincount(c, minlength=n)
                union(label, r, c)
    return links, label


def vector_links(vectors: DataFrame, n: int, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """row_id, links, other (a row it is connected to, or itself), a row for each cell in which a vector has links. vectors: row_id, vector, dim; n: their number."""
    spark = vectors.sparkSession
    usable_rows = vectors.where("dim > 0")
    found = spark.sparkContext.broadcast(spaces(vectors, max(LEAST_BLOCKS, -(-n // block_rows))))
    plan = block_plan(region_boxes(usable_rows, found), threshold, block_rows)
    plan = spark.createDataFrame(plan, "dim int, region long, first long, blocks long, partners array<struct<first:bigint,last:bigint>>")

    def place(batches):
        for batch in batches:
            regions = np.zeros(batch.num_rows, np.int64)
            for _, rows, _, region in _turned(batch, found.value):
                regions[rows] = region
            yield batch.append_column("region", pa.array(regions))

    placed = usable_rows.select("row_id", "vector", "dim").mapInArrow(place, "row_id long, vector binary, dim int, region long")
    dealt = placed.join(F.broadcast(plan), ["dim", "region"])
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("row_id"), F.col("blocks"))).select("dim", "block", "row_id", "vector", F.explode("partners").alias("range"))
    dealt = dealt.withColumn("other", F.explode(F.sequence("range.first", "range.last")))
    dealt = dealt.select("dim", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row_id", "vector")

    def run(key, table):
        dim, low, high = (k.as_py() for k in key)
        ids = table.column("row_id").to_numpy()
        raw = np.frombuffer(b"".join(table.column("vector").to_pylist())).reshape(-1, dim)
        first = table.column("block").to_numpy() == low
        ids = np.concatenate([ids[first], ids[~first]])
        space = found.value.get(dim)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if low == high or first.any() and not first.all():
            links, label = cell_links(raw[first], None if low == high else raw[~first], np.eye(dim) if space is None else space.axes, threshold)
        linked = links > 0
        return pa.table({"row_id": ids[linked], "links": links[linked], "other": ids[label[linked]]})

    return dealt.groupBy("dim", "low", "high").applyInArrow(run, "row_id long, links long, other long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """embeddings: vec_id, embedding. A row per vector: vec_id, n_links, component_id, kept."""
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    read = embeddings.select("vec_id", "embedding").mapInArrow(_read, f"vec_id {id_type}, vector binary, dim int")
    vectors = materialize(read.withColumn("row_id", F.monotonically_increasing_id()), "vectors", counted=True)
    n = vectors._meshlark_rows
    found = materialize(vector_links(vectors.select("row_id", "vector", "dim"), n, threshold, block_rows), "vector-links")
    counts = found.groupBy("row_id").agg(F.sum("links").alias("n_links"))
    components = connected_components(found.select(F.col("row_id").alias("a"), F.col("other").alias("b")))
    named = vectors.select("row_id", "vec_id").join(components.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))
    named = named.join(counts, "row_id", "left")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    out = join_hot(named, least, "component", n)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
