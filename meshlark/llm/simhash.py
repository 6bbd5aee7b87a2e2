"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into BLOCKS blocks. Two fingerprints that differ in
at most DISTANCE bits agree in BLOCKS - DISTANCE blocks at least, so they meet
under the key made of those. Every distinct fingerprint is dealt under each
choice of that many blocks; rows are shuffled and sorted by key, and each run
of equal keys is verified by Hamming distance. A run gives a spanning forest of
its links, found by search from one fingerprint to the next, so a run of n
gives fewer than n rows. Equal fingerprints are one row throughout.

`representatives` searches farther, for likeness of 0.8 or more of 5-word
shingle sets: that is an angle between fingerprints, about 39 of 256 bits. Its
fingerprints have 256 bits, over distinct shingles; links are at most
WIDE_DISTANCE bits, and all of them are found. The bits are cut into blocks, so
many that a linked pair differs in at most PARTS - 1 bits of one block, and each
block into PARTS parts, of which that pair then has one in common: the key.
Within a run of a key only fingerprints are compared that differ in at most
PARTS - 1 bits of the rest of its block.

Runs are read as a stream, and at most TILE fingerprints of a run are held. A
longer run is passed on and compared in tiles: its rows are dealt to the cells
of a triangular grid, any two of them meet in a cell, and each cell is searched
like a run. So all links are kept whatever the size of a group.

Rows of one fingerprint or one component are not gathered to be named: hot
ones are broadcast, of which there are few (`join_hot`).

Texts are read whole, however long; extra columns are left aside.
Nulls: a null text has no words, hence fingerprint zero; null ids are returned,
and component_id is null only where no document of the component has an id.
Repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.minhash import _mixed, shingle_hashes, word_hashes
from meshlark.operators.cluster import materialize
from meshlark.operators.components import connected_components
from meshlark.operators.skew import join_hot

BLOCKS = 7
DISTANCE = 4
SHINGLE = 4
SEED = 42
TILE = 8192
SMALL_RUN = 16
PARTS = 3
WIDE_TILE = 1 << 18
FEW = 1500  # fingerprints of a run that are compared without an index
AT_A_TIME = 1 << 16  # pairs
WIDE = 4  # 64-bit words of a wide fingerprint
WIDE_SHINGLE = 5
WIDE_DISTANCE = 40


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, as a signed number; bit k is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D part
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), fp of each row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((fingerprint(x.as_py(), shingle) for x in batch.column(1)), pa.int64())], ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {id_type}, text_key long, fp long")


def block_keys(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(number of the choice, signed mask of its bits) for each choice of blocks - distance blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    chosen = [sum(c) for c in combinations(masks, blocks - distance)]
    return [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(chosen)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, over the last axis of words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def spanning(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that span the components of distinct fingerprints, a row of words each."""
    left, right = [np.zeros(0, np.intp)], [np.zeros(0, np.intp)]
    rest = np.arange(len(fps))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step, front = front[:64], front[64:]
            close = _distance(fps[step][:, None], fps[rest][None, :]) <= distance
            hit = close.any(0)
            if hit.any():
                left.append(step[close[:, hit].argmax(0)])
                right.append(rest[hit])
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return np.concatenate(left), np.concatenate(right)


def _links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) of complete runs of equal keys; runs of up to SMALL_RUN give all of theirs."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([edge, [len(keys)]]))
    left, right = [np.zeros(0, np.intp)], [np.zeros(0, np.intp)]
    small = np.repeat(size <= SMALL_RUN, size)
    for lag in range(1, min(int(size.max(initial=1)), SMALL_RUN)):
        at = np.flatnonzero(small[:-lag] & (keys[lag:] == keys[:-lag]))
        at = at[_distance(fps[at], fps[at + lag]) <= distance]
        left.append(at)
        right.append(at + lag)
    for at, many in zip(edge[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist(), strict=True):
        a, b = spanning(fps[at : at + many], distance)
        left.append(a + at)
        right.append(b + at)
    return np.concatenate(left), np.concatenate(right)


def _run_links(links: Callable, tile: int | None):
    """links: of (keys, fps), row numbers of what is linked. Reads rows (key, node, words of the fingerprint) sorted by key; writes links of nodes (a, b), and of runs beyond `tile` the rows (key, b)."""

    def rows(a, b, key) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in (a, b, key)], ["a", "b", "key"])

    def none(n: int) -> pa.Array:
        return pa.nulls(n, pa.int64())

    def linked(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            a, b = links(keys, fps)
            if len(a):
                yield rows(nodes[a], nodes[b], none(len(a)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fps = np.stack([w.astype(np.int64).view(np.uint64) for w in words], 1)
            if held is not None:
                keys, nodes, fps = np.concatenate([held[0], keys]), np.concatenate([held[1], nodes]), np.concatenate([held[2], fps])
                held = None
            if passing is not None:
                ours = int(np.searchsorted(keys, passing, "right"))
                if ours:
                    yield rows(none(ours), nodes[:ours], keys[:ours])
                keys, nodes, fps = keys[ours:], nodes[ours:], fps[ours:]
                if not len(keys):
                    continue
                passing = None
            open_run = int(np.searchsorted(keys, keys[-1], "left"))
            done = np.arange(open_run)
            if tile and open_run:  # runs that ended inside this batch may be long, too
                edge = np.flatnonzero(np.concatenate([[True], keys[1:open_run] != keys[: open_run - 1]]))
                size = np.diff(np.concatenate([edge, [open_run]]))
                long = np.repeat(size > tile, size)
                if long.any():
                    yield rows(none(int(long.sum())), nodes[:open_run][long], keys[:open_run][long])
                done = np.flatnonzero(~long)
            yield from linked(keys[done], nodes[done], fps[done])
            held = keys[open_run:], nodes[open_run:], fps[open_run:]
            if tile and len(held[0]) > tile:
                passing = held[0][0]
                yield rows(none(len(held[0])), held[1], held[0])
                held = None
        if held is not None:
            yield from linked(*held)

    return run


def block_links(dealt: DataFrame, close: Callable, tile: int, fps: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints share a key and are close. dealt: key, node, then the words of the fingerprint. fps: node and words once. close: as `links` of `_run_links`; the last 16 bits of a key are the same in tiles.

    Tiles take their words from `fps`: to deal all rows again for them would
    keep the broadcast of hot keys waiting behind it, beyond its time limit.
    """
    words = dealt.columns[2:]
    sorted_runs = dealt.repartition("key").sortWithinPartitions("key", "node")
    found = materialize(sorted_runs.mapInArrow(_run_links(close, tile), "a long, b long, key long"), "simhash-links")
    links = found.where("key is null").select("a", "b")
    long = found.where("key is not null").select("key", F.col("b").alias("node"))
    n_long = long.count()
    if not n_long:
        return links.distinct()
    sizes = long.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"), F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "simhash-sizes")
    cells = join_hot(long, sizes, "key", n_long).withColumn("tile", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cell = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    cells = cells.select(cell.bitwiseAND(F.lit(-65536)).bitwiseOR(F.col("key").bitwiseAND(F.lit(65535))).alias("key"), "node").join(fps, "node").select("key", "node", *words)
    cells = cells.repartition("key").sortWithinPartitions("key", "node")
    return links.unionByName(cells.mapInArrow(_run_links(close, None), "a long, b long, key long").select("a", "b")).distinct()


def fingerprint_links(fps: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect what pairs within `distance` bits connect. fps: distinct fp, which are the nodes, too."""
    keys = F.array(*[F.struct(F.col("fp").bitwiseAND(F.lit(m)).alias("bits"), F.lit(i).alias("choice")) for i, m in block_keys(blocks, distance)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select(F.xxhash64("k.choice", "k.bits").alias("key"), F.col("fp").alias("node"), F.col("fp").alias("word"))
    return block_links(dealt, partial(_links, distance=distance), tile, fps.select(F.col("fp").alias("node"), F.col("fp").alias("word")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, blocks: int = BLOCKS, distance: int = DISTANCE) -> DataFrame:
    """docs: doc_id, text. A row per document: doc_id, fingerprint, component_id, text_key, component (a fingerprint of it)."""
    marked = materialize(fingerprints(docs, shingle), "simhash", counted=True)
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "simhash-distinct", counted=True)
    components = connected_components(fingerprint_links(distinct.select("fp"), blocks, distance))
    labelled = distinct.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_hot(labelled, least, "component", distinct._meshlark_rows).select("fp", "component", "component_id", F.col("copies").alias("n"))
    return join_hot(marked, named, "fp", marked._meshlark_rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key", "component")


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> np.ndarray:
    """`words` times 64 bits over the distinct shingles of a text; zeros for a text without words."""
    data = (text or "").encode().lower()
    with np.errstate(over="ignore"):
        hashes = np.unique(shingle_hashes(word_hashes(data), shingle)) if data else np.zeros(0, np.uint64)
        counts = np.zeros(64 * words, np.int64)
        for at in range(0, len(hashes), 16384):
            part = np.stack([_mixed(hashes[at : at + 16384] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % 2**64)) for w in range(words)], 1)
            bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
            for b in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
                counts += bits[b : b + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


@lru_cache
def wide_parts(distance: int, bits: int = 64 * WIDE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each key its bits, and the other bits of its block."""
    blocks = min(bits // PARTS, distance // PARTS + 1)
    out = []
    for block in np.array_split(np.arange(bits), blocks):
        out += [(part, np.setdiff1d(block, part)) for part in np.array_split(block, PARTS)]
    return out


def _number(spread: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return spread[:, bits].astype(np.int64) @ (np.int64(1) << np.arange(len(bits), dtype=np.int64))


def _spread(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")


def wide_keys(fps: np.ndarray, distance: int = WIDE_DISTANCE) -> np.ndarray:
    """Keys of each fingerprint (a row of words): a column a part of a block, its number in the last 16 bits."""
    spread = _spread(fps)
    return np.stack([_number(spread, bits) << np.int64(16) | np.int64(i) for i, (bits, _) in enumerate(wide_parts(distance, spread.shape[1]))], 1)


class _Forest:
    """Which rows of a run are connected: the least row of each one's component."""

    def __init__(self, fps: np.ndarray, distance: int):
        self.fps, self.distance, self.root = fps, distance, np.arange(len(fps))
        self.words = [np.ascontiguousarray(w) for w in fps.T[: (fps.shape[1] + 1) // 2]]

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Half of the words rule most pairs out."""
        half = sum(np.bitwise_count(w[x] ^ w[y]) for w in self.words)
        at = np.flatnonzero(half <= self.distance)
        at = at[self.root[x[at]] != self.root[y[at]]]
        at = at[_distance(self.fps[x[at]], self.fps[y[at]]) <= self.distance]
        self.join(x[at], y[at])

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            low, high = np.minimum(self.root[x], self.root[y]), np.maximum(self.root[x], self.root[y])
            apart = low < high
            x, y = x[apart], y[apart]
            np.minimum.at(self.root, high[apart], low[apart])
            while not np.array_equal(further := self.root[self.root], self.root):
                self.root = further


def _all_pairs(forest: _Forest) -> None:
    step = max(1, (1 << 16) // len(forest.root))
    for at in range(0, len(forest.root), step):
        half = sum(np.bitwise_count(w[at : at + step, None] ^ w[None, at:]) for w in forest.words)
        x, y = np.nonzero(half <= forest.distance)
        later = y > x
        forest.compare(x[later] + at, y[later] + at)


def _indexed_pairs(forest: _Forest, rest: np.ndarray, bits: int) -> None:
    """Compares rows whose `rest` differ in fewer than PARTS of their bits. Rows are sorted by `rest`.

    Rows already connected are passed over. Where there are many pairs, rows are
    first compared with one row of each list, which connects dense groups.
    """
    starts = np.searchsorted(rest, np.arange((1 << bits) + 1))
    rows = np.arange(len(rest))

    def meet(x: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
        ends = np.cumsum(n)
        at = 0
        while at < len(x):
            past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_A_TIME, "right")))
            if past == at + 1:
                for y in range(int(low[at]), int(low[at] + n[at]), AT_A_TIME):
                    many = np.arange(y, min(y + AT_A_TIME, int(low[at] + n[at])))
                    forest.compare(np.full(len(many), x[at]), many)
            else:
                k = n[at:past]
                y = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[at:past], k)
                forest.compare(np.repeat(x[at:past], k), y)
            at = past

    masks = [sum(1 << b for b in c) for many in range(PARTS) for c in combinations(range(bits), many)]
    lists = np.flatnonzero(starts[1:] > starts[:-1])
    for mask in masks:
        x = rows if not mask else rows[rest >> (mask.bit_length() - 1) & 1 == 0]
        for first in (True, False):
            low, past = starts[rest[x] ^ mask], starts[(rest[x] ^ mask) + 1]
            least, most = np.full(len(starts), -1), np.full(len(starts), -2)
            least[lists], most[lists] = np.minimum.reduceat(forest.root, starts[lists]), np.maximum.reduceat(forest.root, starts[lists])
            of = rest[x] ^ mask
            open_ = (past > low) & ~((least[of] == most[of]) & (least[of] == forest.root[x]))
            x, low, past = x[open_], low[open_], past[open_]
            low = low if mask else np.where(first, low, x + 1)
            n = past - low
            if first:
                if n.sum() > 4 * len(rest):
                    meet(x, low, np.minimum(n, 1))
                continue
            some = n > 0
            meet(x[some], low[some], n[some])


def wide_links(keys: np.ndarray, fps: np.ndarray, distance: int = WIDE_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers that connect, within complete runs of equal keys, what all pairs within `distance` bits connect there."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    left, right = [np.zeros(0, np.intp)], [np.zeros(0, np.intp)]
    for at, past in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)], strict=True):
        if past - at < 2:
            continue
        others = wide_parts(distance, 64 * fps.shape[1])[int(keys[at]) & 65535][1]
        order = np.arange(past - at)
        if past - at > FEW:
            rest = _number(_spread(fps[at:past]), others)
            order = np.argsort(rest, kind="stable")
            forest = _Forest(fps[at:past][order], distance)
            _indexed_pairs(forest, rest[order], len(others))
        else:
            forest = _Forest(fps[at:past], distance)
            _all_pairs(forest)
        bound = np.flatnonzero(forest.root != np.arange(past - at))
        left.append(order[bound] + at)
        right.append(order[forest.root[bound]] + at)
    return np.concatenate(left), np.concatenate(right)


def representatives(docs: DataFrame, distance: int = WIDE_DISTANCE, tile: int = WIDE_TILE) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) of one document of each group of near-duplicates: the smallest doc_id (null last), of its texts the least key.

    docs: doc_id, text. Texts without words are one group. Repeated rows give
    one row; an empty table none.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = [f"w{i}" for i in range(WIDE)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([wide_fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WIDE)]], ["doc_id", "text_key", *columns])

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(mark, f"doc_id {id_type}, text_key long, {', '.join(f'{c} long' for c in columns)}")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    distinct = marked.groupBy(*columns).agg(first).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct, "simhash-wide")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                node, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                keys = wide_keys(np.stack(words, 1).astype(np.int64).view(np.uint64), distance)
                many = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(x, many)) for x in (node, *words)]], ["key", "node", *columns])

    dealt = distinct.select("node", *columns).mapInArrow(deal, f"key long, node long, {', '.join(f'{c} long' for c in columns)}")
    components = connected_components(block_links(dealt, partial(wide_links, distance=distance), tile, distinct.select("node", *columns)))
    labelled = distinct.select("node", "first").join(components, "node", "left")
    return labelled.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
