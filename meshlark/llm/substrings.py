"""Substring dedup: a count-min prefilter, then exact groups of what it lets through.

A window is `window` consecutive words. A word goes if a window that covers it
also starts in a document with a smaller doc_id.

First pass: every task counts its windows in a count-min sketch of ROWS rows,
saturating at two, and sends the cells it met, sorted and delta-coded, by slabs
of the cell range. Merging adds them up; what is kept is a bit a cell, set
where two or more windows fell. A sketch never counts too low, so a window
that occurs twice has all its bits set. The width follows the bytes of all
texts (CELLS_PER_BYTE) up to MOST_CELLS, which bounds the broadcast: ROWS bits a
cell. Beyond that width the sketch fills up and lets more through; the second
pass, which is exact, stays right and takes in more.

Second pass: windows whose bits are all set are grouped by an 80-bit hash. Of
the documents of a chunk that share a window only the smallest needs to be
compared with other chunks: the others are settled on the spot. So a group has
at most one document a chunk, and a passage found in a third of all documents
does not fill a task. Groups are read by shards of the hash whose number
follows the input. The windows found return to their documents by doc_id and a
hash of the text, through buckets of both: all exact copies of a text have one
hash, but their ids spread them. Rows alike in both keep one entry a window. The
texts are shuffled once.

Texts are read whole, however long; extra columns are left aside.
Nulls: a null text has no words; a null id is larger than all others and
smaller than none. Repeated rows keep their words alike: an equal id is not
smaller. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.minhash import _BLANKS, _mixed, shingle_hashes, word_hashes

WINDOW = 13
ROWS = 2
CELLS_PER_BYTE = 0.4
MOST_CELLS = 1 << 30
SLAB_CELLS = 1 << 21
CHUNK_WORDS = 2_000_000
SKETCH_WORDS = 4_500_000
GROUP_BYTES = 1 << 20
SHARD_BYTES = 12_000_000
_SECOND = np.uint64(0xA0761D6478BD642F)
_NO_ID = np.iinfo(np.int64).max


def slabs_of(width: int) -> tuple[int, int]:
    """Cells of a slab, and how many slabs a row of the sketch has: at least 16, more as it widens."""
    slab = min(SLAB_CELLS, -(-width // 16))
    return slab, -(-width // slab)


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each hash in a row of the sketch, evenly over the width."""
    salt = np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)
    mixed = _mixed(hashes + salt) >> np.uint64(32)
    return (mixed * np.uint64(width) >> np.uint64(32)).astype(np.uint32)


class Chunk:
    """Windows of some documents: hash and, unless only that is asked for, second hash, document, position."""

    def __init__(self, window: int, only_hash: bool = False):
        self.window, self.only_hash, self.parts, self.words = window, only_hash, [], 0
        self.ids: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.documents = 0

    def add(self, ids: list, keys: list, texts: list[bytes]) -> None:
        """Documents whose texts have about GROUP_BYTES together, or one longer one."""
        data = b"\n".join(texts)
        raw = np.frombuffer(data, np.uint8)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        with np.errstate(over="ignore"):
            hashes = word_hashes(data) if data else np.zeros(0, np.uint64)
            blank = _BLANKS[raw]
            starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, np.int64)
            first = np.searchsorted(starts, begins)  # by document: its first word
            many = np.diff(np.concatenate([first, [len(starts)]]))
            self.words += len(starts)
            n = len(hashes) - self.window + 1
            if n > 0:
                position = np.arange(len(starts)) - np.repeat(first, many)
                owner = np.repeat(np.arange(len(texts)), many)
                inside = np.flatnonzero((np.repeat(many, many) - position >= self.window)[:n])
                one = shingle_hashes(hashes, self.window)[inside]
                if self.only_hash:
                    self.parts.append((one,))
                    self.documents += len(texts)
                    return
                two = np.zeros(n, np.uint64)
                for i in range(self.window):
                    two = two * _SECOND + hashes[i : i + n]
                two = (_mixed(two[inside]) >> np.uint64(48)).astype(np.uint16)
                self.parts.append((one, two, (owner[inside] + self.documents).astype(np.int32), position[inside].astype(np.int32)))
        self.ids.append(np.array([_NO_ID if i is None else i for i in ids], np.int64))
        self.keys.append(np.array(keys, np.int32))
        self.documents += len(texts)

    def windows(self) -> list[np.ndarray]:
        """All of them; the chunk lets go of its parts."""
        parts, self.parts = self.parts, []
        if not parts:
            return [np.zeros(0, t) for t in (np.uint64, np.uint16, np.int32, np.int32)]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]


def chunks(batches: Iterator[pa.RecordBatch], window: int, only_hash: bool = False) -> Iterator[Chunk]:
    """Chunks of about CHUNK_WORDS words, SKETCH_WORDS for the sketch, from batches (doc_id, text, key)."""
    chunk, ids, keys, texts, size = Chunk(window, only_hash), [], [], [], 0
    most = SKETCH_WORDS if only_hash else CHUNK_WORDS
    for batch in batches:
        for i, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            ids.append(i)
            keys.append(key)
            texts.append(data)
            size += len(data)
            if size >= GROUP_BYTES:
                chunk.add(ids, keys, texts)
                ids, keys, texts, size = [], [], [], 0
                if chunk.words >= most:
                    yield chunk
                    chunk = Chunk(window, only_hash)
    if texts:
        chunk.add(ids, keys, texts)
    if chunk.documents:
        yield chunk


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers as differences: a byte each, 255 for those that stand in the second list, of 2 or 4 bytes."""
    steps = np.diff(values, prepend=values.dtype.type(0)) if len(values) else values
    wide = steps >= 255
    rest = steps[wide]
    return np.where(wide, 255, steps).astype(np.uint8).tobytes(), rest.astype(np.uint16 if rest.max(initial=0) < 65536 else np.uint32).tobytes()


def decoded(steps: bytes, wide: bytes) -> np.ndarray:
    out = np.frombuffer(steps, np.uint8).astype(np.int64)
    escaped = np.flatnonzero(out == 255)
    out[escaped] = np.frombuffer(wide, np.uint16 if len(wide) == 2 * len(escaped) else np.uint32)
    return np.cumsum(out)


def sketch(docs: DataFrame, width: int, window: int = WINDOW) -> list[bytes]:
    """Merged sketch, a string of bits a row: whether two or more windows fell into a cell. docs: doc_id, text, key."""
    slab, slabs = slabs_of(width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, window, only_hash=True):
            hashes = chunk.windows()[0]
            for row in range(ROWS):
                met = np.sort(cells(hashes, row, width))
                if not len(met):
                    continue
                new = np.concatenate([[True], met[1:] != met[:-1]])
                again = np.unique(met[~new])
                met = met[new]
                edges = np.arange(slabs + 1, dtype=np.int64) * slab
                once, twice = np.searchsorted(met, edges), np.searchsorted(again, edges)
                out = [(*coded(met[once[s] : once[s + 1]] - np.uint32(edges[s])), *coded(again[twice[s] : twice[s + 1]] - np.uint32(edges[s]))) for s in range(slabs)]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(slabs) + row * slabs, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], ["slab", "once", "once_wide", "twice", "twice_wide"])

    def merge(key, batches):
        counts = np.zeros(slab, np.uint8)
        for batch in batches:
            for a, b, c, d in zip(*[batch.column(k).to_pylist() for k in ("once", "once_wide", "twice", "twice_wide")], strict=True):
                at = decoded(a, b)
                counts[at] = np.minimum(counts[at], 1) + 1
                counts[decoded(c, d)] = 2
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())})

    def merge_table(key, table):
        return merge(key, table.to_batches(max_chunksize=16))

    met = docs.mapInArrow(count, "slab int, once binary, once_wide binary, twice binary, twice_wide binary")
    rows = {r["slab"]: r["bits"] for r in met.groupBy("slab").applyInArrow(merge_table, "slab int, bits binary").toLocalIterator()}
    empty = np.packbits(np.zeros(slab, bool)).tobytes()
    return [b"".join(rows.get(row * slabs + s, empty) for s in range(slabs)) for row in range(ROWS)]


class Sketch:
    """The bits of the merged sketch, as the second pass asks them."""

    def __init__(self, rows: list[bytes], width: int):
        self.rows, self.width, self.slab = [np.frombuffer(r, np.uint8) for r in rows], width, slabs_of(width)[0]
        self.slab_bytes = -(-self.slab // 8)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may have occurred more than once."""
        left = np.arange(len(hashes))
        for row, bits in enumerate(self.rows):
            cell = cells(hashes[left], row, self.width).astype(np.int64)
            slab, inside = np.divmod(cell, self.slab)
            left = left[bits[slab * self.slab_bytes + (inside >> 3)] >> (7 - (inside & 7)).astype(np.uint8) & 1 == 1]
        return left


_ENTRY = "shard int, settled boolean, ids binary, keys binary, sizes binary, one binary, two binary, positions binary"


def _entry(shard: int, settled: bool, chunk_ids, chunk_keys, owner, position, one=None, two=None) -> tuple:
    """Windows of a shard, in order of document and position: their documents as runs."""
    new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    sizes = np.diff(np.concatenate([new, [len(owner)]])).astype(np.int32)
    runs = owner[new]
    small = position.astype(np.uint16) if position.max() < 65536 else position.astype(np.int32)
    return shard, settled, chunk_ids[runs].tobytes(), chunk_keys[runs].tobytes(), sizes.tobytes(), one.tobytes() if one is not None else b"", two.tobytes() if two is not None else b"", small.tobytes()


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Indices where ordered rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _positions(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.int32).astype(np.int32)


def candidates(docs: DataFrame, rows: list[bytes], width: int, shards: int, window: int = WINDOW) -> DataFrame:
    """Windows that the sketch lets through, by shards of their hash. docs: doc_id, text, key.

    Settled windows of a chunk, which a smaller document of it has too, go along
    in a shard of their own choosing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sketch(shared.value, width)
        for chunk in chunks(batches, window):
            one, two, owner, position = chunk.windows()
            left = known.repeated(one)
            if not len(left):
                continue
            one, two, owner, position = one[left], two[left], owner[left], position[left]
            ids, keys = np.concatenate(chunk.ids), np.concatenate(chunk.keys)
            order = np.lexsort((position, owner, ids[owner], two, one))
            new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            least = ids[owner[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
            settled = np.zeros(len(one), bool)
            settled[order] = ids[owner[order]] > least
            stays = np.ones(len(one), bool)
            again = np.lexsort((position, keys[owner], ids[owner]))  # rows alike in id and text say the same
            stays[again] = False
            stays[again[_first_of_runs(ids[owner[again]], keys[owner[again]], position[again])]] = True
            out = []
            if (settled & stays).any():
                out.append(_entry(int(ids[0] % shards), True, ids, keys, owner[settled & stays], position[settled & stays]))
            rest = np.flatnonzero(~settled & stays)
            shard = (one[rest] >> np.uint64(33)).astype(np.int64) % shards
            rest = rest[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            edges = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.unique(shard).tolist():
                own = rest[edges[s] : edges[s + 1]]
                out.append(_entry(s, False, ids, keys, owner[own], position[own], one[own], two[own]))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _ENTRY.split(", ")])

    return docs.mapInArrow(find, _ENTRY)


def _unpacked(table: pa.Table, *more: str) -> Iterator[tuple]:
    """Rows of runs as arrays: id, key and position of each window, then the columns `more` as they are."""
    for i, k, sizes, position, *rest in zip(*[table.column(c).to_pylist() for c in ("ids", "keys", "sizes", "positions", *more)], strict=True):
        sizes = np.frombuffer(sizes, np.int32)
        yield np.repeat(np.frombuffer(i, np.int64), sizes), np.repeat(np.frombuffer(k, np.int32), sizes), _positions(position, int(sizes.sum())), *rest


def bucket_of(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each document, from its id and the hash of its text together: copies spread, a document's windows stay together."""
    mixed = _mixed(ids.view(np.uint64) * _SECOND + keys.view(np.uint32).astype(np.uint64))
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_FOUND = "bucket int, ids binary, keys binary, sizes binary, positions binary"


def _resolve(buckets: int):
    """Windows of a shard that a smaller document has, as runs by buckets of their documents: a row a bucket, not one a document."""

    def run(key, table):
        ids, keys, positions, open_rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
        for i, k, p, settled, one, two in _unpacked(table, "settled", "one", "two"):
            if settled:
                ids.append(i)
                keys.append(k)
                positions.append(p)
            else:
                open_rows.append((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint16), i, k, p))
        if open_rows:
            one, two, i, k, p = (np.concatenate(x) for x in zip(*open_rows, strict=True))
            order = np.lexsort((i, two, one))
            one, two, i, k, p = one[order], two[order], i[order], k[order], p[order]
            new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            later = i > i[np.flatnonzero(new)][np.cumsum(new) - 1]
            ids.append(i[later])
            keys.append(k[later])
            positions.append(p[later])
        ids, keys, positions = np.concatenate(ids), np.concatenate(keys), np.concatenate(positions)
        bucket = bucket_of(ids, keys, buckets)
        order = np.lexsort((positions, keys, ids, bucket))
        ids, keys, positions, bucket = ids[order], keys[order], positions[order], bucket[order]
        new = _first_of_runs(ids, keys, positions)
        ids, keys, positions, bucket = ids[new], keys[new], positions[new], bucket[new]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in np.unique(bucket).tolist():
            own = slice(edges[b], edges[b + 1])
            i, k, p = ids[own], keys[own], positions[own]
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])]))
            sizes = np.diff(np.concatenate([new, [len(i)]])).astype(np.int32)
            small = p.astype(np.uint16) if p.max() < 65536 else p
            rows.append((b, i[new].tobytes(), k[new].tobytes(), sizes.tobytes(), small.tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "ids", "keys", "sizes", "positions"])

    return run


def _gather(key, table):
    """Runs of a bucket as a row a document: id, key, positions."""
    ids, keys, positions = (np.concatenate(x) for x in zip(*_unpacked(table), strict=True))
    order = np.lexsort((positions, keys, ids))
    ids, keys, positions = ids[order], keys[order], positions[order]
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
    ends, own = [*new[1:].tolist(), len(ids)], ids[new]
    return pa.table({"id": pa.array(own, mask=own == _NO_ID), "key": pa.array(keys[new]), "positions": pa.array([np.unique(positions[a:b]).tobytes() for a, b in zip(new.tolist(), ends, strict=True)], pa.binary())})


def _strip(window: int, with_text: bool = True):
    """Rows (doc_id, text, positions): what is left of each text, as its digest and, with_text, itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of, removed_of, digests, kept_texts = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if found.is_valid:
                    edge, at = np.zeros(len(words) + 1, np.int32), np.frombuffer(found.as_py(), np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + window, len(words)), -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    words_kept = [words[i] for i in np.flatnonzero(stays).tolist()]
                else:
                    words_kept = words
                kept = b" ".join(words_kept)
                words_of.append(len(words))
                removed_of.append(gone)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            columns = {"doc_id": batch.column(0), "n_words": pa.array(words_of, pa.int64()), "n_removed": pa.array(removed_of, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if with_text:
                columns["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, key, positions: windows of each document that a smaller one has, by doc_id and key. docs: doc_id, text, key."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    width = min(MOST_CELLS, max(1024, math.ceil(n_bytes * CELLS_PER_BYTE)))
    shards = max(1, math.ceil(n_bytes / SHARD_BYTES))
    let_through = candidates(docs, sketch(docs, width, window), width, shards, window)
    found = let_through.groupBy("shard").applyInArrow(_resolve(shards), _FOUND)
    return found.groupBy("bucket").applyInArrow(_gather, "id long, key int, positions binary")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """docs: doc_id, text. A row per document: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.hash("text").alias("key"))
    found = repeated_windows(keyed.withColumn("doc_id", F.col("doc_id").cast("long")), window)
    found = found.withColumnRenamed("key", "found_key")
    joined = keyed.join(found, (F.col("key") == F.col("found_key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", "text", "positions").mapInArrow(_strip(window, with_text), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string{', kept_text string' if with_text else ''}")
