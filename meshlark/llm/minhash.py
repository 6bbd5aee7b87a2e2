"""Document fingerprints: one-permutation MinHash with optimal densification.

Each shingle of five words is hashed once; the high bits of the hash name one
of BINS bins, and a bin keeps its least hash. An empty bin takes the value of a
bin that holds one, found by a walk of 2-universal hashes of (bin, attempt): the
walk is the same for all documents, so equal bins of two documents take from
the same places and stay comparable. The low BITS bits of each bin are packed.
Two fingerprints agree in a bin by chance with probability 2^-BITS, which the
estimate takes out: likeness = (agreeing share - 2^-BITS) / (1 - 2^-BITS), at
least 0.

A text of fewer than five words is one shingle; a text without words has the
fingerprint of zeros, and its likeness to another text is 1 if that has no
words either, else 0. Equal texts have equal fingerprints.

Nulls: a null text counts as empty. Null ids come before all others. Rows
alike in id follow the order of their texts' xxhash64. With one row that row is its own next. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.cluster import materialize

SHINGLE = 5
BINS = 512
BITS = 4
ATTEMPTS = 4096
_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD_BASE = 0x100000001B3
_SHINGLE_BASE = 0xD6E8FEB86659FD93
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64)]
_INVERSE = pow(_WORD_BASE, -1, 1 << 64)


def _powers(base: int, n: int, store: list) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and grown as needed."""
    if len(store[0]) < n:
        out = np.full(max(n, 2 * len(store[0])), base, np.uint64)
        out[0] = 1
        store[0] = np.cumprod(out, dtype=np.uint64)
    return store[0][:n]


_INVERSES = [np.ones(1, np.uint64)]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of a UTF-8 text, whatever blanks part them.

    Prefix sums of byte * base^position; the sum over a word, shifted back by
    the inverse power of its start, depends on the word alone.
    """
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANKS[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_WORD_BASE, len(raw), _POWERS), out=sums[1:], dtype=np.uint64)
    return _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw) + 1, _INVERSES)[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `shingle` words; of all words if there are fewer."""
    if not len(words):
        return words
    n = max(len(words) - shingle + 1, 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        total = total * np.uint64(_SHINGLE_BASE) + words[i : i + n]
    return _mixed(total * np.uint64(_MULTIPLIER))


_WALKS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def walks(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin to look at, by empty bin and attempt; attempt at which a bin is first looked at, by empty bin and bin.

    A bin that no attempt looks at comes after all that one does, in circular order.
    """
    if bins not in _WALKS:
        cell = np.arange(bins * ATTEMPTS, dtype=np.uint64) + np.uint64(1)
        paths = (_mixed(cell * np.uint64(_MULTIPLIER)) % np.uint64(bins)).astype(np.int16).reshape(bins, ATTEMPTS)
        every = np.arange(bins)
        first = (ATTEMPTS + (every[None, :] - every[:, None]) % bins).astype(np.int16)
        for a in range(ATTEMPTS - 1, -1, -1):
            first[every, paths[:, a]] = a
        _WALKS[bins] = paths, first
    return _WALKS[bins]


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """values with each empty bin filled from the first full bin on its walk."""
    (paths, first), places, empty = walks(len(values)), np.flatnonzero(filled), np.flatnonzero(~filled)
    out = values.copy()
    if len(places) > 64:
        looked = paths[empty, :16]
        full = filled[looked]
        found = full.any(1)
        out[empty[found]] = values[looked[found, full[found].argmax(1)]]
        empty = empty[~found]
    if len(empty):
        out[empty] = values[places[first[np.ix_(empty, places)].argmin(1)]]
    return out


def minhash(data: bytes, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> bytes:
    """Packed low bits of the densified bins of a UTF-8 text; b"" for a text without words."""
    with np.errstate(over="ignore"):
        hashes = shingle_hashes(word_hashes(data), shingle) if data else np.zeros(0, np.uint64)
    if not len(hashes):
        return b""
    shift = np.uint64(64 - bins.bit_length() + 1)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(bins, bool)
    where = (hashes >> shift).astype(np.intp)
    np.minimum.at(least, where, hashes)
    filled[where] = True
    low = (densified(least, filled) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]).tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated share of common shingles from two packed fingerprints, bias taken out."""
    if a == b or not a or not b:
        return float(a == b)
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(bins, bits).any(1)
    chance = 2.0**-bits
    return max(0.0, (float(bins - differ.sum()) / bins - chance) / (1 - chance))


NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_SCHEMA = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(text: str, mark: bytes, after: str, after_mark: bytes) -> tuple:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + after[:cut]
    data = edited.encode()
    other = minhash(data) if edited != text else mark
    return len(text), hashlib.sha256(data).digest(), mark, other, likeness(mark, other), likeness(mark, after_mark)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((squeeze((x.as_py() or "").encode()) for x in batch.column(2)), pa.binary())], ["doc_id", "key", "packed"])


def _read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range in order: a row (role 0) for each document but the last, the first text (1) and the last (2)."""
    held, expand = None, zstandard.ZstdDecompressor().decompress
    blank = (None,) * len(_KINDS)
    for batch in batches:
        ids, rows, texts, roles, parts = [], [], [], [], []
        for i in range(batch.num_rows):
            data = expand(batch.column(1)[i].as_py())
            own, text, part = batch.column(0).slice(i, 1), data.decode(), batch.column(2)[i].as_py()
            mark = minhash(data)
            if held:
                new = (held[0], _compared(held[1], held[2], text, mark), None, 0)
            else:
                new = (own, blank, text, 1)
            for store, value in zip((ids, rows, texts, roles), new, strict=True):
                store.append(value)
            parts.append(part)
            held = (own, text, mark, part)
        if rows:
            yield _table(ids, rows, texts, roles, parts)
    if held:
        yield _table([held[0]], [blank], [held[1]], [2], [held[3]])


def _table(ids, rows, texts, roles, parts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *_columns(rows), pa.array(texts, pa.string()), pa.array(roles, pa.int32()), pa.array(parts, pa.int32())], ["doc_id", *NAMES, "text", "role", "part"])


def _close_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, after): the last document of a range and the first text of the next."""
    for batch in batches:
        rows = [_compared(t or "", minhash((t or "").encode()), a or "", minhash((a or "").encode())) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows)], ["doc_id", *NAMES])


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row per document: doc_id and NAMES, fingerprints and sha256 in lower-case hex.

    Texts are shuffled once, by ranges of doc_id, and read in order. The last
    document of a range and the first of the next one meet in a second shuffle
    of two rows a range.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_packed, f"doc_id {id_type}, key long, packed binary")
    ordered = keyed.repartitionByRange("doc_id", "key")  # range bounds are sampled on the driver: no texts there
    ordered = ordered.sortWithinPartitions("doc_id", "key", "packed").select("doc_id", "packed", F.spark_partition_id().alias("part"))
    read = materialize(ordered.mapInArrow(_read_range, f"doc_id {id_type}, {_SCHEMA}, text string, role int, part int"), "minhash")
    done = read.where("role = 0").select("doc_id", *NAMES)
    firsts, lasts = read.where("role = 1").select("part", F.col("text").alias("after")), read.where("role = 2").select("part", "doc_id", "text")
    order = Window.orderBy("part")
    following = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    ends = lasts.join(following, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after")
    out = done.unionByName(ends.mapInArrow(_close_ranges, f"doc_id {id_type}, {_SCHEMA}"))

    def shown(c: str) -> Column:
        return F.when(F.length(c) > 0, F.lower(F.hex(c))).otherwise("0" * (BINS * BITS // 4)).alias(c)

    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), shown("fingerprint"), shown("edited_fingerprint"), "near_edited", "near_next")
