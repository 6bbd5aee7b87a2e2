"""Toxicity: bags of subword embeddings, averaged, under a linear softmax.

A word is a bag of its hashed character n-grams and of itself; its vector is
the mean of their embeddings, a text's vector SCALE times the mean of its words'
vectors and of NEUTRAL zero vectors, and a linear softmax over two classes reads
it. Words weigh log(1 + count), so that repeated lines do not drown the rest;
the zero vectors keep a text of a few words from being judged by one of them.
Embeddings and softmax are trained jointly by full-batch Adam in numpy, on the
driver. A misspelling never seen shares n-grams, and so vectors, with what was
seen.

The cut: a model of two thirds of the labelled rows gives margins of the other
third, and a logistic line through those, both classes weighing the same, tells
how margins are scaled and shifted so that 0.5 parts the classes out of sample.
A model of all rows then takes that line.

Learning takes at most SAMPLE labelled rows, those with the least xxhash64 of
doc_id, of the rows whose crc32(doc_id as text) modulo FOLDS is not 0, and stops
before their bags exceed SAMPLE_BYTES on the driver. Tasks turn texts into bags
of words; no text reaches the driver. Label rows of one id are learnt as toxic if
one of them is, and of several texts of one id the one with the least xxhash64 is
learnt. Words met in fewer than LEAST sampled rows teach nothing, but count in
the mean, unless a row has no others; when scoring, all words' n-grams count.
Only the text is an input. Scoring reads every word of every text, however long:
as the model is linear, a word adds a scalar, which each worker keeps for words it has met.

Nulls: a null text or label: the first scores as an empty text, the second is
not learnt from. A null id counts as the text `null` for the fold. An empty
text has the score that the softmax gives to the zero vector. With no label to
learn from every score is 0, with labels of one class only that class is certain.
Repeated rows give a row each. Empty tables give an empty result. Of extra
columns only those asked for are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.operators.cluster import discard, materialize

SAMPLE = 10_000
SAMPLE_BYTES = 48 << 20
FOLDS = 5
BUCKETS = 1 << 17
DIM = 4
SCALE = 50.0
NEUTRAL = 30.0
GRAMS = (3, 4, 5)
STEPS = 60
LEAST = 5
RATE = 0.05
DECAY = 3e-5
MOST_WORDS = 400_000


def normal(word: str) -> str:
    """Letters of a lower-case word; "" if it has none."""
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' bags, one after another, and the size of each bag.

    A bag holds the word between marks and the n-grams of that; all are hashed
    at once, as polynomials over code points.
    """
    joined = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = _ranges(sizes)
    word_at = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(points))  # characters to the end of the word
    with np.errstate(over="ignore"):
        powers = np.repeat(np.uint64(_BASE), int(sizes.max(initial=1)))
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        offset = np.arange(len(points)) - np.repeat(first, sizes)
        whole = np.add.reduceat(points * powers[offset], first) if len(words) else points
        ids, owners = [_mixed(whole, 0, buckets)], [np.arange(len(words))]
        value = np.zeros(len(points), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            value[: len(points) - n + 1] = value[: len(points) - n + 1] * np.uint64(_BASE) + points[n - 1 :]
            if n in GRAMS:
                inside = np.flatnonzero((left >= n) & (np.repeat(sizes, sizes) > n))
                ids.append(_mixed(value[inside], n, buckets))
                owners.append(word_at[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(ids)[order], np.bincount(owner, minlength=len(words))


_BASE = 0x100000001B3


def _mixed(value: np.ndarray, n: int, buckets: int) -> np.ndarray:
    value = (value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def bag(text: str | None) -> dict[str, int]:
    """Counts of the normalised words of a whole text."""
    counts: dict[str, int] = {}
    for met, n in Counter((text or "").lower().split()).items():
        w = normal(met)
        if w:
            counts[w] = counts.get(w, 0) + n
    return counts


def packed(counts: dict[str, int]) -> bytes:
    """A bag as bytes: words hold letters only, so a line break parts them."""
    return "\n".join(counts).encode() + b"\0" + np.array(list(counts.values()), np.int32).tobytes()


def unpacked(data: bytes) -> tuple[list[str], np.ndarray]:
    words, counts = data.split(b"\0", 1)
    return words.decode().split("\n") if words else [], np.frombuffer(counts, np.int32)


@dataclass
class Model:
    """What scoring needs: the softmax margin of each bucket's embedding, and the bias."""

    margin: np.ndarray
    bias: float


def weight(n: int) -> float:
    """What a word met n times weighs in its text's mean: repeated lines do not drown the rest."""
    return math.log1p(n)


def _ranges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]])


class Features:
    """The bags of all rows as flat arrays: words of rows, grams of words, and both the other way round."""

    def __init__(self, bags: list[bytes]):
        seen = Counter(w for b in bags for w in unpacked(b)[0])
        ids: dict[str, int] = {}
        of_doc, part, sizes, self.rows = [], [], [], []
        for row, data in enumerate(bags):
            words, counts = unpacked(data)
            weights = np.log1p(counts).astype(np.float32)
            total = weights.sum() + NEUTRAL
            known = [i for i, w in enumerate(words) if seen[w] >= LEAST] or list(range(len(words)))
            if known:
                of_doc.append(np.array([ids.setdefault(words[i], len(ids)) for i in known], np.int32))
                part.append(weights[known] / total)
                sizes.append(len(known))
                self.rows.append(row)
        if not sizes:
            return
        self.word_of, self.share = np.concatenate(of_doc), np.concatenate(part)
        self.doc_at = _ranges(np.array(sizes))
        grams, n_grams = subwords(list(ids))
        self.gram_at = _ranges(n_grams)
        self.used, self.gram_of = np.unique(grams, return_inverse=True)
        self.per_gram = np.repeat((1.0 / n_grams).astype(np.float32), n_grams)
        word_of_gram = np.repeat(np.arange(len(ids), dtype=np.int32), n_grams)
        by_bucket = np.argsort(self.gram_of, kind="stable")
        self.bucket_at = np.searchsorted(self.gram_of[by_bucket], np.arange(len(self.used)))
        self.back_word, self.back_share = word_of_gram[by_bucket], self.per_gram[by_bucket]
        by_word = np.argsort(self.word_of, kind="stable")
        self.word_at = np.searchsorted(self.word_of[by_word], np.arange(len(ids)))
        self.back_doc, self.back_part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_word], self.share[by_word]

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """The vector of each row; one dimension at a time keeps the temporaries at one float a gram."""
        out = np.empty((len(self.rows), vectors.shape[1]), np.float32)
        for d in range(vectors.shape[1]):
            words = np.add.reduceat(vectors[self.gram_of, d] * self.per_gram, self.gram_at)
            out[:, d] = np.add.reduceat(words[self.word_of] * self.share, self.doc_at) * SCALE
        return out

    def gradients(self, back: np.ndarray) -> np.ndarray:
        """The gradient of each bucket's embedding from those of the rows' vectors."""
        out = np.empty((len(self.used), back.shape[1]), np.float32)
        for d in range(back.shape[1]):
            words = np.add.reduceat(back[self.back_doc, d] * self.back_part, self.word_at)
            out[:, d] = np.add.reduceat(words[self.back_word] * self.back_share, self.bucket_at) * SCALE
        return out


def train(bags: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 1) -> Model:
    """Joint training of embeddings and softmax on packed bags."""
    if not labels:
        return Model(np.zeros(BUCKETS, np.float32), -math.inf)
    known = Features(bags)
    target = [labels[r] for r in known.rows]
    if len(set(target)) < 2:
        toxic = sum(labels) / len(labels)
        return Model(np.zeros(BUCKETS, np.float32), math.log((toxic + 1e-9) / (1 - toxic + 1e-9)))
    y = np.eye(2, dtype=np.float32)[np.array(target)]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(known.used), DIM)).astype(np.float32)
    weights = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.log(np.maximum(y.mean(0), 1e-6)).astype(np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, weights, bias)]
    for step in range(1, steps + 1):
        docs = known.means(vectors)
        logits = docs @ weights + bias
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        error = (prob - y) / len(y)
        slopes = (known.gradients(error @ weights.T) + DECAY * vectors, docs.T @ error, error.sum(0))
        for p, g, (m, v) in zip((vectors, weights, bias), slopes, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    margin = np.zeros(BUCKETS, np.float32)
    margin[known.used] = vectors @ (weights[:, 1] - weights[:, 0]) * SCALE
    return Model(margin, float(bias[1] - bias[0]))


def balanced_line(logits: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic line through (logit, label), both classes weighing the same; (1, 0) if it does not rise."""
    share = np.where(labels > 0, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    spread = max(float(logits.std()), 1e-9)
    x = np.stack([logits / spread, np.ones(len(logits))], 1)
    line = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (share * (p - labels)) + 1e-4 * line
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        line -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(line[0] / spread), float(line[1])) if line[0] > 0 else (1.0, 0.0)


def train_calibrated(bags: list[bytes], labels: list[int], steps: int = STEPS) -> Model:
    """A model of all rows whose 0.5 parts the classes as rows left out of a first model show."""
    held = range(0, len(bags), 3)
    rest = [i for i in range(len(bags)) if i % 3]
    line = (1.0, 0.0)
    if len({labels[i] for i in held}) == 2:
        first = train([bags[i] for i in rest], [labels[i] for i in rest], steps)
        words = WordMargins(first.margin)
        logits = np.array([_logit(dict(zip(*unpacked(bags[i]), strict=True)), words, first.bias) for i in held])
        line = balanced_line(logits, np.array([labels[i] for i in held], np.float64)) if np.isfinite(logits).all() else line
    model = train(bags, labels, steps)
    return Model(model.margin * np.float32(line[0]), model.bias * line[0] + line[1])


class WordMargins(dict):
    """Margin of a word as met, None for one without letters; dropped when MOST_WORDS are there."""

    def __init__(self, margin: np.ndarray):
        super().__init__()
        self.margin = margin

    def learn(self, words: Iterable[str]) -> None:
        """Add the words that are not there yet."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MOST_WORDS:
            self.clear()
            new = list(words)
        lettered = [(w, x) for w in new if (x := normal(w))]
        self.update(dict.fromkeys(new))
        if lettered:
            ids, sizes = subwords([x for _, x in lettered], len(self.margin))
            means = np.add.reduceat(self.margin[ids], _ranges(sizes)) / sizes
            self.update(zip((w for w, _ in lettered), means.tolist(), strict=True))


def _logit(counts: dict[str, int], words: WordMargins, bias: float) -> float:
    words.learn(counts.keys())
    total, below = 0.0, NEUTRAL
    for word, n in counts.items():
        w = weight(n)
        total += w * words[word]
        below += w
    return bias + total / below


def score(text: str | None, words: WordMargins, bias: float) -> float:
    """The softmax's probability of class 1 for a whole text, from the bag that learning takes of it."""
    logit = _logit(bag(text), words, bias)
    return 1 / (1 + math.exp(-logit)) if logit > -700 else 0.0


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS


def sampled_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` rows outside the held-out fold: place (the order they are taken in), doc_id, toxic, bag."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array((packed(bag(x.as_py())) for x in batch.column(4)), pa.binary())], ["place", "doc_id", "toxic", "text_key", "bag"])

    rows = rows.select("place", "doc_id", "toxic", F.xxhash64("text").alias("text_key"), "text").mapInArrow(bags, f"place long, doc_id {id_type}, toxic int, text_key long, bag binary")
    return rows.groupBy("place", "doc_id", "toxic").agg(F.min_by("bag", "text_key").alias("bag"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most `sample` labelled rows whose bags have at most `sample_bytes`."""
    rows = materialize(sampled_bags(docs, labels, sample), "toxicity-bags")
    bags, toxic, held = [], [], 0
    for r in rows.orderBy("place", "doc_id").toLocalIterator():
        held += len(r["bag"])
        if held > sample_bytes:
            break
        bags.append(bytes(r["bag"]))
        toxic.append(int(r["toxic"] > 0))
    discard(rows)
    return train_calibrated(bags, toxic)


_WORDS: dict[int, WordMargins] = {}


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] | list[str] = ("doc_id",), text_at: str | None = None) -> DataFrame:
    """The columns `keep` of docs and `score`, from `text`. text_at: the column of `keep` that is the text, if one is."""
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))
    fields = [docs.schema[c] for c in keep]
    at = keep.index(text_at) if text_at else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = shared.value
        key = zlib.crc32(margin.tobytes())
        if key not in _WORDS:
            _WORDS.clear()
            _WORDS[key] = WordMargins(margin)
        words = _WORDS[key]
        for batch in batches:
            scores = pa.array([score(x.as_py(), words, bias) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], [*keep, "_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    scored = (docs.select(*keep) if text_at else docs.select(*keep, F.col("text").alias("_scored_text"))).mapInArrow(run, f"{schema}, _score double")
    return scored.withColumnRenamed("_score", "score")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; a row per document."""
    scored = score_documents(docs, learn(docs, labels, sample))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
