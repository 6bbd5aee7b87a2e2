"""Token counts by a tokenizer compiled to finite-state machines.

Two deterministic transducers stand for a byte-level BPE tokenizer.

The first cuts a text into pre-tokens. It reads character classes and has eight
states; its transitions say whether a pre-token starts. A text is cut into
chunks, all chunks are read at once from all eight states, which gives each
chunk's state map, the maps are composed by a parallel prefix scan, and a
second reading from the state that holds at each chunk's start emits the
starts.

The second reads the bytes of a pre-token. Its states are the prefixes met so
far, each with the last token of the prefix's encoding, and each transition is
annotated with the change in the number of tokens. A prefix ends in exactly one
token t such that the encoding of what precedes it, followed by t, is itself an
encoding; and that holds when the last two tokens encode their concatenation.
So a new transition takes a few lookups; transitions are compiled when first
met, whole pre-tokens are kept as single transitions, and both tables are
dropped when they reach MOST_STATES, which costs time and never a count.

Character classes follow the Unicode version of the regex module; code points
that a library of an older version does not know may be classed differently.

Nulls: a null text counts as empty; a null id is returned as null. Repeated
rows give a row each; an empty table gives an empty result. Long texts are read
in windows cut where a pre-token always starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

MOST_STATES = 400_000
WINDOW = 1 << 20
CHUNK = 256
LIMIT = 1024

# Character classes as read from the text, before context is taken in.
LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE = range(6)
# Classes that the machine reads; RESET is added on the first character of a segment.
C_LETTER, C_NUMBER, C_OTHER, C_SHORT, C_LONG, C_LEAD, C_RUN, C_LAST = range(8)
RESET = 8
# States: fresh (nothing to join), inside letters, numbers, others, after a leading space, inside blanks, one or two letters of a contraction to go.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, LED, IN_BLANK, ONE_LEFT, TWO_LEFT = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token starts, by class * 8 + state."""
    nxt, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), np.uint8)
    joins = {C_LETTER: (IN_LETTER, {IN_LETTER, LED}), C_NUMBER: (IN_NUMBER, {IN_NUMBER, LED}), C_OTHER: (IN_OTHER, {IN_OTHER, LED}), C_SHORT: (ONE_LEFT, set()), C_LONG: (TWO_LEFT, set()), C_LEAD: (LED, set()), C_RUN: (IN_BLANK, {IN_BLANK}), C_LAST: (FRESH, set())}
    for c, (to, joined) in joins.items():
        nxt[c, :], nxt[c + RESET, :] = to, to
        for s in joined:
            starts[c, s] = 0
    for s in (IN_OTHER, LED):  # an apostrophe after others or a space is one of the others
        for c in (C_SHORT, C_LONG):
            nxt[c, s], starts[c, s] = IN_OTHER, 0
    for s, to in ((ONE_LEFT, FRESH), (TWO_LEFT, ONE_LEFT)):
        nxt[C_LETTER, s], starts[C_LETTER, s] = to, 0
    return nxt.ravel(), starts.ravel()


NEXT, STARTS = _machine()
_CLASSES: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point."""
    if not _CLASSES:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        table[0xD800:0xE000] = OTHER
        table[32], table[39] = SPACE, APOSTROPHE
        _CLASSES.append(table)
    return _CLASSES[0]


def machine_classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes with one or two characters of context. first: indices where segments begin."""
    n = len(points)
    raw = char_classes()[points]
    ends = np.zeros(n, bool)
    ends[first[1:] - 1] = True
    ends[n - 1] = True
    blank = (raw == SPACE) | (raw == BLANK)
    follows = np.zeros(n, bool)  # a character that is no blank follows in the segment
    follows[:-1] = ~blank[1:]
    follows &= ~ends
    out = raw.copy()
    out[raw == APOSTROPHE] = C_OTHER
    out[blank] = C_RUN
    last = blank & follows
    out[last & (raw == SPACE)] = C_LEAD
    out[last & (raw == BLANK)] = C_LAST
    quotes = np.flatnonzero((raw == APOSTROPHE) & ~ends)
    if len(quotes):
        one = points[quotes + 1]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = C_SHORT
        more = quotes[~ends[quotes + 1]]
        a, b = points[more + 1], points[more + 2]
        out[more[((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))]] = C_LONG
    out[first] += RESET
    return out


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of all maps before each one; maps[k, s] is the state after chunk k entered in state s."""
    scanned, step = maps.copy(), 1
    while step < len(scanned):
        later = np.take_along_axis(scanned[step:], scanned[:-step].astype(np.intp), axis=1)
        scanned[step:] = later
        step *= 2
    return np.concatenate([np.arange(8, dtype=np.uint8)[None, :], scanned[:-1]])


def pretoken_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Indices where pre-tokens start."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.full(-(-n // chunk) * chunk, C_OTHER, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(-1, chunk).T) * np.uint8(8)
    maps = np.repeat(np.arange(8, dtype=np.uint8)[None, :], columns.shape[1], axis=0)
    for column in columns:
        maps = NEXT[maps + column[:, None]]
    state = prefix_scan(maps)[:, FRESH]
    emitted = np.empty(columns.shape, np.uint8)
    for i, column in enumerate(columns):
        at = state + column
        emitted[i] = STARTS[at]
        state = NEXT[at]
    return np.flatnonzero(emitted.T.ravel()[:n])


class PretokenCounter(dict):
    """Tokens of a pre-token; entries are compiled when first asked for."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[int, int], tuple[int, int]], most: int = MOST_STATES):
        super().__init__()
        self.vocab, self.ranks, self.most = vocab, {p: r for p, (r, _) in ranks.items()}, most
        self.longest = max(map(len, vocab))
        self.made = {t: (r, *p) for p, (r, t) in ranks.items()}  # token -> rank of the merge that makes it, its parts
        self.pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.edges: dict[int, int] = {}  # state * 256 + byte -> state
        self.last, self.total = [-1], [0]  # by state: last token of the prefix; annotations summed along its path

    def _fits(self, left: int, right: int) -> bool:
        """Whether two tokens encode their concatenation.

        The merges that made the two are undone, the later one first. At no
        point may the pieces that then meet have a merge that would have come
        before the one just undone; of equal merges the one further left comes
        first.
        """
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2 * self.most:
                self.pairs.clear()
            before, none = float("inf"), (-1, 0, 0)
            while True:
                rank = self.ranks.get((left, right))
                if rank is not None and rank < before:
                    found = False
                    break
                a, b = self.made.get(left, none), self.made.get(right, none)
                if a[0] > b[0]:
                    before, left = a[0], a[2]
                elif b[0] >= 0:
                    before, right = b[0] + 1, b[1]
                else:
                    found = True
                    break
            self.pairs[key] = found
        return found

    def _step(self, word: bytes, i: int, lasts, totals) -> tuple[int, int]:
        """Last token and count of word[:i]; lasts(j) and totals(j) give those of word[:j]."""
        for j in range(max(0, i - self.longest), i):
            token = self.vocab.get(word[j:i])
            if token is not None and (j == 0 or self._fits(lasts(j), token)):
                return token, totals(j) + 1
        raise ValueError("a byte is missing in the vocabulary")

    def __missing__(self, text: str) -> int:
        word = text.encode()
        if len(word) > 64:  # too long to keep its prefixes
            last, total = [-1], [0]
            for i in range(1, len(word) + 1):
                t, n = self._step(word, i, last.__getitem__, total.__getitem__)
                last.append(t)
                total.append(n)
            return total[-1]
        if len(self.last) > self.most:
            self._reset()
        if len(self) > self.most:
            self.clear()
        edges, lasts, totals, path, state = self.edges, self.last, self.total, [0], 0
        for i, byte in enumerate(word, 1):
            edge = state << 8 | byte
            state = edges.get(edge)
            if state is None:
                t, n = self._step(word, i, lambda j: lasts[path[j]], lambda j: totals[path[j]])
                state = edges[edge] = len(lasts)
                lasts.append(t)
                totals.append(n)
            path.append(state)
        n = self[text] = totals[state]
        return n


def _alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary: printable Latin-1 bytes themselves, the others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return out


class CompiledTokenizer:
    """The machines of a byte-level BPE tokenizer file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE tokenizers compile")
        if pre.get("use_regex") is False or any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("pre-tokens without the pattern and added tokens that take blanks or whole words do not compile")
        alphabet = _alphabet()
        names = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {b: model["vocab"][t] for t, b in names.items() if t not in special}
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        self.special = sorted(special)
        self.words = PretokenCounter(vocab, ranks)

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of those there are."""
        parts, found = [text], 0
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        found = len(parts) - 1
        return [p for p in parts if p], found

    def windows(self, text: str) -> Iterator[str]:
        """The segment in windows; a cut lies before a space between two characters that are no blanks."""
        at = 0
        while len(text) - at > WINDOW:
            cut = text.find(" ", at + WINDOW)
            while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut >= len(text) - 1:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _count(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece; pieces are read together."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        joined = "".join(pieces)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = pretoken_starts(machine_classes(points, first))
        bounds = starts.tolist()
        bounds.append(len(joined))
        lookup = self.words.__getitem__
        counts = np.fromiter((lookup(joined[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)), np.int64, len(starts))
        return np.add.reduceat(counts, np.searchsorted(starts, first))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals = [0] * len(texts)
        pieces: list[str] = []
        owners: list[int] = []
        pending = 0
        for i, text in enumerate(texts):
            parts, totals[i] = self.segments(text)
            for part in parts:
                for piece in self.windows(part):
                    pieces.append(piece)
                    owners.append(i)
                    pending += len(piece)
                    if pending >= WINDOW:
                        self._settle(pieces, owners, totals)
                        pending = 0
        self._settle(pieces, owners, totals)
        return totals

    def _settle(self, pieces: list[str], owners: list[int], totals: list[int]) -> None:
        if pieces:
            for i, n in zip(owners, self._count(pieces).tolist(), strict=True):
                totals[i] += n
        pieces.clear()
        owners.clear()


_COMPILED: dict[int, CompiledTokenizer] = {}


def compiled(source: str) -> CompiledTokenizer:
    """The compiled tokenizer of this process; its tables serve all later tasks."""
    key = hash(source)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = CompiledTokenizer(source)
    return _COMPILED[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """docs: doc_id, text. A row per document: doc_id, n_bytes, n_tokens, over_limit.

    The tokenizer file is read once, on the driver, and its text broadcast: its
    size is that of one vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [x or "" for x in part.column(1).to_pylist()]
                tokens = tokenizer.count(texts)
                sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
