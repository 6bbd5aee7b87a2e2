"""Token counts against the library whose file is compiled."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshlark.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" the", "'re", "'s", "<|endoftext|>", "  ", "\n", "x", "don't", "'LL", "'", "''", "12", " 3", "é", "　", ".", "漢字", "\r\n", "Straße", "aaaa", "🙂", "\t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def compiled():
    return T.CompiledTokenizer(open(PATH, encoding="utf-8").read())


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts(library, compiled):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert compiled.count(texts) == counts(library, texts)


def test_chunk_maps_do_not_depend_on_the_cut(compiled):
    rng = random.Random(3)
    text = "".join(rng.choice(PIECES) for _ in range(3000)).replace("<|endoftext|>", "")
    points = T.np.frombuffer(text.encode("utf-32-le"), "<u4")
    classes = T.machine_classes(points, T.np.array([0]))
    whole = T.pretoken_starts(classes, chunk=1 << 20).tolist()
    assert all(T.pretoken_starts(classes, chunk=c).tolist() == whole for c in (1, 2, 7, 64, 256))


def test_long_texts_and_full_tables(library, monkeypatch):
    monkeypatch.setattr(T, "WINDOW", 200)
    small = T.CompiledTokenizer(open(PATH, encoding="utf-8").read())
    small.words.most = 50
    texts = ["word another " * 500, "a" * 3000 + "b" * 100, " " * 1000, "x\n\n y" * 300]
    assert small.count(texts) == counts(library, texts)


def test_rows(spark, library):
    rows = [(1, "Hello  world's", "clash"), (2, None, "clash"), (3, "", "clash"), (None, "é" * 10, None), (1, "Hello  world's", "clash"), (4, "tok " * 1100, None)]
    got = T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t, _), n in zip(rows, counts(library, [t or "" for _, t, _ in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
