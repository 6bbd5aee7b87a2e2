"""SimHash, MinHash, embeddings and substrings against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from meshlark.llm import embeddings, minhash, simhash, substrings

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30, 90):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return [*rows, (90, None), (91, ""), (92, "one"), (93, "One \t"), (94, base[0]), (95, base[0].upper()), (0, base[0])]


def flat(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def simhash_of(text):
    words = flat(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> k & 1 for h in hashes) * 2 > len(hashes)) << k for k in range(64))


def groups_of(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def test_simhash_components(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")).collect()
    marks = [simhash_of(t) for _, t in rows]
    roots = groups_of(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    want = sorted((i, f"{m:016x}", min(rows[k][0] for k in range(len(rows)) if roots[k] == r)) for (i, _), m, r in zip(rows, marks, roots, strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_null_ids_and_empty(spark):
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "q r s t u")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 5), (5, 5)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("tile", [2, 7, 8192])
def test_links_connect_alike_whatever_the_tile(spark, tile):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    marks = set()
    for s in seeds:
        for _ in range(40):
            marks.add(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    links = simhash.fingerprint_links(spark.createDataFrame([(m,) for m in signed], "fp long"), tile=tile).collect()
    at = {m: i for i, m in enumerate(signed)}
    assert all((marks[at[r.a]] ^ marks[at[r.b]]).bit_count() <= 4 for r in links)
    want = groups_of(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    pairs = {(at[r.a], at[r.b]) for r in links}
    have = groups_of(list(range(len(marks))), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert len({*zip(want, have, strict=True)}) == len({*want}) == len({*have})


def test_block_choices_cover_close_pairs():
    masks = [m & (1 << 64) - 1 for _, m in simhash.block_keys()]
    rng = random.Random(2)
    for _ in range(2000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not d & m for m in masks)


def jaccard(a, b):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def five_word_likeness(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_wide_search_finds_likeness_of_four_fifths_and_leaves_the_unlike(spark):
    rng = random.Random(21)
    texts, alike, unlike = [], [], []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.2):
            edited = [w if rng.random() > share else f"w{rng.randrange(5000)}" for w in words]
            likeness = five_word_likeness(texts[-1], " ".join(edited))
            (alike if likeness >= 0.8 else unlike if likeness < 0.6 else []).append((" ".join(words), " ".join(edited)))
    pairs = alike + unlike
    docs = spark.createDataFrame([(2 * i + side, pair[side]) for i, pair in enumerate(pairs) for side in (0, 1)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.representatives(docs.where("doc_id % 2 = 0").union(docs.where("doc_id % 2 = 1"))).collect()}
    firsts = {}
    for i, (a, _) in enumerate(pairs):
        firsts.setdefault(a, 2 * i)
    assert {d for d in kept if d % 2 == 0} == set(firsts.values())  # originals: copies of one text are one
    missed = [i for i in range(len(alike)) if 2 * i + 1 in kept and pairs[i][0] != pairs[i][1]]
    assert len(alike) > 100 and len(missed) <= 0.06 * len(alike)
    assert len(unlike) > 80 and all(2 * i + 1 in kept for i in range(len(alike), len(pairs)))


@pytest.mark.parametrize("tile", [8192, 5])
def test_wide_search_equals_brute_force_where_pairs_are_close(spark, tile):
    rng = random.Random(5)
    texts = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(400)]
        texts += [" ".join(words[:k] + [f"new{rng.random()}"] + words[k:]) for k in rng.sample(range(400), 12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (900, ""), (901, None), (3, texts[3]), (3, "another text with this id"), (950, "x" * 300000)]
    kept = simhash.representatives(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string"), tile=tile)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([0, 12, 24, 36, 48, 60, 900, 3, 950])
    assert simhash.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_fingerprint_is_that_of_plain_loops():
    assert not simhash.wide_fingerprint(None).any() and not simhash.wide_fingerprint(" \t").any()
    from meshlark.llm.minhash import _mixed, shingle_hashes, word_hashes

    for text in ("One two", " ".join(f"w{i % 70}" for i in range(900))):
        words = text.lower().encode().split()
        with np.errstate(over="ignore"):
            hashes = {int(shingle_hashes(word_hashes(b" ".join(words[i : i + 5])))[0]) for i in range(max(1, len(words) - 4))}
            want = []
            for w in range(simhash.WIDE):
                mixed = [int(_mixed(np.array([h], np.uint64) + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % 2**64))[0]) for h in hashes]
                want.append(sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed)))
        assert simhash.wide_fingerprint(text).tolist() == want


def test_hot_component_and_fingerprint_are_named_whole(spark):
    rows = [(i, "same words in all of these texts") for i in range(3000)] + [(5000 + i, f"a lone text {i} of its own kind {i * 7}") for i in range(50)]
    got = simhash.near_duplicates(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    assert len(got) == 3050 and all(r.component_id == 0 for r in got if r.doc_id < 3000)


def test_minhash_estimates_without_bias():
    rng, errors = random.Random(4), []
    for _ in range(150):
        n = rng.choice([30, 120, 700])
        a = prose(rng, n)
        words = a.split()
        cut = rng.randrange(n)
        b = " ".join(words[:cut] + prose(rng, n - cut).split())
        errors.append(minhash.likeness(minhash.minhash(a.encode()), minhash.minhash(b.encode())) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_fingerprint_rows(spark):
    rows = [(3, "c d e f g h"), (1, "a b c d"), (None, "x y"), (2, None), (7, ""), (5, "é" * 9 + " tail"), (5, "é" * 9 + " tail")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
    got = sorted(map(tuple, minhash.fingerprint_with_next(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "near_next").collect()), key=repr)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        cut = len(t) // 4
        mark = minhash.minhash(t.encode())
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest(), mark.hex() or "0" * 512, minhash.likeness(mark, minhash.minhash(after.encode()))))
    assert got == sorted(want, key=repr)
    assert minhash.fingerprint_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = minhash.fingerprint_with_next(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 12))
    x[40:70] = x[3] + rng.normal(size=(30, 12)) * 0.2
    x[100] = x[50] * 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(500, None), (501, [0.0] * 12), (502, [float("nan")] * 12), (503, []), (None, [1.0, 2.0]), (504, [1.0, None]), (0, [float(v) for v in x[0]])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, links int")
    got = embeddings.near_duplicates(df, block_rows=20).collect()
    assert len(got) == len(rows) + len(odd)
    u = np.concatenate([x, x[:1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    roots = groups_of(range(161), lambda a, b: near[a, b])
    ids = [*range(160), 0]
    want = sorted((ids[i], int(near[i].sum()), min(ids[k] for k in range(161) if roots[k] == roots[i])) for i in range(161))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 500) == want
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is not None and r.vec_id >= 500)
    assert [(r.component_id, r.kept) for r in got if r.vec_id is None] == [(None, False)]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_regions_that_cannot_link_are_not_dealt_to_each_other(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24)) * np.array([4.0] * 4 + [0.3] * 20)
    x = np.repeat(centres, 40, 0) + rng.normal(size=(480, 24)) * rng.choice([0.02, 0.25], size=(480, 1))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    vectors = df.mapInArrow(embeddings._read, "vec_id long, vector binary, dim int").withColumnRenamed("vec_id", "row_id")
    found = spark.sparkContext.broadcast(embeddings.spaces(vectors, 24))
    plan = embeddings.block_plan(embeddings.region_boxes(vectors, found), 0.9, 20)
    blocks = sum(p[3] for p in plan)
    dealt = sum(p[3] * sum(last - first + 1 for first, last in p[4]) for p in plan)
    assert blocks >= 24 and dealt < 0.6 * blocks * blocks
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    roots = groups_of(range(480), lambda a, b: near[a, b])
    least = {}
    for i in range(480):
        least.setdefault(roots[i], i)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block_rows=20).collect())
    assert got == [(i, int(near[i].sum()), least[roots[i]]) for i in range(480)]


def test_cosine_at_the_threshold_is_decided_in_full_precision():
    a = np.array([[1.0, 0.0], [0.9, np.sqrt(1 - 0.81)], [0.8999999, np.sqrt(1 - 0.8999999**2)]])
    links, _ = embeddings.cell_links(a, None, np.eye(2), 0.9)
    exact = a @ a.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(a, axis=1))
    assert links.tolist() == [(int((exact[i] >= 0.9).sum()) - 1) for i in range(3)]


def stripped(rows, window):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i is None, i or 0))
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i is None, i or 0):
                gone[k : k + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk, group, shard", [(2_000_000, 1 << 20, 12_000_000), (300, 500, 2000)])
def test_substrings(spark, monkeypatch, chunk, group, shard):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(0, 40)) + " \n" + (passage if i % 3 == 0 else "") + "\t" + prose(rng, rng.randint(5, 30))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, passage), (None, passage), (62, rows[0][1]), (0, rows[0][1]), (63, (prose(rng, 20) + " ") * 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    got = substrings.dedup_substrings(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == stripped(rows, 13)


def test_substrings_of_nothing(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_CELLS", 16)
    rng = random.Random(11)
    rows = [(i, prose(rng, 40)) for i in range(20)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == stripped(rows, 13)


def test_exact_copies_spread_over_buckets_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 300)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 500)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 2000)
    rng = random.Random(12)
    copied = prose(rng, 30)
    rows = [(i, copied if i % 3 == 0 else prose(rng, 20)) for i in range(240)]
    rows += [(None, copied)] * 20
    seen, inner = [], substrings._resolve

    def traced(buckets):
        seen.append(buckets)
        return inner(buckets)

    monkeypatch.setattr(substrings, "_resolve", traced)
    monkeypatch.setattr(substrings, "_gather", _bucket_sizes)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, key int").repartition(3)
    sizes = substrings.repeated_windows(df).collect()
    held = {}
    for r in sizes:
        documents = np.frombuffer(r.positions, np.int64).tolist()
        for d in documents:
            assert held.setdefault(d, r.key) == r.key
    copies = {i for i, t in rows[1:240] if t == copied} | {np.iinfo(np.int64).max}
    assert set(held) == copies and seen[0] > 5
    assert max(len(np.frombuffer(r.positions, np.int64)) for r in sizes) < len(copies) / 2


def _bucket_sizes(key, table):
    ids = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]))
    return pa.table({"id": pa.array([len(ids)], pa.int64()), "key": pa.array([key[0].as_py()], pa.int32()), "positions": pa.array([ids.tobytes()], pa.binary())})


def test_tiles_of_a_long_run_do_not_deal_all_fingerprints_again(spark):
    fps = sorted({(7 << 40) ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12, 24)} | {random.Random(5).getrandbits(62) for _ in range(50)})
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=16)
    assert links._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 1  # of tiles, not of blocks
    close = groups_of(fps, lambda x, y: (x ^ y).bit_count() <= simhash.DISTANCE)
    parts = {x: {x} for x in fps}
    for r in links.collect():
        assert (r.a ^ r.b).bit_count() <= simhash.DISTANCE
        whole = parts[r.a] | parts[r.b]
        parts.update(dict.fromkeys(whole, whole))
    assert len({frozenset(p) for p in parts.values()}) == len(set(close))
