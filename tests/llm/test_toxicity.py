"""The classifier against plain loops, and its accuracy at 0.5 on rows it has not seen."""

import os
import zlib

import numpy as np
import pytest

from meshlark.llm import toxicity
from tests.llm.test_texts import labelled


def dense(bags, least):
    """Mean bag of each row as one dense row over all buckets, by loops over words and their buckets."""
    seen = {}
    for b in bags:
        for w in b:
            seen[w] = seen.get(w, 0) + 1
    out = np.zeros((len(bags), toxicity.BUCKETS))
    for row, b in enumerate(bags):
        total = sum(np.log(1 + n) for n in b.values()) + toxicity.NEUTRAL
        for w in [w for w in b if seen[w] >= least] or list(b):
            buckets = toxicity.subwords([w])[0]
            for k in buckets:
                out[row, k] += np.log(1 + b[w]) / total / len(buckets)
    return out


def test_training_is_that_of_plain_loops():
    rows = labelled(60)
    bags = [toxicity.bag(t) for _, t, _ in rows]
    y = np.array([r[2] for r in rows])
    got = toxicity.train([toxicity.packed(b) for b in bags], y.tolist(), steps=12)
    full = dense(bags, toxicity.LEAST)
    used = np.flatnonzero(full.any(0))
    x, target = full[:, used], np.eye(2)[y]
    rng = np.random.default_rng(1)
    params = [rng.normal(0, 0.1, (len(used), toxicity.DIM)), rng.normal(0, 0.3, (toxicity.DIM, 2)), np.log(target.mean(0))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, 13):
        docs = x @ params[0] * toxicity.SCALE
        z = docs @ params[1] + params[2]
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        e = (p - target) / len(y)
        slopes = [x.T @ (e @ params[1].T) * toxicity.SCALE + toxicity.DECAY * params[0], docs.T @ e, e.sum(0)]
        for i, g in enumerate(slopes):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] - toxicity.RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    margin = np.zeros(toxicity.BUCKETS)
    margin[used] = params[0] @ (params[1][:, 1] - params[1][:, 0]) * toxicity.SCALE
    assert np.abs(got.bias - (params[2][1] - params[2][0])) < 0.02
    assert np.abs(full @ (got.margin - margin)).max() < 0.2 and np.corrcoef(full @ got.margin, full @ margin)[0, 1] > 0.999


def test_score_is_that_of_plain_loops():
    rng = np.random.default_rng(3)
    margin = rng.normal(0, 5, toxicity.BUCKETS).astype(np.float32)
    for text in [None, "", "one two two  Thr3ee ... four-five", "word " * 5000 + "other"]:
        b = toxicity.bag(text)
        logit = 0.3 + float(dense([b], 1)[0] @ margin) if b else 0.3
        assert abs(toxicity.score(text, toxicity.WordMargins(margin), 0.3) - 1 / (1 + np.exp(-logit))) < 1e-6


def test_bags_come_back_packed():
    for b in [{}, {"a": 1}, {"çé": 3, "word": 70000}]:
        words, counts = toxicity.unpacked(toxicity.packed(b))
        assert dict(zip(words, counts.tolist(), strict=True)) == b


def test_balanced_line_parts_classes_in_the_middle():
    rng = np.random.default_rng(5)
    z, y = np.concatenate([rng.normal(-9, 2, 900), rng.normal(-1, 2, 60)]), np.repeat([0.0, 1.0], [900, 60])
    slope, shift = toxicity.balanced_line(z, y)
    assert slope > 0 and abs(-shift / slope - -5) < 0.7
    assert toxicity.balanced_line(-z, y) == (1.0, 0.0)


def test_learning_bounds_bytes_and_takes_one_text_an_id(spark):
    rows = labelled(80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, "another text of this id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1)], "doc_id long, toxic int")
    got = toxicity.sampled_bags(docs, labels).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
    assert {r.toxic for r in got if r.doc_id == 1} <= {1}
    assert len(toxicity.sampled_bags(docs, labels, 10).collect()) == 10
    assert toxicity.learn(docs, labels, sample_bytes=0).bias == -np.inf  # no row fits: every score is 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_accuracy_at_one_half(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic").where("toxic is not null")
    rows = toxicity.toxicity(docs, labels).where("held_out").join(known, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    recall, false = sum(r.predicted for r in toxic) / len(toxic), sum(r.predicted for r in clean) / len(clean)
    print(f"recall {recall:.3f} of {len(toxic)}, false positives {false:.3f} of {len(clean)}")
    assert recall >= 0.87 and false <= 0.06
