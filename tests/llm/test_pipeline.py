"""The pipeline against a version that does each stage in plain Python."""

import random

import corpus_pipeline
from meshlark.llm import pii, simhash, toxicity
from tests.llm.test_texts import labelled


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_keeps_what_plain_stages_keep(spark, tmp_path):
    rows = labelled(300)
    rng = random.Random(4)
    docs = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t, _ in rows]
    docs += [(1000 + i, d[1] + " write me@mail.org", "en", d[3], 0) for i, d in enumerate(docs[:40])]
    docs += [(2000, None, None, "a", None), (2001, "", "en", "b", 0), (None, "lonely words here", "en", "a", 3), docs[1], docs[2]]
    folder = str(tmp_path)
    write(spark, folder, docs, [(i, 1, y) for i, _, y in rows])
    read = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(read, spark.read.parquet(f"{folder}/labels.parquet"))
    words = toxicity.WordMargins(model.margin)
    clean = [d for d in docs if toxicity.score(d[1], words, model.bias) < 0.5]
    marks = [int.from_bytes(simhash.wide_fingerprint(d[1]).tobytes(), "little") for d in clean]
    parent = list(range(len(clean)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(clean)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= simhash.WIDE_DISTANCE:
                parent[root(i)] = root(j)
    best = {}
    for i, d in enumerate(clean):
        k, order = root(i), (d[0] is None, d[0] or 0)
        if k not in best or order < best[k][0]:
            best[k] = order, d
    kept = {d[0]: pii.redact(d[1]) for _, d in best.values()}
    docs_after = read
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs_after = corpus_pipeline.materialize(stage(spark, docs_after, folder), name)
    assert {r.doc_id: r.text for r in docs_after.collect()} == kept and docs_after.count() == len(best)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs_after, folder).collect()
    for r in mixed:
        whole = kept[r.doc_id].split()
        assert r.text == kept[r.doc_id] or r.text.split() == whole[: len(r.text.split())]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in packed) == sorted((r.doc_id or -1, len(r.text.split())) for r in mixed)


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
