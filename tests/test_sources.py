"""Reading and writing graphs."""

import gzip
import re

import pytest

from meshlark.graph import PropertyGraph
from meshlark.plans.match import match
from meshlark.sources import graphalytics, nquads
from meshlark.sources.store import GraphStore
from meshlark.streaming.ingest import append_rels, match_hop
from tests import graphs

XSD = "http://www.w3.org/2001/XMLSchema#"
QUADS = f"""# people
<http://x/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/Person> .
<http://x/a> <http://x/name> "Al \\"A\\" \\\\ B" .
<http://x/a> <http://x/name> "second" .
<http://x/a> <http://x/age> "30"^^<{XSD}integer> .

<http://x/a> <http://x/knows> <http://x/b> <http://x/g1> .
<http://x/g1> <http://x/since> "1.5"^^<{XSD}double> .
<http://x/b> <http://x/nick> "bé"@fr .
"""


def test_nquads(spark, tmp_path):
    (tmp_path / "g.nq").write_text(QUADS, encoding="utf-8")
    with gzip.open(tmp_path / "z.nq.gz", "wt", encoding="utf-8") as f:
        f.write(QUADS)
    for name in ("g.nq", "z.nq.gz"):
        g = nquads.read_graph(spark, f"file://{tmp_path}/{name}")
        a = g.find("uri", "http://x/a").first()
        assert (a.labels, a.name, a.age) == (["Person"], 'Al "A" \\ B', 30)
        rel = g.rels.first()
        assert g.node_count() == 2 and (rel.type, rel.since) == ("knows", 1.5)
        assert g.find("uri", "http://x/b").first().nick == "bé"
    out = f"file://{tmp_path}/out"
    nquads.write_graph(g, out, compress=True)
    again = nquads.read_graph(spark, out)
    keep = lambda x: (sorted(map(str, x.nodes.select("uri", "labels", "name", "age", "nick").collect())), [(r.type, r.since) for r in x.rels.collect()])
    assert keep(again) == keep(g)
    (tmp_path / "bad.nq").write_text("<a> <b> .\n")
    with pytest.raises(Exception, match="not a statement"):
        nquads.read_quads(spark, f"file://{tmp_path}/bad.nq").collect()


def test_nquads_escapes_and_names(spark, tmp_path):
    lines = [r'<http://x/a> <http://x/name> "caf\u00e9 \U0001F600 \t\b\f\n\\u0041 \'" .', '<http://x/\\u00e9> <http://x/name> "\x01 plain" .']
    (tmp_path / "e.nq").write_text("\n".join(lines) + "\n", encoding="utf-8")
    g = nquads.read_graph(spark, f"file://{tmp_path}/e.nq")
    assert g.find("uri", "http://x/a").first().name == "café \U0001F600 \t\b\f\n\\u0041 '"
    assert g.find("uri", "http://x/é").first().name == "\x01 plain"


def test_nquads_keep_the_writers_ids_and_names(spark, tmp_path):
    nodes = spark.createDataFrame([(7, ["A/B#c"], "x", 1), (12, ["D >"], "y", 2)], ["id", "labels", "a/b", "n"])
    rels = spark.createDataFrame([(0, 12, 7, "is/of", 0.5)], ["pos", "src", "dst", "type", "w 1"])
    g = PropertyGraph.from_frames(nodes, rels)
    nquads.write_graph(g, f"file://{tmp_path}/w")
    again = nquads.read_graph(spark, f"file://{tmp_path}/w")
    assert sorted(map(tuple, again.nodes.select("id", "labels", "`a/b`", "n").collect())) == [(7, ["A/B#c"], "x", 1), (12, ["D >"], "y", 2)]
    assert [tuple(r) for r in again.rels.select("src", "dst", "type", "`w 1`").collect()] == [(12, 7, "is/of", 0.5)]


def test_store_and_versions(spark, tmp_path):
    store, g = GraphStore(spark, f"file://{tmp_path}/s"), graphs.social(spark)
    assert store.versions() == []
    store.save(g, "v1")
    store.save(g)
    assert store.versions() == ["latest", "v1"]
    loaded = store.load("v1")
    assert loaded.rel_count("KNOWS") == 7 and match(loaded).node("a", name="Alice").hop("a", "WORKS_AT", "c").df.count() == 1
    plan = loaded.rel_scan("KNOWS")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*type#\d+[^]]*KNOWS", plan), plan
    store.save(loaded, "v1")  # onto itself, while it is being read
    assert store.load("v1").rel_count() == loaded.rel_count() == g.rel_count()
    store.tidy("v1")
    assert store.load("v1").node_count() == g.node_count()
    with pytest.raises(FileNotFoundError):
        store.load("none")
    assert store.remove("v1") and store.versions() == ["latest"]
    with pytest.raises(ValueError):
        store.load("../x")


def test_graphalytics(spark, tmp_path):
    (tmp_path / "t.v").write_text("1\n2\n5\n")
    (tmp_path / "t.e").write_text("1 2 0.5\n2 5 1.5\n")
    g = graphalytics.read_graph(spark, f"file://{tmp_path}/t", weighted=True)
    assert g.node_count() == 3 and [r.weight for r in g.rels.orderBy("pos").collect()] == [0.5, 1.5]


def test_streamed_relationships(spark, tmp_path):
    g = graphs.social(spark)
    g.rels.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(g.rels.schema).parquet(f"{tmp_path}/in")
    append_rels(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    q = match_hop(stream, g, ("name",)).writeStream.format("memory").queryName("hops").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hops").where("name = 'Alice'").count() == 3


def test_graphalytics_parameters(spark, tmp_path):
    (tmp_path / "x.properties").write_text("# a comment\ngraph.x.directed = True\ngraph.x.algorithms = bfs, PR ,\ngraph.x.bfs.source-vertex = 7\ngraph.x.pr.damping-factor=0.85\ngraph.x.cdlp.max-iterations = ten\nother=1\n")
    assert graphalytics.read_parameters(spark, f"file://{tmp_path}/x") == {"directed": True, "algorithms": ["bfs", "pr"], "bfs.source-vertex": 7, "pr.damping-factor": 0.85}
    assert graphalytics.read_parameters(spark, f"file://{tmp_path}/none") == {}
