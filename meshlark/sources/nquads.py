"""N-Quads and N-Triples, plain or gzip, to and from property graphs.

A triple whose predicate is rdf:type gives its subject a label, one with a
literal a property (of several values the first stands), one with a resource a
relationship. A named graph that names a single relationship carries its
properties: triples about that graph's name are theirs. Node IRIs of the writer
(`base` n/ id) give their nodes those ids back; all other nodes are numbered from
the next id on and keep their IRI as the property `uri`. Local names are what
follows the last / or #; the writer's own names are percent-encoded and come back
as they were. All escapes of literals and IRIs are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.graph import PropertyGraph, SchemaError
from meshlark.operators.cluster import materialize
from meshlark.operators.ranks import sharded_running

#: More property names than this are no table's columns.
MOST_PROPERTIES = 10_000
BASE = "urn:g/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
_TERM = r'(<[^>]*>|_:\S+)'
_OBJECT = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_QUAD = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_OBJECT}\s*{_TERM}?\s*\.\s*(?:#.*)?$"
_NUMBERS = ("integer", "int", "long", "double", "decimal", "float", "boolean")


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """line, s, p, o (resource), literal, datatype, g; lines that are no statement, but blank or a comment, raise."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).withColumn("line", F.monotonically_increasing_id())
    part = lambda i: F.regexp_extract("value", _QUAD, i)
    bare = lambda c: F.when(c.startswith("<"), unescape(F.regexp_extract(c, "^<(.*)>$", 1))).when(c != "", c)
    checked = lines.withColumn("value", F.when(F.col("value").rlike(_QUAD), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.col("value")))))
    raw = checked.select("line", bare(part(1)).alias("s"), bare(part(2)).alias("p"), part(3).alias("raw"), bare(part(4)).alias("g"))
    quoted = F.col("raw").startswith('"')
    body = unescape(F.regexp_extract("raw", r'^"((?:[^"\\]|\\.)*)"', 1))
    return raw.select("line", "s", "p", F.when(~quoted, bare(F.col("raw"))).alias("o"), F.when(quoted, body).alias("literal"), F.when(quoted, F.regexp_extract("raw", rf"\^\^<{XSD}(.*)>$", 1)).alias("datatype"), "g")


def unescape(text):
    """The escapes of literals and IRIs: t b n r f, quotes, backslash, u with four and U with eight hex digits; others stay."""
    one = {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f", '\\"': '"', "\\'": "'", "\\\\": "\\"}
    pieces = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def plain(piece):
        out = F.when(piece.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), F.decode(F.unhex(F.lpad(F.substring(piece, 3, 8), 8, "0")), "UTF-32"))
        for mark, char in one.items():
            out = out.when(piece == mark, F.lit(char))
        return out.otherwise(piece)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, plain), "")).otherwise(text)


def escape(text):
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, mark in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def local(iri, base: str = BASE):
    """What follows the last / or #; of the writer's IRIs, decoded."""
    name = F.regexp_extract(iri, r"([^/#]*)$", 1)
    return F.when(F.startswith(iri, F.lit(base)), F.url_decode(name)).otherwise(name)


def _wide(df: DataFrame, key: str) -> DataFrame:
    """A column a property, typed by its literals: the first value of each (key, property) stands."""
    first = df.groupBy(key, "name").agg(F.min_by(F.struct("literal", "datatype"), "line").alias("v")).select(key, "name", "v.*")
    kinds = {r["name"]: set(r["kinds"]) for r in first.groupBy("name").agg(F.collect_set("datatype").alias("kinds")).limit(MOST_PROPERTIES + 1).collect()}
    if len(kinds) > MOST_PROPERTIES:
        raise SchemaError(f"{len(kinds)} property names are more than {MOST_PROPERTIES}")
    wide = first.groupBy(key).pivot("name", sorted(kinds)).agg(F.first("literal")) if kinds else first.select(key).distinct()

    def typed(name: str):
        k = kinds[name]
        to = "long" if k <= {"integer", "int", "long"} else "double" if k <= {"integer", "int", "long", "double", "decimal", "float"} else "boolean" if k <= {"boolean"} else "string"
        return F.col(f"`{name}`").try_cast(to) if to != "string" else F.col(f"`{name}`")

    return wide.withColumns({n: typed(n) for n in kinds})


def read_graph(spark: SparkSession, path: str, base: str = BASE) -> PropertyGraph:
    """The property graph of a file or folder; ids that the writer's IRIs do not give follow the md5 of IRIs, so no task sorts them all."""
    quads = materialize(read_quads(spark, path), "quads")
    links = quads.where(F.col("o").isNotNull() & (F.col("p") != RDF_TYPE))
    single = links.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("at")).where("n = 1").select(F.col("g").alias("anchor"), "at")
    about = quads.where("literal is not null").join(single, F.col("s") == F.col("anchor"), "left")
    subjects = quads.join(single, F.col("s") == F.col("anchor"), "left_anti").select(F.col("s").alias("uri")).union(links.select("o")).distinct()
    own = F.regexp_extract("uri", rf"^{re.escape(base)}n/([0-9]{{1,18}})$", 1)
    given = subjects.withColumn("id", F.when(own != "", own).cast("long"))
    known = given.where("id is not null")
    next_id = known.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")).first()["n"]
    subjects = given.where("id is null").select("uri")
    hashed = subjects.withColumn("_md5", F.md5("uri")).withColumns({"_shard": F.substring("_md5", 1, 3), "_all": F.lit(0)})
    ids = materialize(sharded_running(hashed, ["_all"], "_shard", [F.col("_md5"), F.col("uri")], F.lit(1), "id").select("uri", (F.col("id") + next_id).alias("id")).unionByName(known), "quad-ids")
    labels = quads.where(F.col("p") == RDF_TYPE).groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set(local(F.col("o"), base))).alias("labels"))
    props = _wide(about.where("anchor is null").select(F.col("s").alias("uri"), local(F.col("p"), base).alias("name"), "literal", "datatype", "line"), "uri")
    nodes = ids.join(labels, "uri", "left").join(props, "uri", "left").withColumn("labels", F.coalesce("labels", F.expr("cast(array() as array<string>)")))
    nodes = nodes.withColumn("uri", F.when(~F.startswith("uri", F.lit(f"{base}n/")), F.col("uri")))
    rel_props = _wide(about.where("anchor is not null").select("at", local(F.col("p"), base).alias("name"), "literal", "datatype", "line"), "at")
    src, dst = ids.select(F.col("uri").alias("s"), F.col("id").alias("src")), ids.select(F.col("uri").alias("o"), F.col("id").alias("dst"))
    rels = links.join(src, "s").join(dst, "o").select(F.col("line").alias("at"), "src", "dst", local(F.col("p"), base).alias("type")).join(rel_props, "at", "left")
    return PropertyGraph.from_frames(nodes, rels.drop("at"))


def _literal(c: str, kind: str):
    suffix = {"bigint": "integer", "int": "integer", "double": "double", "boolean": "boolean"}.get(kind)
    return F.concat(F.lit('"'), escape(F.col(c).cast("string")), F.lit(f'"^^<{XSD}{suffix}>' if suffix else '"'))


def write_graph(graph: PropertyGraph, path: str, base: str = BASE, compress: bool = False) -> None:
    """Statements in one order: by node, then relationship; `uri` names a node that has it."""
    node = F.coalesce("uri", F.concat(F.lit(base), F.lit("n/"), F.col("id").cast("string"))) if "uri" in graph.nodes.columns else F.concat(F.lit(base), F.lit("n/"), F.col("id").cast("string"))
    named = graph.nodes.withColumn("_iri", node)
    iri = lambda name: F.concat(F.lit(f"<{base}"), F.url_encode(name), F.lit(">"))
    triple = lambda s, p, o: F.concat_ws(" ", s, p, o, F.lit("."))
    s = F.concat(F.lit("<"), F.col("_iri"), F.lit(">"))
    typed = named.withColumn("_label", F.explode("labels"))
    lines = [typed.select(F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("pos"), triple(s, F.lit(f"<{RDF_TYPE}>"), iri(F.col("_label"))).alias("value"))]
    for name, kind in graph.nodes.dtypes:
        if name not in ("id", "labels", "uri"):
            lines.append(named.where(F.col(f"`{name}`").isNotNull()).select(F.lit(0), "id", F.lit(0).cast("long"), triple(s, iri(F.lit(name)), _literal(f"`{name}`", kind))))
    ends = graph.rels.join(named.select(F.col("id").alias("src"), F.col("_iri").alias("_s")), "src").join(named.select(F.col("id").alias("dst"), F.col("_iri").alias("_d")), "dst")
    anchor = F.concat(F.lit(f"<{base}r/"), F.col("pos").cast("string"), F.lit(">"))
    link = F.concat_ws(" ", F.concat(F.lit("<"), F.col("_s"), F.lit(">")), iri(F.col("type")), F.concat(F.lit("<"), F.col("_d"), F.lit(">")), anchor, F.lit("."))
    lines.append(ends.select(F.lit(1), "src", "pos", link))
    for name, kind in graph.rels.dtypes:
        if name not in ("pos", "src", "dst", "type"):
            lines.append(ends.where(F.col(f"`{name}`").isNotNull()).select(F.lit(1), "src", "pos", triple(anchor, iri(F.lit(name)), _literal(f"`{name}`", kind))))
    out = lines[0]
    for more in lines[1:]:
        out = out.union(more)
    writer = out.orderBy("kind", "id", "pos", "value").select("value").write.mode("overwrite")
    (writer.option("compression", "gzip") if compress else writer).text(path)
