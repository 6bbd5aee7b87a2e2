"""The property graph over relational tables: customers, orders, parts, suppliers, nations, regions, users and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.graph import PropertyGraph

#: Ids of a label are its keys plus the label's number times SPACE.
SPACE = 1 << 40
NUMBER = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Event": 8, "Doc": 9}


def node_id(label: str, key: str):
    return F.col(key).cast("long") + NUMBER[label] * SPACE


def key_of(column):
    """The table's key of a node id."""
    return column % SPACE


def _nodes(df: DataFrame, label: str, key: str, **props: str) -> tuple[str, DataFrame]:
    return label, df.select(node_id(label, key).alias("id"), F.col(key).cast("long").alias("key"), *[F.expr(e).alias(name) for name, e in props.items()])


#: Schemas are given, not inferred: opening the graph reads no footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
_OPENED: dict[tuple, PropertyGraph] = {}


def commerce_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Scans only what a query uses: labels and types are literals of their branch. Texts are taken as they are. A session opens a folder once."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _OPENED:
        _OPENED.clear()
        _OPENED[key] = _open(spark, sf_dir)
    return _OPENED[key]


def _open(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = {n: spark.read.schema(schema).parquet(f"{sf_dir}/{n}.parquet") for n, schema in SCHEMAS.items()}
    nodes = [
        _nodes(t["region"], "Region", "r_regionkey", name="r_name"),
        _nodes(t["nation"], "Nation", "n_nationkey", name="n_name"),
        _nodes(t["customer"], "Customer", "c_custkey", name="c_name", acctbal="c_acctbal", segment="c_mktsegment"),
        _nodes(t["supplier"], "Supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
        _nodes(t["part"], "Part", "p_partkey", name="p_name", brand="p_brand", kind="p_type", size="cast(p_size as long)", price="p_retailprice"),
        _nodes(t["orders"], "Order", "o_orderkey", status="o_orderstatus", total="o_totalprice", placed="unix_millis(cast(o_orderdate as timestamp))", priority="o_orderpriority"),
        _nodes(t["events"], "Event", "event_id", kind="event_type", value="value", at="unix_millis(cast(ts as timestamp))"),
        ("User", t["events"].select(node_id("User", "user_id").alias("id"), F.col("user_id").alias("key")).distinct()),
    ]

    def rels(df: DataFrame, src: tuple[str, str], dst: tuple[str, str], pos: str, **props: str) -> DataFrame:
        return df.select(F.expr(pos).alias("pos"), node_id(*src).alias("src"), node_id(*dst).alias("dst"), *[F.expr(e).alias(name) for name, e in props.items()])

    line = "l_orderkey * 16 + l_linenumber"
    edges = [
        ("IN_REGION", rels(t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "cast(n_nationkey as long)")),
        ("IN_NATION", rels(t["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), f"c_custkey + {SPACE}")),
        ("IN_NATION", rels(t["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), f"s_suppkey + {2 * SPACE}")),
        ("PLACED", rels(t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey"), f"o_orderkey + {3 * SPACE}")),
        ("CONTAINS", rels(t["lineitem"], ("Order", "l_orderkey"), ("Part", "l_partkey"), f"{line} + {4 * SPACE}", quantity="l_quantity", price="l_extendedprice", discount="l_discount", flag="l_returnflag")),
        ("SUPPLIED", rels(t["lineitem"], ("Supplier", "l_suppkey"), ("Part", "l_partkey"), f"{line} + {5 * SPACE}", quantity="l_quantity")),
        ("DID", rels(t["events"], ("User", "user_id"), ("Event", "event_id"), f"event_id + {6 * SPACE}")),
    ]
    return PropertyGraph.from_parts(nodes, edges, blanks=False)
