"""The star schema of the test tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph


_KNOWN: dict[tuple[str, str], Graph] = {}


def star(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over a folder of tables; its declaration (schemas, no data) is kept for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        _KNOWN[key] = _declare(spark, sf_dir)
    return _KNOWN[key]


def _declare(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts, orders, users, events, documents, vectors and turns with their relationships."""
    read: dict = {}

    def t(name: str):
        if name not in read:
            read[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return read[name]

    g = Graph(spark)
    g.add_nodes("Region", t("region"), "r_regionkey", {"key": "r_regionkey", "name": "r_name"})
    g.add_nodes("Nation", t("nation"), "n_nationkey", {"key": "n_nationkey", "name": "n_name", "region": "n_regionkey"})
    g.add_nodes("Customer", t("customer"), "c_custkey", {"key": "c_custkey", "name": "c_name", "nation": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment"})
    g.add_nodes("Supplier", t("supplier"), "s_suppkey", {"key": "s_suppkey", "name": "s_name", "nation": "s_nationkey", "balance": "s_acctbal"})
    g.add_nodes("Part", t("part"), "p_partkey", {"key": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"})
    g.add_nodes("Order", t("orders"), "o_orderkey", {"key": "o_orderkey", "status": "o_orderstatus", "total": "o_totalprice", "priority": "o_orderpriority", "date": "o_orderdate"})
    g.add_nodes("User", t("events").select("user_id").distinct(), "user_id", {"key": "user_id"})
    g.add_nodes("Event", t("events"), "event_id", {"key": "event_id", "type": "event_type", "value": "value", "ts": "ts"})
    g.add_nodes("Document", t("documents"), "doc_id", {"key": "doc_id", "text": "text", "lang": "lang", "source": "source", "chars": "n_chars"})
    g.add_nodes("Vec", t("embeddings"), "vec_id", {"key": "vec_id", "embedding": "embedding", "group": "label"})
    turn = F.col("conv_id") * 65536 + F.col("turn")
    g.add_nodes("Turn", t("conversations"), turn, {"key": turn, "conv": "conv_id", "turn": "turn", "role": "role", "text": "text"})
    g.add_edges("IN_REGION", t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), key="n_nationkey")
    g.add_edges("IN_NATION", t("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), key="c_custkey")
    g.add_edges("BASED_IN", t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), key="s_suppkey")
    g.add_edges("PLACED", t("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), key="o_orderkey")
    g.add_edges("CONTAINS", t("lineitem"), ("Order", "l_orderkey"), ("Part", "l_partkey"), {"qty": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "flag": "l_returnflag", "status": "l_linestatus", "line": "l_linenumber"})
    g.add_edges("SUPPLIES", t("lineitem").select("l_suppkey", "l_partkey").distinct(), ("Supplier", "l_suppkey"), ("Part", "l_partkey"))
    g.add_edges("DID", t("events"), ("User", "user_id"), ("Event", "event_id"), {"ts": "ts"}, key="event_id")
    c = t("conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("before"), "turn").join(c.select("conv_id", F.col("turn").alias("before")), ["conv_id", "before"])
    g.add_edges("NEXT", nxt, ("Turn", F.col("conv_id") * 65536 + F.col("before")), ("Turn", F.col("conv_id") * 65536 + F.col("turn")), key=F.col("conv_id") * 65536 + F.col("turn"))
    return g
