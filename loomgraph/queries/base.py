"""The decorator that registers a query with its SQL, and the derived graphs the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import projection
from loomgraph.storage import materialize

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def g_customer_part(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customer-part pairs: a bipartite graph."""
    o, l = t(spark, d, "orders"), t(spark, d, "lineitem")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p")).distinct()


SQL_CUSTOMER_PART = "g1 AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def g_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """a < b suppliers of a common part, w = common parts; only pairs in the top 15 % by w (the graph is complete otherwise)."""
    return supplier_edges(spark, d).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")


def supplier_links(spark: SparkSession, d: str) -> DataFrame:
    """g_suppliers both ways, a row for each supplier with its neighbours (projection.LINKS), written."""
    return projection.heaviest(projection.links_met(t(spark, d, "lineitem"), "l_suppkey", "l_partkey"), 0.85)


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, w) of supplier_links, a row for each edge and direction."""
    return supplier_links(spark, d).select("src", F.explode(F.arrays_zip("dst", "w")).alias("e")).select("src", "e.dst", "e.w")


def copart_weights(spark: SparkSession, d: str) -> DataFrame:
    from loomgraph.operators.traverse import project_bipartite

    return project_bipartite(t(spark, d, "lineitem"), "l_suppkey", "l_partkey")


SQL_COPART = """
    sp AS (SELECT DISTINCT l_suppkey AS x, l_partkey AS via FROM lineitem),
    cw AS (SELECT l.x AS a, r.x AS b, count(*) AS w FROM sp l JOIN sp r ON l.via = r.via AND l.x < r.x GROUP BY 1, 2)"""
SQL_SUPPLIERS = SQL_COPART + """,
    g2 AS (SELECT a, b, w FROM cw WHERE w >= (SELECT quantile_cont(w, 0.85) FROM cw)),
    g2u AS (SELECT a AS src, b AS dst, w FROM g2 UNION ALL SELECT b, a, w FROM g2)"""


def g_nations(spark: SparkSession, d: str) -> DataFrame:
    """supplier nation -> customer nation, w = lines, no loops, top 15 % by w."""
    o, l, s, c = (t(spark, d, n) for n in ("orders", "lineitem", "supplier", "customer"))
    e = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    w = materialize(e.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("w")).where("src <> dst"), "nations")
    cut = w.agg(F.percentile("w", F.lit(0.85)).alias("cut")).select("cut").scalar()
    return w.where(F.col("w") >= cut)


SQL_NATIONS = """
    nw AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS w
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
    g3 AS (SELECT src, dst, w FROM nw WHERE w >= (SELECT quantile_cont(w, 0.85) FROM nw))"""
