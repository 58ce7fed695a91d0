"""Graphs derived from the driver's tables, and the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.runtime import in_order


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Kinds of commerce vertices: an id is key * 8 + kind.
CUSTOMER, ORDER, PART, SUPPLIER, NATION = range(5)
#: Edges, repeated ones counted, of a task that makes them distinct.
DEALT = 500_000


def _key(column: str, kind: int) -> Column:
    return F.col(column).cast("long") * 8 + kind


def commerce(spark: SparkSession, sf_dir: str) -> Graph:
    """nation -> customer -> order -> part -> supplier -> nation."""
    t = lambda name: read(spark, sf_dir, name)
    vertex = lambda df, key, kind, label: df.select(_key(key, kind).alias("id"), label.alias("label"))
    vertices = (
        vertex(t("customer"), "c_custkey", CUSTOMER, F.col("c_mktsegment"))
        .unionByName(vertex(t("orders"), "o_orderkey", ORDER, F.col("o_orderpriority")))
        .unionByName(vertex(t("part"), "p_partkey", PART, F.col("p_brand")))
        .unionByName(vertex(t("supplier"), "s_suppkey", SUPPLIER, F.lit("SUPP")))
        .unionByName(vertex(t("nation"), "n_nationkey", NATION, F.col("n_name")))
    )
    edge = lambda df, a, ka, b, kb: df.select(_key(a, ka).alias("src"), _key(b, kb).alias("dst"))
    line = t("lineitem")
    edges = (
        edge(t("customer"), "c_nationkey", NATION, "c_custkey", CUSTOMER)
        .unionByName(edge(t("orders"), "o_custkey", CUSTOMER, "o_orderkey", ORDER))
        .unionByName(edge(line, "l_orderkey", ORDER, "l_partkey", PART))
        .unionByName(edge(line, "l_partkey", PART, "l_suppkey", SUPPLIER))
        .unionByName(edge(t("supplier"), "s_suppkey", SUPPLIER, "s_nationkey", NATION))
    )
    # Dealt by their number: a task that merges small parts, as Spark sizes them, would hold tens of millions of edges.
    found = 2 * line.count() + t("orders").count() + t("customer").count()
    return Graph(vertices, edges.repartition(max(spark.sparkContext.defaultParallelism, found // DEALT + 1), "src", "dst").distinct())


COMMERCE_SQL = """
v AS (SELECT c_custkey::BIGINT * 8 AS id, c_mktsegment AS label FROM customer UNION ALL SELECT o_orderkey::BIGINT * 8 + 1, o_orderpriority FROM orders
  UNION ALL SELECT p_partkey::BIGINT * 8 + 2, p_brand FROM part UNION ALL SELECT s_suppkey::BIGINT * 8 + 3, 'SUPP' FROM supplier UNION ALL SELECT n_nationkey::BIGINT * 8 + 4, n_name FROM nation),
e AS MATERIALIZED (SELECT c_nationkey::BIGINT * 8 + 4 AS src, c_custkey::BIGINT * 8 AS dst FROM customer UNION SELECT o_custkey::BIGINT * 8, o_orderkey::BIGINT * 8 + 1 FROM orders
  UNION SELECT l_orderkey::BIGINT * 8 + 1, l_partkey::BIGINT * 8 + 2 FROM lineitem UNION SELECT l_partkey::BIGINT * 8 + 2, l_suppkey::BIGINT * 8 + 3 FROM lineitem UNION SELECT s_suppkey::BIGINT * 8 + 3, s_nationkey::BIGINT * 8 + 4 FROM supplier)
"""


def sessions(spark: SparkSession, sf_dir: str) -> Graph:
    """Each event leads to the next one of its user."""
    events = read(spark, sf_dir, "events")
    later = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select(F.col("event_id").alias("src"), later.alias("dst")).where("dst is not null")
    return Graph(events.select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), "props"), edges)


SESSIONS_SQL = """
v AS (SELECT event_id AS id, event_type AS label, props FROM events),
e AS MATERIALIZED (SELECT src, dst FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)
"""


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, labelled with their most frequent event type; each leads to the user of the next event of all."""
    events = read(spark, sf_dir, "events")
    rank = F.count("*") * 1000 + F.ascii("event_type")
    often = events.groupBy("user_id", "event_type").agg(rank.alias("rank"))
    vertices = often.groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "rank").alias("label"))
    # The next event stands one place on in a global order, which no single task makes.
    placed = in_order(events.select("event_id", "user_id"), "event_id").select("user_id", "index")
    edges = placed.select(F.col("user_id").alias("src"), (F.col("index") + 1).alias("index")).join(placed.select(F.col("user_id").alias("dst"), "index"), "index")
    return Graph(vertices, edges.where("src <> dst").select("src", "dst").distinct())


TRANSITIONS_SQL = """
v AS MATERIALIZED (SELECT user_id AS id, max_by(event_type, r) AS label FROM (SELECT user_id, event_type, count(*) * 1000 + ascii(event_type) AS r FROM events GROUP BY user_id, event_type) GROUP BY user_id),
e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY event_id) AS dst FROM events) WHERE dst <> src)
"""


def turns(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations, labelled with their role; each leads to the next of its conversation.

    A turn's id is its conversation times one more than the largest turn of all, plus the turn.
    """
    rows = read(spark, sf_dir, "conversations")
    most = rows.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0] + 1
    name = F.col("conv_id") * F.lit(most).cast("long") + F.col("turn")
    later = F.lead(name).over(W.partitionBy("conv_id").orderBy("turn"))
    edges = rows.select(name.alias("src"), later.alias("dst")).where("dst is not null")
    return Graph(rows.select(name.alias("id"), F.col("role").alias("label")), edges)


TURNS_SQL = """
t AS MATERIALIZED (SELECT conv_id * (SELECT max(turn) + 1 FROM conversations) + turn AS id, conv_id, turn, role FROM conversations),
v AS (SELECT id, role AS label FROM t),
e AS MATERIALIZED (SELECT src, dst FROM (SELECT id AS src, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM t) WHERE dst IS NOT NULL)
"""
