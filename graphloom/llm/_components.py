"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import cut, join_by_weight, tidy


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of the component, and each root has a row too.

    Each step is aggregations and joins on single nodes, of which those with very many edges are broadcast; the state is cut after
    each round, and the rounds end once all edges are stars: each points to a node that points to none. Loops and nulls are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    while True:
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up")))
        nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        odd = (F.col("up") > 1) | (F.col("up") > 0) & (F.col("up") < F.col("n"))
        total, top, left = nodes.agg(F.sum("up"), F.max("n"), F.count_if(odd)).first()
        if not left:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_by_weight(both, least, "a", "n", 2 * total, top).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # A node has at most as many smaller neighbours now as it had neighbours before.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        pairs = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = join_by_weight(large, low, "a", "n", 2 * total, top).select(F.explode(pairs).alias("x")).select("x.*").where("a <> b").distinct()
        e = cut(small, "edges", 2 * total)
    tidy(e.sparkSession)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
