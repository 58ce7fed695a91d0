"""Strong and strict simulation: matches that hold within a ball around a vertex.

A ball has the vertices within the pattern's diameter of its centre, whatever the direction of edges. Within each ball the greatest
dual simulation is taken; where it has the centre, the part of the match that hangs together with the centre is the answer. Balls
of strong simulation lie in the graph, those of strict simulation in the graph of dual matches, which is smaller.

All balls are worked on at once, as rows keyed by (centre, id): no task holds a ball. What a ball can match is a dual match of the
whole graph, so only such vertices are centres and members; others are just walked over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, Pattern
from graphloom.operators.simulate import HUB, HUBS, relation, surviving, useful
from graphloom.runtime import table


def diameter(pattern: Pattern) -> int:
    """The largest number of edges, in any direction, between two nodes; a pattern in several parts has none."""
    n = len(pattern.nodes)
    near = {q: {t for s, t in (*pattern.edges, *pattern.reversed().edges) if s == q} for q in range(n)}
    most = 0
    for q in range(n):
        seen, front, hops = {q}, {q}, 0
        while front := {t for s in front for t in near[s]} - seen:
            seen |= front
            hops += 1
        if len(seen) < n:
            raise ValueError("the pattern must hang together")
        most = max(most, hops)
    return most


class Adjacency:
    """(id, other) dealt for joins on id from step to step. A vertex of very many neighbours has them in several blocks, so that no
    task gets them all: rows that ask for it are sent to each of its blocks."""

    def __init__(self, pairs: DataFrame, hub: int = HUB, hubs: int = HUBS) -> None:
        per = pairs.groupBy("id").agg(F.count("*").alias("n"))
        total, top = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        limit = max(hub, total // hubs)
        # Fewer than `hubs` vertices are over the limit.
        self.hubs = F.broadcast(per.where(F.col("n") > limit).select("id", F.ceil(F.col("n") / limit).alias("blocks"))) if top > limit else None
        if self.hubs is None:
            self.pairs = pairs.select("id", "other").repartition("id").persist()
        else:
            block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("other"), F.col("blocks"))).cast("int")
            self.pairs = pairs.join(self.hubs, "id", "left").select("id", block.alias("block"), "other").repartition("id", "block").persist()

    def joined(self, rows: DataFrame) -> DataFrame:
        """rows (id, ...) with each neighbour `other`."""
        if self.hubs is None:
            return rows.join(self.pairs, "id")
        dealt = rows.join(self.hubs, "id", "left").withColumn("block", F.explode(F.sequence(F.lit(0), (F.coalesce("blocks", F.lit(1)) - 1).cast("int"))))
        return dealt.drop("blocks").join(self.pairs, ["id", "block"]).drop("block")

    def unpersist(self) -> None:
        self.pairs.unpersist()


def undirected(edges: DataFrame) -> DataFrame:
    """(id, other): each edge from both of its ends, once."""
    there, back = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")), edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    return there.unionByName(back).distinct()


def balls(edges: DataFrame, centres: DataFrame, radius: int, members: DataFrame | None = None) -> DataFrame:
    """(centre, id): the vertices within radius of each centre (id), over edges in any direction. With members (id), only those.

    A step joins the vertices that the last one reached. The last step walks to members only.
    """
    pairs = undirected(edges).persist()
    seen = table(centres.select(F.col("id").alias("centre"), "id").distinct(), "ball")
    front = seen
    for hop in range(radius):
        last = members is not None and hop == radius - 1
        way = Adjacency(pairs.join(members.select(F.col("id").alias("other")).distinct(), "other", "left_semi") if last else pairs)
        step = way.joined(front).select("centre", F.col("other").alias("id")).distinct()
        front = table(step.join(seen, ["centre", "id"], "left_anti"), "front")
        way.unpersist()
        seen = seen.unionByName(front)
    pairs.unpersist()
    return seen if members is None else seen.join(members.select("id").distinct(), "id", "left_semi").select("centre", "id")


def match_graph(graph: Graph, pattern: Pattern, state: DataFrame) -> DataFrame:
    """(src, dst): edges of the graph that stand for an edge of the pattern, between vertices of state (id, mask)."""
    return useful(graph.simple(), state, pattern)


def _ball_round(state: DataFrame, edges: DataFrame, needs: list[int], to: str, back: str) -> DataFrame:
    told = edges.join(state.select("centre", F.col("id").alias(to), "mask"), ["centre", to])
    below = told.groupBy("centre", F.col(back).alias("id")).agg(F.bit_or("mask").alias("below"))
    mask = surviving(needs, F.coalesce("below", F.lit(0).cast("long")))
    return state.join(below, ["centre", "id"], "left").select("centre", "id", mask.alias("mask")).where("mask <> 0")


def dual_in_balls(state: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """The greatest dual simulation of each ball: state (centre, id, mask) reduced, over edges (centre, src, dst)."""
    bits = F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))
    needs, behind = pattern.needs(), pattern.reversed().needs()
    count = state.agg(bits).first()[0]
    while any(needs):
        new = _ball_round(_ball_round(state, edges, needs, "dst", "src"), edges, behind, "src", "dst")
        state = table(new, "ball-state")
        left = state.agg(bits).first()[0]
        if left == count:
            break
        count = left
    return state


def around_centres(state: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """The rows of state (centre, id, mask) that edges of the match lead to from the centre, in any direction."""
    pairs = useful(edges, state, pattern, ("centre",))
    back = pairs.select("centre", F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = pairs.unionByName(back).distinct().persist()
    seen = front = table(state.where("id = centre").select("centre", "id"), "around")
    while not front.isEmpty():
        step = pairs.join(front.withColumnRenamed("id", "src"), ["centre", "src"]).select("centre", F.col("dst").alias("id")).distinct()
        front = table(step.join(seen, ["centre", "id"], "left_anti"), "around")
        seen = seen.unionByName(front)
    out = table(state.join(seen, ["centre", "id"], "left_semi"), "matched")
    pairs.unpersist()
    return out


def simulate_strong(graph: Graph, pattern: Pattern, *, strict: bool = False, include_isolated: bool = False) -> DataFrame:
    """(centre, q, id): for each ball whose centre is matched, the vertices that match query node q together with it.

    The pattern must hang together. strict: balls lie in the graph of dual matches instead of the graph. As a pattern that hangs
    together is matched whole or not at all by what hangs together with a matched centre, every ball that has rows has all nodes.
    """
    radius, n = diameter(pattern), len(pattern.nodes)
    state, _, found = relation(graph, pattern, include_isolated=include_isolated, dual=True)
    if not found:
        state = state.where(F.lit(False))
    matched = table(match_graph(graph, pattern, state), "match-graph")
    held = balls(matched if strict else graph.simple(), state.select("id"), radius, members=state.select("id"))
    rows = table(held.join(state, "id").select("centre", "id", "mask"), "balls")
    # Edges of a ball: edges of the match graph from a member, to another of the same ball.
    way = Adjacency(matched.select(F.col("src").alias("id"), F.col("dst").alias("other")))
    leading = way.joined(rows.select("centre", "id")).select("centre", F.col("id").alias("src"), F.col("other").alias("dst"))
    edges = table(leading.join(rows.select("centre", F.col("id").alias("dst")), ["centre", "dst"], "left_semi").select("centre", "src", "dst"), "ball-edges")
    way.unpersist()
    inner = dual_in_balls(rows, edges, pattern)
    # A ball whose centre is gone has no answer.
    alive = inner.join(inner.where("id = centre").select("centre"), "centre", "left_semi")
    out = around_centres(alive, edges, pattern)
    bits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit("mask", i) == 1)
    return out.select("centre", F.explode(bits).alias("q"), "id").select("centre", F.col("q").cast("int").alias("q"), "id")
