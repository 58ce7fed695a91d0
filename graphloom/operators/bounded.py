"""Bounded simulation: an edge of the pattern stands for a path of at most so many edges, or of any length.

A round spreads the surviving query nodes of vertices, as bits, backwards over edges: after k hops a vertex knows which query nodes
it reaches by paths of 1 to k edges. No pairs of vertices are made. For paths of any length chains of vertices with a single edge are
passed over first, in rounds that double how far is seen; over what is left bits are spread from vertices whose bits are new alone,
until none are. This is done only for query nodes that have lost a vertex in the round before.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, Pattern
from graphloom.operators.simulate import MAX_BITS, _Edges, _pairs, _start
from graphloom.runtime import table

#: A bound of any length.
ANY = None


def bounded_pattern(text: str) -> tuple[Pattern, list[int | None]]:
    """A pattern file whose edges may have a `bound`: a number of edges from 1 on, or "*"; without one it is 1."""
    raw = json.loads(text)
    bounds = [ANY if e.get("bound", 1) == "*" else int(e.get("bound", 1)) for e in raw.get("edge", ())]
    return Pattern.parse(text), bounds


def _zero():
    return F.lit(0).cast("long")


def _hop(edges: _Edges, masks: DataFrame) -> DataFrame:
    """(id, mask): the bits of a vertex's targets."""
    return edges.joined(masks).groupBy(F.col("src").alias("id")).agg(F.bit_or("mask").alias("mask"))


def within(edges: _Edges, masks: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """(id, reach_k for each bound k): the bits of masks (id, mask), of those that bounds[k] has, that a vertex has at the end of paths
    of 1 to k edges."""
    out, reach = None, None
    for k in range(1, max(bounds) + 1):
        # Bits to spread: those that vertices have themselves and those that they reach in fewer hops, as far as they are asked for.
        spread = masks if reach is None else masks.unionByName(reach)
        asked = F.col("mask").bitwiseAND(F.lit(reduce(int.__or__, (x for j, x in bounds.items() if j >= k))).cast("long"))
        spread = spread.select("id", asked.alias("mask")).where("mask <> 0")
        if reach is not None:
            spread = spread.groupBy("id").agg(F.bit_or("mask").alias("mask"))
        reach = table(_hop(edges, spread), "reach")
        if k in bounds:
            found = reach.withColumnRenamed("mask", f"reach_{k}")
            out = found if out is None else out.join(found, "id", "full")
    return out


def chains(singles: DataFrame, masks: DataFrame) -> DataFrame:
    """(id, mask, end) of vertices with a single edge (id, next): the bits of masks from the vertex on, up to and without the first
    vertex that is none of them, which is its end; null where there is none, but a cycle.

    Each round doubles how far a vertex has looked, so their number is the logarithm of the longest chain. The join is one of unique
    ids, which adaptive execution splits where very many look to one vertex.
    """
    looking = table(singles.join(masks, "id", "left").select("id", F.coalesce("mask", _zero()).alias("mask"), "next"), "chains")
    done = looking.select("id", "mask", F.col("next").alias("end")).where(F.lit(False))
    while True:
        known = looking.select("id", "mask", F.col("next").alias("to"), F.lit(True).alias("open")).unionByName(done.select("id", "mask", F.col("end").alias("to"), F.lit(False).alias("open")))
        seen = known.select(F.col("id").alias("next"), F.col("mask").alias("told"), "to", "open")
        mask = F.col("mask").bitwiseOR(F.coalesce("told", _zero()))
        step = table(looking.join(seen, "next", "left").select("id", mask.alias("mask"), F.coalesce("to", "next").alias("next"), F.coalesce("open", F.lit(False)).alias("open"), (mask != F.col("mask")).alias("new")), "chains")
        n_open, n_closed, n_new = step.agg(F.count_if("open"), F.count_if(~F.col("open")), F.count_if("new")).first()
        looking = step.where("open").select("id", "mask", "next")
        done = done.unionByName(step.where("not open").select("id", "mask", F.col("next").alias("end")))
        # On a chain that ends some vertex gets to the end in each round; where none does all lead to cycles.
        if not n_open or not n_closed and not n_new:
            return done.unionByName(looking.select("id", "mask", F.lit(None).cast("long").alias("end")))


def anywhere(edges: _Edges, masks: DataFrame) -> DataFrame:
    """(id, mask): the bits that a vertex has at the end of paths of any length from 1 on.

    Vertices with one edge are passed over, so that a long chain takes few rounds. Among the others a hop joins the bits that are new alone.
    """
    ways = table(edges.source.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("next")), "ways")
    found = chains(ways.where("n = 1").select(F.col("src").alias("id"), "next"), masks)
    forks = ways.where("n > 1").select("src")
    held = masks
    if not forks.isEmpty():
        # An edge of a fork leads to where the chain that it begins ends, and tells what that chain has.
        to = F.when(F.col("chain"), F.col("end")).otherwise(F.col("dst"))
        led = edges.source.join(forks, "src", "left_semi").join(found.select(F.col("id").alias("dst"), "mask", "end", F.lit(True).alias("chain")), "dst", "left")
        led = table(led.select("src", to.alias("dst"), F.coalesce("mask", _zero()).alias("mask")), "forks")
        core = _Edges(led.select("src", "dst").where("dst is not null").distinct())
        told = led.where("mask <> 0").select(F.col("src").alias("id"), "mask")
        held = front = table(masks.unionByName(told).groupBy("id").agg(F.bit_or("mask").alias("mask")), "anywhere")
        while not front.isEmpty():
            step = _hop(core, front).withColumnRenamed("mask", "told")
            both = step.join(held, "id", "left").select("id", F.col("told").bitwiseAND(F.bitwise_not(F.coalesce("mask", _zero()))).alias("mask"))
            front = table(both.where("mask <> 0"), "new")
            held = table(held.unionByName(front).groupBy("id").agg(F.bit_or("mask").alias("mask")), "anywhere")
        core.unpersist()
    # Chains get what their ends have, and then each vertex what its targets have.
    ends = held.select(F.col("id").alias("end"), F.col("mask").alias("told"))
    passed = found.join(ends, "end", "left").select("id", F.col("mask").bitwiseOR(F.coalesce("told", _zero())).alias("mask"))
    alone = held.join(found, "id", "left_anti")
    return table(_hop(edges, alone.unionByName(passed.where("mask <> 0"))), "anywhere")


def simulate_bounded(graph: Graph, pattern: Pattern, bounds: list[int | None], *, include_isolated: bool = False) -> DataFrame:
    """(q, id) for each vertex that simulates a query node, where edge i of the pattern stands for a path of 1 to bounds[i] edges
    (ANY: of any length); no rows if some query node has none.

    With all bounds 1 this is simulate(). A vertex without edges matches nothing unless include_isolated.
    """
    if len(bounds) != len(pattern.edges) or any(k is not ANY and k < 1 for k in bounds):
        raise ValueError("each edge of the pattern needs a bound, of 1 at least")
    n = len(pattern.nodes)
    if not 0 < n <= MAX_BITS:
        raise ValueError(f"a pattern must have 1 to {MAX_BITS} nodes here")
    needs: dict[int | None, list[int]] = {}
    for (s, t), k in zip(pattern.edges, bounds, strict=True):
        needs.setdefault(k, [0] * n)[s] |= 1 << t
    finite, far = {k: reduce(int.__or__, x) for k, x in needs.items() if k is not ANY}, reduce(int.__or__, needs.get(ANY, [0]))
    simple = graph.simple().persist()
    held = table(_start(graph, pattern, simple, include_isolated), "state")
    bits = [F.count_if(F.getbit("mask", F.lit(q)) == 1).alias(f"n{q}") for q in range(n)]
    counts = list(held.agg(*bits).first())
    edges = _Edges(simple) if needs and all(counts) else None
    star, stale = None, far
    while edges is not None:
        new = held
        if finite:
            new = new.join(within(edges, held, finite), "id", "left")
        if stale:
            # Of query nodes that lost no vertex, what is known of paths to them still holds.
            fresh = anywhere(edges, held.select("id", F.col("mask").bitwiseAND(F.lit(stale).cast("long")).alias("mask")).where("mask <> 0"))
            if star is not None:
                fresh = star.select("id", F.col("mask").bitwiseAND(F.lit(far & ~stale).cast("long")).alias("mask")).unionByName(fresh).groupBy("id").agg(F.bit_or("mask").alias("mask"))
            star = table(fresh, "star")
        if far:
            new = new.join(star.withColumnRenamed("mask", "star"), "id", "left")
        below = {k: F.coalesce("star" if k is ANY else f"reach_{k}", _zero()) for k in needs}

        def bit(q: int):
            has = F.col("mask").bitwiseAND(F.lit(1 << q).cast("long"))
            ok = [below[k].bitwiseAND(F.lit(need[q]).cast("long")) == F.lit(need[q]).cast("long") for k, need in needs.items() if need[q]]
            return F.when(reduce(lambda a, b: a & b, ok), has).otherwise(_zero()) if ok else has

        mask = reduce(lambda a, b: a.bitwiseOR(b), (bit(q) for q in range(n)))
        held = table(new.select("id", mask.alias("mask")).where("mask <> 0"), "state")
        left = list(held.agg(*bits).first())
        stale = far & reduce(int.__or__, (1 << q for q in range(n) if left[q] != counts[q]), 0)
        if left == counts or not all(left):
            counts = left
            break
        counts = left
    if edges is not None:
        edges.unpersist()
    simple.unpersist()
    return _pairs(held if all(counts) else held.where(F.lit(False)), n)
