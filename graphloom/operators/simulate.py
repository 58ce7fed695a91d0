"""Graph simulation: the greatest relation of vertices to query nodes that keeps predicates and child edges.

`simulate` holds the surviving query nodes of a vertex as bits of one number. A round joins edges with the state of their
targets, takes the OR for each source (with partial aggregation on the map side) and clears the bits whose children are not
all there. Masks only shrink, so the first round that changes nothing has reached the greatest relation. Two further
implementations, on pairs and on counters of supporting children, take patterns of any size and serve as a cross-check.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import candidate_mask
from graphloom.model import Graph, Pattern
from graphloom.runtime import table

MAX_BITS = 63
#: Rounds that an action runs, after which the state is written, from the round SINGLE on; before, one.
STEP, SINGLE = 2, 4
#: Vertices that at least so many edges, and more than one of HUBS of all edges, lead to are joined by broadcast.
HUB, HUBS = 100_000, 20_000


def candidates(graph: Graph, pattern: Pattern) -> DataFrame:
    """(q, id): vertices whose attributes match, whatever their edges."""
    return _pairs(graph.vertices.select("id", candidate_mask(graph, pattern).alias("mask")), len(pattern.nodes))


def sink_matches(graph: Graph, pattern: Pattern) -> DataFrame:
    """(q, id): candidates of query nodes without edges, which nothing can refute."""
    sinks = [q for q, n in enumerate(pattern.out_degrees()) if not n]
    return candidates(graph, pattern).where(F.col("q").isin(sinks))


def _pairs(state: DataFrame, n: int) -> DataFrame:
    bits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit("mask", i) == 1) if n else F.array().cast("array<int>")
    return state.select(F.explode(bits).alias("q"), "id").select(F.col("q").cast("int").alias("q"), "id")


def _start(graph: Graph, pattern: Pattern, edges: DataFrame, include_isolated: bool) -> DataFrame:
    state = graph.vertices.select("id", candidate_mask(graph, pattern).alias("mask")).where("mask <> 0")
    # Only query nodes without edges can match a vertex without any: others need a child.
    if include_isolated or 0 not in pattern.out_degrees():
        return state
    touched = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return state.join(touched, "id", "left_semi")


def hub_limit(total: int) -> int:
    """A vertex of more edges is a hub. Degrees sum up to the edges, so fewer than HUBS vertices are."""
    return max(HUB, total // HUBS)


class _Edges:
    """Edges dealt for joins with the state of their dst: kept from round to round.

    They stay dealt by dst, but for those of the few vertices that very many edges lead to: these stay where they are, and the
    state of such vertices is broadcast.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.source = edges
        degrees = edges.groupBy("dst").agg(F.count("*").alias("n"))
        self.total, top = degrees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        limit = hub_limit(self.total)
        self.hubs = F.broadcast(degrees.where(F.col("n") > limit).select("dst")) if top > limit else None
        light = edges if self.hubs is None else edges.join(self.hubs, "dst", "left_anti")
        self.light = light.repartition("dst").persist()
        self.heavy = None if self.hubs is None else edges.join(self.hubs, "dst", "left_semi").persist()

    def joined(self, state: DataFrame) -> DataFrame:
        """(dst, src, the state's columns) of edges whose target has a state."""
        masks = state.withColumnRenamed("id", "dst")
        found = self.light.join(masks, "dst")
        if self.hubs is None:
            return found
        return found.unionByName(self.heavy.join(F.broadcast(masks.join(self.hubs, "dst", "left_semi")), "dst"))

    def unpersist(self) -> None:
        self.light.unpersist()
        if self.heavy is not None:
            self.heavy.unpersist()


def surviving(needs: list[int], below: Column) -> Column:
    """The bits of `mask` whose needs, a mask each, are all in `below`."""

    def bit(q: int, need: int) -> Column:
        has = F.col("mask").bitwiseAND(F.lit(1 << q).cast("long"))
        if not need:
            return has
        need_ = F.lit(need).cast("long")
        return F.when(below.bitwiseAND(need_) == need_, has).otherwise(F.lit(0).cast("long"))

    return reduce(lambda a, b: a.bitwiseOR(b), (bit(q, need) for q, need in enumerate(needs)))


def _shrunk(state: DataFrame, edges: _Edges, needs: list[int]) -> DataFrame:
    child = edges.joined(state).groupBy("src").agg(F.bit_or("mask").alias("below"))
    mask = surviving(needs, F.coalesce("below", F.lit(0).cast("long")))
    return state.join(child, state.id == child.src, "left").select("id", mask.alias("mask")).where("mask <> 0")


def relation(graph: Graph, pattern: Pattern, *, include_isolated: bool = False, max_rounds: int | None = None, dual: bool = False) -> tuple[DataFrame, int, bool]:
    """(state(id, mask), rounds, whether every query node is matched); see simulate.

    Edges that stand for no edge of the pattern between candidates are dropped at once. Where the matched vertices have become less than
    half as many, those that touch others are.
    """
    if not 0 < len(pattern.nodes) <= MAX_BITS:
        raise ValueError(f"a pattern must have 1 to {MAX_BITS} nodes here; see simulate")
    simple = source = graph.simple().persist()
    needs, behind = pattern.needs(), pattern.reversed().needs()
    full = (1 << len(needs)) - 1
    held = _start(graph, pattern, simple, include_isolated).persist()
    told = F.struct(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)), F.coalesce(F.bit_or("mask"), F.lit(0)), F.count("*"))
    count, union, size = held.agg(told.alias("x")).first().x
    rounds, dealt, size_then = 0, [], size
    if union == full and any(needs):
        # No other edge can support anything, now or later, as masks only shrink.
        simple = table(useful(simple, held, pattern), "edges")
        source.unpersist()
        dealt = [_Edges(simple)] + ([_Edges(_reversed(simple))] if dual else [])
    while dealt:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        # Most matches settle in few rounds; of those that do not, an action runs several.
        steps, kept = STEP if max_rounds is None and rounds >= SINGLE else 1, []
        new = held
        for k in range(steps):
            new = _shrunk(new, dealt[0], needs)
            if dual:
                new = _shrunk(new, dealt[1], behind)
            if k < steps - 1:
                # A round reads its state twice.
                kept.append(new := new.persist())
        rounds += steps
        # The state is written, as plans that hold one another grow with a power of the rounds.
        new = table(new, "state")
        left, union, size = new.agg(told.alias("x")).first().x
        for old in (held, *kept):
            old.unpersist()
        held = new
        if left == count or union != full:
            break
        count = left
        if 2 * size < size_then:
            size_then, old = size, dealt
            simple = table(_between(old[0].source, held), "edges")
            dealt = [_Edges(simple)] + ([_Edges(_reversed(simple))] if dual else [])
            for x in old:
                x.unpersist()
    if not rounds:
        held, start = table(held, "state"), held
        start.unpersist()
    for x in (source, *dealt):
        x.unpersist()
    return held, rounds, union == full


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _between(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Edges whose ends both have a state."""
    ids = state.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def matched_edge(pattern: Pattern, source: Column, target: Column) -> Column:
    """Whether some edge of the pattern leads from a bit of one mask to a bit of another."""
    has = lambda mask, q: F.getbit(mask, F.lit(q)) == 1
    return reduce(lambda a, b: a | b, (has(source, s) & has(target, t) for s, t in sorted(set(pattern.edges))), F.lit(False))


def useful(edges: DataFrame, state: DataFrame, pattern: Pattern, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, dst) of edges (keys, src, dst) that stand for an edge of the pattern under state (keys, id, mask)."""
    source = state.select(*keys, F.col("id").alias("src"), F.col("mask").alias("source_mask"))
    target = state.select(*keys, F.col("id").alias("dst"), F.col("mask").alias("target_mask"))
    found = edges.join(source, [*keys, "src"]).join(target, [*keys, "dst"])
    return found.where(matched_edge(pattern, F.col("source_mask"), F.col("target_mask"))).select(*keys, "src", "dst")


def confined(graph: Graph, pattern: Pattern) -> Graph:
    """The part of a graph that a match can depend on: candidates of the pattern's nodes and what they lead to.

    Worth it where few vertices are candidates; simulate() on it gives what it gives on the whole graph.
    """
    reached = reachable(graph, candidates(graph, pattern).select("id").distinct())
    edges = graph.edges.join(reached.withColumnRenamed("id", "src"), "src", "left_semi")
    return Graph(graph.vertices.join(reached, "id", "left_semi"), edges, graph.attrs)


def simulate(graph: Graph, pattern: Pattern, *, include_isolated: bool = False, max_rounds: int | None = None, dual: bool = False) -> DataFrame:
    """(q, id) for each vertex that simulates a query node; no rows if some query node has none.

    A vertex without edges matches nothing unless include_isolated. There is no limit on rounds; max_rounds raises when
    reached. With dual (beyond plain simulation) parents must be matched too. Patterns of more than MAX_BITS nodes take several words
    a vertex, as simulate_many has them.
    """
    if len(pattern.nodes) > MAX_BITS:
        from graphloom.operators.many import simulate_many

        return simulate_many(graph, [pattern], include_isolated=include_isolated, max_rounds=max_rounds, dual=dual).drop("pattern")
    state, _, found = relation(graph, pattern, include_isolated=include_isolated, max_rounds=max_rounds, dual=dual)
    return _pairs(state if found else state.where(F.lit(False)), len(pattern.nodes))


def match_counts(graph: Graph, pattern: Pattern, **options) -> DataFrame:
    """(q, n_matches) for all query nodes."""
    matches = simulate(graph, pattern, **options).groupBy("q").agg(F.count("*").alias("n"))
    nodes = pattern.node_table(graph.edges.sparkSession)
    return F.broadcast(nodes).join(matches, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n_matches"))


def data_shipped(matches: DataFrame) -> DataFrame:
    """(n_results, shipped_bytes): 4 bytes for each result id."""
    return matches.agg(F.count("*").alias("n_results"), (F.count("*") * 4).alias("shipped_bytes"))


def run_report(graph: Graph, pattern: Pattern, path: str | None = None, **options) -> dict:
    """A match, counted and written if a path is given: results of each query node, bytes shipped, rounds and wall seconds."""
    started = time.monotonic()
    state, rounds, found = relation(graph, pattern, **options)
    matches = _pairs(state if found else state.where(F.lit(False)), len(pattern.nodes))
    if path:
        from graphloom.sinks import write_matches

        write_matches(matches, path)
    per = {r.q: r.n for r in matches.groupBy("q").agg(F.count("*").alias("n")).collect()}
    n = sum(per.values())
    return {"matches": [per.get(q, 0) for q in range(len(pattern.nodes))], "n_results": n, "shipped_bytes": 4 * n, "rounds": rounds, "seconds": time.monotonic() - started}


def union_matches(*parts: DataFrame) -> DataFrame:
    """The union of results of several workers, each pair once."""
    return reduce(DataFrame.unionByName, parts).distinct()


def _all_or_nothing(pairs: DataFrame, n: int) -> DataFrame:
    found = pairs.agg(F.count_distinct("q").alias("found"))
    return pairs.crossJoin(F.broadcast(found.where(F.col("found") == n))).drop("found")


def _start_pairs(graph: Graph, pattern: Pattern, edges: DataFrame, include_isolated: bool) -> DataFrame:
    from graphloom.functions.predicates import node_matches

    hits = F.array_compact(F.array(*(F.when(node_matches(graph, n), F.lit(q)) for q, n in enumerate(pattern.nodes))))
    pairs = graph.vertices.select(F.explode(hits).alias("q"), "id")
    if include_isolated:
        return pairs
    return pairs.join(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))), "id", "left_semi").select("q", "id")


def simulate_pairs(graph: Graph, pattern: Pattern, *, include_isolated: bool = False) -> DataFrame:
    """simulate() on the relation (q, id) itself, for patterns of any size.

    A pair with edges survives a round if its children are matched to as many distinct query nodes as its edges lead to.
    """
    spark, edges = graph.edges.sparkSession, graph.simple().persist()
    dealt, pattern_edges = _Edges(edges), pattern.edge_table(spark)
    need = pattern_edges.groupBy("source").agg(F.count("*").alias("need"))
    pairs = table(_start_pairs(graph, pattern, edges, include_isolated), "pairs")
    count = pairs.count()
    while True:
        below = dealt.joined(pairs.select("id", F.col("q").alias("target")))
        support = below.join(F.broadcast(pattern_edges), "target").groupBy(F.col("src").alias("id"), F.col("source").alias("q")).agg(F.count_distinct("target").alias("have"))
        wanted = pairs.join(F.broadcast(need), pairs.q == need.source, "left").drop("source")
        pairs = table(wanted.join(support, ["id", "q"], "left").where("need is null or have = need").select("q", "id"), "pairs")
        left = pairs.count()
        if left == count:
            dealt.unpersist()
            edges.unpersist()
            return _all_or_nothing(pairs, len(pattern.nodes))
        count = left


def simulate_delta(graph: Graph, pattern: Pattern, *, include_isolated: bool = False) -> DataFrame:
    """simulate() by refutation: each pair counts its supporting children per query edge, and a round only moves pairs newly refuted.

    It pays where late rounds refute few pairs: a round joins the edges with those alone.
    """
    spark, edges = graph.edges.sparkSession, graph.simple().persist()
    dealt, pattern_edges = _Edges(edges), F.broadcast(pattern.edge_table(spark))
    alive = table(_start_pairs(graph, pattern, edges, include_isolated), "alive")
    below = dealt.joined(alive.select("id", F.col("q").alias("target"))).groupBy(F.col("src").alias("id"), "target").agg(F.count("*").alias("n"))
    needed = alive.join(pattern_edges, alive.q == F.col("source")).select("id", "q", "target")
    counters = table(needed.join(below, ["id", "target"], "left").select("id", "q", "target", F.coalesce("n", F.lit(0)).alias("n")), "counters")
    while True:
        gone = table(counters.where("n <= 0").select("id", "q").distinct(), "refuted")
        if gone.isEmpty():
            dealt.unpersist()
            edges.unpersist()
            return _all_or_nothing(alive, len(pattern.nodes))
        alive = table(alive.join(gone, ["id", "q"], "left_anti").select("q", "id"), "alive")
        less = dealt.joined(gone.select("id", F.col("q").alias("target"))).groupBy(F.col("src").alias("id"), "target").agg(F.count("*").alias("less"))
        kept = counters.join(gone, ["id", "q"], "left_anti").join(less, ["id", "target"], "left")
        counters = table(kept.select("id", "q", "target", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")), "counters")


def reachable(graph: Graph, start: DataFrame, hops: int | None = None) -> DataFrame:
    """(id): start and its descendants, within so many hops if given. It can confine a match to what its candidates lead to."""
    edges = graph.simple().persist()
    dealt = _Edges(_reversed(edges))
    seen = table(start.select("id").distinct(), "seen")
    front, n = seen, 0
    while (hops is None or n < hops) and not front.isEmpty():
        step = dealt.joined(front.select("id")).select(F.col("src").alias("id")).distinct()
        front = table(step.join(seen, "id", "left_anti"), "front")
        seen = table(seen.unionByName(front), "seen")
        n += 1
    dealt.unpersist()
    edges.unpersist()
    return seen
