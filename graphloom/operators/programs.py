"""Vertex programs as loops over DataFrames: gather-apply-scatter, functional kernels, message passing, edge aggregation.

A program is given as Columns, so a round is joins and one aggregation. Updates are seen in the next round (bulk-synchronous);
of programs that see them within a round those are offered whose fixpoint does not depend on it (run_monotone).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators.simulate import _Edges, _reversed, hub_limit
from graphloom.runtime import table

CUT_EVERY = 4


class Direction(Enum):
    NONE = "none"
    IN = "in"
    OUT = "out"
    ALL = "all"

    @property
    def ends(self) -> list[Direction]:
        """IN for targets, OUT for sources."""
        return {Direction.NONE: [], Direction.IN: [Direction.IN], Direction.OUT: [Direction.OUT], Direction.ALL: [Direction.IN, Direction.OUT]}[self]


@dataclass
class Context:
    """What a loop knows: the round, their number, the graph's size, time, and changes logged."""

    n_vertices: int = 0
    n_edges: int = 0
    iteration: int = 0
    num_iterations: int = 0
    started: float = field(default_factory=time.monotonic)
    deltas: list[dict] = field(default_factory=list)
    stopped: bool = False

    def runtime(self) -> float:
        return time.monotonic() - self.started

    def set_last_iteration(self, n: int) -> None:
        self.num_iterations = min(self.num_iterations, n + 1)

    def stop(self) -> None:
        self.stopped = True

    def log_change(self, updates: int, delta: float) -> None:
        if delta < 0:
            raise ValueError("a change is not negative")
        self.deltas.append({"iteration": self.iteration, "updates": updates, "work": self.n_edges, "delta": delta})


def triplets(graph: Graph, direction: Direction, value: str = "value", of: DataFrame | None = None) -> DataFrame:
    """(id, other, own_value, other_value, edge columns): each edge as seen from the vertex `id` that gathers.

    IN has a row for the target of each edge, OUT one for its source, ALL both. With `of` (id), only for those vertices: their edges
    are picked before values are joined to them.
    """
    extra = [c for c in graph.edges.columns if c not in ("src", "dst")]
    incoming = graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), *(F.col(c).alias(f"edge_{c}") for c in extra))
    outgoing = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), *(F.col(c).alias(f"edge_{c}") for c in extra))
    rows = {Direction.IN: incoming, Direction.OUT: outgoing, Direction.ALL: incoming.unionByName(outgoing)}[direction]
    if of is not None:
        rows = rows.join(of.select("id"), "id", "left_semi")
    others = graph.vertices.select(F.col("id").alias("other"), F.col(value).alias("other_value"))
    own = graph.vertices.select("id", F.col(value).alias("own_value"))
    return rows.join(others, "other").join(own, "id")


def gather(graph: Graph, expression: Column, aggregate: Callable[[Column], Column], direction: Direction = Direction.IN, value: str = "value", of: DataFrame | None = None) -> DataFrame:
    """(id, acc): the aggregate of an expression over triplets; null for a vertex without edges in that direction, or with NONE."""
    ids = graph.vertices.select("id")
    if direction is Direction.NONE:
        return ids.withColumn("acc", F.lit(None).cast("double"))
    got = triplets(graph, direction, value, of).groupBy("id").agg(aggregate(expression).alias("acc"))
    return ids.join(got, "id", "left")


class _Ends:
    """Edges as the vertices at one of their ends see them, kept over the rounds of a loop.

    They are dealt by the vertex that gathers (IN: the target, OUT: the source). Where the other end is one of the few that very many
    edges have, rows have a salt, and so many copies of its value are told, so that no task joins all of a hub's edges.
    """

    def __init__(self, edges: DataFrame, direction: Direction) -> None:
        own, other = ("dst", "src") if direction is Direction.IN else ("src", "dst")
        rows = edges.select(F.col(own).alias("dst"), F.col(other).alias("other"), *(F.col(c).alias(f"edge_{c}") for c in edges.columns if c not in ("src", "dst")))
        counts = rows.groupBy("other").agg(F.count("*").alias("n"))
        self.total, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        limit, self.salts = hub_limit(self.total), None
        if top > limit:
            # Written, as each round reads it: fewer than HUBS rows, whose salts sum up to fewer than twice as many.
            self.salts = table(counts.where(F.col("n") > limit).select("other", F.ceil(F.col("n") / limit).cast("int").alias("salts")), "hubs")
            rows = rows.join(F.broadcast(self.salts), "other", "left")
            rows = rows.withColumn("salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "salts")), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        self.dealt = _Edges(rows)

    def triplets(self, state: DataFrame, active: DataFrame | None = None) -> DataFrame:
        """The columns of triplets(), for values (id, value); with active (id), for those vertices alone."""
        own = state if active is None else state.join(active.select("id"), "id", "left_semi")
        rows = self.dealt.joined(own.select("id", F.col("value").alias("own_value"))).withColumnRenamed("dst", "id")
        others = state.select(F.col("id").alias("other"), F.col("value").alias("other_value"))
        if self.salts is None:
            return rows.join(others, "other")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        others = others.join(F.broadcast(self.salts), "other", "left").select("other", "other_value", copies)
        return rows.join(others, ["other", "salt"]).drop("salt")

    def told(self, speakers: DataFrame) -> DataFrame:
        """(id): the other ends of the edges of speakers (id, once each), repeats included."""
        return self.dealt.joined(speakers.select("id")).select(F.col("other").alias("id"))

    def unpersist(self) -> None:
        self.dealt.unpersist()


def edge_aggregate(graph: Graph, expression: Column, aggregate: Callable[[Column], Column], finish: Callable[[Column], Column] = lambda x: x, value: str = "value") -> DataFrame:
    """(result): an aggregate over the edges as seen from both of their ends, so each edge counts twice."""
    return triplets(graph, Direction.ALL, value).agg(finish(aggregate(expression)).alias("result"))


def gas(
    graph: Graph,
    apply: Column,
    rounds: int,
    gather_expression: Column | None = None,
    aggregate: Callable[[Column], Column] = F.sum,
    direction: Direction = Direction.IN,
    scatter: Direction = Direction.NONE,
    signal: Column | None = None,
    tolerance: float | None = None,
    before: Callable[[Context], None] | None = None,
    after: Callable[[Context], None] | None = None,
    start: DataFrame | None = None,
    repeat: int = 1,
) -> tuple[DataFrame, Context]:
    """Run a gather-apply-scatter program on the column `value` of graph.vertices.

    gather_expression sees own_value, other_value and edge_*; apply sees value, acc, id and round. With a scatter direction only
    vertices that a neighbour signalled run again: signal (over old, value) tells which vertices signal along that direction. The
    loop ends after `rounds`, when no vertex is signalled, when a hook calls stop(), or when the change is at most tolerance.
    start (id) are the vertices that run in the first round, all by default. repeat runs apply so often a round on its own result,
    with the same acc.
    """
    edges = graph.edges.persist()
    state = graph.vertices.select("id", "value").persist()
    context = Context(state.count(), edges.count(), num_iterations=rounds)
    ends = {d: _Ends(edges, d) for d in Direction.ALL.ends if d in direction.ends + scatter.ends}
    # A round's plan names what the rounds before left, the more often the more ends and hubs there are, so it is cut the sooner.
    every = CUT_EVERY if len(ends) < 2 and all(e.salts is None and e.dealt.hubs is None for e in ends.values()) else 1
    active = None if start is None else start.select("id").distinct()
    old_state, cached = state, [edges, *ends.values()]
    expression = F.col("other_value") if gather_expression is None else gather_expression
    while context.iteration < context.num_iterations and not context.stopped:
        if before:
            before(context)
        if direction is Direction.NONE:
            rows = state.withColumn("acc", F.lit(None).cast("double"))
        else:
            seen = reduce(DataFrame.unionByName, [ends[d].triplets(state, active) for d in direction.ends])
            rows = state.join(seen.groupBy("id").agg(aggregate(expression).alias("acc")), "id", "left")
        rows = rows.withColumn("round", F.lit(context.iteration))
        rows = rows.withColumn("old", F.col("value"))
        if active is not None:
            rows = rows.join(active.withColumn("__on", F.lit(True)), "id", "left")
        for _ in range(repeat):
            rows = rows.withColumn("value", apply if active is None else F.when(F.col("__on"), apply).otherwise(F.col("value")))
        new = rows.select("id", "value", "old")
        new = table(new, "vertices") if (context.iteration + 1) % every == 0 else new.persist()
        moved = F.abs(F.col("value").cast("double") - F.col("old").cast("double"))
        updates, delta = new.agg(F.count_if(~F.col("value").eqNullSafe(F.col("old"))), F.coalesce(F.sum(moved), F.lit(0.0))).first()
        context.log_change(updates, delta)
        if scatter is not Direction.NONE:
            speakers = new.where(~F.col("value").eqNullSafe(F.col("old")) if signal is None else signal).select("id")
            active = reduce(DataFrame.unionByName, [ends[d].told(speakers) for d in scatter.ends]).distinct().persist()
            cached.append(active)
        # What the round before kept has been read for the last time, but for the vertices it signalled.
        old_state.unpersist()
        old_state, state = new, new.select("id", "value")
        if after:
            after(context)
        context.iteration += 1
        if tolerance is not None and delta <= tolerance or scatter is not Direction.NONE and active.isEmpty():
            break
    final = table(state, "vertices")
    for x in (old_state, *cached):
        x.unpersist()
    return final, context


@dataclass(frozen=True)
class Kernel:
    """A functional kernel: six slots, each a Column or a function of Columns.

    initial(id, indegree, outdegree); reset, the neutral value; op(neighbour message) on each in-edge; plus, an aggregate over
    them; compute(old value, acc); message(new value, outdegree), what a vertex tells along its out-edges.
    """

    initial: Callable[[Column, Column, Column], Column]
    reset: Column
    op: Callable[[Column], Column]
    plus: Callable[[Column], Column]
    compute: Callable[[Column, Column], Column]
    message: Callable[[Column, Column], Column]


def run_kernel(edges: DataFrame, kernel: Kernel, rounds: int) -> DataFrame:
    """(id, value) after so many synchronous rounds over the vertices in edges."""
    from graphloom.operators.analytics import degrees

    edges = edges.select("src", "dst").persist()
    deg = degrees(edges).persist()
    state = deg.select("id", "outdegree", kernel.initial(F.col("id"), F.col("indegree"), F.col("outdegree")).alias("value"))
    # Dealt by the end that tells; what a hub tells is broadcast.
    dealt = _Edges(_reversed(edges))
    for i in range(rounds):
        told = state.select("id", kernel.message(F.col("value"), F.col("outdegree")).alias("m"))
        acc = dealt.joined(told).groupBy(F.col("src").alias("id")).agg(kernel.plus(kernel.op(F.col("m"))).alias("acc"))
        state = state.join(acc, "id", "left").select("id", "outdegree", kernel.compute(F.col("value"), F.coalesce("acc", kernel.reset)).alias("value"))
        if (i + 1) % CUT_EVERY == 0:
            state = table(state, "kernel")
    final = table(state.select("id", "value"), "kernel")
    for x in (dealt, edges, deg):
        x.unpersist()
    return final


def pagerank_kernel(damping: float = 0.85) -> Kernel:
    """Ranks that start at 1 and are not divided by the number of vertices."""
    return Kernel(
        initial=lambda i, indeg, outdeg: F.lit(1.0), reset=F.lit(0.0), op=lambda m: m, plus=F.sum,
        compute=lambda old, acc: F.lit(1 - damping) + F.lit(damping) * acc, message=lambda value, outdeg: value / outdeg,
    )


def shortest_hops(edges: DataFrame, start: int, rounds: int) -> DataFrame:
    """(id, value): hops from start along edges, null beyond `rounds`."""
    far = F.lit(None).cast("int")
    kernel = Kernel(
        initial=lambda i, indeg, outdeg: F.when(i == start, F.lit(0)).otherwise(far), reset=far, op=lambda m: m + 1, plus=F.min,
        compute=lambda old, acc: F.least(old, acc), message=lambda value, outdeg: value,
    )
    return run_kernel(edges, kernel, rounds)


@dataclass
class VertexProgram:
    """A vertex program with hooks: message (over src_value as other_value, edge_*), merge, apply (over value, acc, id, round).

    The interval hooks get the context and a range of ids (first, last): a round is one interval here, of all vertices. repeat runs a
    vertex's apply so often a round. edge, where given, is what a vertex writes on its out-edges after each round (over value,
    edge_value, src, dst): its neighbours see it in the next round as edge_value.
    """

    message: Column
    merge: Callable[[Column], Column]
    apply: Column
    before_iteration: Callable[[Context], None] | None = None
    after_iteration: Callable[[Context], None] | None = None
    before_interval: Callable[[Context, int, int], None] | None = None
    after_interval: Callable[[Context, int, int], None] | None = None
    repeat: int = 1
    edge: Column | None = None

    def _hooks(self, graph: Graph) -> tuple[Callable[[Context], None], Callable[[Context], None]]:
        ends = (0, -1)
        if self.before_interval or self.after_interval:
            first, last = graph.vertices.agg(F.min("id"), F.max("id")).first()
            ends = (first if first is not None else 0, last if last is not None else -1)

        def before(context: Context) -> None:
            if self.before_iteration:
                self.before_iteration(context)
            if self.before_interval:
                self.before_interval(context, *ends)

        def after(context: Context) -> None:
            if self.after_interval:
                self.after_interval(context, *ends)
            if self.after_iteration:
                self.after_iteration(context)

        return before, after

    def run(self, graph: Graph, rounds: int, start: DataFrame | None = None) -> tuple[DataFrame, Context]:
        """Messages go from sources to targets; the result is (id, value)."""
        before, after = self._hooks(graph)
        if self.edge is None:
            return gas(graph, self.apply, rounds, self.message, self.merge, Direction.IN, before=before, after=after, start=start, repeat=self.repeat)
        state, _, context = self.run_with_edges(graph, rounds, start)
        return state, context

    def run_with_edges(self, graph: Graph, rounds: int, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Context]:
        """(vertices(id, value), edges(src, dst, value), context): a round at a time, since edges change too."""
        before, after = self._hooks(graph)
        edges, vertices = graph.edges.select("src", "dst", "value"), graph.vertices.select("id", "value")
        context = Context(vertices.count(), edges.count(), num_iterations=rounds)
        while context.iteration < context.num_iterations and not context.stopped:
            before(context)
            vertices, one = gas(Graph(vertices, edges), self.apply, 1, self.message, self.merge, Direction.IN, start=start, repeat=self.repeat)
            context.deltas.append(one.deltas[0] | {"iteration": context.iteration})
            wrote = edges.withColumnRenamed("value", "edge_value").join(vertices.select(F.col("id").alias("src"), "value"), "src")
            edges = table(wrote.select("src", "dst", (self.edge if self.edge is not None else F.col("edge_value")).alias("value")), "edge-values")
            after(context)
            context.iteration, start = context.iteration + 1, None
        return vertices, edges, context


def emitted_graph(graph: Graph, emit: Callable, schema: str, path: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A new graph in a folder, of the edges that emit(id, frame of out-edges) gives for each vertex as rows of schema (src, dst, ...).

    keep, where given, reduces duplicates (see analytics.reduce_duplicates). The result is read from the shards that are written.
    """
    from graphloom.sources.readers import write_shards

    out = map_vertices(graph, emit, schema)
    write_shards(out if keep is None else keep(out), path)
    return graph.edges.sparkSession.read.parquet(path)


def run_monotone(edges: DataFrame, kernel: Kernel, decreasing: bool = True, max_rounds: int = 1000) -> DataFrame:
    """(id, value): a kernel's fixpoint, for kernels whose values only ever fall (or only ever rise).

    Such a kernel has the same fixpoint whether rounds see each other's new values at once or in the next round, so this stands for
    semi-synchronous runs of it. A value that moves the other way raises.
    """
    from graphloom.operators.analytics import degrees

    edges = edges.select("src", "dst").persist()
    deg = degrees(edges)
    state = table(deg.select("id", "outdegree", kernel.initial(F.col("id"), F.col("indegree"), F.col("outdegree")).alias("value")), "monotone")
    dealt = _Edges(_reversed(edges))
    for _ in range(max_rounds):
        told = state.select("id", kernel.message(F.col("value"), F.col("outdegree")).alias("m"))
        acc = dealt.joined(told).groupBy(F.col("src").alias("id")).agg(kernel.plus(kernel.op(F.col("m"))).alias("acc"))
        new = state.join(acc, "id", "left").select("id", "outdegree", kernel.compute(F.col("value"), F.coalesce("acc", kernel.reset)).alias("value"), F.col("value").alias("old"))
        new = table(new, "monotone")
        wrong = F.col("value") > F.col("old") if decreasing else F.col("value") < F.col("old")
        moved, against = new.agg(F.count_if(~F.col("value").eqNullSafe(F.col("old"))), F.count_if(wrong)).first()
        if against:
            raise ValueError("the kernel is not monotone")
        state = new.select("id", "outdegree", "value")
        if not moved:
            dealt.unpersist()
            edges.unpersist()
            return state.select("id", "value")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def sum_priority(x: Column) -> Column:
    """How priorities of messages to one vertex add up: as their sum."""
    return F.sum(x.cast("double"))


def max_priority(x: Column) -> Column:
    """The same as their largest."""
    return F.max(x.cast("double"))


def engine_info(context: Context, graph: Graph, name: str = "") -> str:
    """What a loop is doing, as JSON: the round, their number, sizes, seconds, and the updates and change of each round."""
    last = context.deltas[-1] if context.deltas else {}
    told = {"engine": "spark", "app": name, "iteration": context.iteration, "numIterations": context.num_iterations, "runTime": round(context.runtime(), 3), "updates": sum(x["updates"] for x in context.deltas), "numVertices": context.n_vertices, "edges": context.n_edges, "lastUpdates": last.get("updates"), "lastDelta": last.get("delta"), "partitions": graph.edges.rdd.getNumPartitions()}
    return json.dumps(told)


def map_vertices(graph: Graph, function: Callable, schema: str, by: str = "id") -> DataFrame:
    """Arbitrary Python for each vertex with its out-edges: function(id, pandas frame of edges) -> pandas frame of schema."""
    edges = graph.edges.withColumnRenamed("src", by)
    return edges.groupBy(by).applyInPandas(lambda key, pdf: function(key[0], pdf), schema)


def emit_rows(edges: DataFrame, emitter: Callable[[], object], schema: str, order: list[str] | None = None) -> DataFrame:
    """The rows that an object of emitter() yields for each vertex, by a table function partitioned by src.

    It gets the vertex's out-edges one after the other, by `order` (dst if not given): edge(row) may yield tuples of schema for each,
    and end() for the last time. Neither edges nor rows of a vertex are gathered, so its number of edges is bounded by nothing.
    """
    from pyspark.sql import types as T
    from pyspark.sql.functions import AnalyzeResult, udtf

    kind = T._parse_datatype_string(schema)
    names = edges.columns

    class Emitted:
        @staticmethod
        def analyze(table, **_):
            return AnalyzeResult(schema=kind)

        def __init__(self):
            self.vertex = None

        def eval(self, row, **_):
            if self.vertex is None:
                self.vertex = emitter()
            yield from self.vertex.edge(row) or ()

        def terminate(self):
            if self.vertex is not None:
                yield from self.vertex.end() or ()

    function = udtf(Emitted)
    argument = edges.asTable().partitionBy("src").orderBy(*(order or [c for c in ("dst",) if c in names]))
    return function(argument)
