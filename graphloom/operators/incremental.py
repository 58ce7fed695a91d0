"""Matching kept up to date while edges come and go (beyond what the engine was asked for: each batch is not matched anew).

Kept are the edges, the surviving pairs (q, id), and for each candidate pair and edge of the pattern the number of supporting edges.
Deletions take from the counts of the sources of deleted edges; pairs whose count is used up are refuted, which takes from the counts
of their parents, and so on. Insertions first open again what could come back: refuted candidates with a new edge, and those that
lead to opened ones; these get their counts, and what does not hold is refuted as before. Anything else is left alone: steps join
what has changed with the tables, and write changes only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, Pattern
from graphloom.operators.simulate import _all_or_nothing, _pairs
from graphloom.runtime import table


class Counts:
    """Whole numbers by key: a base and changes to it, which are merged into a new base once they are a good part of it."""

    #: Changes are merged when they have more rows than this share of the base, or are in more tables than so many.
    SHARE, PARTS = 0.25, 12

    def __init__(self, base: DataFrame, keys: list[str], name: str) -> None:
        self.keys, self.name = keys, name
        self.base = table(base.select(*keys, F.col("n").cast("long").alias("n")), name)
        self.base_rows = self.base.count()
        self.changes: list[DataFrame] = []
        self.changed_rows = 0

    def _summed(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def now(self) -> DataFrame:
        """(keys, n) of all keys whose number is not 0."""
        return self._summed([self.base, *self.changes]) if self.changes else self.base

    def of(self, wanted: DataFrame, on: list[str]) -> DataFrame:
        """The same for keys that agree with a row of wanted in some columns; each part is filtered before anything is added up."""
        some = wanted.select(*on).distinct()
        return self._summed([x.join(some, on, "left_semi") for x in (self.base, *self.changes)])

    def add(self, change: DataFrame) -> DataFrame:
        """Add numbers (keys, n); the written change is given back."""
        written = table(change.select(*self.keys, F.col("n").cast("long").alias("n")), self.name)
        rows = written.count()
        if rows:
            self.changes.append(written)
            self.changed_rows += rows
        if len(self.changes) > self.PARTS or self.changed_rows > self.SHARE * self.base_rows:
            self.base = table(self.now(), self.name)
            self.base_rows, self.changes, self.changed_rows = self.base.count(), [], 0
        return written


class IncrementalMatch:
    """A pattern's greatest simulation on a graph whose edges change in batches.

    Vertices and their attributes stay as they are: candidates are found once.
    """

    #: Steps of refutation that look up what they need in the tables; what then is left to refute goes far.
    NEAR = 1

    def __init__(self, graph: Graph, pattern: Pattern, include_isolated: bool = False) -> None:
        from graphloom.functions.predicates import candidate_mask

        self.pattern, self.include_isolated = pattern, include_isolated
        spark = graph.edges.sparkSession
        self.pattern_edges = F.broadcast(table(pattern.edge_table(spark).withColumnRenamed("source", "q"), "pattern"))
        self.sinks = [q for q, n in enumerate(pattern.out_degrees()) if not n]
        self.candidates = table(_pairs(graph.vertices.select("id", candidate_mask(graph, pattern).alias("mask")), len(pattern.nodes)), "candidates")
        self.edges = Counts(graph.simple().withColumn("n", F.lit(1)), ["src", "dst"], "edges")
        alive = self.candidates
        if not include_isolated:
            alive = alive.join(self._touched(self.edges.now()), "id", "left_semi")
        self.alive = Counts(alive.withColumn("n", F.lit(1)), ["q", "id"], "alive")
        self.support = Counts(self._support(self.edges.now(), self.alive.now()), ["id", "q", "target"], "support")
        wanted = self.alive.now().select("q", "id").join(self.pattern_edges, "q")
        self._refute(self._unsupported(wanted, self.support.now()))

    @staticmethod
    def _touched(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()

    def _support(self, edges: DataFrame, alive: DataFrame) -> DataFrame:
        """(id, q, target, n): what edges (src, dst) give their sources' candidate pairs, as they lead to pairs of alive (q, id)."""
        reached = edges.select("src", "dst").join(alive.select(F.col("q").alias("target"), F.col("id").alias("dst")), "dst")
        per = reached.groupBy(F.col("src").alias("id"), "target").agg(F.count("*").alias("n"))
        return per.join(self.pattern_edges, "target").join(self.candidates, ["id", "q"], "left_semi").select("id", "q", "target", "n")

    def _unsupported(self, wanted: DataFrame, support: DataFrame) -> DataFrame:
        """(q, id) of wanted (id, q, target) that have no support by some edge."""
        have = wanted.join(support, ["id", "q", "target"], "left")
        return have.where(F.coalesce("n", F.lit(0)) <= 0).select("q", "id").distinct()

    def _refute(self, refuted: DataFrame) -> None:
        """Refute pairs (q, id), and what stood on them: step by step while that is near, else by what is left to refute."""
        for _ in range(self.NEAR):
            front = self.alive.of(refuted, ["q", "id"]).withColumn("n", -F.col("n"))
            front = self.alive.add(front)
            if front.isEmpty():
                return
            into = self.edges.of(front.select(F.col("id").alias("dst")), ["dst"])
            less = self.support.add(self._support(into, front).withColumn("n", -F.col("n")))
            refuted = table(self._unsupported(less.select("id", "q", "target"), self.support.of(less, ["id", "q", "target"])), "refuted")
        self._cascade(refuted)

    def _cascade(self, refuted: DataFrame) -> None:
        """The same for many steps: edges between surviving pairs are looked up once, and a step joins them with the pairs that the last
        one has refuted. The tables are told once, of all together."""
        alive = self.alive.now().select("q", "id")
        front = table(refuted.select("q", "id").join(alive, ["q", "id"], "left_semi"), "refuted")
        if front.isEmpty():
            return
        to = alive.select(F.col("q").alias("target"), F.col("id").alias("dst"))
        led = self.edges.now().join(to, "dst").join(self.pattern_edges, "target").select(F.col("src").alias("id"), "q", "target", "dst")
        led = table(led.join(alive, ["id", "q"], "left_semi"), "led")
        left = self.support.now().join(alive, ["id", "q"], "left_semi")
        fronts = []
        while not front.isEmpty():
            fronts.append(front)
            lost = front.select(F.col("q").alias("target"), F.col("id").alias("dst"))
            less = led.join(lost, ["target", "dst"]).groupBy("id", "q", "target").agg(F.count("*").alias("less"))
            rest = left.join(front, ["id", "q"], "left_anti").join(less, ["id", "q", "target"], "left")
            left = table(rest.select("id", "q", "target", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")), "left")
            front = table(left.where("n <= 0").select("q", "id").distinct(), "refuted")
        gone = self.alive.add(reduce(DataFrame.unionByName, fronts).withColumn("n", F.lit(-1)))
        into = self.edges.of(gone.select(F.col("id").alias("dst")), ["dst"])
        self.support.add(self._support(into, gone).withColumn("n", -F.col("n")))

    def delete(self, edges: DataFrame) -> None:
        """Take edges (src, dst) out; those that are not there don't matter."""
        gone = self.edges.add(self.edges.of(edges, ["src", "dst"]).withColumn("n", -F.col("n")))
        if gone.isEmpty():
            return
        alive = self.alive.of(gone.select(F.col("dst").alias("id")), ["id"])
        less = self.support.add(self._support(gone, alive).withColumn("n", -F.col("n")))
        refuted = self._unsupported(less.select("id", "q", "target"), self.support.of(less, ["id", "q", "target"]))
        if self.sinks and not self.include_isolated:
            # A vertex that has lost its last edge matches nothing.
            ends = self._touched(gone)
            left = self._touched(self.edges.of(ends.withColumnRenamed("id", "src"), ["src"])).union(self._touched(self.edges.of(ends.withColumnRenamed("id", "dst"), ["dst"])))
            alone = ends.join(left, "id", "left_anti")
            refuted = refuted.unionByName(self.candidates.where(F.col("q").isin(self.sinks)).join(alone, "id", "left_semi").select("q", "id")).distinct()
        self._refute(table(refuted, "refuted"))

    def insert(self, edges: DataFrame) -> None:
        """Put edges (src, dst) in; loops and those that are there already don't matter."""
        new = edges.select("src", "dst").where("src <> dst").distinct()
        fresh = self.edges.add(new.join(self.edges.of(new, ["src", "dst"]), ["src", "dst"], "left_anti").withColumn("n", F.lit(1)))
        if fresh.isEmpty():
            return
        opened = self._opened(fresh)
        # New edges to pairs that have been there, and all edges to those that are opened.
        before = self.alive.of(fresh.select(F.col("dst").alias("id")), ["id"])
        more = self._support(fresh, before)
        into = self.edges.of(opened.select(F.col("id").alias("dst")), ["dst"])
        self.support.add(more.unionByName(self._support(into, opened)).groupBy("id", "q", "target").agg(F.sum("n").alias("n")))
        self.alive.add(opened.withColumn("n", F.lit(1)))
        wanted = opened.join(self.pattern_edges, "q")
        self._refute(table(self._unsupported(wanted, self.support.of(wanted, ["id", "q", "target"])), "refuted"))

    def _opened(self, fresh: DataFrame) -> DataFrame:
        """(q, id): refuted candidates that new edges could bring back, as far as they lead to one another.

        A pair that comes back has an edge of the pattern for which it leans on a new edge or on another pair that comes back; else it
        would have held before.
        """
        targets = self.candidates.join(fresh.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        first = self._support(fresh, targets).select("q", "id")
        if self.sinks and not self.include_isolated:
            first = first.unionByName(self.candidates.where(F.col("q").isin(self.sinks)).join(self._touched(fresh), "id", "left_semi").select("q", "id"))
        front = table(self._refuted_of(first), "opened")
        opened = front
        while not front.isEmpty():
            into = self.edges.of(front.select(F.col("id").alias("dst")), ["dst"])
            step = self._refuted_of(self._support(into, front).select("q", "id"))
            front = table(step.join(opened, ["q", "id"], "left_anti"), "opened")
            opened = opened.unionByName(front)
        return opened

    def _refuted_of(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        return pairs.join(self.alive.of(pairs, ["q", "id"]), ["q", "id"], "left_anti")

    def matches(self) -> DataFrame:
        """(q, id), as simulate() gives it for the graph as it is now."""
        return _all_or_nothing(self.alive.now().select("q", "id"), len(self.pattern.nodes))
