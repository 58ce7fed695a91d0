"""Graphs that change: insertions and deletions of edges, in batches or as streams, and vertex state carried along.

A dynamic graph is a folder: `base` versions of edges, each with the names of the log batches that it holds (`included`), and `log`,
appended rows (src, dst, value, op, batch) with op 1 for an insertion and -1 for a deletion. A batch has a place in the order of
changes and a name of its writer's: a stream's batch is named after the stream and its number there, so a retry finds it done, and
batches of other streams, or appended by hand, are never taken for it. Readers see the base with the rest of the log applied;
compaction writes a new base. Files are only added, and a version counts once its marker is written, so a job that dies midway leaves
the last state readable.
"""

from __future__ import annotations

import hashlib
from typing import TYPE_CHECKING
from uuid import uuid4

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph

if TYPE_CHECKING:
    from graphloom.operators.programs import VertexProgram

SCHEMA = "src bigint, dst bigint, value double, op int, batch bigint"
#: Compaction: log rows against the limit of buffered rows, deleted edges against all.
BUFFER_FULL, DELETED_SHARE = 0.8, 0.1


def insert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and new ones without loops; an edge that is there stays as it is."""
    fresh = new.where("src <> dst").dropDuplicates(["src", "dst"]).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return edges.unionByName(fresh)


def delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges without those of gone(src, dst)."""
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def delete_vertices(edges: DataFrame, ids: DataFrame, incoming: bool = True, outgoing: bool = True) -> DataFrame:
    """edges without the in- and out-edges of some vertices."""
    ids = ids.select("id").distinct()
    if incoming:
        edges = edges.join(ids, edges.dst == ids.id, "left_anti")
    if outgoing:
        edges = edges.join(ids, edges.src == ids.id, "left_anti")
    return edges


def apply_log(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The base after a log (src, dst, value, op, batch): the last change of an edge decides, insertions before deletions of a batch."""
    rest = [c for c in base.columns if c not in ("src", "dst")]
    # An aggregate, so that an edge that changes very often is summed up where its changes are; of equal changes the largest value stays.
    last = changes.groupBy("src", "dst").agg(F.max(F.struct("batch", (-F.col("op")).alias("gone"), *rest)).alias("last"))
    kept = base.join(last.select("src", "dst"), ["src", "dst"], "left_anti")
    return kept.unionByName(last.where("last.gone = -1").select("src", "dst", *(F.col("last")[c].alias(c) for c in rest)))


def buffered_degrees(degrees: DataFrame, changes: DataFrame) -> DataFrame:
    """Degrees (id, indegree, outdegree) with a log of new (op 1) and deleted (op -1) edges added, without reading the base edges."""
    ends = changes.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.col("op").alias("o")), F.struct(F.col("dst").alias("id"), F.col("op").alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    rows = degrees.select("id", F.col("indegree").cast("long").alias("i"), F.col("outdegree").cast("long").alias("o")).unionByName(ends.select("id", F.col("i").cast("long").alias("i"), F.col("o").cast("long").alias("o")))
    return rows.groupBy("id").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


class DynamicGraph:
    """A graph in a folder that batches and streams change."""

    def __init__(self, spark: SparkSession, path: str, buffer_limit: int = 10_000_000) -> None:
        self.spark, self.path, self.buffer_limit = spark, path.rstrip("/"), buffer_limit
        #: Vertices scheduled from outside for the next run of a program (see add_task).
        self.tasks: DataFrame | None = None
        self.last_batch: int | None = None

    def _names(self, folder: str, whole: bool = True) -> list[str]:
        """Names in a folder, by default only those whose marker is written."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        store = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(p):
            return []
        return sorted(s.getPath().getName() for s in store.listStatus(p) if not whole or store.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def base(self) -> DataFrame:
        names = self._names("base")
        empty = self.spark.createDataFrame([], "src bigint, dst bigint, value double")
        return self.spark.read.parquet(f"{self.path}/base/{names[-1]}") if names else empty

    def _included(self) -> set[str]:
        """The names of the batches that the newest base holds."""
        names = self._names("base")
        return {r.name for r in self.spark.read.parquet(f"{self.path}/included/{names[-1]}").collect()} if names else set()

    def _pending(self) -> list[str]:
        held = self._included()
        return [n for n in self._names("log") if n not in held]

    def log(self) -> DataFrame:
        names = self._pending()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/log/{n}" for n in names))

    def next_batch(self) -> int:
        """The place of the next batch in the order of changes; batches that were begun and not ended keep theirs."""
        return 1 + max([-1, *(int(n.split("-")[1]) for n in self._names("log", whole=False))])

    def edges(self) -> DataFrame:
        return apply_log(self.base(), self.log())

    def append(self, changes: DataFrame, name: str | None = None) -> int:
        """Add changes (src, dst[, value][, op]) as a batch and return its place. A batch of a name that is there already is not added
        again; one that a dead job left unfinished is written anew in its place."""
        own = name or uuid4().hex
        begun = [n for n in self._names("log", whole=False) if n.split("-", 2)[2] == own]
        if begun and begun[0] in self._names("log"):
            return int(begun[0].split("-")[1])
        n = int(begun[0].split("-")[1]) if begun else self.next_batch()
        rows = changes if "op" in changes.columns else changes.withColumn("op", F.lit(1))
        rows = rows if "value" in rows.columns else rows.withColumn("value", F.lit(None).cast("double"))
        rows = rows.where("src <> dst").select("src", "dst", F.col("value").cast("double").alias("value"), F.col("op").cast("int").alias("op"), F.lit(n).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch-{n:012d}-{own}")
        return n

    def add_edges(self, edges: DataFrame) -> int:
        return self.append(edges)

    def remove_edges(self, edges: DataFrame) -> int:
        return self.append(edges.withColumn("op", F.lit(-1)))

    def counts(self) -> tuple[int, int]:
        """(edges in the base, rows in the log)."""
        return self.base().count(), self.log().count()

    def due(self) -> bool:
        """Whether the log or its deletions have grown enough for compaction."""
        rows, deleted = self.log().agg(F.count("*"), F.count_if(F.col("op") == -1)).first()
        if rows >= BUFFER_FULL * self.buffer_limit or not deleted:
            return rows >= BUFFER_FULL * self.buffer_limit
        # Only deletions make the base's size matter.
        base = self.base().count()
        return base > 0 and deleted >= DELETED_SHARE * base

    def compact(self, force: bool = False) -> bool:
        """Write the current edges as a new base, dealt by ranges of targets: as many as their size asks for, so shards that have grown
        are split."""
        if not force and not self.due():
            return False
        held, pending = self._included(), self._pending()
        name = f"upto-{len(self._names('base', whole=False)):012d}"
        # Of a batch that another job is writing meanwhile nothing is read, and it stays pending.
        self.spark.createDataFrame([(x,) for x in sorted({*held, *pending})], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/included/{name}")
        log = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/log/{x}" for x in pending)) if pending else self.spark.createDataFrame([], SCHEMA)
        out = apply_log(self.base(), log).repartitionByRange("dst").sortWithinPartitions("src", "dst")
        out.write.mode("overwrite").parquet(f"{self.path}/base/{name}")
        return True

    def degrees(self) -> DataFrame:
        from graphloom.operators.analytics import degrees

        return degrees(self.edges())

    def add_task(self, ids: DataFrame) -> None:
        """Schedule vertices (id) from outside for the next run, besides what the program signals."""
        new = ids.select("id")
        self.tasks = new if self.tasks is None else self.tasks.unionByName(new).distinct()

    def finish_after(self, batches: int | None) -> None:
        """End streams that follow() runs once they have given so many batches from now on; None lets them go on."""
        self.last_batch = batches

    def run(self, program: VertexProgram, vertices: DataFrame, rounds: int) -> DataFrame:
        """(id, value): a vertex program on the graph as it is now, from the given values.

        vertices (id, value) are kept values, for instance those of the run before; vertices that the graph has gained are added by
        merge_state(). With tasks, the first round runs the scheduled vertices only.
        """
        graph = Graph(vertices, self.edges().select("src", "dst", "value"))
        out, _ = program.run(graph, rounds, start=self.tasks)
        self.tasks = None
        return out

    def follow(self, stream: DataFrame, checkpoint: str, on_batch=None, available_now: bool = True, name: str | None = None):
        """Append each micro-batch of a streaming DataFrame of changes; on_batch(graph, batch id) may then match anew.

        Back-pressure is the source's maxFilesPerTrigger. name tells streams apart, by default by their checkpoint: batches of one
        stream are applied once, however often they are retried, and after a restart too.
        """
        own = name or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

        def step(rows: DataFrame, number: int) -> None:
            if self.last_batch is not None and self.last_batch <= 0:
                raise StreamEnded(own)
            self.append(rows, f"{own}-{number:012d}")
            self.compact()
            if on_batch is not None:
                on_batch(self, number)
            if self.last_batch is not None:
                self.last_batch -= 1

        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


    def wait(self, query) -> None:
        """Wait until a query of follow() has ended, be it that finish_after() ended it."""
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if StreamEnded.__name__ not in str(e):
                raise


class StreamEnded(Exception):
    """A stream has given as many batches as finish_after() asked for; its next batch is left for a restart."""


def merge_state(state: DataFrame, graph: DynamicGraph, initial: Column) -> DataFrame:
    """(id, value): the values kept from earlier batches, and initial (over id) for vertices that the graph has gained since.

    Values of vertices that lost all their edges are kept.
    """
    edges = graph.edges()
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.join(state.select("id", "value"), "id", "full").select("id", F.coalesce("value", initial).alias("value"))
