"""Values of vertices kept in a state store while edges stream in.

A micro-batch touches the vertices that it has edges of, not the graph: their state is read from the store by key, changed and put
back. What changes is written as one folder a batch, named by the batch, so a batch that is run again after a failure replaces what
it wrote; the newest row of a vertex is its value. A stream that is started again with its checkpoint goes on from its last batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VertexState:
    """Values (id, ...) in a folder, fed by a stream. The columns are told when the stream is followed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _follow(self, updates: DataFrame, checkpoint: str, available_now: bool):
        columns = [c for c in updates.columns if c != "id"]
        shape = updates.select("id", F.struct(*columns).alias("value")).schema

        def write(rows: DataFrame, number: int) -> None:
            out = rows.select("id", F.struct(*columns).alias("value"), F.lit(number).cast("long").alias("batch"))
            out.write.mode("overwrite").parquet(f"{self.path}/batch-{number:012d}")

        self.schema = shape.add("batch", "long")
        writer = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def follow(self, edges: DataFrame, checkpoint: str, values: dict[str, Column], key: str = "dst", available_now: bool = True):
        """Keep aggregates of each vertex's edges, as Columns over the edges; key says which end is the vertex.

        It is a streaming aggregation, so that nothing leaves the JVM, and a hot vertex's edges are added up before they are shuffled.
        """
        return self._follow(edges.groupBy(F.col(key).alias("id")).agg(*(v.alias(n) for n, v in values.items())), checkpoint, available_now)

    def follow_program(self, edges: DataFrame, checkpoint: str, step: Callable[[int, Iterator, tuple | None], tuple], schema: str, key: str = "dst", available_now: bool = True):
        """Keep what step(id, frames of new edges, state or None) returns, a tuple of schema: for programs that are no aggregate.

        The frames are pandas frames that come one after the other, so a vertex may have any number of new edges.
        """
        import pandas as pd

        names = [c.split()[0] for c in schema.split(",")]

        def run(keys, frames, state):
            new = step(keys[0], frames, state.get if state.exists else None)
            state.update(new)
            yield pd.DataFrame([(keys[0], *new)], columns=["id", *names])

        kept = edges.withColumn("id", F.col(key).cast("long")).groupBy("id").applyInPandasWithState(run, f"id long, {schema}", schema, "update", "NoTimeout")
        return self._follow(kept, checkpoint, available_now)

    def written(self) -> DataFrame:
        """(id, value, batch): all rows that batches have written."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")

    def values(self) -> DataFrame:
        """(id, ...) as of the last batch."""
        return self.written().groupBy("id").agg(F.max_by("value", "batch").alias("value")).select("id", "value.*")
