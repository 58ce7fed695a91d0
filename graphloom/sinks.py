"""Results as files: matches, edges, values, interval and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_MATCH = "No match"
#: Ids that are put together at a time.
PIECE = 100_000


def match_lines(matches: DataFrame, per_line: int | None = 100_000) -> DataFrame:
    """(q, part, value): for each query node a line with its number, then lines of its ids ascending, each followed by a tab.

    Ids are cut into lines of per_line, so that no line holds an unbounded group. With None a query node has one line: its
    pieces are made on their own, and only their texts meet, of which a string has room for 2 GB.
    """
    from graphloom.runtime import in_order

    placed = in_order(matches.select("q", "id"), "q", "id")
    first = placed.groupBy("q").agg(F.min("index").alias("first"))
    parts = placed.join(F.broadcast(first), "q").withColumn("part", F.floor((F.col("index") - F.col("first")) / (per_line or PIECE)).cast("int") + 1)
    ids = parts.groupBy("q", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    body = ids.select("q", "part", F.array_join(F.transform("ids", lambda x: F.concat(x.cast("string"), F.lit("\t"))), "").alias("value"))
    if per_line is None:
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), "")
        body = body.groupBy("q").agg(whole.alias("value")).select("q", F.lit(1).alias("part"), "value")
    return body.unionByName(first.select("q", F.lit(0).alias("part"), F.col("q").cast("string").alias("value")))


def write_matches(matches: DataFrame, path: str, per_line: int = 100_000) -> None:
    """Match lines in order as text; one line `No match` where there is none."""
    if matches.isEmpty():
        matches.sparkSession.createDataFrame([(NO_MATCH,)], "value string").write.mode("overwrite").text(path)
        return
    match_lines(matches, per_line).orderBy("q", "part").select("value").write.mode("overwrite").text(path)


def edge_lines(edges: DataFrame, delimiter: str = "\t") -> DataFrame:
    """(value): src, dst and other columns parted by a delimiter."""
    return edges.select(F.concat_ws(delimiter, *(F.col(c).cast("string") for c in edges.columns)).alias("value"))


def write_edges(edges: DataFrame, path: str, delimiter: str = "\t") -> None:
    edges.write.mode("overwrite").option("sep", delimiter).csv(path)


def write_values(vertices: DataFrame, path: str, value: str = "value", delimiter: str = "\t") -> None:
    vertices.select("id", value).write.mode("overwrite").option("sep", delimiter).csv(path)


def write_history(spark, deltas: list[dict], path: str) -> None:
    """The log of a loop: iteration, updates, work, delta."""
    history(spark, deltas).coalesce(1).orderBy("iteration").write.mode("overwrite").csv(path)


def history(spark, deltas: list[dict]) -> DataFrame:
    return spark.createDataFrame([(d["iteration"], d["updates"], d["work"], float(d["delta"])) for d in deltas], "iteration int, updates long, work long, delta double")


def write_components(frequency: DataFrame, path: str) -> None:
    """label,n lines, the most frequent first."""
    frequency.orderBy(F.desc("n"), "label").write.mode("overwrite").csv(path)


def write_metadata(edges: DataFrame, path: str, shards: int) -> None:
    """What goes with a graph's shards, as tables in a folder: intervals, numvertices and degrees."""
    from graphloom.operators.analytics import degrees, num_vertices, range_shards

    for name, rows in (("intervals", range_shards(edges, shards)), ("numvertices", num_vertices(edges)), ("degrees", degrees(edges))):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def reset_edge_values(edges: DataFrame, zero=0.0) -> DataFrame:
    """edges with all values set to one: tables are immutable, so a run that starts anew reads these."""
    return edges.withColumn("value", F.lit(zero))


def split_files(spark, path: str, to: str, rows: int) -> None:
    """Rewrite Parquet files so that none has more than so many rows; rows keep their order within a file."""
    spark.read.parquet(path).write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(to)
