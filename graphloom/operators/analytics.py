"""Degrees, aggregations over vertices, labels, top lists, renumbering, duplicate edges and range shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.runtime import in_order, table


def degrees(edges: DataFrame) -> DataFrame:
    """(id, indegree, outdegree) of each vertex in an edge: one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.select("x.*").groupBy("id").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def degree_of(edges: DataFrame, vertex: int) -> DataFrame:
    """(id, indegree, outdegree) of one vertex, zero if it is in no edge."""
    return edges.where((F.col("src") == vertex) | (F.col("dst") == vertex)).agg(
        F.lit(vertex).cast("long").alias("id"), F.count_if(F.col("dst") == vertex).alias("indegree"), F.count_if(F.col("src") == vertex).alias("outdegree")
    )


def degree_totals(edges: DataFrame) -> DataFrame:
    """(connected, edges): vertices with an edge, and edges."""
    return degrees(edges).agg(F.count("*").alias("connected"), F.coalesce(F.sum("outdegree"), F.lit(0)).alias("edges"))


def num_vertices(edges: DataFrame) -> DataFrame:
    """(n_vertices): one more than the largest id in an edge."""
    return edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("n_vertices"))


def with_degrees(graph: Graph) -> DataFrame:
    """Vertices with their degrees, zero where they are in no edge."""
    found = graph.vertices.join(degrees(graph.edges), "id", "left")
    return found.fillna(0, ["indegree", "outdegree"])


def vertex_range(vertices: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Vertices from start up to, without, stop."""
    return vertices.where(F.col("id") >= start) if stop is None else vertices.where((F.col("id") >= start) & (F.col("id") < stop))


def for_each_vertex(vertices: DataFrame, visit: Callable[[list], None], start: int = 0, stop: int | None = None, at_once: int = 1 << 20) -> None:
    """Call visit on the executors with windows of at most at_once vertices of the range, each in order of ids."""

    def run(rows) -> None:
        window = []
        for r in rows:
            window.append(r)
            if len(window) == at_once:
                visit(window)
                window = []
        if window:
            visit(window)

    vertex_range(vertices, start, stop).repartitionByRange("id").sortWithinPartitions("id").foreachPartition(run)


def sum_vertices(vertices: DataFrame, value: str = "value", start: int = 0, stop: int | None = None) -> DataFrame:
    """(total): integers are summed as 64-bit numbers, others as doubles."""
    kind = "bigint" if vertices.schema[value].dataType.typeName() in ("byte", "short", "integer", "long") else "double"
    return vertex_range(vertices, start, stop).agg(F.sum(F.col(value).cast(kind)).alias("total"))


def label_frequency(vertices: DataFrame, label: str = "label", top: int | None = None) -> DataFrame:
    """(label, n): members of each label. The vertex whose id is the label is counted as one though its row is left out; labels
    that only such a vertex has are missing. With top, the most frequent ones."""
    out = vertices.where(F.col(label) != F.col("id")).groupBy(F.col(label).alias("label")).agg((F.count("*") + 1).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "label").limit(top)


def top_vertices(vertices: DataFrame, n: int, value: str = "value", shift: int = 0) -> DataFrame:
    """(id, value) of the n largest values, ties by smaller id; shift is added to the ids reported."""
    return vertices.orderBy(F.desc(value), F.asc("id")).limit(n).select((F.col("id") + shift).alias("id"), F.col(value).alias("value"))


def reduce_duplicates(edges: DataFrame, reduction: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """One edge for each (src, dst), its values reduced by an aggregate such as F.min, F.max or F.sum."""
    return edges.groupBy("src", "dst").agg(reduction(F.col(value)).alias(value))


def first_duplicate(edges: DataFrame, ordinal: str, value: str = "value") -> DataFrame:
    """One edge for each (src, dst): the one with the smallest ordinal."""
    return edges.groupBy("src", "dst").agg(F.min_by(value, ordinal).alias(value))


def order_by_degree(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertexmap(id, new_id), edges(src, dst) renumbered): new ids from 0 ascend with the degree, ties by id. Values are dropped."""
    deg = degrees(edges).select("id", (F.col("indegree") + F.col("outdegree")).alias("degree"))
    mapped = in_order(deg, "degree", "id", index="new_id").select("id", "new_id")
    src = mapped.select(F.col("id").alias("src"), F.col("new_id").alias("s"))
    dst = mapped.select(F.col("id").alias("dst"), F.col("new_id").alias("d"))
    return mapped, edges.select("src", "dst").join(src, "src").join(dst, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def range_shards(edges: DataFrame, shards: int) -> DataFrame:
    """(shard, first, last, n_edges): intervals of target ids of about equally many edges; a target's edges are in one shard."""
    per = edges.groupBy("dst").agg(F.count("*").alias("n"))
    total = max(1, edges.count())
    placed = in_order(per, "dst", total="n")
    shard = F.least(F.floor((F.col("running") - F.col("n")) * shards / F.lit(total)), F.lit(shards - 1)).cast("int")
    return placed.withColumn("shard", shard).groupBy("shard").agg(F.min("dst").alias("first"), F.max("dst").alias("last"), F.sum("n").alias("n_edges"))


def balanced_cut(edges: DataFrame, shards: int) -> DataFrame:
    """(shard, first, last, n_edges): intervals of target ids, cut one after the other as a stream of sorted edges would be.

    A shard ends at the first target with which it has as many edges as it should; then what is left is spread over the shards left.
    Running sums over targets are written in their order, so the search for an end reads the row groups that it falls into.
    Intervals adjoin: the first begins at 0, the last ends with the largest vertex of all.
    """
    spark = edges.sparkSession
    if shards < 1:
        raise ValueError("there must be a shard")
    total, most = edges.agg(F.count("*"), F.max(F.greatest("src", "dst"))).first()
    if not total:
        return spark.createDataFrame([], "shard int, first long, last long, n_edges long")
    placed = table(in_order(edges.groupBy("dst").agg(F.count("*").alias("n")), "dst", total="n").select("dst", "running").sortWithinPartitions("running"), "running")
    found, start, before, quota = [], 0, 0, total // shards + 1
    while before < total:
        k = len(found)
        end = placed.where(F.col("running") >= before + quota).orderBy("running").first()
        last, after = (most, total) if end is None or end.running == total else (end.dst, end.running)
        found.append((k, start, last, after - before))
        start, before = last + 1, after
        if k + 1 < shards:
            quota = (total - before) // (shards - k - 1)
    return spark.createDataFrame(found, "shard int, first long, last long, n_edges long")


def in_shards(edges: DataFrame, shards: DataFrame) -> DataFrame:
    """edges with the shard of their target: a range join with the few intervals (one row a shard)."""
    return edges.join(F.broadcast(shards.select("shard", "first", "last")), F.col("dst").between(F.col("first"), F.col("last"))).drop("first", "last")


def split_shards(edges: DataFrame, shards: DataFrame, limit: int) -> DataFrame:
    """shards (shard, first, last, n_edges) with each of more than limit edges parted at the target where half of them are reached,
    until none is that large or has one target only; numbered anew from 0."""
    # Running sums over all targets tell how many edges of a shard lie before a target, so no task gets all of a shard.
    placed = table(in_order(edges.groupBy("dst").agg(F.count("*").alias("n")), "dst", total="n").select("dst", "n", (F.col("running") - F.col("n")).alias("ahead")), "running")
    shards = shards.select("shard", "first", "last", "n_edges")
    while not shards.where((F.col("n_edges") > limit) & (F.col("first") < F.col("last"))).isEmpty():
        held = placed.join(F.broadcast(shards), F.col("dst").between(F.col("first"), F.col("last")))
        held = held.join(F.broadcast(held.groupBy("shard").agg(F.min("ahead").alias("start"))), "shard")
        before = F.col("ahead") - F.col("start")
        half = (F.col("n_edges") > limit) & (2 * before >= F.col("n_edges")) & (before > 0)
        half = half | ((F.col("n_edges") > limit) & (F.col("first") < F.col("last")) & (F.col("dst") == F.col("last")))
        parted = held.withColumn("half", half.cast("int")).groupBy("shard", "half").agg(F.min("dst").alias("first"), F.max("dst").alias("last"), F.sum("n").alias("n_edges"))
        shards = in_order(parted.drop("half", "shard"), "first", index="place").select(F.col("place").cast("int").alias("shard"), "first", "last", "n_edges")
    return shards


#: Rows of a key that a task folds at a time.
FOLDED = 4096


def fold_duplicates(edges: DataFrame, accept_first: Callable[[Column, Column], Column], order: list[str], keys: tuple[str, ...] = ("src", "dst"), folded: int = FOLDED) -> DataFrame:
    """edges with one row for each (src, dst): two that follow each other by `order` become the first where accept_first(first,
    second), over their structs, is true, else the second.

    Which one stays may depend on the order, but not on where one begins: a filter must give the same for (a, b), c and a, (b, c).
    Rows are placed in one order of all, and folded in runs of `folded` places; what runs of a key leave is folded again until there
    is one. So a key of very many rows is folded by many tasks, and no row of a run is far from another.
    """
    rows = in_order(edges.select(*keys, F.struct("*").alias("row"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order))), *keys, *(f"o{i}" for i in range(len(order))), index="place")
    rows = rows.select(*keys, "place", "row")

    def one(first: Column, second: Column) -> Column:
        return F.when(F.coalesce(accept_first(first["row"], second["row"]), F.lit(False)), first).otherwise(second)

    while True:
        runs = rows.groupBy(*keys, F.floor(F.col("place") / folded).alias("run")).agg(F.sort_array(F.collect_list(F.struct("place", "row"))).alias("l"))
        left = runs.select(*keys, "run", F.aggregate(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), F.get("l", F.lit(0)), one).alias("x"))
        left = table(left.select(*keys, "run", F.col("x.row").alias("row")), "folded")
        if left.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return left.select("row.*")
        # The runs that are left are placed anew, so a round leaves a part of folded of them.
        rows = in_order(left, *keys, "run", index="place").select(*keys, "place", "row")


def random_order(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """rows with place, their number in an order that the seed fixes."""
    return in_order(rows.withColumn("__draw", F.xxhash64(F.lit(seed), key)), "__draw", key, index="place").drop("__draw")


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbours): the ids at the other end of a vertex's edges in ascending order, whatever their direction."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    return both.groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))


def random_out_edge(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(id, dst): a random target of each vertex that has one, drawn without gathering its edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.min_by("dst", F.xxhash64(F.lit(seed), "src", "dst")).alias("dst"))


def change(old: DataFrame, new: DataFrame, value: str = "value") -> DataFrame:
    """(delta): the sum of absolute differences of a value between two vertex tables."""
    a, b = old.select("id", F.col(value).alias("a")), new.select("id", F.col(value).alias("b"))
    return a.join(b, "id").agg(F.coalesce(F.sum(F.abs(F.col("b") - F.col("a"))), F.lit(0.0)).cast("double").alias("delta"))


def ordinals(edges: DataFrame, order: str) -> DataFrame:
    """edges with valindex, the place of each among the edges with its ends, by `order`."""
    from pyspark.sql import Window as W

    return edges.withColumn("valindex", F.row_number().over(W.partitionBy("src", "dst").orderBy(order)) - 1)


#: A vertex with more edges than these, and more than one of HUBS of all, is joined by broadcast.
HUB, HUBS = 100_000, 20_000


def _told(rows: DataFrame, least: DataFrame, total: int, top: int) -> DataFrame:
    """rows joined with least (a, m, n) on a; the vertices of most edges, fewer than HUBS as degrees sum up to total, by broadcast."""
    limit = max(HUB, total // HUBS)
    if top <= limit:
        return rows.join(least, "a")
    hubs, others = F.broadcast(least.where(F.col("n") > limit)), least.where(F.col("n") <= limit)
    return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(others, "a"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each vertex is connected with, by large-star and small-star steps.

    Rounds end once all edges are stars: each points to a vertex that points to none.
    """
    from graphloom.runtime import table

    e = table(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    while True:
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up")))
        nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        odd = (F.col("up") > 1) | (F.col("up") > 0) & (F.col("up") < F.col("n"))
        total, top, left = nodes.agg(F.sum("up"), F.max("n"), F.count_if(odd)).first()
        if not left:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _told(both, least, 2 * total, top).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = _told(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), 2 * total, top)
        e = table(low.select("a", F.col("m").alias("b")).unionByName(low.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().join(stars, "id", "left_anti").select("id", F.col("id").alias("label"))
    return stars.unionByName(loops)
