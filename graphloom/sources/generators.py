"""Generated graphs: lattices of one to four dimensions, random graphs, random weights."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Edges of a random graph that a task makes, about; the first ones make up to twice as many.
SLICE = 20_000_000
#: Edges that a task holds in arrays at once.
PIECE = 32_768


def _edges(ids: DataFrame, steps: list[tuple[Column, Column]]) -> DataFrame:
    """(src, dst) for each id and step whose condition holds: steps are (condition, target)."""
    targets = F.array_compact(F.array(*(F.when(ok, to) for ok, to in steps)))
    return ids.select(F.col("id").alias("src"), F.explode(targets).alias("dst"))


def lattice(spark: SparkSession, n: int, dimensions: int) -> DataFrame:
    """Edges from each point of an n ** dimensions lattice to the next one along each axis."""
    ids = spark.range(n**dimensions)
    place = lambda d: F.floor(F.col("id") / n**d) % n
    return _edges(ids, [(place(d) < n - 1, F.col("id") + n**d) for d in range(dimensions)])


def chain(spark: SparkSession, n: int) -> DataFrame:
    return lattice(spark, n, 1)


def grid(spark: SparkSession, n: int) -> DataFrame:
    return lattice(spark, n, 2)


def crossgrid(spark: SparkSession, n: int) -> DataFrame:
    """A grid with both diagonals that lead to the right."""
    i = F.col("id")
    x, y = i % n, F.floor(i / n)
    diagonals = [((x < n - 1) & (y < n - 1), i + n + 1), ((x < n - 1) & (y > 0), i - n + 1)]
    return grid(spark, n).unionByName(_edges(spark.range(n * n), diagonals))


def cubegrid(spark: SparkSession, n: int) -> DataFrame:
    return lattice(spark, n, 3)


def quadgrid(spark: SparkSession, n: int) -> DataFrame:
    return lattice(spark, n, 4)


def _later(n: int, p: float, seed: int, i: int, piece: int):
    """Pieces (j, turn) of at most `piece` edges of i to later vertices, and whether an edge leads from j to i. Arrays are used again."""
    import numpy as np

    rng = np.random.default_rng([seed, i])
    if n - 1 - i <= 0 or not p:
        return
    drawn, turn = np.empty(piece), np.empty(piece, bool)
    if p == 1:
        # Every gap is 1: there is nothing to draw.
        step, j = np.arange(min(piece, n)), np.empty(min(piece, n), np.int64)
        pieces = (np.add(step[: n - at], at, out=j[: n - at]) for at in range(i + 1, n, piece))
    else:
        found, at = [], i
        while at < n:
            gaps = rng.geometric(p, max(16, int((n - 1 - i) * p * 1.2)))
            places = at + np.cumsum(gaps)
            found.append(places[places < n])
            at = int(places[-1])
        whole = np.concatenate(found)
        pieces = (whole[k : k + piece] for k in range(0, len(whole), piece))
    for part in pieces:
        m = len(part)
        yield part, np.less(rng.random(out=drawn[:m]), 0.5, out=turn[:m])


def _slices(spark: SparkSession, n: int, p: float) -> DataFrame:
    """(id) of n vertices, dealt to tasks by the edges that they have to later ones."""
    return spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, int(n * n / 2 * p) // SLICE + 1))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Each pair i < j is an edge with probability p, in a random direction.

    Pairs are not made one by one: for each i the gaps between accepted j are drawn as geometric numbers, so rows are made for edges
    only. Draws depend on the seed and i, not on partitions.
    """
    if not 0 <= p <= 1:
        raise ValueError("p is a probability")

    piece = PIECE

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in batch["id"].to_pylist():
                for j, turn in _later(n, p, seed, i, piece):
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(turn, j, i)), pa.array(np.where(turn, i, j))], ["src", "dst"])

    return _slices(spark, n, p).mapInArrow(draw, "src long, dst long")


def folded_erdos_renyi(spark: SparkSession, n: int, p: float, fold: Callable, schema: str, seed: int = 0, weight_seed: int = 0, limit: int = 100_000_000) -> DataFrame:
    """Rows (schema), which fold(i, pieces) gives as a dict for each vertex i, where pieces are arrays (src, dst, value) of its edges to later vertices.

    All edges are made, those of erdos_renyi with the values of random_weights, but a piece at a time where they are folded: they are
    no rows, which a graph with many more edges than vertices could not pay for. fold must not keep the arrays.
    """
    if not 0 <= p <= 1:
        raise ValueError("p is a probability")
    columns, piece = to_arrow_schema(StructType.fromDDL(schema)), PIECE

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights = weigher(weight_seed, limit, piece)
        other = np.empty(piece, np.int64)

        def edges(i):
            for j, turn in _later(n, p, seed, i, piece):
                src, dst = np.where(turn, j, i), other[: len(j)]
                # The other end; a masked copy takes three times as long.
                np.subtract(np.add(j, i, out=dst), src, out=dst)
                yield src, dst, weights(src, dst)

        for batch in batches:
            yield pa.RecordBatch.from_pylist([fold(i, edges(i)) for i in batch["id"].to_pylist()], columns)

    return _slices(spark, n, p).mapInArrow(run, schema)


def weigher(seed: int = 0, limit: int = 100_000_000, piece: int = PIECE) -> Callable:
    """A function of arrays src and dst of at most `piece` edges that gives the values of random_weights; its arrays are used again."""
    import numpy as np

    one, two, three, four, five = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    full = (1 << 64) - 1
    # The seed's own hash, by XXH64 of four bytes under Spark's seed of 42.
    h = (42 + five + 4) & full ^ ((seed & 0xFFFFFFFF) * one & full)
    h = (((h << 23 | h >> 41) & full) * two + three) & full
    h = (h ^ h >> 33) * two & full
    h = (h ^ h >> 29) * three & full
    start = h ^ h >> 32
    u = np.uint64
    first, second, third, fourth, added = u(one), u(two), u(three), u(four), u((five + 8) & full)
    held = np.empty((3, piece), u)

    by = [u(k) for k in range(64)]

    def turned(x, k, t):
        np.left_shift(x, by[k], out=t)
        np.right_shift(x, by[64 - k], out=x)
        np.bitwise_or(x, t, out=x)

    def mixed(x, k, t):
        np.right_shift(x, by[k], out=t)
        np.bitwise_xor(x, t, out=x)

    def weights(src, dst):
        x, h, t = held[:, : len(src)]
        h[:] = u(start)
        for end in (src, dst):
            np.multiply(end.view(u), second, out=x)
            turned(x, 31, t)
            np.multiply(x, first, out=x)
            np.add(h, added, out=h)
            np.bitwise_xor(h, x, out=h)
            turned(h, 27, t)
            np.multiply(h, first, out=h)
            np.add(h, fourth, out=h)
            mixed(h, 33, t)
            np.multiply(h, second, out=h)
            mixed(h, 29, t)
            np.multiply(h, third, out=h)
            mixed(h, 32, t)
        # The remainder of a floor division is pmod's.
        value, down = h.view(np.int64), t.view(np.int64)
        np.floor_divide(value, limit, out=down)
        np.multiply(down, limit, out=down)
        return np.subtract(value, down, out=value)

    return weights


def random_weights(edges: DataFrame, seed: int = 0, limit: int = 100_000_000) -> DataFrame:
    """edges with value, a whole number from 0 to limit - 1 that depends on the seed and the edge alone."""
    return edges.withColumn("value", F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(limit)))


def multivalue_lines(spark: SparkSession, n: int, max_out: int = 50, seed: int = 0) -> DataFrame:
    """Lines `i dst v[:v+1:v+2]` with v = i + dst, three values where v % 3 = 1: an input for readers of lists."""
    degree = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max_out))
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.greatest(degree, F.lit(1)))).alias("k")).select("id", F.pmod(F.xxhash64(F.lit(seed), "id", "k"), F.lit(n)).alias("dst"))
    v = F.col("id") + F.col("dst")
    values = F.when(v % 3 == 1, F.concat_ws(":", v, v + 1, v + 2)).otherwise(v.cast("string"))
    return rows.where("id <> dst").distinct().select(F.concat_ws(" ", "id", "dst", values).alias("value"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
