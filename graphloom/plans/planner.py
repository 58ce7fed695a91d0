"""Resource formulas: workers for a match, shards for a graph, bits for a Bloom filter.

Formulas are Columns over a table of parameters. Numbers are doubles throughout.
"""

from __future__ import annotations

from math import floor, log1p, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share of memory that may be used.
ALPHA = 0.75
MEMORY_MB = 2000
MAX_WORKERS = 10


def _d(x: str) -> Column:
    return F.col(x).cast("double")


def memory_plan(params: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """params (vertices, edges, q_nodes, q_edges, vertex_file, memory_mb) with in_memory: the parts that hold a match in memory."""
    need = 4 * _d("edges") * (32 + 4 * _d("q_nodes"))
    room = _d("memory_mb") * alpha * 1e6 - (1152 + _d("vertex_file") + _d("vertices") * (124 + 24 * _d("q_nodes") + 4 * _d("q_edges")))
    return params.withColumn("in_memory", F.ceil(need / F.nullif(room, F.lit(0.0))))


def swap_plan(params: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """params with swapped: the parts of a match that spills; -1 where memory does not suffice."""
    need = 4 * _d("edges") * (32 + 4 * _d("q_nodes")) + _d("vertices") * (120 + 24 * _d("q_nodes") + 4 * _d("q_edges")) + _d("vertex_file")
    room = alpha * _d("memory_mb") * 1e6 - (1152 + 4 * _d("vertices"))
    parts = F.ceil(need / F.nullif(room, F.lit(0.0))) + F.floor(_d("vertices") / 1e7)
    return params.withColumn("swapped", F.when(parts == 2, F.lit(-1)).otherwise(parts).cast("long"))


def worker_plan(params: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """params with worker ('memory', 'swap' or 'insufficient') and parts.

    In memory a match of more than one part takes one more; below 1 or from 10 parts on it spills.
    """
    both = swap_plan(memory_plan(params, alpha), alpha)
    fits = (F.col("in_memory") >= 1) & (F.col("in_memory") < MAX_WORKERS)
    parts = F.when(fits, F.when(F.col("in_memory") == 1, 1).otherwise(F.col("in_memory") + 1)).otherwise(F.col("swapped")).cast("long")
    worker = F.when(parts < 1, "insufficient").when(fits, "memory").otherwise("swap")
    return both.withColumn("parts", parts).withColumn("worker", worker).drop("in_memory", "swapped")


def shard_count(params: DataFrame, dynamic: bool = False) -> DataFrame:
    """params (edges, edge_bytes, memory_mb) with shards of at most an eighth of memory, rounded to the nearest number plus one;
    for edges of changing size four times as many plus two."""
    share = _d("edges") * _d("edge_bytes") / (_d("memory_mb") * 1048576.0 / 8)
    return params.withColumn("shards", F.floor((2 + 4 * share if dynamic else 1 + share) + 0.5).cast("int"))


def bloom_size(n: int, fpp: float) -> tuple[int, int]:
    """(bits, hashes) of the smallest Bloom filter for n elements at a rate of false positives; bits are whole bytes.

    With k hashes that takes -k n / ln(1 - fpp ** (1 / k)) bits, which is least near k = -log2(fpp): the better of the two whole
    numbers around it is taken, the smaller one of equals.
    """
    if n < 1 or not 0 < fpp < 1:
        raise ValueError("n must be positive and fpp between 0 and 1")
    near = floor(-log2(fpp))
    bits, hashes = min((-k * n / log1p(-(fpp ** (1.0 / k))), k) for k in (max(1, near), near + 1))
    return -(-int(bits) // 8) * 8, hashes
