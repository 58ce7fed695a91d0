"""Monotone kernels run block by block: a block's vertices see one another's new values at once, those of other blocks after an exchange.

Vertices are dealt to blocks by ranges of ids with about equally many edges. Edges within a block stay with it; a block is run until
nothing in it changes, which takes as many sweeps as it takes but no shuffle. Then what has changed is told along the edges that lead
to other blocks, added up before and after the shuffle. As values only ever fall (or only ever rise), the fixpoint is the one that
rounds of all vertices at a time reach, in fewer exchanges than rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.analytics import degrees
from graphloom.operators.simulate import _Edges, _reversed
from graphloom.runtime import in_order, table

#: Edges of a block, about; a target's edges are in one block, but those from other blocks are not kept there.
BLOCK_EDGES = 2_000_000


@dataclass(frozen=True)
class BlockKernel:
    """A kernel on arrays: message tells what values say along out-edges; a vertex takes the least of its own value and what it is
    told, or the largest if rising. Values are longs or doubles. message must keep order: what falls may not say more."""

    message: Callable[[np.ndarray], np.ndarray]
    rising: bool = False
    kind: str = "long"


def _settled(kernel: BlockKernel, value: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Values of a block after sweeps over its edges (places of sources and targets) until nothing changes.

    A sweep follows the out-edges of vertices that the one before has changed.
    """
    best = np.maximum if kernel.rising else np.minimum
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    first = np.searchsorted(source, np.arange(len(value) + 1))
    active = np.arange(len(value))
    while len(active):
        size = first[active + 1] - first[active]
        edge = np.arange(size.sum()) + np.repeat(first[active] - (np.cumsum(size) - size), size)
        new = value.copy()
        best.at(new, target[edge], kernel.message(np.repeat(value[active], size)))
        active = np.flatnonzero(new != value)
        value = new
    return value


def run_blocks(edges: DataFrame, initial: Column, kernel: BlockKernel, block_edges: int = BLOCK_EDGES, history: list[dict] | None = None) -> DataFrame:
    """(id, value): the fixpoint of a monotone kernel over the vertices of edges (src, dst), from initial (over id, indegree, outdegree).

    history, where given, gets a dict for each exchange: how many values it has changed.
    """
    edges = table(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    # A block begins where the in-edges of the vertices before have filled the last one.
    ordered = in_order(degrees(edges), "id", total=F.col("indegree") + 1)
    block = F.floor((F.col("running") - F.col("indegree") - 1) / block_edges).cast("int")
    state = table(ordered.select("id", block.alias("block"), initial.cast(kernel.kind).alias("value")), "blocks")
    # Blocks of both ends: no task gets all edges of a hub.
    ends = _Edges(edges)
    there = table(ends.joined(state.select("id", F.col("block").alias("to"))).select("src", "dst", "to"), "ends")
    ends.unpersist()
    starts = _Edges(there.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "to"))
    placed = table(starts.joined(state.select("id", "block")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "block", "to"), "placed")
    starts.unpersist()
    inner = placed.where("block = to").select("block", "src", "dst").repartition("block").persist()
    outer = table(placed.where("block <> to").select("src", "dst"), "outer")
    dealt = _Edges(_reversed(outer))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, value = np.asarray(left["id"]), np.asarray(left["value"])
        told = np.asarray(left["told"].fill_null(0)), np.asarray(left["told"].is_valid())
        order = np.argsort(ids)
        ids, value, acc, some = ids[order], value[order], told[0][order], told[1][order]
        best = np.maximum if kernel.rising else np.minimum
        now = np.where(some, best(value, acc), value)
        now = _settled(kernel, now, np.searchsorted(ids, np.asarray(right["src"])), np.searchsorted(ids, np.asarray(right["dst"])))
        return pa.table({"id": ids, "block": pa.array(np.full(len(ids), left["block"][0].as_py()), pa.int32()), "value": now, "says": kernel.message(now).astype(now.dtype), "changed": now != value})

    kind = kernel.kind
    told, first = state.where(F.lit(False)).select("id", F.col("value").alias("told")), True
    while True:
        rows = state.join(told, "id", "left").select("id", "block", "value", "told")
        around = inner.withColumnRenamed("block", "of").groupBy("of")
        new = table(rows.groupBy("block").cogroup(around).applyInArrow(run, f"id long, block int, value {kind}, says {kind}, changed boolean"), "blocks")
        state = new.select("id", "block", "value")
        # At first every vertex tells its value, later those that have a new one.
        speaking = new if first else new.where("changed")
        if history is not None:
            history.append({"changed": new.where("changed").count()})
        most = F.max if kernel.rising else F.min
        told = table(dealt.joined(speaking.select("id", "says")).groupBy(F.col("src").alias("id")).agg(most("says").alias("told")), "told")
        first = False
        if told.isEmpty():
            break
    dealt.unpersist()
    inner.unpersist()
    return state.select("id", "value")
