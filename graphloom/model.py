"""Data graphs, as two DataFrames, and query patterns, which are small and live on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a pattern's node that are no predicates.
RESERVED = ("id", "out_degree")


@dataclass(frozen=True)
class Pattern:
    """Query nodes, each a conjunction {key: value}, and directed edges between their numbers."""

    nodes: tuple[dict[str, Any], ...]
    edges: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        for s, t in self.edges:
            if not (0 <= s < len(self.nodes) and 0 <= t < len(self.nodes)):
                raise ValueError(f"edge {s} -> {t} names no node")

    @classmethod
    def parse(cls, text: str) -> Pattern:
        raw = json.loads(text)
        return cls(tuple(raw["node"]), tuple((int(e["source"]), int(e["target"])) for e in raw.get("edge", ())))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pattern:
        return cls.parse(spark.read.text(path, wholetext=True).first()[0])

    @classmethod
    def labelled(cls, labels: list[str], edges: list[tuple[int, int]], key: str = "label") -> Pattern:
        return cls(tuple({key: x} for x in labels), tuple(edges))

    def out_degrees(self) -> list[int]:
        """Edges of each node, duplicates counted."""
        return [sum(s == q for s, _ in self.edges) for q in range(len(self.nodes))]

    def needs(self) -> list[int]:
        """For each node a bit mask of the nodes its edges lead to."""
        return [reduce(lambda m, t: m | 1 << t, (t for s, t in self.edges if s == q), 0) for q in range(len(self.nodes))]

    def reversed(self) -> Pattern:
        return Pattern(self.nodes, tuple((t, s) for s, t in self.edges))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(q, out_degree)"""
        return spark.createDataFrame(list(enumerate(self.out_degrees())), "q int, out_degree long")

    def edge_table(self, spark: SparkSession) -> DataFrame:
        """(source, target) without duplicates."""
        return spark.createDataFrame(sorted(set(self.edges)), "source int, target int")


@dataclass
class Graph:
    """vertices(id, ...) and edges(src, dst, ...). Attributes are columns, or one variant column named attrs."""

    vertices: DataFrame
    edges: DataFrame
    attrs: str | None = field(default=None)

    def simple(self) -> DataFrame:
        """(src, dst) without loops and duplicates."""
        return self.edges.select("src", "dst").where("src <> dst").dropDuplicates(["src", "dst"])

    def dense(self) -> DataFrame:
        """Vertices for each id from 0 to the largest one in an edge."""
        spark = self.edges.sparkSession
        last = self.edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        ids = spark.range(0 if last is None else last + 1)
        return ids.join(self.vertices, "id", "left")
