"""Matches kept up to date against matching anew after each batch."""

import random

import pytest
from model_worklist import simulation
from pyspark.sql import functions as F

from graphloom.model import Graph, Pattern
from graphloom.operators.incremental import Counts, IncrementalMatch


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_matching_anew(spark, seed):
    rng = random.Random(seed)
    n = 18
    labels = {i: rng.choice(["a", "b", "ab", None]) for i in range(n)}
    wants, pattern_edges = [(["a", "b"], [(0, 1), (1, 0)]), (["a", "b", "a"], [(0, 1), (1, 2)]), (["b", "a", "b"], [(0, 1), (1, 1), (1, 2)])][seed]
    draw = lambda k: [(rng.randrange(n), rng.randrange(n)) for _ in range(k)]
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    now = set(draw(25))
    g = Graph(spark.createDataFrame(list(labels.items()), "id long, label string"), frame(list(now)))
    isolated = seed == 2
    m = IncrementalMatch(g, Pattern.labelled(wants, pattern_edges), include_isolated=isolated)
    for step in range(4):
        found = {(r.q, r.id) for r in m.matches().collect()}
        assert found == simulation(labels, now, wants, pattern_edges, isolated), step
        if step % 2:
            gone = rng.sample(sorted(now), min(len(now), 6)) + draw(2)
            m.delete(frame(gone + gone[:1]))
            now -= set(gone)
        else:
            new = draw(10)
            m.insert(frame(new + new[:2]))
            now |= set(new)


def test_deleting_and_inserting_everything(spark):
    v = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "id long, label string")
    ring = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long")
    m = IncrementalMatch(Graph(v, ring), Pattern.labelled(["a", "b"], [(0, 1), (1, 0)]))
    assert m.matches().count() == 6
    m.delete(ring.limit(1))
    assert m.matches().count() == 0 and m.alive.now().count() == 0
    m.insert(ring)
    assert m.matches().count() == 6
    m.delete(ring)
    m.delete(ring)
    m.insert(ring.limit(0))
    assert m.matches().count() == 0 and m.edges.now().count() == 0
    m.insert(ring)
    assert m.matches().count() == 6


def test_counts_are_merged(spark, monkeypatch):
    monkeypatch.setattr(Counts, "PARTS", 2)
    c = Counts(spark.range(100).select("id", F.lit(1).alias("n")), ["id"], "c")
    for k in range(5):
        c.add(spark.createDataFrame([(k, -1), (200 + k, 2)], "id long, n int"))
        assert len(c.changes) <= 2
    assert c.now().count() == 100 and c.of(spark.createDataFrame([(0,), (204,), (99,)], "id long"), ["id"]).count() == 2
