"""Strong, strict and bounded simulation, many patterns at once and the label index against plain versions."""

import random

import pytest
from model_simulations import bounded, strong
from model_worklist import simulation
from pyspark.sql import functions as F

from graphloom.model import Graph, Pattern
from graphloom.operators import bounded as BS
from graphloom.operators import labels as L
from graphloom.operators import many as MP
from graphloom.operators import simulate as M
from graphloom.operators import strong as ST


def make(spark, labels, edges):
    v = spark.createDataFrame(list(labels.items()), "id long, label string")
    return Graph(v, spark.createDataFrame(list(edges), "src long, dst long"))


def rows(df):
    return {tuple(r) for r in df.collect()}


def drawn(seed, n=24, m=48, letters=("a", "b", "ab", "c", None)):
    rng = random.Random(seed)
    labels = {i: rng.choice(letters) for i in range(n)}
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return rng, labels, edges + edges[:3]


SHAPES = [(["a", "b"], [(0, 1)]), (["a", "b", "c"], [(0, 1), (1, 2)]), (["a", "b"], [(0, 1), (1, 0)]), (["a", "b", "a"], [(0, 1), (2, 1), (0, 1)])]


@pytest.mark.parametrize("seed", range(len(SHAPES)))
def test_strong_and_strict_equal_the_model(spark, seed):
    _, labels, edges = drawn(seed)
    wants, pattern_edges = SHAPES[seed]
    g, p = make(spark, labels, edges), Pattern.labelled(wants, pattern_edges)
    for strict in (False, True):
        assert rows(ST.simulate_strong(g, p, strict=strict)) == strong(labels, edges, wants, pattern_edges, strict)


def test_strong_simulation_sees_what_plain_simulation_does_not(spark):
    # A cycle of four matches one of two, as long as nobody looks at how far its vertices are from one another.
    labels = {0: "a", 1: "b", 2: "a", 3: "b", 10: "a", 11: "b"}
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (10, 11), (11, 10)]
    g, p = make(spark, labels, edges), Pattern.labelled(["a", "b"], [(0, 1), (1, 0)])
    assert {r.id for r in M.simulate(g, p, dual=True).collect()} == {0, 1, 2, 3, 10, 11}
    assert rows(ST.simulate_strong(g, p)) == {(10, 0, 10), (10, 1, 11), (11, 0, 10), (11, 1, 11)}
    one = Pattern.labelled(["a"], [])
    assert rows(ST.simulate_strong(g, one)) == {(i, 0, i) for i in (0, 2, 10)}
    assert rows(ST.simulate_strong(make(spark, {}, []), p)) == set()
    assert rows(ST.simulate_strong(g, Pattern.labelled(["a", "no"], [(0, 1)]))) == set()
    with pytest.raises(ValueError):
        ST.simulate_strong(g, Pattern.labelled(["a", "b"], []))
    assert ST.diameter(Pattern.labelled(list("abcd"), [(0, 1), (2, 1), (2, 3)])) == 3


def test_a_hub_has_its_neighbours_in_blocks(spark):
    pairs = spark.range(5000).select(F.lit(7).cast("long").alias("id"), (F.col("id") + 100).alias("other"))
    pairs = pairs.unionByName(spark.createDataFrame([(100, 7), (3, 4)], "id long, other long"))
    way = ST.Adjacency(pairs, hub=500, hubs=1000)
    blocks = {r.block: r.n for r in way.pairs.where("id = 7").groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert len(blocks) == 10 and max(blocks.values()) < 700
    asked = spark.createDataFrame([(1, 7), (2, 7), (2, 3), (2, 9)], "centre long, id long")
    found = way.joined(asked)
    assert found.columns == ["id", "centre", "other"] and found.count() == 10_001 and found.distinct().count() == 10_001


@pytest.mark.parametrize("seed", range(3))
def test_bounded_equals_the_model(spark, seed):
    rng, labels, edges = drawn(seed + 10, n=22, m=26)
    n = 3
    wants = [rng.choice("abc") for _ in range(n)]
    pattern_edges = [(0, 1), (1, 2), (2, rng.randrange(2)), (0, 1)][: 3 + seed % 2]
    bounds = [rng.choice([1, 2, 3, None]) for _ in pattern_edges]
    g, p = make(spark, labels, edges), Pattern.labelled(wants, pattern_edges)
    assert rows(BS.simulate_bounded(g, p, bounds)) == bounded(labels, edges, wants, pattern_edges, bounds)
    assert rows(BS.simulate_bounded(g, p, [1] * len(pattern_edges))) == rows(M.simulate(g, p))


def test_bounds_on_a_path_and_a_cycle(spark):
    labels = {i: "abcd"[min(i, 3)] for i in range(6)}
    g = make(spark, labels, [(i, i + 1) for i in range(5)])
    far = Pattern.labelled(["a", "d"], [(0, 1)])
    assert rows(BS.simulate_bounded(g, far, [2])) == set()
    assert rows(BS.simulate_bounded(g, far, [3])) == rows(BS.simulate_bounded(g, far, [BS.ANY])) == {(0, 0), (1, 3), (1, 4), (1, 5)}
    # A vertex reaches itself over a cycle alone.
    own = Pattern.labelled(["a"], [(0, 0)])
    ring = make(spark, {0: "a", 1: "b", 2: "c"}, [(0, 1), (1, 2), (2, 0)])
    assert rows(BS.simulate_bounded(ring, own, [2])) == set() and rows(BS.simulate_bounded(ring, own, [3])) == {(0, 0)}
    assert rows(BS.simulate_bounded(g, own, [BS.ANY])) == set()
    parsed, bounds = BS.bounded_pattern('{"node": [{"label": "a"}, {"label": "d"}], "edge": [{"source": 0, "target": 1, "bound": 3}, {"source": 0, "target": 1, "bound": "*"}, {"source": 0, "target": 1}]}')
    assert parsed.edges == ((0, 1),) * 3 and bounds == [3, None, 1]
    for wrong in ([0], [1, 1], []):
        with pytest.raises(ValueError):
            BS.simulate_bounded(g, far, wrong)


def test_many_patterns_equal_single_runs_and_scan_edges_once_a_round(spark, monkeypatch):
    rng, labels, edges = drawn(5, n=30, m=80)
    g = make(spark, labels, edges)
    patterns = [Pattern.labelled([rng.choice("abc") for _ in range(k)], [(rng.randrange(k), rng.randrange(k)) for _ in range(k)]) for k in [1, 2, 3, 4, 5] * 2]
    patterns += [Pattern.labelled(["a", "none"], [(0, 1)]), Pattern((), ()), Pattern.labelled(["a"], [])]
    # One pattern of more nodes than a word has bits.
    patterns.append(Pattern.labelled(["a"] + ["b", "a"] * 40, [(0, i) for i in range(1, 81)] + [(7, 3)]))
    joins, history = [], []
    kept = MP._Edges.joined
    monkeypatch.setattr(MP._Edges, "joined", lambda self, state: joins.append(1) or kept(self, state))
    for isolated in (False, True):
        joins.clear()
        history.clear()
        found = rows(MP.simulate_many(g, patterns, include_isolated=isolated, history=history))
        assert len(joins) == len(history) - 1
        want = {(i, *x) for i, p in enumerate(patterns) for x in simulation(labels, edges, [n["label"] for n in p.nodes], p.edges, isolated)}
        assert found == want
    assert history[0]["patterns"] == len(patterns) - 1 and history[-1]["patterns"] < history[0]["patterns"] and sum(h["settled"] + h["lost"] for h in history) == len(patterns) - 1
    assert {(q, i) for p, q, i in rows(MP.simulate_many(g, patterns[1:3], dual=True)) if p == 0} == rows(M.simulate(g, patterns[1], dual=True))
    assert rows(MP.simulate_many(g, [])) == set()
    with pytest.raises(RuntimeError):
        MP.simulate_many(g, patterns, max_rounds=0)


def test_large_patterns_need_no_other_call(spark):
    labels = {i: "abc"[i % 3] for i in range(30)}
    edges = [(i, j) for i in range(30) for j in (i + 1, i + 2) if j < 30]
    wants, pattern_edges = ["a"] + ["b", "c"] * 35, [(0, i) for i in range(1, 71)]
    found = rows(M.simulate(make(spark, labels, edges), Pattern.labelled(wants, pattern_edges)))
    assert found == simulation(labels, edges, wants, pattern_edges) and len(found) > 71


def test_label_search(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 16)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé \n%_") for _ in range(rng.randrange(0, 70))) for _ in range(120)]
    texts += [None, "", "a", "ab", "abc" * 40, "x" * 16 + "yz", "x" * 15 + "yzw", "日本語です", "a.c", "😀😁😂 smile"]
    data = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    index = L.LabelIndex.build(data, "name")
    needles = ["", "a", "é", "ab", "c\n", "abc", "abca", "xyz", "xyzw", "none at all", "日", "本語", "本語で", "a.c", "%", "_%", "aaaaaaaa", "😀", "😁😂", "zz"]
    needles += ["".join(rng.choice("abc") for _ in range(k)) for k in (1, 2, 3, 4, 5, 6) for _ in range(3)]
    found = rows(index.search(needles))
    assert found == {(k, i) for k, n in enumerate(needles) for i, t in enumerate(texts) if t is not None and n in t}
    assert rows(index.search(["abca"], most=1)) == {(0, i) for i, t in enumerate(texts) if t and "abca" in t}
    again = L.LabelIndex(spark, index.path, data, "name")
    assert rows(again.search(["abc"])) == rows(index.search(["abc"]))
    assert index.search([]).count() == 0 and L.LabelIndex.build(data.limit(0), "name").search(["a", "abc"]).count() == 0
    # A search for a rare needle looks at few labels.
    assert index.candidates(["xyzw"]).count() == 1


def test_a_search_reads_its_grams_alone(spark):
    data = spark.range(20_000).select("id", F.concat(F.lit("label number "), F.hex(F.xxhash64("id"))).alias("name"))
    index = L.LabelIndex.build(data, "name")
    plan = index.candidates(["ABC"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram, [ABC])" in plan or "EqualTo(gram,ABC)" in plan


def test_indexed_candidates(spark):
    labels = {i: x for i, x in enumerate(["abcd", "bcde", "abc", "cde", None, "abcde"])}
    v = spark.createDataFrame([(i, x, i % 2, x and x[::-1]) for i, x in labels.items()], "id long, label string, odd int, back string")
    g = Graph(v, spark.createDataFrame([], "src long, dst long"))
    p = Pattern(({"label": "bcd"}, {"label": "cd", "odd": 1}, {"odd": 0}, {"back": "dcb", "label": "a"}, {"label": 3}, {}), ())
    found = L.indexed_candidates(g, p, {"label": L.LabelIndex.build(v, "label")})
    assert rows(found) == rows(M.candidates(g, p))
