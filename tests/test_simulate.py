import json
import random

import pytest
from model_worklist import simulation
from pyspark.sql import functions as F

from graphloom.functions.predicates import candidate_mask
from graphloom.model import Graph, Pattern
from graphloom.operators import simulate as M


def make(spark, labels, edges):
    v = spark.createDataFrame(list(labels.items()), "id long, label string")
    return Graph(v, spark.createDataFrame(list(edges), "src long, dst long"))


def found(df):
    return {(r.q, r.id) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_three_implementations_agree_with_the_worklist(spark, seed):
    rng = random.Random(seed)
    n = 25
    labels = {i: rng.choice(["a", "b", "ab", None]) for i in range(n)}
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(60)]
    edges += edges[:5]
    wants = [rng.choice("ab") for _ in range(3)]
    pattern_edges = [(rng.randrange(3), rng.randrange(3)) for _ in range(3)]
    g, p = make(spark, labels, edges), Pattern.labelled(wants, pattern_edges)
    for isolated in (False, True):
        want = simulation(labels, edges, wants, pattern_edges, isolated)
        assert found(M.simulate(g, p, include_isolated=isolated)) == want
        assert found(M.simulate_pairs(g, p, include_isolated=isolated)) == want
        assert found(M.simulate_delta(g, p, include_isolated=isolated)) == want


def test_small_cases(spark):
    labels = {0: "a", 1: "b", 2: "a", 3: "b", 4: "b", 5: None}
    g = make(spark, labels, [(0, 1), (1, 0), (2, 3), (3, 3), (5, 0)])
    assert found(M.simulate(g, Pattern.labelled(["a", "b"], [(0, 1)]))) == {(0, 0), (0, 2), (1, 1), (1, 3)}
    assert found(M.simulate(g, Pattern.labelled(["a", "b"], [(0, 1), (1, 0)]))) == {(0, 0), (1, 1)}
    assert found(M.simulate(g, Pattern.labelled(["a", "c"], [(0, 1)]))) == set()
    assert found(M.simulate(g, Pattern.labelled(["b"], []))) == {(0, 1), (0, 3)}
    assert found(M.simulate(g, Pattern.labelled(["b"], []), include_isolated=True)) == {(0, 1), (0, 3), (0, 4)}
    assert found(M.simulate(g, Pattern.labelled(["b"], [(0, 0)]))) == set()
    assert found(M.simulate(make(spark, {}, []), Pattern.labelled(["b"], []))) == set()
    assert found(M.simulate(g, Pattern.labelled(["a", "b"], [(0, 1)]), dual=True)) == {(0, 0), (0, 2), (1, 1), (1, 3)}
    with pytest.raises(RuntimeError):
        M.simulate(g, Pattern.labelled(["a", "b"], [(0, 1), (1, 0)]), max_rounds=0)
    with pytest.raises(ValueError):
        Pattern.labelled(["a"], [(0, 1)])


def test_result_is_a_greatest_simulation_and_only_grows_with_edges(spark):
    rng = random.Random(9)
    labels = {i: rng.choice("abc") for i in range(30)}
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(70)}
    p = Pattern.labelled(["a", "b", "c"], [(0, 1), (1, 2), (2, 0)])
    less = found(M.simulate(make(spark, labels, list(edges)), p))
    more = found(M.simulate(make(spark, labels, list(edges | {(1, 2), (3, 4), (5, 6)})), p))
    assert less <= more


def test_predicates_on_variants(spark):
    rows = ['{"s": "abc", "n": 3, "b": true, "z": null, "o": {"y": 1, "x": 2}}', '{"s": 3, "n": 3.0, "b": false}', "null", None]
    v = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id long, j string").select("id", F.try_parse_json("j").alias("attrs"))
    g = Graph(v, spark.createDataFrame([], "src long, dst long"), attrs="attrs")
    nodes = ({"s": "b"}, {"s": 3}, {"n": 3}, {"b": True}, {"z": None}, {"missing": 1}, {}, {"n": "3"}, {"o": {"x": 2, "y": 1}}, {"s": "abc", "n": 3, "id": 7})
    got = {r.id: r.m for r in v.select("id", candidate_mask(g, Pattern(nodes)).alias("m")).collect()}
    bits = lambda m: [q for q in range(len(nodes)) if m >> q & 1]
    assert bits(got[0]) == [0, 2, 3, 4, 6, 8, 9]
    assert bits(got[1]) == [1, 2, 6]
    assert bits(got[2]) == bits(got[3]) == []


def test_pattern_file(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"node": [{"label": "a"}, {"label": "b"}], "edge": [{"source": 0, "target": 1}, {"source": 0, "target": 1}]}')
    p = Pattern.load(spark, str(tmp_path / "q.json"))
    assert p.out_degrees() == [2, 0] and p.needs() == [2, 0]
    assert p.edge_table(spark).count() == 1


def test_whole_numbers_are_compared_exactly(spark):
    big = 2**53
    v = spark.createDataFrame([(i, x) for i, x in enumerate((big, big + 1, -big - 1, 5))], "id long, n long")
    g = Graph(v, spark.createDataFrame([], "src long, dst long"))
    nodes = tuple({"n": x} for x in (big, big + 1, -big - 1, 5, 5.0, 10**30))
    got = {r.id: r.m for r in v.select("id", candidate_mask(g, Pattern(nodes)).alias("m")).collect()}
    assert got == {0: 1, 1: 2, 2: 4, 3: 24}
    texts = v.select("id", F.parse_json(F.concat(F.lit('{"n": '), F.col("n"), F.lit("}"))).alias("attrs")).unionByName(spark.createDataFrame([(9, '{"n": 5.0}'), (10, '{"n": 1000000000000000000000000000000}')], "id long, j string").select("id", F.parse_json("j").alias("attrs")))
    got = {r.id: r.m for r in texts.select("id", candidate_mask(Graph(texts, g.edges, attrs="attrs"), Pattern(nodes)).alias("m")).collect()}
    assert got == {0: 1, 1: 2, 2: 4, 3: 24, 9: 24, 10: 32}


def test_json_keys_may_hold_quotes(spark):
    from graphloom.functions import scalars as S

    keys = ["a'b", 'a"b', "a'\"b", "ab"]
    v = spark.createDataFrame([(json.dumps({k: i}),) for i, k in enumerate(keys)], "j string").select(F.parse_json("j").alias("v"))
    for k in keys:
        assert [r.h for r in v.select(S.json_has(F.col("v"), k).alias("h")).collect()] == [x == k for x in keys]
    g = Graph(v.select(F.monotonically_increasing_id().alias("id"), F.col("v").alias("attrs")), spark.createDataFrame([], "src long, dst long"), attrs="attrs")
    got = [r.m for r in g.vertices.select(candidate_mask(g, Pattern(tuple({k: i} for i, k in enumerate(keys)))).alias("m")).collect()]
    assert sorted(got) == [1, 2, 4, 8]
