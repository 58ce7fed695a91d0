"""Split JSON arrays, exact cuts, blocked Bloom filters."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import analytics as A
from graphloom.operators import sets as B
from graphloom.sources import readers as R

VALUES = [{"label": "a,b", "n": 1}, None, {"s": 'quote " and \\ and ]}', "l": [1, [2, 3], {"x": "[,{"}]}, {}, [], "text, with comma", 7, True, {"deep": [[[["]", "\\\\"]]]]}, {"e": "\\\",", "z": "é,日"}, {"last": ","}]


@pytest.mark.parametrize("indent", [None, 2, "line"])
def test_arrays_in_any_form_are_split(spark, tmp_path, indent):
    rng = random.Random(1)
    data = [rng.choice(VALUES) for _ in range(400)]
    text = "[\n" + ",\n".join(json.dumps(x) for x in data) + "\n]\n" if indent == "line" else json.dumps(data, indent=indent, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(" [ ] ")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        blocks = R.comma_blocks(spark, str(tmp_path / "a.json"))
        assert blocks.select("block").distinct().count() > 3
        found = sorted(R.array_elements(blocks).collect(), key=lambda r: r.n)
        assert [r.n for r in found] == list(range(400)) and [json.loads(r.value) for r in found] == data
        assert R.read_attributes(spark, str(tmp_path / "b.json")).count() == 0
        kinds = R.read_attributes(spark, str(tmp_path / "a.json")).select("id", F.col("attrs").isNull().alias("none")).collect()
        assert {r.id for r in kinds if r.none} == {i for i, x in enumerate(data) if x is None} and len(kinds) == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_arrays_and_what_is_none(spark, tmp_path):
    for k, x in enumerate(([1], [{"a": [1, 2]}, 3, "x,y"], [])):
        (tmp_path / f"{k}.json").write_text(json.dumps(x))
    found = R.array_elements(R.comma_blocks(spark, str(tmp_path))).collect()
    per = {}
    for r in sorted(found, key=lambda r: r.n):
        per.setdefault(r.file[-6], []).append(json.loads(r.value))
    assert per == {"0": [1], "1": [{"a": [1, 2]}, 3, "x,y"]}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "o.json").write_text('{"a": 1, "b": 2}')
    with pytest.raises(Exception, match="not an array"):
        R.array_elements(R.comma_blocks(spark, str(tmp_path / "o"))).collect()


def _cut(edges, shards):
    """One edge after the other, in the order of their targets."""
    out, start, count, done, quota, prev = [], 0, 0, 0, len(edges) // shards + 1, None
    top = max(max(e) for e in edges)
    for _, dst in sorted(edges, key=lambda e: e[1]):
        if count >= quota and dst != prev:
            out.append((len(out), start, prev, count))
            start, count = prev + 1, 0
            if len(out) < shards:
                quota = (len(edges) - done) // (shards - len(out))
        count, prev, done = count + 1, dst, done + 1
    out.append((len(out), start, top, count))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_balanced_cut_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    n = [5, 40, 300, 40][seed]
    edges = [(rng.randrange(n), int(n * rng.random() ** (1 + seed))) for _ in range(400)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    for shards in (1, 3, 9):
        want = _cut(edges, shards)
        assert [tuple(r) for r in A.balanced_cut(df, shards).orderBy("shard").collect()] == want
    assert A.balanced_cut(df.limit(0), 3).count() == 0
    cut = A.balanced_cut(df, 5)
    assert A.in_shards(df, cut).groupBy("shard").count().count() == cut.count()


def test_blocked_bloom(spark):
    ids = spark.range(0, 20_000)
    b = B.BlockedBloom.sized(spark, 20_000, 0.01).insert(ids)
    assert b.rows.count() <= b.blocks and b.contains(ids).where("not may_contain").isEmpty()
    wrong = b.contains(spark.range(1_000_000, 1_100_000)).where("may_contain").count() / 100_000
    assert 0.003 < wrong < 0.013 and abs(wrong - b.effective_fpp()) < 0.002
    assert abs(B.BlockedBloom.rate(20_000 / b.blocks, b.hashes) - wrong) < 0.003
    # No more than a quarter above the bits of a plain filter.
    assert b.blocks * 512 < 1.6 * 20_000 * 9.6
    low, high = B.BlockedBloom(spark, 800, 8).insert(spark.range(0, 6000)), B.BlockedBloom(spark, 800, 8).insert(spark.range(4000, 10_000))
    asked = spark.range(0, 12_000)
    have = lambda f: {r.id for r in f.contains(asked).where("may_contain").collect()}
    assert have(low | high) >= set(range(10_000)) and set(range(4000, 6000)) <= have(low & high) and len(have(low & high)) < 6000
    bits = lambda f: f.bits_set().first()[0]
    assert bits(low ^ high) == bits(low | high) - bits(low & high) and bits(low ^ low) == 0
    assert bits(low) + bits(high) == bits(low | high) + bits(low & high)
    none = spark.createDataFrame([(None, "x"), (5, "y")], "id long, w0 string")
    assert {(r.w0, r.may_contain) for r in low.insert(none).contains(none).collect()} == {("x", False), ("y", True)}
    assert B.BlockedBloom(spark, 3).contains(ids.limit(2)).where("may_contain").isEmpty()
    with pytest.raises(ValueError):
        low | B.BlockedBloom(spark, 801, 8)


@pytest.mark.parametrize("folded", [3, 4096])
def test_duplicates_are_folded_in_order(spark, folded):
    rng = random.Random(4)
    # A filter that is not commutative: the first one of the largest kind stays.
    rows = [(rng.randrange(3), rng.randrange(2), k, rng.randrange(4), f"r{k}") for k in rng.sample(range(1000), 120)]
    rows += [(9, 9, k, k % 2, "hot") for k in range(2000, 2200)]
    df = spark.createDataFrame(rows, "src long, dst long, at long, kind long, place string").repartition(4)
    want = {}
    for r in sorted(rows, key=lambda r: r[2]):
        kept = want.get(r[:2])
        want[r[:2]] = r if kept is None or kept[3] < r[3] else kept
    found = A.fold_duplicates(df, lambda a, b: a["kind"] >= b["kind"], ["at"], folded=folded)
    assert found.columns == df.columns and {tuple(r) for r in found.collect()} == set(want.values())
    last = A.fold_duplicates(df, lambda a, b: F.lit(False), ["at"], folded=folded)
    assert {tuple(r) for r in last.collect()} == {max((r for r in rows if r[:2] == k), key=lambda r: r[2]) for k in want}
    assert A.fold_duplicates(df.limit(0), lambda a, b: F.lit(True), ["at"]).count() == 0


def test_rows_are_emitted_by_a_table_function(spark):
    from graphloom.operators import programs as P

    class Gaps:
        """What a vertex's neighbours leave out, and how many it has."""

        def __init__(self):
            self.n, self.last = 0, None

        def edge(self, row):
            if self.last is not None and row.dst > self.last + 1:
                yield row.src, self.last + 1, row.dst - 1
            self.n, self.last, self.src = self.n + 1, row.dst, row.src

        def end(self):
            yield self.src, -1, self.n

    edges = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (1, 9)], "src long, dst long").unionByName(spark.range(50_000).select(F.lit(7).cast("long").alias("src"), (F.col("id") * 2).alias("dst")))
    found = P.emit_rows(edges, Gaps, "id long, low long, high long")
    assert found.columns == ["id", "low", "high"]
    assert {tuple(r) for r in found.where("id < 7").collect()} == {(1, 4, 4), (1, 6, 8), (1, -1, 3), (2, -1, 1)}
    assert found.where("id = 7").count() == 50_000 and found.where("id = 7 and low = -1").first().high == 50_000
    assert P.emit_rows(edges.limit(0), Gaps, "id long, low long, high long").count() == 0


def test_vertex_state_goes_on_after_a_restart(spark, tmp_path):
    from graphloom.streaming.state import VertexState

    rng = random.Random(5)
    edges = [(rng.randrange(1000), rng.randrange(30)) for _ in range(400)]
    schema = "src long, dst long"
    kept, program = VertexState(spark, str(tmp_path / "kept")), VertexState(spark, str(tmp_path / "program"))

    def step(vertex, frames, state):
        # The last two sources in ascending order: no aggregate that could be added up in parts.
        seen = [] if state is None else [x for x in state if x is not None]
        for f in frames:
            seen = sorted({*seen, *f["src"].tolist()})[-2:]
        return (seen[-1], seen[-2] if len(seen) > 1 else None)

    touched = []
    for k in range(4):
        spark.createDataFrame(edges[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        # Each run is a restart from the checkpoint.
        kept.follow(stream, str(tmp_path / "c1"), {"least": F.min("src"), "n": F.count("*")}).awaitTermination()
        if k % 2:
            program.follow_program(stream, str(tmp_path / "c2"), step, "top long, second long").awaitTermination()
        touched.append(kept.written().where(F.col("batch") == kept.written().agg(F.max("batch")).first()[0]).count())
        now = edges[: k * 100 + 100]
        assert {tuple(r) for r in kept.values().collect()} == {(d, min(s for s, x in now if x == d), sum(x == d for _, x in now)) for d in {x for _, x in now}}
    # A batch writes the vertices that it has edges of.
    assert touched[-1] == len({d for _, d in edges[300:]})
    best = {d: sorted({s for s, x in edges if x == d}) for d in range(30)}
    assert {tuple(r) for r in program.values().collect()} == {(d, b[-1], b[-2] if len(b) > 1 else None) for d, b in best.items() if b}


def test_hubs_are_told_and_heard_without_a_task_of_their_own(spark, monkeypatch):
    from model_worklist import simulation

    from graphloom.model import Graph, Pattern
    from graphloom.operators import programs as P
    from graphloom.operators import simulate as M

    labels = {0: "a", **{i: "b" if i % 3 else "c" for i in range(1, 60)}}
    edges = [(0, i) for i in range(1, 50)] + [(i, 0) for i in range(20, 60)] + [(i, i + 1) for i in range(1, 30)]
    g = Graph(spark.createDataFrame(list(labels.items()), "id long, label string"), spark.createDataFrame(edges, "src long, dst long"))
    p = Pattern.labelled(["a", "b", "c"], [(0, 1), (1, 2), (1, 0)])

    def all_of_it():
        return (
            {tuple(r) for r in M.simulate_pairs(g, p).collect()},
            {tuple(r) for r in M.simulate_delta(g, p).collect()},
            {r.id for r in M.reachable(g, g.vertices.where("id = 58").select("id")).collect()},
            {(r.id, round(r.value, 9)) for r in P.run_kernel(g.edges, P.pagerank_kernel(), 3).collect()},
            {tuple(r) for r in P.shortest_hops(g.edges, 58, 4).collect()},
        )

    plain = all_of_it()
    dealt = []
    start = M._Edges.__init__
    monkeypatch.setattr(M, "HUB", 10)
    monkeypatch.setattr(M, "HUBS", 20)
    monkeypatch.setattr(M._Edges, "__init__", lambda self, e: (start(self, e), dealt.append(self.hubs is not None))[0])
    assert all_of_it() == plain and all(dealt) and len(dealt) == 5
    want = simulation(labels, edges, ["a", "b", "c"], p.edges)
    assert plain[0] == plain[1] == want


def test_gather_apply_scatter_deals_hubs_at_both_ends(spark, monkeypatch):
    from graphloom.model import Graph
    from graphloom.operators import programs as P
    from graphloom.operators import simulate as M

    # Vertex 0 has most edges, both ways; some edges come twice, 70 has none, 80 is not a vertex.
    edges = [(0, i, i % 5) for i in range(1, 50)] + [(i, 0, i % 3) for i in range(20, 60)] + [(i, i + 1, 1) for i in range(1, 59)] + [(0, 7, 2), (0, 7, 2), (0, 80, 1)]
    ids = [*range(60), 70]
    g = Graph(spark.createDataFrame([(i, (i * 37) % 61) for i in ids], "id long, value long"), spark.createDataFrame(edges, "src long, dst long, w long"))
    apply = F.least("value", F.coalesce("acc", "value"))

    cases = [("ALL", None), ("IN", "OUT"), ("ALL", "ALL")]
    cases = [(P.Direction[d], s and P.Direction[s]) for d, s in cases]

    def run(d, s):
        if s is None:
            e = F.col("other_value") + F.col("edge_w") * F.greatest(F.col("own_value"), F.lit(1))
            return dict(map(tuple, P.gas(g, F.coalesce("acc", F.lit(0)) % 1009, 2, e, F.sum, d)[0].collect()))
        start = spark.createDataFrame([(1,), (0,), (70,)], "id long")
        return dict(map(tuple, P.gas(g, apply, 4, aggregate=F.min, direction=d, scatter=s, start=start)[0].collect()))

    def plain(d, s=None, rounds=4):
        value, active = {i: (i * 37) % 61 for i in ids}, set(ids) if s is None else {0, 1, 70}
        inside = [x for x in edges if x[0] in value and x[1] in value]
        for _ in range(rounds):
            seen = {i: [] for i in ids}
            for a, b, w in inside:
                for own, other in [(b, a)] * (d != P.Direction.OUT) + [(a, b)] * (d != P.Direction.IN):
                    seen[own].append(value[other] + w * max(value[own], 1) if s is None else value[other])
            new = {i: sum(seen[i]) % 1009 if s is None else min([value[i], *seen[i]]) if i in active else value[i] for i in ids}
            spoke = {i for i in ids if new[i] != value[i]}
            if s is not None:
                active = {b for a, b, _ in edges if a in spoke and s != P.Direction.IN} | {a for a, b, _ in edges if b in spoke and s != P.Direction.OUT}
            value = new
            if s is not None and not active:
                break
        return value

    want = [plain(d, s, 4 if s else 2) for d, s in cases]
    assert [run(d, s) for d, s in cases] == want
    monkeypatch.setattr(M, "HUB", 10)
    monkeypatch.setattr(M, "HUBS", 20)
    assert [run(d, s) for d, s in cases] == want
    # What tasks join: no key of both ends and a salt has a hub's edges.
    ends = P._Ends(g.edges, P.Direction.IN)
    assert ends.salts is not None and ends.dealt.hubs is not None
    assert ends.dealt.light.unionByName(ends.dealt.heavy).groupBy("other", "salt").count().agg(F.max("count")).first()[0] <= 25
    ends.unpersist()


def test_blocks_reach_the_fixpoint_in_fewer_exchanges_than_rounds(spark):
    from graphloom.operators import blocks as K

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(31), rng.randrange(31)) for _ in range(5)] + [(200, 3), (7, 7)]
    df = spark.createDataFrame(edges, "src long, dst long")
    history = []
    found = K.run_blocks(df, F.col("id"), K.BlockKernel(lambda v: v), block_edges=12, history=history)
    found = {tuple(r) for r in found.collect()}
    # Rounds of all vertices at a time go a step along the chain each.
    value, rounds = {v: v for e in edges for v in e}, 0
    while True:
        new = dict(value)
        for a, b in edges:
            new[b] = min(new[b], value[a])
        rounds += 1
        if new == value:
            break
        value = new
    assert found == set(value.items()) and 1 < len(history) < rounds / 2
    far = (1 << 62)
    hops = K.run_blocks(df, F.when(F.col("id") == 0, F.lit(0)).otherwise(F.lit(far)), K.BlockKernel(lambda v: np.where(v >= far, far, v + 1)), block_edges=20)
    reached, front = {0: 0}, [0]
    while front:
        front = [b for v in front for a, b in edges if a == v and b not in reached and not reached.update({b: reached[v] + 1})]
    assert {(r.id, r.value) for r in hops.collect()} == {(v, reached.get(v, far)) for v in value}
    rising = K.run_blocks(df, F.col("indegree").cast("double"), K.BlockKernel(lambda v: v * 0.5, rising=True, kind="double"), block_edges=9)
    level = {v: float(sum(b == v and a != b for a, b in set(edges))) for v in value}
    while True:
        new = dict(level)
        for a, b in edges:
            new[b] = max(new[b], level[a] * 0.5)
        if new == level:
            break
        level = new
    assert {tuple(r) for r in rising.collect()} == set(level.items())
    assert K.run_blocks(df.limit(0), F.col("id"), K.BlockKernel(lambda v: v)).count() == 0
