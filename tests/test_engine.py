import json
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.metrics import Metrics
from graphloom.model import Graph
from graphloom.operators import analytics as A
from graphloom.operators import programs as P
from graphloom.operators import sets as B
from graphloom.plans import planner
from graphloom.sinks import write_matches
from graphloom.sources import generators as G
from graphloom.sources import readers as R
from graphloom.sources.config import Config
from graphloom.streaming.dynamic import DynamicGraph, merge_state


def pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_readers_on_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n0 1 5\n1,2,6\n2\t2\t7\n")
    assert pairs(R.read_graph(spark, str(tmp_path / "e.txt"), value="int").select("src", "dst")) == [(0, 1), (1, 2)]
    (tmp_path / "bad.txt").write_text("0 x\n1 2\n")
    assert pairs(R.read_graph(spark, str(tmp_path / "bad.txt"), mode="drop")) == [(1, 2)]
    with pytest.raises(Exception, match="malformed"):
        R.read_graph(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "b.bin").write_bytes(b"".join(struct.pack("<IIf", *x) for x in ((0, 1, 0.5), (3, 3, 1.0), (4294967295, 2, 2.0))))
    assert sorted(map(tuple, R.read_graph(spark, str(tmp_path / "b.bin"), "binedgelistval", "float").collect())) == [(0, 1, 0.5), (4294967295, 2, 2.0)]
    (tmp_path / "m.graph").write_text("3 2 11\n2 1\n1 1\n\n")
    with pytest.raises(Exception, match="malformed"):
        R.read_graph(spark, str(tmp_path / "m.graph"), "metis").collect()
    first = R.cached_graph(spark, str(tmp_path / "e.txt"), str(tmp_path / "cache"))
    assert pairs(R.cached_graph(spark, str(tmp_path / "e.txt"), str(tmp_path / "cache"))) == pairs(first) == [(0, 1), (1, 2)]
    (tmp_path / "v.json").write_text('[{"label": "a"}, null, {"label": 3}]')
    got = R.read_attributes(spark, str(tmp_path / "v.json"))
    assert {r.id: r.j for r in got.select("id", F.to_json("attrs").alias("j")).collect()} == {0: '{"label":"a"}', 1: None, 2: '{"label":3}'}


def test_multivalue_checksum(spark):
    lines = G.multivalue_lines(spark, 500, seed=3)
    edges = R.parse_edge_list(lines, "int:list")
    rows = edges.collect()
    assert len(rows) == lines.count() > 1000
    for r in rows:
        v = r.src + r.dst
        assert r.value == ([v, v + 1, v + 2] if v % 3 == 1 else [v])


def test_generators(spark):
    a = pairs(G.erdos_renyi(spark, 60, 0.1, seed=1))
    assert a == pairs(G.erdos_renyi(spark, 60, 0.1, seed=1).repartition(5)) and 100 < len(a) < 260
    assert len({(min(x), max(x)) for x in a}) == len(a)
    assert len(pairs(G.erdos_renyi(spark, 20, 1.0))) == 190 and not pairs(G.erdos_renyi(spark, 20, 0.0))
    w = G.random_weights(G.chain(spark, 100), seed=2)
    assert w.where("value < 0 or value >= 100000000").isEmpty() and w.select("value").distinct().count() > 90


def test_kernel_is_bulk_synchronous(spark):
    """What a vertex hears in round i is i - 1."""
    edges = G.grid(spark, 5)
    heard = P.Kernel(lambda i, a, b: F.lit(-1), F.lit(None).cast("int"), lambda m: m, F.max, lambda old, acc: old + 1, lambda v, o: v)
    state = P.run_kernel(edges, heard, 4)
    assert {r.value for r in state.collect()} == {3}


def test_gas_stops_when_nothing_is_signalled(spark):
    g = Graph(spark.range(6).select("id", F.col("id").alias("value")), G.chain(spark, 6))
    state, context = P.gas(g, F.least("value", F.coalesce("acc", "value")), 50, aggregate=F.min, scatter=P.Direction.OUT)
    assert {r.value for r in state.collect()} == {0} and context.iteration < 10
    assert sum(d["updates"] for d in context.deltas) == 15
    program = P.VertexProgram(F.col("other_value"), F.min, F.least("value", F.coalesce("acc", "value")), after_iteration=lambda c: c.set_last_iteration(1))
    state, context = program.run(g, 50)
    assert context.iteration == 2


def test_sets(spark):
    ids = spark.range(0, 4000, 3).select("id")
    b = B.BloomFilter.sized(spark, 1500, 0.02).insert(ids)
    assert b.contains_all(ids)
    others = spark.range(1, 4000, 3).select("id")
    wrong = b.contains(others).where("may_contain").count()
    assert wrong < 0.06 * others.count()
    assert (b | b).contains_all(ids) and (b & b).contains_all(ids) and (b ^ b).contains_none(ids)
    assert b.compress(8).contains_all(ids)
    f = B.Frontier(ids).remove(spark.range(100)).add(spark.range(3))
    assert f.count() == 1334 - 34 + 3 and f.any_in(0, 3) and not f.any_in(3, 100)
    mask = spark.range(1).select(B.set_bit(F.lit(4).cast("long"), 0).alias("a"), B.clear_bit(F.lit(5).cast("long"), 2).alias("b"), B.get_bit(F.lit(4).cast("long"), 2).alias("c")).first()
    assert tuple(mask) == (5, 1, True)


def test_order_and_shards(spark):
    edges = G.erdos_renyi(spark, 80, 0.1, seed=5).persist()
    mapped, new = A.order_by_degree(edges)
    deg = Counter(x for e in edges.collect() for x in e)
    want = {v: i for i, v in enumerate(sorted(deg, key=lambda v: (deg[v], v)))}
    assert {r.id: r.new_id for r in mapped.collect()} == want
    assert pairs(new) == sorted((want[a], want[b]) for a, b in pairs(edges))
    shards = A.range_shards(edges, 5).orderBy("shard").collect()
    assert sum(s.n_edges for s in shards) == edges.count() and all(a.last < b.first for a, b in zip(shards, shards[1:]))


def test_planner():
    assert planner.bloom_size(1000, 0.01) == (9592, 7)
    with pytest.raises(ValueError):
        planner.bloom_size(0, 0.5)


def test_random_functions(spark):
    drawn = spark.range(4000).select(S.uniform(2, 4, 1).alias("u"), S.bernoulli(0.3, 2).cast("int").alias("b"), S.gamma(3.0, F.col("id"), 1).alias("g"), S.multinomial(F.array(F.lit(1.0), F.lit(3.0)), 5).alias("m"), S.gaussian(5, 1, 3).alias("n"))
    row = drawn.agg(*(F.avg(c) for c in drawn.columns)).first()
    for got, want in zip(row, (3, 0.3, 3, 0.75, 5)):
        assert abs(got - want) < 0.15
    assert sorted(spark.range(1).select(S.permutation(F.lit(10), 4).alias("p")).first().p) == list(range(10))
    p = spark.range(1).select(S.set_new_value(S.pair(F.lit(1), F.lit(2)), F.lit(2), F.lit(9)).alias("p"), S.old_value(S.pair(F.lit(1), F.lit(2)), F.lit(3)).alias("o"), S.basename(F.lit("/a/b.c")).alias("b"), S.dirname(F.lit("/a/b.c")).alias("d"), S.trimmed(F.lit(" \tx ")).alias("t")).first()
    assert tuple(p.p) == (1, 9) and p.o == 2 and (p.b, p.d, p.t) == ("b.c", "/a", "x")


def test_config_and_metrics(spark):
    c = Config(Config.parse("a = 1\n# x\nb=2\n").values | Config.arguments(["--b=3", "c", "4", "--d"]).values)
    assert c.integer("a") == 1 and c.integer("b") == 3 and c.string("c") == "4" and c.flag("d")
    with pytest.raises(KeyError):
        c.string("none")
    m = Metrics("m")
    m.add("x", 2)
    m.add("x", 4)
    with m.timed("t"):
        pass
    row = m.table(spark).where("name = 'x'").first()
    assert (row["value"], row["count"], row["min"], row["max"], row["avg"]) == (6, 2, 2, 4, 3)
    assert json.loads(m.report("json"))["x"]["value"] == 6 and "<td>x</td>" in m.report("html")


def test_match_file(spark, tmp_path):
    m = spark.createDataFrame([(0, 5), (0, 3), (1, 7)], "q int, id long")
    write_matches(m, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["0", "3\t5\t", "1", "7\t"]
    write_matches(m.where("q > 5"), str(tmp_path / "n"))
    assert [r.value for r in spark.read.text(str(tmp_path / "n")).collect()] == ["No match"]


def test_deletions_keep_degrees_right(spark):
    rng = np.random.default_rng(0)
    edges = G.erdos_renyi(spark, 40, 0.2, seed=7).persist()
    kept = pairs(edges)
    deg = A.degrees(edges)
    from graphloom.streaming.dynamic import buffered_degrees

    for _ in range(2):
        gone = [kept[i] for i in np.flatnonzero(rng.random(len(kept)) < 0.25)]
        kept = sorted(set(kept) - set(gone))
        deg = buffered_degrees(deg, spark.createDataFrame([(int(a), int(b), -1) for a, b in gone], "src long, dst long, op int"))
    want = Counter(b for _, b in kept)
    assert all(r.indegree == want[r.id] for r in deg.collect())


def test_stream_equals_batches(spark, tmp_path):
    for i, rows in enumerate([[(0, 1, 1), (1, 2, 1)], [(2, 3, 1), (0, 1, -1)], [(0, 1, 1), (1, 2, -1), (4, 4, 1)]]):
        spark.createDataFrame(rows, "src long, dst long, op int").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    g = DynamicGraph(spark, str(tmp_path / "graph"), buffer_limit=4)
    for i in range(3):
        stream = spark.readStream.schema("src long, dst long, op int").parquet(str(tmp_path / f"in/part={i}"))
        seen = []
        q = g.follow(stream.repartition(1), str(tmp_path / f"cp{i}"), on_batch=lambda graph, n: seen.append(n)) if i == 0 else None
        if q:
            q.awaitTermination()
            assert seen == [0]
        else:
            g.append(spark.read.parquet(str(tmp_path / f"in/part={i}")).select("src", "dst", "op"))
            g.compact()
    assert pairs(g.edges().select("src", "dst")) == [(0, 1), (2, 3)]
    assert g.counts()[0] > 0
    g.append(spark.createDataFrame([(7, 8)], "src long, dst long"), "own")
    g.append(spark.createDataFrame([(7, 9)], "src long, dst long"), "own")
    assert pairs(g.edges().select("src", "dst")) == [(0, 1), (2, 3), (7, 8)]


def test_batches_of_several_writers_keep_apart(spark, tmp_path):
    """Edges added by hand, a stream, compaction, another stream, a restart of the first, and a batch that a dead job left."""
    def frame(*rows):
        return spark.createDataFrame(list(rows), "src long, dst long, op int")

    def files(name, *parts):
        for rows in parts:
            frame(*rows).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def follow(graph, name):
        stream = spark.readStream.schema("src long, dst long, op int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        graph.wait(graph.follow(stream, str(tmp_path / f"cp-{name}")))

    g = DynamicGraph(spark, str(tmp_path / "graph"))
    g.add_edges(frame((1, 2, 1)).select("src", "dst"))
    files("a", [(10, 11, 1)], [(11, 12, 1)])
    follow(g, "a")
    assert pairs(g.edges().select("src", "dst")) == [(1, 2), (10, 11), (11, 12)]
    assert g.compact(force=True) and g.counts() == (3, 0)
    files("b", [(8, 9, 1), (1, 2, -1)])
    follow(g, "b")
    assert pairs(g.edges().select("src", "dst")) == [(8, 9), (10, 11), (11, 12)]
    files("a", [(12, 13, 1)])
    again = DynamicGraph(spark, str(tmp_path / "graph"))
    follow(again, "a")
    follow(again, "a")
    assert again.counts() == (3, 1) and pairs(again.edges().select("src", "dst")) == [(8, 9), (10, 11), (11, 12), (12, 13)]
    # A batch that was begun before a compaction and ended after it still counts.
    n = again.next_batch()
    frame((20, 21, 1)).selectExpr("src", "dst", "cast(null as double) value", "op", f"{n}L batch").write.parquet(str(tmp_path / f"graph/log/batch-{n:012d}-late"))
    (tmp_path / f"graph/log/batch-{n:012d}-late/_SUCCESS").unlink()
    assert again.compact(force=True) and again.next_batch() == n + 1
    again.append(frame((20, 22, 1)), "late")
    assert pairs(again.edges().select("src", "dst")) == [(8, 9), (10, 11), (11, 12), (12, 13), (20, 22)]
    # finish_after: the third file is left for a restart.
    files("c", [(30, 31, 1)], [(31, 32, 1)], [(32, 33, 1)])
    again.finish_after(2)
    follow(again, "c")
    assert again.counts()[1] == 3
    again.last_batch = None
    follow(again, "c")
    assert again.counts()[1] == 4


def test_programs_on_a_changing_graph(spark, tmp_path):
    g = DynamicGraph(spark, str(tmp_path / "graph"))
    g.add_edges(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    least = P.VertexProgram(F.col("other_value"), F.min, F.least("value", F.coalesce("acc", F.col("value"))))
    state = merge_state(spark.createDataFrame([], "id long, value long"), g, F.col("id"))
    state = g.run(least, state, 3)
    assert pairs(state) == [(0, 0), (1, 0), (2, 0)]
    g.add_edges(spark.createDataFrame([(2, 3), (4, 5)], "src long, dst long"))
    state = merge_state(state, g, F.col("id") * 10)
    assert pairs(state) == [(0, 0), (1, 0), (2, 0), (3, 30), (4, 40), (5, 50)]
    g.add_task(spark.createDataFrame([(3,)], "id long"))
    assert pairs(g.run(least, state, 1)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 40), (5, 50)]
    assert g.tasks is None


def test_vertex_programs_with_hooks_and_edge_values(spark):
    calls = []
    edges = spark.createDataFrame([(0, 1, 0.0), (1, 2, 0.0), (0, 2, 0.0)], "src long, dst long, value double")
    graph = Graph(spark.createDataFrame([(i, 0.0) for i in range(3)], "id long, value double"), edges)
    count = P.VertexProgram(
        F.lit(0.0), F.sum, F.col("value") + 1, repeat=2,
        before_iteration=lambda c: calls.append(("b", c.iteration)), after_iteration=lambda c: calls.append(("a", c.iteration)),
        before_interval=lambda c, i, j: calls.append(("bi", i, j)), after_interval=lambda c, i, j: calls.append(("ai", i, j)),
    )
    out, context = count.run(graph, 2)
    assert pairs(out) == [(0, 4.0), (1, 4.0), (2, 4.0)] and len(context.deltas) == 2
    assert calls == [("b", 0), ("bi", 0, 2), ("ai", 0, 2), ("a", 0), ("b", 1), ("bi", 0, 2), ("ai", 0, 2), ("a", 1)]
    # Vertices write src + round on their out-edges; targets sum what the round before wrote.
    writes = P.VertexProgram(F.col("edge_value"), F.sum, F.coalesce("acc", F.lit(0.0)), edge=F.col("src") + F.col("edge_value") + 1)
    vertices, wrote, context = writes.run_with_edges(graph, 3)
    assert pairs(vertices) == [(0, 0.0), (1, 2.0), (2, 6.0)] and [x["iteration"] for x in context.deltas] == [0, 1, 2]
    assert sorted(map(tuple, wrote.collect())) == [(0, 1, 3.0), (0, 2, 3.0), (1, 2, 6.0)]
    assert pairs(writes.run(graph, 3)[0]) == pairs(vertices)
    assert json.loads(P.engine_info(context, graph, "x")) | {"runTime": 0} == {"engine": "spark", "app": "x", "iteration": 3, "numIterations": 3, "runTime": 0, "updates": 4, "numVertices": 3, "edges": 3, "lastUpdates": 2, "lastDelta": 4.0, "partitions": graph.edges.rdd.getNumPartitions()}


def test_monotone_kernels_and_emitted_graphs(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 4)], "src long, dst long")
    least = P.Kernel(lambda i, a, b: i, F.lit(None).cast("long"), lambda m: m, F.min, lambda old, acc: F.least(old, acc), lambda v, o: v)
    assert pairs(P.run_monotone(edges, least)) == [(0, 0), (1, 0), (2, 0), (4, 4), (5, 5)]
    with pytest.raises(ValueError, match="monotone"):
        P.run_monotone(edges, P.Kernel(lambda i, a, b: i, F.lit(0), lambda m: m, F.sum, lambda old, acc: old + acc, lambda v, o: v)).collect()
    graph = Graph(spark.range(3), edges)
    new = P.emitted_graph(graph, lambda key, pdf: pdf.assign(src=pdf.dst, dst=key + 100)[["src", "dst"]], "src long, dst long", str(tmp_path / "new"), keep=lambda e: e.distinct())
    assert pairs(new) == [(0, 102), (1, 100), (2, 101), (4, 105)]
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id long, p double").groupBy("id").agg(P.sum_priority(F.col("p")).alias("s"), P.max_priority(F.col("p")).alias("m")).collect()
    assert [tuple(r) for r in rows] == [(1, 5.0, 3.0)]


def blocks_of(spark, text, each=2):
    """Lines of a text as a file that is read in blocks."""
    rows = [("f", i // each, i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, block long, at long, value string").repartition(3)


@pytest.mark.parametrize("each", [1, 2, 100])
def test_readers_that_split_files(spark, each):
    metis = "% a graph\n4 3\n2 3\n% inside\n1 4 2\n\n2"
    assert pairs(R.parse_metis(blocks_of(spark, metis, each))) == [(0, 1), (0, 2), (1, 3)]
    assert pairs(R.parse_metis(blocks_of(spark, metis, each), loops=True)) == [(0, 1), (0, 2), (1, 1), (1, 3)]
    assert pairs(R.parse_metis(blocks_of(spark, "2 1\n1 1\n0", each), base=0)) == [(0, 1), (0, 1)]
    cassovary = "1 2\n2\n3\n4 0\n# c\n7 1\n\n1\n9 1\n9"
    assert pairs(R.parse_cassovary(blocks_of(spark, cassovary, each))) == [(1, 2), (1, 3), (7, 1)]
    for bad in ("x", "1 1\nx", "1 2\n3", "5\n1 1\n2", "1 1\n2\n3", "1 2 3"):
        with pytest.raises(Exception, match="malformed|tells"):
            R.parse_cassovary(blocks_of(spark, bad, each)).collect()
    assert pairs(R.parse_cassovary(blocks_of(spark, "x\n1 1\n2", each), mode="drop")) == [(1, 2)]
    array = '[\n{"a": 1},\nnull,\n"text",\n{"a": [1, 2]}\n]'
    got = R.parse_attributes(blocks_of(spark, array, each)).select("id", F.to_json("attrs").alias("j")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, '{"a":1}'), (1, None), (2, '"text"'), (3, '{"a":[1,2]}')]


def test_files_of_every_format(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/one").write_text("3 2\n2 3\n1\n1\n")
    (tmp_path / "m/skipped.tmp").write_text("broken")
    assert pairs(R.read_graph(spark, str(tmp_path / "m"), "metis")) == [(0, 1), (0, 2)]
    (tmp_path / "c.txt").write_text("1 2\n2\n3\n4 1\n1\n")
    assert pairs(R.read_graph(spark, str(tmp_path / "c.txt"), "cassovary")) == [(1, 2), (1, 3), (4, 1)]
    (tmp_path / "b").mkdir()
    for k in range(2):
        (tmp_path / f"b/{k}").write_bytes(b"".join(struct.pack("<II", i, i * 7 % 50 + k) for i in range(1000)))
    want = sorted((i, i * 7 % 50 + k) for i in range(1000) for k in range(2) if i != i * 7 % 50 + k)
    assert pairs(R.read_graph(spark, str(tmp_path / "b"), "binedgelist")) == want
    (tmp_path / "b/odd").write_bytes(b"123")
    with pytest.raises(ValueError, match="malformed"):
        R.read_graph(spark, str(tmp_path / "b"), "binedgelist")
    (tmp_path / "v.jsonl").write_text('{"id": 3, "label": "x"}\n\n{"id": 1}\n')
    assert sorted(r.id for r in R.read_attributes(spark, str(tmp_path / "v.jsonl"), "lines").collect()) == [1, 3]
    (tmp_path / "v.json").write_text('[{"label": "x"},\nnull]')
    assert [(r.id, r.n) for r in R.read_attributes(spark, str(tmp_path / "v.json"), "array_lines").select("id", F.col("attrs").isNull().alias("n")).orderBy("id").collect()] == [(0, False), (1, True)]
    with pytest.raises(ValueError, match="layout"):
        R.read_attributes(spark, "x", "other")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from graphloom import cli

    (tmp_path / "e.txt").write_text("0 1\n1 2\n2 0\n")
    (tmp_path / "v.json").write_text('[{"label": "a"}, {"label": "b"}, {"label": "c"}]')
    (tmp_path / "q.json").write_text('{"node": [{"label": "a"}, {"label": "b"}], "edge": [{"source": 0, "target": 1}]}')
    assert cli.main([]) == 2
    assert cli.main(["convert", f"--file={tmp_path}/e.txt", f"--outputfile={tmp_path}/out", "--nshards=2"]) == 0
    assert pairs(spark.read.parquet(str(tmp_path / "out"))) == [(0, 1), (1, 2), (2, 0)]
    assert cli.main(["degree", f"--file={tmp_path}/e.txt", "--vertex=1"]) == 0
    assert "indegree" in capsys.readouterr().out
    assert cli.main(["match", f"--file={tmp_path}/e.txt", f"--vertexfile={tmp_path}/v.json", f"--queryfile={tmp_path}/q.json", f"--outputfile={tmp_path}/found"]) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "found").glob("part-*"))).split() == ["0", "0", "1", "1"]


def test_hubs_and_dead_vertices(spark, monkeypatch):
    """Matches and components with every vertex a hub, and on edges that are dropped as vertices die."""
    import random

    from graphloom.model import Pattern
    from graphloom.operators import simulate as M

    rng = random.Random(2)
    edges = [(i, rng.randrange(40)) for i in range(400)] + [(i, i + 1) for i in range(300)]
    graph = Graph(spark.createDataFrame([(i, rng.choice("abc")) for i in range(400)], "id long, label string"), spark.createDataFrame(edges, "src long, dst long"))
    pattern = Pattern.labelled(["a", "b", "c"], [(0, 1), (1, 2), (2, 0)])
    want = sorted(map(tuple, M.simulate(graph, pattern).collect()))
    labels = pairs(A.connected_components(graph.edges))
    assert want and pairs(M.simulate_delta(graph, pattern)) == want
    for module in (M, A):
        monkeypatch.setattr(module, "HUB", 1)
        monkeypatch.setattr(module, "HUBS", 1000)
    assert sorted(map(tuple, M.simulate(graph, pattern).collect())) == want
    assert set(map(tuple, M.simulate(graph, pattern, dual=True).collect())) <= set(want)
    assert pairs(A.connected_components(graph.edges)) == labels
    line = Graph(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "id long, label string"), spark.createDataFrame([(i, i + 1) for i in range(59)], "src long, dst long"))
    assert M.simulate(line, Pattern.labelled(["a", "b"], [(0, 1), (1, 0)])).count() == 0


def test_logging_and_series(tmp_path):
    import logging

    from graphloom import metrics

    metrics.set_logging("warning", str(tmp_path / "log"))
    metrics.log.info("not this")
    metrics.log.warning("but this")
    assert "but this" in (tmp_path / "log").read_text() and "not this" not in (tmp_path / "log").read_text()
    metrics.set_logging("off", str(tmp_path / "log"))
    metrics.log.error("nor that")
    assert "nor that" not in (tmp_path / "log").read_text()
    metrics.log.handlers[:] = []
    metrics.log.setLevel(logging.NOTSET)
    series = metrics.TimeSeries()
    assert "polyline" in series.svg("none")
