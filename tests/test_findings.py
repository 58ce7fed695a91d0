"""Findings of reviews, each with what would have failed before."""

from pyspark.sql import functions as F


def test_blocks_of_an_alignment_are_bounded_in_files_and_tasks(spark):
    from graphloom.llm import alignment as A

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words, more of them, number "), "id").alias("text")).coalesce(1)
    paths = A.tokenizer_path("byte_bpe_50k.json"), A.tokenizer_path("piece_bpe_32k.model")
    blocks = A.encoded_blocks(docs, *paths, size=500)
    files = [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 16 and max(files) <= 8
    told = A.alignments(docs, *paths, size=500)
    assert told.rdd.getNumPartitions() == sum(files) // 4 + 1
    assert sorted(told.collect()) == sorted(A.alignments(docs, *paths).collect())


def test_a_match_file_has_one_line_a_query_node(spark, monkeypatch):
    from graphloom import sinks

    monkeypatch.setattr(sinks, "PIECE", 3)
    ids = {0: range(5, 40), 2: range(100, 103), 3: range(1)}
    rows = [(q, i) for q, x in ids.items() for i in x][::-1]
    got = sinks.match_lines(spark.createDataFrame(rows, "q int, id long").repartition(5), per_line=None).collect()
    assert sorted(map(tuple, got)) == sorted([(q, 0, str(q)) for q in ids] + [(q, 1, "".join(f"{i}\t" for i in x)) for q, x in ids.items()])


def test_pairs_of_a_random_graph_are_not_shuffled(spark, tmp_path):
    from graphloom.queries import QUERIES

    spark.range(300).select(F.col("id").alias("event_id"), F.col("id").alias("user_id")).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["random_graph"](spark, str(tmp_path))
    row = found.first()
    assert (row.pairs, row.apart, row.within) == (300 * 299 // 2, True, True)
    written = []
    plan = found._jdf.queryExecution().executedPlan().finalPhysicalPlan()

    def visit(node):
        if "Exchange" in node.nodeName() and node.metrics().contains("shuffleRecordsWritten"):
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        for k in range(node.children().size()):
            visit(node.children().apply(k))
        if "QueryStage" in node.nodeName():
            visit(node.plan())

    found.collect()
    visit(plan)
    assert 0 < max(written) < 300 * 299 // 2 // 10


def test_edges_of_commerce_are_dealt_by_their_number(spark, monkeypatch):
    from graphloom import datasets as D

    want = D.commerce(spark, "/root/testdata/sf0.001").edges.count()
    monkeypatch.setattr(D, "DEALT", 500)
    edges = D.commerce(spark, "/root/testdata/sf0.001").edges
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == want and len(sizes) > 20 and max(sizes) < 1000


def test_bags_of_a_fit_are_narrow_and_whole():
    import numpy as np

    from graphloom.llm._embed import bag

    found = np.random.default_rng(3).integers(0, 1 << 18, 5000)
    apart, counts = bag(found)
    u, n = np.unique(found, return_counts=True)
    assert (np.cumsum(apart, dtype=np.int64) == u).all() and (counts == n).all()
    assert apart.nbytes + counts.nbytes < 4 * len(u)
    assert [len(x) for x in bag(found[:0])] == [0, 0] and bag(np.repeat(7, 300))[1].tolist() == [300]


def test_lines_of_a_cassovary_file_are_sorted_once(spark):
    from graphloom.sources import readers as R

    lines = spark.range(0, 4000).select(F.lit("f").alias("file"), F.floor(F.col("id") / 37).alias("block"), F.col("id").alias("at"), F.when(F.col("id") % 4 == 0, F.concat_ws(" ", F.col("id"), F.lit(3))).otherwise(F.col("id").cast("string")).alias("value"))
    found = R.parse_cassovary(lines)
    assert sorted(map(tuple, found.collect())) == [(i - i % 4, i) for i in range(4000) if i % 4]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Lines are dealt to their blocks once, for the row a block too.
    dealt = [x for x in plan.split("\n") if "hashpartitioning(" in x and "block#" in x]
    assert len([x for x in dealt if "Reused" not in x]) == 1 and "ReusedExchange" in plan


def test_keys_are_placed_once_for_filters_whose_blocks_are_broadcast(spark):
    from graphloom.operators import sets as B

    ids = spark.range(3000)
    empty = B.BlockedBloom(spark, 31, 6)
    f, g = empty.insert(ids.where("id % 5 = 0")), empty.insert(ids.where("id % 7 < 2"))
    each = empty.contains_each(ids, {"a": f, "b": f | g})
    assert each.columns == ["id", "a", "b"]
    want = {r.id: (r.may_contain,) for r in f.contains(ids).collect()}
    want = {r.id: (*want[r.id], r.may_contain) for r in (f | g).contains(ids).collect()}
    assert {r.id: (r.a, r.b) for r in each.collect()} == want
    plan = each._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan


def test_edges_that_support_nothing_are_not_dealt(spark, monkeypatch):
    from graphloom.model import Graph, Pattern
    from graphloom.operators import simulate as M

    dealt, edges_ = [], M._Edges
    monkeypatch.setattr(M, "_Edges", lambda e: dealt.append(e.count()) or edges_(e))
    vertices = spark.range(400).select("id", F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("label"))
    edges = vertices.crossJoin(spark.range(1, 4).withColumnRenamed("id", "step")).select(F.col("id").alias("src"), ((F.col("id") + F.col("step")) % 400).alias("dst"))
    pattern = Pattern.labelled(["a", "b", "c"], [(0, 1), (1, 2)])
    for dual in (False, True):
        got = M.simulate(Graph(vertices, edges), pattern, dual=dual)
        assert sorted(map(tuple, got.collect())) == sorted((q, i) for i in range(400) for q in range(3) if i % 4 == q)
    # Of 1,200 edges, those from a to b and from b to c.
    assert dealt == [200] * 3


def test_paths_of_any_length_take_few_rounds_on_chains(spark, monkeypatch):
    import random

    from graphloom.operators import bounded as BS
    from graphloom.operators.simulate import _Edges

    written, kept = [], BS.table
    monkeypatch.setattr(BS, "table", lambda df, name: written.append(name) or kept(df, name))

    def reached(edges, masks):
        way = _Edges(spark.createDataFrame(edges, "src long, dst long"))
        found = {r.id: r.mask for r in BS.anywhere(way, spark.createDataFrame(sorted(masks.items()), "id long, mask long")).collect()}
        return {k: x for k, x in found.items() if x}

    def plain(edges, masks):
        out = {}
        while True:
            new = {a: 0 for a, _ in edges}
            for a, b in edges:
                new[a] |= masks.get(b, 0) | out.get(b, 0)
            if new == out:
                return {k: x for k, x in out.items() if x}
            out = new

    # A chain, before which each edge was a round.
    chain = [(i, i + 1) for i in range(100)]
    assert reached(chain, {100: 1, 50: 2, 0: 4}) == plain(chain, {100: 1, 50: 2, 0: 4})
    assert len(written) < 15
    # A cycle, chains that lead to it and to a fork, whose edges lead to chains, to a fork and to a cycle.
    cycle = [(i, (i + 1) % 5) for i in range(5)] + [(10, 11), (11, 2), (20, 21), (21, 30), (30, 40), (30, 50), (40, 41), (50, 51), (50, 10), (51, 30)]
    masks = {1: 1, 41: 2, 51: 4, 21: 8, 11: 16, 30: 32}
    assert reached(cycle, masks) == plain(cycle, masks)
    rng = random.Random(7)
    drawn = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(45)})
    drawn = [(a, b) for a, b in drawn if a != b]
    masks = {i: 1 << i % 6 for i in rng.sample(range(40), 12)}
    assert reached(drawn, masks) == plain(drawn, masks)


def test_an_index_of_labels_has_a_row_for_many_labels(spark, monkeypatch):
    from graphloom.operators import labels as L

    said = F.concat(F.lit("the label "), F.col("id").cast("string"))
    data = spark.range(2000, numPartitions=2).select((F.col("id") * 7 % 2000).alias("id"), F.when(F.col("id") % 50 == 3, None).otherwise(said).alias("name"))
    index = L.LabelIndex.build(data, "name")
    held = index.postings.where("gram = 'abe'").collect()
    # Before, a row for each of the 1,960 labels.
    assert len(held) < 20 and max(r.n for r in held) <= L.LIST and all(r.n == len(r.ids) and r.ids == sorted(r.ids) for r in held)
    assert sorted(i for r in held for i in r.ids) == sorted(r.id for r in data.where("name is not null").collect())
    assert index.frequencies.where("gram = 'abe'").first().n == 1960
    found = {tuple(r) for r in index.search(["label 19", "l", ""]).collect()}
    monkeypatch.setattr(L, "FEW", 3)
    assert found == {tuple(r) for r in index.search(["label 19", "l", ""]).collect()}
    assert found == {(k, r.id) for r in data.collect() if r.name is not None for k, x in enumerate(["label 19", "l", ""]) if x in r.name}


def test_grams_of_many_letters_and_of_long_texts(spark, monkeypatch):
    from graphloom.operators import labels as L

    monkeypatch.setattr(L, "PIECE", 1000)
    texts = ["".join(chr(0x10000 + (i * 977 + k * 31) % 200_000) for k in range(60)) for i in range(9)] + ["ab" * 3000 + "z", "\U0010fffe", "b"]
    data = spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "id long, name string").coalesce(1)
    index = L.LabelIndex.build(data, "name")
    needles = [texts[3][7:12], texts[8][:1], "bab", "abz", "z", "\U0010fffe", "b"]
    assert {tuple(r) for r in index.search(needles).collect()} == {(k, -i) for i, t in enumerate(texts) for k, x in enumerate(needles) if x in t}


def test_a_long_cascade_tells_the_tables_once(spark, monkeypatch):
    from graphloom.model import Graph, Pattern
    from graphloom.operators import incremental as I

    added, kept = [], I.Counts.add
    monkeypatch.setattr(I.Counts, "add", lambda self, change: added.append(self.name) or kept(self, change))
    n = 8
    v = spark.range(n).select("id", F.lit("a").alias("label"))
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    m = I.IncrementalMatch(Graph(v, ring), Pattern.labelled(["a"], [(0, 0)]))
    assert m.matches().count() == n
    added.clear()
    m.delete(ring.where("src = 5"))
    # A step for each vertex of the ring, of which each but the first added to both tables before.
    assert m.matches().count() == 0 and m.support.now().count() == 0 and len(added) <= 6
    m.insert(ring.where("src = 5"))
    assert m.matches().count() == n and m.support.now().agg(F.sum("n")).first()[0] == n


def test_a_round_of_many_patterns_asks_a_row_for_few_shifts(spark, monkeypatch):
    from model_worklist import simulation

    from graphloom.model import Graph, Pattern
    from graphloom.operators import many as MP
    from graphloom.queries_match import TWENTY

    layout = MP.Layout(TWENTY)
    words = spark.range(1).select("id", *(F.lit(0).cast("long").alias(f"{x}{w}") for x in "wb" for w in range(layout.words)))
    for reverse in (False, True):
        plan = words.select(*MP.surviving_words(layout, reverse))._jdf.queryExecution().analyzed().toString()
        # Before, a test for each of the 66 query nodes.
        assert "CASE" not in plan and plan.count("shift") < 25
    assert [MP.longest_path(p) for p in (TWENTY[0], TWENTY[1], TWENTY[-1], Pattern(({},), ((0, 0),)), Pattern(({}, {})))] == [2, None, 5, None, 0]

    # A path of labels that match chains and cycles, dealt anew at each halving.
    monkeypatch.setattr(MP, "FEW", 0)
    labels = dict(enumerate(["view", "click"] * 9 + ["purchase"] * 5 + ["view", "click", "error", "signup", "purchase", "view"] * 2))
    edges = [(i, i + 1) for i in labels if i + 1 in labels]
    g = Graph(spark.createDataFrame(list(labels.items()), "id long, label string"), spark.createDataFrame(edges, "src long, dst long"))
    history = []
    found = {tuple(r) for r in MP.simulate_many(g, TWENTY, history=history).collect()}
    assert found == {(i, *x) for i, p in enumerate(TWENTY) for x in simulation(labels, edges, [n["label"] for n in p.nodes], p.edges, False)}
    # A pattern without edges is done before the first round, a pattern of single edges after it, and not a round later.
    assert history[0]["settled"] == 1 and history[1]["settled"] + history[1]["lost"] >= 1


def test_edges_of_a_random_graph_are_folded_where_they_are_made(spark, tmp_path, monkeypatch):
    import numpy as np
    import pytest

    from graphloom.queries import QUERIES
    from graphloom.sources import generators as G

    def listed(i, pieces):
        return {"edges": [[int(x) for x in e] for piece in pieces for e in zip(*piece)]}

    monkeypatch.setattr(G, "PIECE", 7)
    for p, limit in ((1.0, 50), (0.2, 100_000_000), (0.0, 3)):
        rows = G.folded_erdos_renyi(spark, 60, p, listed, "edges array<array<long>>", 3, -4, limit).collect()
        want = G.random_weights(G.erdos_renyi(spark, 60, p, 3), -4, limit).collect()
        assert len(rows) == 60 and sorted(tuple(e) for r in rows for e in r.edges) == sorted(map(tuple, want))
    ends = np.array([-5, 0, 1 << 62, -(1 << 63)]), np.array([3, -1, (1 << 63) - 1, 7])
    edges = spark.createDataFrame([tuple(map(int, e)) for e in zip(*ends)], "src long, dst long").coalesce(1)
    assert [r.value for r in G.random_weights(edges, 9, 1000).collect()] == G.weigher(9, 1000)(*ends).tolist()
    with pytest.raises(ValueError):
        G.folded_erdos_renyi(spark, 5, 1.5, listed, "edges array<array<long>>")
    monkeypatch.undo()

    for n in (0, 1, 300):
        spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("user_id")).write.parquet(str(tmp_path / f"{n}/events.parquet"))
        found = QUERIES["random_graph"](spark, str(tmp_path / str(n)))
        assert tuple(found.first()) == (n * (n - 1) // 2, True, True)
    made = []

    def visit(node):
        if "MapInArrow" in node.nodeName():
            made.append(node.metrics().apply("pythonNumRowsReceived").value())
        for k in range(node.children().size()):
            visit(node.children().apply(k))
        if "QueryStage" in node.nodeName():
            visit(node.plan())

    found.collect()
    visit(found._jdf.queryExecution().executedPlan().finalPhysicalPlan())
    # A row a vertex, not one for each of 44,850 pairs.
    assert made == [300]


def test_filters_of_orders_grow_with_their_keys(spark, tmp_path):
    import duckdb

    from graphloom.queries import ORACLE, QUERIES

    spark.range(60_000).select(F.col("id").alias("l_orderkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = sorted(map(tuple, QUERIES["bloom_blocked"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert rows == sorted(db.execute(ORACLE["bloom_blocked"]).fetchall())
    # With 97 blocks whatever the keys, the first filter said to hold 141,041 of the 147,236 orders of sf0.1, of which 29,453 were put in.
    held = [(i % 5 == 0, i % 7 < 2) for i, *_ in rows]
    for k, what in ((1, lambda a, b: a), (2, lambda a, b: a or b), (3, lambda a, b: a and b)):
        wrong = sum(r[k] and not what(*h) for r, h in zip(rows, held))
        assert wrong < 60_000 // 200 and all(r[k] for r, h in zip(rows, held) if what(*h))


def test_keys_are_shuffled_without_their_bits(spark):
    from graphloom.operators import sets as B

    ids = spark.range(3000)
    empty = B.BlockedBloom(spark, 31, 6)
    f, g = empty.insert(ids.where("id % 5 = 0")), empty.insert(ids.where("id % 7 < 2"))
    want = sorted(map(tuple, empty.contains_each(ids, {"a": f, "b": f | g}).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        each = empty.contains_each(ids, {"a": f, "b": f | g})
        assert sorted(map(tuple, each.collect())) == want
        plan = each._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The keys once and each filter's blocks, of which none has bits of keys.
    dealt = []

    def visit(node):
        if "Exchange" in node.nodeName():
            dealt.append([node.output().apply(k).name() for k in range(node.output().size())])
        for k in range(node.children().size()):
            visit(node.children().apply(k))
        if "QueryStage" in node.nodeName():
            visit(node.plan())

    visit(plan.finalPhysicalPlan())
    assert len(dealt) == 3 and ["id", "__block"] in dealt and not any(c.startswith("__b0") for x in dealt for c in x)
