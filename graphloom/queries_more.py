"""Further registered queries: readers and writers on whole tables, streams, vertex programs, functions; and their SQL for DuckDB."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import datasets as D
from graphloom import metrics, sinks
from graphloom.functions import scalars as S
from graphloom.model import Graph, Pattern
from graphloom.operators import analytics as A
from graphloom.operators import programs as P
from graphloom.operators import sets as B
from graphloom.operators import simulate as M
from graphloom.queries import PATH, query, relation_sql
from graphloom.runtime import new_path
from graphloom.sources import generators as G
from graphloom.sources import readers as R
from graphloom.sources.config import Config, hosts
from graphloom.streaming import dynamic as Y


def _blocks(rows: DataFrame, at: Column, value: Column, each: int = 500) -> DataFrame:
    """Lines as a file that is read in blocks of `each` places."""
    return rows.select(F.lit("f").alias("file"), F.floor(at / each).alias("block"), at.alias("at"), value.alias("value"))


# --- readers on texts made of whole tables -----------------------------------------------------------------------------------


@query("SELECT src, dst, v AS value FROM (SELECT o_orderkey AS src, o_custkey AS dst, round(o_totalprice, 2) AS v FROM orders) WHERE src <> dst")
def parse_edgelist_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each order as an edge line, by turns with tabs, commas and blanks, and a comment for every seventh."""
    o = D.read(spark, d, "orders")
    sep = F.element_at(F.array(F.lit("\t"), F.lit(","), F.lit(" ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    price = F.round("o_totalprice", 2)
    line = F.concat(F.col("o_orderkey").cast("string"), sep, F.col("o_custkey").cast("string"), sep, price.cast("string"))
    lines = o.select(F.explode(F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("# a comment"), line)).otherwise(F.array(line))).alias("value"))
    return R.parse_edge_list(lines, "double")


@query("SELECT l_orderkey AS src, l_partkey AS dst, list(l_quantity::INTEGER ORDER BY l_linenumber, l_quantity::INTEGER) AS value FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY ALL")
def parse_multivalue_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = D.read(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("l"))
    return R.parse_edge_list(rows.select(F.concat_ws(" ", "l_orderkey", "l_partkey", F.concat_ws(":", F.transform("l", lambda x: x["q"].cast("string")))).alias("value")), "int:list")


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey")
def parse_adjlist_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rows = D.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("l"))
    return R.parse_adjacency(rows.select(F.concat_ws(" ", "l_orderkey", F.size("l"), F.concat_ws(" ", F.transform("l", lambda x: x.cast("string")))).alias("value")))


_METIS = "(SELECT row_number() OVER (ORDER BY event_id) - 1 AS src, user_id, count(*) OVER () AS n, event_id FROM events)"


@query(f"SELECT src, dst FROM (SELECT src, user_id AS dst FROM {_METIS} UNION ALL SELECT src, (event_id * 7) % n FROM {_METIS}) WHERE src < dst")
def parse_metis_events(spark: SparkSession, d: str) -> DataFrame:
    """Line k names two neighbours of event k, counted from 1; read in blocks."""
    events = D.read(spark, d, "events")
    n = events.count()
    head = spark.createDataFrame([(-2, "% events"), (-1, f"{n} {2 * n}")], "at long, value string")
    lines = events.select(F.col("event_id").alias("at"), F.concat_ws(" ", F.col("user_id") + 1, F.col("event_id") * 7 % n + 1).alias("value"))
    return R.parse_metis(_blocks(head.unionByName(lines), F.col("at"), F.col("value")))


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey")
def parse_cassovary_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """A line for each order with the number of its items, and a line for each item; blocks part orders from their items."""
    items = D.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("k"), F.col("l_partkey").cast("string").alias("value"), F.monotonically_increasing_id().alias("m"))
    heads = items.groupBy("o").agg(F.lit(0).cast("long").alias("k"), F.concat_ws(" ", F.col("o"), F.count("*")).alias("value")).select("o", "k", "value", F.lit(0).cast("long").alias("m"))
    rows = heads.unionByName(items).select(F.struct("o", "k", "m", "value").alias("at"), "o", "k", "value")
    return R.parse_cassovary(rows.select(F.lit("f").alias("file"), F.floor((F.col("o") * 8 + F.col("k")) / 333).alias("block"), "at", "value"))


def _packed(value: str | None):
    """A function that packs batches of two ids and, where given, a value, to a record a row."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        kind = R._record(value)
        for b in batches:
            rows = np.empty(len(b), kind)
            for name, column in zip(kind.names, b.columns, strict=True):
                rows[name] = column.to_numpy(zero_copy_only=False)
            data = rows.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + kind.itemsize] for i in range(0, len(data), kind.itemsize)], pa.binary())], ["value"])

    return pack


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_quantity::FLOAT AS value FROM lineitem WHERE l_orderkey <> l_partkey")
def parse_binary_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Records of two ids and a float, packed by Python and read as records."""

    rows = D.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").mapInArrow(_packed("float"), "value binary")
    return R.parse_binary(rows, "float")


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey")
def parse_binary_ids(spark: SparkSession, d: str) -> DataFrame:
    """The same without a value."""
    return R.parse_binary(D.read(spark, d, "lineitem").select("l_orderkey", "l_partkey").mapInArrow(_packed(None), "value binary"))


@query("SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey <> o_custkey")
def graph_without_values(spark: SparkSession, d: str) -> DataFrame:
    """Edges written with values as text, and read by format without them."""
    folder = new_path(spark, "file")
    sinks.write_edges(D.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), folder)
    return R.read_graph(spark, folder, "edgelist")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey::BIGINT END AS nation FROM customer")
def parse_attributes_customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a JSON array with an element a line, every ninth of them null; read in blocks."""
    c = D.read(spark, d, "customer")
    last = c.agg(F.max("c_custkey")).first()[0]
    element = F.when(F.col("c_custkey") % 9 == 0, F.lit("null")).otherwise(F.to_json(F.struct(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("nation"))))
    line = F.concat(F.when(F.col("c_custkey") == 0, F.lit("[")).otherwise(F.lit("  ")), element, F.when(F.col("c_custkey") == last, F.lit("]")).otherwise(F.lit(",")))
    out = R.parse_attributes(_blocks(c, F.col("c_custkey"), line))
    return out.select("id", S.json_at(F.col("attrs"), "$.label", "string").alias("segment"), S.json_at(F.col("attrs"), "$.nation", "long").alias("nation"))


@query("SELECT o_orderkey AS src, o_custkey AS dst, o_totalprice AS value FROM orders WHERE o_orderkey <> o_custkey AND greatest(o_orderkey, o_custkey) <= 5000")
def graph_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as text, read by format with a limit on ids, kept as Parquet, and read from there."""
    folder = new_path(spark, "file")
    sinks.write_edges(D.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), f"{folder}/edges")
    for _ in range(2):
        out = R.cached_graph(spark, f"{folder}/edges", f"{folder}/cache", "edgelist", "double", max_vertex=5000)
    return out


@query("SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey <> o_custkey")
def graph_from_shards(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as shards, the files split, and read; the shards deleted."""
    folder = new_path(spark, "shards")
    R.write_shards(D.read(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")).where("src <> dst"), f"{folder}/a", 6)
    sinks.split_files(spark, f"{folder}/a", f"{folder}/b", 1000)
    R.delete_shards(spark, f"{folder}/a")
    return spark.read.parquet(f"{folder}/b")


# --- writers -----------------------------------------------------------------------------------------------------------------


@query("SELECT event_id AS id, event_type AS value FROM events")
def values_file(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "values")
    sinks.write_values(D.sessions(spark, d).vertices, folder, "label")
    return spark.read.csv(folder, sep="\t", schema="id long, value string")


@query(f"WITH {D.COMMERCE_SQL} SELECT label, n + 1 AS n FROM (SELECT label, count(*) AS n FROM v WHERE label <> id::VARCHAR GROUP BY label)")
def components_file(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "components")
    vertices = D.commerce(spark, d).vertices.withColumn("id", F.col("id").cast("string"))
    sinks.write_components(A.label_frequency(vertices), folder)
    return spark.read.csv(folder, schema="label string, n long")


@query(f"WITH {D.TRANSITIONS_SQL}, p AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT (SELECT max(greatest(src, dst)) + 1 FROM e) AS n_vertices, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT id) FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)) AS connected")
def metadata_tables(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "metadata")
    sinks.write_metadata(D.transitions(spark, d).edges, folder, 5)
    t = lambda name: spark.read.parquet(f"{folder}/{name}")
    edges = t("intervals").agg(F.sum("n_edges").alias("n_edges"))
    return t("numvertices").join(edges, F.lit(True)).join(t("degrees").agg(F.count("*").alias("connected")), F.lit(True))


@query("SELECT 0 AS iteration, 5::BIGINT AS updates, 9::BIGINT AS work, 2.5::DOUBLE AS delta UNION ALL SELECT 1, 3, 9, 0.0")
def history_file(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "history")
    sinks.write_history(spark, [{"iteration": 0, "updates": 5, "work": 9, "delta": 2.5}, {"iteration": 1, "updates": 3, "work": 9, "delta": 0}], folder)
    return spark.read.csv(folder, schema="iteration int, updates long, work long, delta double")


@query("SELECT o_orderkey AS src, o_custkey AS dst, 7.0::DOUBLE AS value FROM orders")
def edge_values_reset(spark: SparkSession, d: str) -> DataFrame:
    return sinks.reset_edge_values(D.read(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_totalprice").alias("value")), 7.0)


@query("SELECT event_type AS name, 'real' AS kind, sum(value) AS value, count(*) AS count, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def metrics_table(spark: SparkSession, d: str) -> DataFrame:
    """Metrics that a driver keeps, from the totals that a query gives."""
    m = metrics.Metrics("events")
    for r in D.read(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b")).collect():
        m.set(r.event_type, r.s)
        e = m.entries[r.event_type]
        e.count, e.least, e.most = r.n, r.a, r.b
    return m.table(spark).drop("avg").withColumn("value", F.round("value", 6))


# --- analytics ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {D.COMMERCE_SQL} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS connected, (SELECT count(*) FROM e) AS edges")
def degree_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.degree_totals(D.commerce(spark, d).edges)


@query(f"WITH {D.COMMERCE_SQL}, i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src) SELECT id, label, coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree FROM v LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def vertices_with_degrees(spark: SparkSession, d: str) -> DataFrame:
    return A.with_degrees(D.commerce(spark, d))


@query("WITH d AS (SELECT o_custkey AS dst, o_orderkey AS src FROM orders) SELECT i AS id, (SELECT count(*) FROM d WHERE dst = i) AS n FROM range((SELECT max(greatest(src, dst)) + 1 FROM d)) r(i) WHERE i % 50 = 0")
def dense_vertices(spark: SparkSession, d: str) -> DataFrame:
    """In-degrees over all ids from 0 on, reported for round ids."""
    edges = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return Graph(counts, edges).dense().where("id % 50 = 0").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {D.TRANSITIONS_SQL} SELECT count(*) AS n, count(DISTINCT id) AS n_ids, 0::BIGINT AS first, (count(*) - 1)::BIGINT AS last FROM v")
def random_order(spark: SparkSession, d: str) -> DataFrame:
    placed = A.random_order(D.transitions(spark, d).vertices, 3)
    return placed.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min("place").alias("first"), F.max("place").alias("last"))


@query("WITH p AS (SELECT o_custkey AS dst, count(*) AS n FROM orders GROUP BY 1) SELECT (SELECT count(*) FROM orders) AS n_edges, true AS small, true AS apart, (SELECT count(*) FROM p)::BIGINT AS covered")
def shards_split(spark: SparkSession, d: str) -> DataFrame:
    """Shards split until none has over 700 edges: what they hold, and that no two overlap."""
    from pyspark.sql import Window as W

    edges = D.read(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    shards = A.split_shards(edges, A.range_shards(edges, 2), 700)
    covered = edges.select("dst").distinct().join(F.broadcast(shards), F.col("dst").between(F.col("first"), F.col("last"))).agg(F.count("*").alias("covered"))
    later = F.coalesce(F.col("first") > F.lag("last").over(W.orderBy("first")), F.lit(True))
    return shards.withColumn("apart", later).agg(F.sum("n_edges").alias("n_edges"), (F.max("n_edges") <= 700).alias("small"), F.bool_and("apart").alias("apart")).join(covered, F.lit(True))


@query("SELECT count(DISTINCT o_custkey) AS n, 0::BIGINT AS wrong FROM orders")
def random_targets(spark: SparkSession, d: str) -> DataFrame:
    """One out-edge of each customer: how many there are, and how many are no edge."""
    edges = D.read(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    drawn = A.random_out_edge(edges, 5)
    wrong = drawn.withColumnRenamed("id", "src").join(edges, ["src", "dst"], "left_anti").agg(F.count("*").alias("wrong"))
    return drawn.agg(F.count("*").alias("n")).join(wrong, F.lit(True))


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS total FROM events WHERE event_id >= 100 AND event_id < 4000")
def vertices_visited(spark: SparkSession, d: str) -> DataFrame:
    """A callback on windows of a range of vertices, whose visits accumulators count."""
    n, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def visit(window: list) -> None:
        n.add(len(window))
        total.add(sum(r.id for r in window))

    A.for_each_vertex(D.read(spark, d, "events").select(F.col("event_id").alias("id")), visit, 100, 4000, 500)
    return spark.createDataFrame([(n.value, total.value)], "n long, total long")


# --- matches -----------------------------------------------------------------------------------------------------------------


@query(relation_sql(D.SESSIONS_SQL, PATH) + "SELECT q, count(*) AS n, 4 * sum(count(*)) OVER ()::BIGINT AS shipped_bytes, true AS timed FROM m GROUP BY q")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    told = M.run_report(D.sessions(spark, d), PATH, path=new_path(spark, "matches"))
    rows = [(q, n, told["shipped_bytes"], told["seconds"] > 0) for q, n in enumerate(told["matches"])]
    return spark.createDataFrame(rows, "q int, n long, shipped_bytes long, timed boolean")


@query(relation_sql(D.SESSIONS_SQL, PATH) + "SELECT q, id FROM m")
def sim_confined(spark: SparkSession, d: str) -> DataFrame:
    """The match on what the candidates lead to."""
    return M.simulate(M.confined(D.sessions(spark, d), PATH), PATH)


@query(relation_sql(D.SESSIONS_SQL, PATH) + "SELECT q, id FROM m")
def sim_query_file(spark: SparkSession, d: str) -> DataFrame:
    """The pattern and settings read from files."""
    import json

    folder = new_path(spark, "query")
    text = json.dumps({"node": list(PATH.nodes), "edge": [{"source": s, "target": t} for s, t in PATH.edges]}, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/query")
    spark.createDataFrame([("# settings",), ("include_isolated = 0",)], "value string").coalesce(1).write.text(f"{folder}/conf")
    config = Config.parse("\n".join(r.value for r in spark.read.text(f"{folder}/conf").collect()))
    return M.simulate(D.sessions(spark, d), Pattern.parse("\n".join(r.value for r in spark.read.text(f"{folder}/query", wholetext=True).collect())), include_isolated=config.flag("include_isolated"))


# --- programs ----------------------------------------------------------------------------------------------------------------

_USERS = "t AS (SELECT user_id AS id, count(*)::DOUBLE AS value FROM events GROUP BY user_id)"


@query(f"WITH {D.TRANSITIONS_SQL}, {_USERS}, a AS (SELECT dst AS id, sum(t.value + src % 5) AS s FROM e JOIN t ON t.id = src GROUP BY dst) SELECT id, t.value + coalesce(s, 0) AS value FROM t LEFT JOIN a USING (id)")
def vertex_program(spark: SparkSession, d: str) -> DataFrame:
    """One round: each user adds what the edges that lead to it tell, and the values on them."""
    g = D.transitions(spark, d)
    values = D.read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").cast("double").alias("value"))
    edges = g.edges.withColumn("value", (F.col("src") % 5).cast("double"))
    program = P.VertexProgram(F.col("other_value") + F.col("edge_value"), F.sum, F.col("value") + F.coalesce("acc", F.lit(0.0)))
    return program.run(Graph(values, edges), 1)[0]


@query(f"WITH {D.TRANSITIONS_SQL} SELECT src, dst, (src + 2)::DOUBLE AS value FROM e")
def edge_values_written(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds in which vertices write on their out-edges: their id, then that plus the round's step."""
    g = D.transitions(spark, d)
    edges = g.edges.withColumn("value", F.lit(0.0))
    program = P.VertexProgram(F.col("edge_value"), F.max, F.lit(0.0), edge=F.when(F.col("edge_value") == 0, F.col("src") + 1.0).otherwise(F.col("edge_value") + 1.0))
    return program.run_with_edges(Graph(g.vertices.select("id", F.lit(0.0).alias("value")), edges), 2)[1]


@query(f"WITH {D.TRANSITIONS_SQL} SELECT src AS id, count(*)::BIGINT AS n, max(dst) AS last FROM e GROUP BY src")
def vertices_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Python for each vertex with its out-edges."""
    import pandas as pd

    g = D.transitions(spark, d)
    return P.map_vertices(g, lambda key, pdf: pd.DataFrame({"id": [key], "n": [len(pdf)], "last": [pdf["dst"].max()]}), "id long, n long, last long")


@query(f"WITH {D.TRANSITIONS_SQL} SELECT DISTINCT dst AS src, src % 10 AS dst FROM e")
def graph_emitted(spark: SparkSession, d: str) -> DataFrame:
    """A new graph from edges that a function emits for each vertex, each once."""
    emit = lambda key, pdf: pdf.assign(src=pdf["dst"], dst=key % 10)[["src", "dst"]]
    return P.emitted_graph(D.transitions(spark, d), emit, "src long, dst long", new_path(spark, "emitted"), keep=lambda e: e.distinct())


@query(f"WITH RECURSIVE {D.TRANSITIONS_SQL}, r(a, b) AS (SELECT DISTINCT id, id FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT b AS id, min(a) AS value FROM r GROUP BY b")
def monotone_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """The smallest id from which each vertex can be reached, as a fixpoint of a kernel whose values only fall."""
    least = P.Kernel(lambda i, a, b: i, F.lit(None).cast("long"), lambda m: m, F.min, lambda old, acc: F.least(old, acc), lambda v, o: v)
    return P.run_monotone(D.transitions(spark, d).edges, least)


@query("SELECT user_id AS id, sum(value) AS total, max(value) AS most FROM events GROUP BY user_id")
def message_priorities(spark: SparkSession, d: str) -> DataFrame:
    return D.read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(P.sum_priority(F.col("value")).alias("total"), P.max_priority(F.col("value")).alias("most"))


@query(f"WITH {D.TRANSITIONS_SQL}, f AS (SELECT id FROM v WHERE id % 3 = 0 UNION SELECT id FROM v WHERE id % 5 = 0) SELECT (SELECT count(*) FROM f WHERE id % 7 <> 0) AS scheduled, (SELECT count(*) FROM v) AS everything, (SELECT count(*) FROM f WHERE id BETWEEN 20 AND 29 AND id % 7 <> 0) > 0 AS any_in_window")
def frontier_steps(spark: SparkSession, d: str) -> DataFrame:
    v = D.transitions(spark, d).vertices
    f = B.Frontier(v.where("id % 3 = 0")).add(v.where("id % 5 = 0")).remove(v.where("id % 7 = 0"))
    return spark.createDataFrame([(f.count(), f.add_all(v).count(), f.any_in(20, 30))], "scheduled long, everything long, any_in_window boolean")


# --- changing graphs ---------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT o_custkey AS src, o_orderkey + 100000 AS dst FROM orders WHERE o_orderkey % 10 <> 3 UNION SELECT event_id + 1000000, user_id FROM events WHERE event_id + 1000000 <> user_id")
def dynamic_stream(spark: SparkSession, d: str) -> DataFrame:
    """Edges added by hand, a stream of insertions, a compaction, and a second stream of deletions; the first stream restarted."""
    folder = new_path(spark, "stream")
    g = Y.DynamicGraph(spark, f"{folder}/graph")
    orders = D.read(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 100000).alias("dst"))
    g.add_edges(orders)

    def follow(name: str) -> None:
        rows = spark.readStream.schema("src long, dst long, op int").option("maxFilesPerTrigger", 2).parquet(f"{folder}/{name}")
        g.wait(g.follow(rows, f"{folder}/checkpoint-{name}"))

    events = D.read(spark, d, "events").select((F.col("event_id") + 1000000).alias("src"), F.col("user_id").alias("dst"), F.lit(1).alias("op"))
    events.repartition(4).write.parquet(f"{folder}/added")
    follow("added")
    g.compact(force=True)
    orders.where("(dst - 100000) % 10 = 3").withColumn("op", F.lit(-1)).coalesce(1).write.parquet(f"{folder}/removed")
    follow("removed")
    follow("added")
    return g.edges().select("src", "dst")


@query("SELECT 2::BIGINT AS first_batches, 4::BIGINT AS batches, 0::BIGINT AS base_before, n AS log_before, n AS base_after, 0::BIGINT AS log_after FROM (SELECT count(*) AS n FROM (SELECT DISTINCT event_id + 1000000 AS src, user_id AS dst FROM events) WHERE src <> dst)")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """A stream that is to end after two batches of four, goes on when it is started again, and the counts before and after a compaction."""
    folder = new_path(spark, "stream")
    g = Y.DynamicGraph(spark, f"{folder}/graph", buffer_limit=1 << 40)
    events = D.read(spark, d, "events").select((F.col("event_id") + 1000000).alias("src"), F.col("user_id").alias("dst"), F.lit(1).alias("op"))
    events.repartition(4).write.parquet(f"{folder}/added")
    batches = []
    for last in (2, None):
        g.finish_after(last)
        rows = spark.readStream.schema("src long, dst long, op int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/added")
        g.wait(g.follow(rows, f"{folder}/checkpoint"))
        batches.append(g.next_batch())
    before = g.counts()
    g.compact(force=True)
    return spark.createDataFrame([(*batches, *before, *g.counts())], "first_batches long, batches long, base_before long, log_before long, base_after long, log_after long")


@query("SELECT user_id AS id, min(event_id)::BIGINT AS value FROM (SELECT user_id, event_id FROM events) GROUP BY user_id")
def state_over_batches(spark: SparkSession, d: str) -> DataFrame:
    """The first event that leads to each user, kept over two batches of edges: only new edges' targets run in the second."""
    folder = new_path(spark, "state")
    g = Y.DynamicGraph(spark, folder)
    edges = D.read(spark, d, "events").select((F.col("event_id") + 10_000_000).alias("src"), F.col("user_id").alias("dst"))
    known = F.when(F.col("id") >= 10_000_000, F.col("id") - 10_000_000)
    least = P.VertexProgram(F.col("other_value"), F.min, F.least("value", "acc"))
    state = None
    for k in (0, 1):
        new = edges.where(F.col("src") % 2 == k)
        g.add_edges(new)
        state = Y.merge_state(state if state is not None else spark.createDataFrame([], "id long, value long"), g, known)
        g.add_task(new.select(F.col("dst").alias("id")))
        state = g.run(least, state, 1)
    return state.where("id < 10000000")


# --- sets, functions, settings -----------------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id AS id FROM events WHERE user_id < 100 AND (user_id < 20 OR user_id >= 40)")
def bit_set_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Users as a bit set, a range cleared and the set cut."""
    bits = B.bit_set(D.read(spark, d, "events").select(F.col("user_id").alias("id")))
    return B.bit_set_members(B.bit_set_resized(B.bit_set_without(bits, 20, 40), 100))


@query("SELECT user_id AS id, (user_id & 2) > 0 AS got, user_id | 8 AS put, user_id & ~4 AS cleared FROM events")
def bits_of_ids(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    return D.read(spark, d, "events").select(u.alias("id"), B.get_bit(u, 1).alias("got"), B.set_bit(u, 3).alias("put"), B.clear_bit(u, 2).alias("cleared"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS base, url AS trimmed, url AS line, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM pages")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return D.read(spark, d, "pages").select("page_id", S.dirname(u).alias("dir"), S.basename(u).alias("base"), S.trimmed(F.concat(F.lit(" \t"), u, F.lit("\r\n"))).alias("trimmed"), S.without_newline(F.concat(u, F.lit("\r\n"))).alias("line"), S.tokens(u, "/").alias("parts"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS old, CASE WHEN event_id % 2 = 0 THEN value ELSE -1.0 END AS l, CASE WHEN event_id % 2 = 0 THEN -1.0 ELSE value + 1 END AS r FROM events")
def pair_functions(spark: SparkSession, d: str) -> DataFrame:
    p, i = S.pair(F.col("value"), F.col("value") + 1), F.col("event_id")
    new = S.set_new_value(p, i, F.lit(-1.0))
    return D.read(spark, d, "events").select("event_id", S.old_value(p, i).alias("old"), new["left"].alias("l"), new["right"].alias("r"))


@query("SELECT user_id AS id, (count(*) + 1)::INTEGER AS size, 0::INTEGER AS cleared, -1::BIGINT AS last, -2::BIGINT AS first, sum(event_id)::BIGINT AS total FROM events GROUP BY user_id")
def list_functions(spark: SparkSession, d: str) -> DataFrame:
    lists = D.read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_list("event_id").alias("l"))
    more = S.list_add(F.col("l"), F.lit(-1).cast("long"))
    return lists.select("id", S.list_size(more).alias("size"), S.list_size(S.list_clear(more)).alias("cleared"), F.element_at(more, -1).alias("last"), S.list_get(S.list_set(more, 0, F.lit(-2).cast("long")), 0).alias("first"), S.fold(lambda a, x: a + x, F.col("l"), F.lit(0).cast("long")).alias("total"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE = 5 AS same, CASE WHEN k < 50 THEN -1 WHEN k > 50 THEN 1 ELSE 0 END AS order_, 1 AS before, k AS front, event_id AS back, false AS none FROM (SELECT event_id, props, (props->>'$.k')::BIGINT AS k FROM events)")
def json_order(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons and the ends of arrays."""
    k = S.json_at(F.parse_json("props"), "$.k")
    pair = F.parse_json(F.concat(F.lit("["), F.to_json(k), F.lit(","), F.col("event_id"), F.lit("]")))
    return D.read(spark, d, "events").select(
        "event_id", S.json_equal(k, F.parse_json(F.lit("5.0"))).alias("same"), S.json_compare(k, F.parse_json(F.lit("50"))).alias("order_"), S.json_compare(F.parse_json(F.lit('"a"')), k).alias("before"),
        S.json_front(pair).try_cast("long").alias("front"), S.json_back(pair).try_cast("long").alias("back"), S.json_empty(pair).alias("none"),
    )


@query("SELECT event_id, '{\"k\":' || (props->>'$.k') || ',\"z\":' || event_id || '}' AS put, '{}' AS erased, '[1,' || event_id || ',2]' AS inserted, '[1,2,' || event_id || ']' AS pushed, '{}' AS cleared, true AS indented FROM events")
def json_change(spark: SparkSession, d: str) -> DataFrame:
    """Members set and erased, elements inserted and pushed."""
    v, two = F.parse_json("props"), F.parse_json(F.lit("[1,2]"))
    i = F.parse_json(F.col("event_id").cast("string"))
    return D.read(spark, d, "events").select(
        "event_id", S.json_dump(S.json_set(v, "z", i)).alias("put"), S.json_dump(S.json_erase(v, "k")).alias("erased"), S.json_dump(S.json_insert(two, 1, i)).alias("inserted"),
        S.json_dump(S.json_push(two, i)).alias("pushed"), S.json_dump(S.json_clear(v)).alias("cleared"), F.contains(S.json_dump(v, indent=True), F.lit("\n")).alias("indented"),
    )


@query("SELECT count(*) AS n, true AS whole, true AS real, true AS mean, true AS coin, true AS gamma, true AS classes, true AS nan FROM events")
def random_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws for each event: their ranges, and means near what they should be."""
    e = D.read(spark, d, "events").select(
        "event_id", S.uniform_int(3, 7, 1).alias("i"), S.uniform(-1.0, 1.0, 2).alias("u"), S.gaussian(5.0, 2.0, 3).alias("g"), S.bernoulli(0.25, 4).alias("b"),
        S.gamma(2.0, F.col("event_id"), 5).alias("m"), S.multinomial(F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0)), 6).alias("c"), S.is_nan(F.lit(float("nan"))).alias("x"),
    )
    near = lambda x, to, by: F.abs(F.avg(x) - to) < by
    return e.agg(
        F.count("*").alias("n"), (F.min("i").eqNullSafe(F.lit(3)) & F.max("i").eqNullSafe(F.lit(7))).alias("whole"), ((F.min("u") >= -1) & (F.max("u") < 1)).alias("real"), near("g", 5.0, 0.2).alias("mean"),
        near(F.col("b").cast("int"), 0.25, 0.03).alias("coin"), near("m", 2.0, 0.2).alias("gamma"), (near(F.col("c").cast("int"), 1.5, 0.1) & ~F.bool_or(F.col("c") == 1)).alias("classes"), F.bool_and("x").alias("nan"),
    )


@query("SELECT event_id, list_sort(range(event_id % 9 + 1)) AS sorted FROM events")
def permutations(spark: SparkSession, d: str) -> DataFrame:
    e = D.read(spark, d, "events")
    return e.select("event_id", F.sort_array(S.permutation((F.col("event_id") % 9 + 1).cast("long"), 4)).cast("array<bigint>").alias("sorted"))


@query("SELECT (n * (n - 1) // 2)::BIGINT AS pairs, true AS apart, true AS within FROM (SELECT count(DISTINCT user_id) AS n FROM events)")
def random_graph(spark: SparkSession, d: str) -> DataFrame:
    """As many vertices as there are users: all pairs at probability 1, in either direction, and weights within their limit."""
    n = D.read(spark, d, "events").agg(F.count_distinct("user_id")).first()[0]

    def checked(i, pieces):
        import numpy as np

        # Pairs are half a square of the users: they are marked where they are made, and each vertex is a row.
        seen, apart, within = np.zeros(n, bool), True, True
        for src, dst, value in pieces:
            if (np.minimum(src, dst) != i).any():
                raise ValueError("an edge is not its vertex's")
            seen[np.maximum(src, dst)] = True
            apart = apart and bool((src != dst).all())
            within = within and bool(value.min() >= 0 and value.max() < 50)
        return {"pairs": int(np.count_nonzero(seen)), "apart": apart, "within": within}

    found = G.folded_erdos_renyi(spark, n, 1.0, checked, "pairs long, apart boolean, within boolean", 3, 4, 50)
    return found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"), *(F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in ("apart", "within")))


@query("SELECT 3::BIGINT AS hosts, 7::BIGINT AS from_line, 2000::BIGINT AS by_default")
def settings(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "hosts")
    spark.createDataFrame([("n1",), ("n2",), (" ",), ("n3",)], "value string").coalesce(1).write.text(folder)
    config = Config.load(spark, None, ["--alpha=7", "filetype", "metis"])
    return spark.createDataFrame([(hosts(spark, folder), config.integer("alpha"), config.integer("memory"))], "hosts long, from_line long, by_default long")


@query("SELECT event_id FROM events")
def checked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold an assertion each."""
    return D.read(spark, d, "events").where(S.check(F.col("event_id") >= 0, "an id is negative").isNull()).select("event_id")


@query("SELECT 3::BIGINT AS n, 12.0::DOUBLE AS last, true AS drawn")
def time_series(spark: SparkSession, d: str) -> DataFrame:
    t = metrics.TimeSeries()
    for k in (4, 8, 12):
        t.record(edges=k, updates=1)
    drawn = t.svg("edges").count(",") == 3
    return t.table(spark).where("name = 'edges'").agg(F.count("*").alias("n"), F.max("value").alias("last")).withColumn("drawn", F.lit(drawn))
