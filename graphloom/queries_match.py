"""Registered queries on further kinds of simulation, many patterns at once, and search for labels; and their SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import datasets as D
from graphloom.model import Graph, Pattern
from graphloom.operators import bounded as BS
from graphloom.operators import labels as L
from graphloom.operators import many as MP
from graphloom.operators import simulate as M
from graphloom.operators import strong as ST
from graphloom.queries import DIAMOND, PATH, TRIANGLE, TWO_CYCLE, _label_sql, query

#: Rounds of recursive SQL, more than these patterns need on the test tables.
ROUNDS = 20


def _start_sql(pattern: Pattern, bits: str = "BIGINT", first: int = 0) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {1 << (q + first)}::{bits} ELSE 0 END" for q, c in enumerate(_label_sql(pattern)))


def _kept_sql(pattern: Pattern, dual: bool) -> str:
    """The bits of p.mask that go on, from k.cm (children's) and, for dual simulation, b.cm (parents')."""
    behind = pattern.reversed().needs()
    bit = lambda q, need: f"p.mask & {1 << q} > 0" + (f" AND coalesce(k.cm, 0) & {need} = {need}" if need else "") + (f" AND coalesce(b.cm, 0) & {behind[q]} = {behind[q]}" if dual and behind[q] else "")
    return " + ".join(f"CASE WHEN {bit(q, need)} THEN {1 << q} ELSE 0 END" for q, need in enumerate(pattern.needs()))


def _fits_sql(pattern: Pattern, a: str, b: str) -> str:
    return "(" + " OR ".join(f"({a} & {1 << s} > 0 AND {b} & {1 << t} > 0)" for s, t in sorted(set(pattern.edges))) + ")"


def dual_sql(tables: str, pattern: Pattern, rounds: int = ROUNDS) -> str:
    """CTEs that end in dm(id, mask), the greatest dual simulation."""
    full = (1 << len(pattern.nodes)) - 1
    return f"""WITH RECURSIVE {tables.strip()},
g AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
s(r, id, mask) AS (
  SELECT 0, id, ({_start_sql(pattern)})::BIGINT FROM v WHERE id IN (SELECT src FROM g UNION SELECT dst FROM g)
  UNION ALL
  SELECT p.r + 1, p.id, ({_kept_sql(pattern, True)})::BIGINT FROM s p
  LEFT JOIN (SELECT g.src, bit_or(c.mask) AS cm FROM g JOIN s c ON c.id = g.dst GROUP BY 1) k ON k.src = p.id
  LEFT JOIN (SELECT g.dst, bit_or(c.mask) AS cm FROM g JOIN s c ON c.id = g.src GROUP BY 1) b ON b.dst = p.id WHERE p.r < {rounds}),
dm AS MATERIALIZED (SELECT id, mask FROM s WHERE r = {rounds} AND mask > 0 AND (SELECT bit_or(mask) FROM s WHERE r = {rounds}) = {full})
"""


def strong_sql(tables: str, pattern: Pattern, strict: bool, rounds: int = ROUNDS) -> str:
    """Balls as rows, the dual fixpoint of each as a recursion over rounds, and what hangs together with the centre."""
    walked = "(SELECT src, dst FROM mg)" if strict else "g"
    return f"""{dual_sql(tables, pattern, rounds)},
mg AS MATERIALIZED (SELECT g.src, g.dst FROM g JOIN dm a ON a.id = g.src JOIN dm b ON b.id = g.dst WHERE {_fits_sql(pattern, "a.mask", "b.mask")}),
u AS MATERIALIZED (SELECT src AS a, dst AS b FROM {walked} UNION SELECT dst, src FROM {walked}),
ball(c, id, h) AS (SELECT id, id, 0 FROM dm UNION SELECT ball.c, u.b, ball.h + 1 FROM ball JOIN u ON u.a = ball.id WHERE ball.h < {ST.diameter(pattern)}),
bm AS MATERIALIZED (SELECT DISTINCT c, id, mask FROM ball JOIN dm USING (id)),
be AS MATERIALIZED (SELECT x.c, mg.src, mg.dst FROM mg JOIN bm x ON x.id = mg.src JOIN bm y ON y.id = mg.dst AND y.c = x.c),
t(r, c, id, mask) AS (
  SELECT 0, c, id, mask FROM bm
  UNION ALL
  SELECT p.r + 1, p.c, p.id, ({_kept_sql(pattern, True)})::BIGINT FROM t p
  LEFT JOIN (SELECT be.c, be.src, bit_or(x.mask) AS cm FROM be JOIN t x ON x.id = be.dst AND x.c = be.c GROUP BY ALL) k ON k.src = p.id AND k.c = p.c
  LEFT JOIN (SELECT be.c, be.dst, bit_or(x.mask) AS cm FROM be JOIN t x ON x.id = be.src AND x.c = be.c GROUP BY ALL) b ON b.dst = p.id AND b.c = p.c WHERE p.r < {rounds}),
tm AS MATERIALIZED (SELECT c, id, mask FROM t WHERE r = {rounds} AND mask > 0),
te AS MATERIALIZED (SELECT be.c, be.src, be.dst FROM be JOIN tm a ON a.c = be.c AND a.id = be.src JOIN tm b ON b.c = be.c AND b.id = be.dst WHERE {_fits_sql(pattern, "a.mask", "b.mask")}),
tu AS MATERIALIZED (SELECT c, src AS a, dst AS b FROM te UNION SELECT c, dst, src FROM te),
part(c, id) AS (SELECT c, id FROM tm WHERE c = id UNION SELECT part.c, tu.b FROM part JOIN tu ON tu.c = part.c AND tu.a = part.id)
SELECT tm.c AS centre, q::INTEGER AS q, tm.id FROM tm JOIN part USING (c, id), range({len(pattern.nodes)}) n(q) WHERE tm.mask & (1::BIGINT << q::INTEGER) > 0"""


@query(dual_sql(D.TRANSITIONS_SQL, DIAMOND) + "SELECT q::INTEGER AS q, id FROM dm, range(4) n(q) WHERE mask & (1::BIGINT << q::INTEGER) > 0")
def sim_dual(spark: SparkSession, d: str) -> DataFrame:
    return M.simulate(D.transitions(spark, d), DIAMOND, dual=True)


@query(strong_sql(D.TRANSITIONS_SQL, TRIANGLE, False))
def sim_strong(spark: SparkSession, d: str) -> DataFrame:
    return ST.simulate_strong(D.transitions(spark, d), TRIANGLE)


@query(strong_sql(D.TRANSITIONS_SQL, TRIANGLE, True))
def sim_strict(spark: SparkSession, d: str) -> DataFrame:
    return ST.simulate_strong(D.transitions(spark, d), TRIANGLE, strict=True)


@query(strong_sql(D.SESSIONS_SQL, PATH, False))
def sim_strong_path(spark: SparkSession, d: str) -> DataFrame:
    """Balls of radius 2 around the events of sessions, most of which the pattern doesn't fill."""
    return ST.simulate_strong(D.sessions(spark, d), PATH)


BOUNDED = Pattern.labelled(["view", "click", "signup", "error"], [(0, 1), (1, 2), (2, 3), (0, 3)])
BOUNDS = [1, 2, 3, BS.ANY]


def bounded_sql(tables: str, pattern: Pattern, bounds: list[int | None], rounds: int = ROUNDS) -> str:
    """Pairs within each bound, and the fixpoint over them; bound 0 stands for any length."""
    finite = sorted({k for k in bounds if k is not None})
    needs: dict[int, list[int]] = {}
    for (s, t), k in zip(pattern.edges, bounds, strict=True):
        needs.setdefault(k or 0, [0] * len(pattern.nodes))[s] |= 1 << t
    joins = "".join(f" LEFT JOIN (SELECT w.a, bit_or(c.mask) AS cm FROM w JOIN s c ON c.id = w.b WHERE w.k = {k} GROUP BY 1) k{k} ON k{k}.a = p.id" for k in needs)
    kept = " + ".join(f"CASE WHEN p.mask & {1 << q} > 0" + "".join(f" AND coalesce(k{k}.cm, 0) & {need[q]} = {need[q]}" for k, need in needs.items() if need[q]) + f" THEN {1 << q} ELSE 0 END" for q in range(len(pattern.nodes)))
    full = (1 << len(pattern.nodes)) - 1
    return f"""WITH RECURSIVE {tables.strip()},
g AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
h(a, b, n) AS (SELECT src, dst, 1 FROM g UNION SELECT h.a, g.dst, h.n + 1 FROM h JOIN g ON g.src = h.b WHERE h.n < {max([*finite, 1])}),
f(a, b) AS (SELECT src, dst FROM g UNION SELECT f.a, g.dst FROM f JOIN g ON g.src = f.b),
w AS MATERIALIZED (SELECT DISTINCT a, b, k FROM h, (VALUES {", ".join(f"({k})" for k in finite)}) x(k) WHERE n <= k{" UNION ALL SELECT a, b, 0 FROM f" if 0 in needs else ""}),
s(r, id, mask) AS (
  SELECT 0, id, ({_start_sql(pattern)})::BIGINT FROM v WHERE id IN (SELECT src FROM g UNION SELECT dst FROM g)
  UNION ALL
  SELECT p.r + 1, p.id, ({kept})::BIGINT FROM s p{joins} WHERE p.r < {rounds})
SELECT q::INTEGER AS q, id FROM s, range({len(pattern.nodes)}) n(q) WHERE r = {rounds} AND mask & (1::BIGINT << q::INTEGER) > 0 AND (SELECT bit_or(mask) FROM s WHERE r = {rounds}) = {full}"""


@query(bounded_sql(D.TRANSITIONS_SQL, BOUNDED, BOUNDS))
def sim_bounded(spark: SparkSession, d: str) -> DataFrame:
    return BS.simulate_bounded(D.transitions(spark, d), BOUNDED, BOUNDS)


FAR_PATH = Pattern.labelled(["signup", "purchase", "error", "view"], [(0, 1), (1, 2), (0, 3), (3, 2)])
FAR_BOUNDS = [2, BS.ANY, 3, 1]


@query(bounded_sql(D.SESSIONS_SQL, FAR_PATH, FAR_BOUNDS))
def sim_bounded_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Where paths are long and nothing leads back."""
    return BS.simulate_bounded(D.sessions(spark, d), FAR_PATH, FAR_BOUNDS)


#: Twenty patterns: chains, cycles, a star, and some that nothing matches, 70 query nodes in all.
TWENTY = [
    PATH, TRIANGLE, TWO_CYCLE, DIAMOND,
    *(Pattern.labelled([a, b, c], [(0, 1), (1, 2)]) for a, b, c in (("view", "view", "click"), ("click", "error", "error"), ("error", "signup", "view"), ("purchase", "purchase", "purchase"))),
    *(Pattern.labelled([a, b, c, a], [(0, 1), (1, 2), (2, 3)]) for a, b, c in (("view", "click", "error"), ("signup", "view", "purchase"), ("click", "click", "error"))),
    *(Pattern.labelled([a, b, c, d], [(0, 1), (0, 2), (0, 3)]) for a, b, c, d in (("view", "click", "error", "signup"), ("error", "view", "purchase", "click"))),
    *(Pattern.labelled([a, b, c], [(0, 1), (1, 2), (2, 1)]) for a, b, c in (("view", "click", "signup"), ("error", "purchase", "view"))),
    *(Pattern.labelled([a, "no such label"], [(0, 1)]) for a in ("view", "error")),
    Pattern.labelled(["signup"], []),
    Pattern.labelled(["e", "i", "u", "ch", "r"], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)]),
    Pattern.labelled(["view", "click", "error", "signup", "purchase", "view"], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)]),
]


def many_sql(tables: str, patterns: list[Pattern], rounds: int = ROUNDS) -> str:
    """One recursion for each pattern."""
    parts, ctes = [], []
    for p, x in enumerate(patterns):
        full = (1 << len(x.nodes)) - 1
        ctes.append(f"""s{p}(r, id, mask) AS (
  SELECT 0, id, ({_start_sql(x)})::BIGINT FROM v WHERE id IN (SELECT src FROM g UNION SELECT dst FROM g)
  UNION ALL
  SELECT p.r + 1, p.id, ({_kept_sql(x, False)})::BIGINT FROM s{p} p LEFT JOIN (SELECT g.src, bit_or(c.mask) AS cm FROM g JOIN s{p} c ON c.id = g.dst GROUP BY 1) k ON k.src = p.id WHERE p.r < {rounds})""")
        parts.append(f"SELECT {p} AS pattern, q::INTEGER AS q, id FROM s{p}, range({len(x.nodes)}) n(q) WHERE r = {rounds} AND mask & (1::BIGINT << q::INTEGER) > 0 AND (SELECT bit_or(mask) FROM s{p} WHERE r = {rounds}) = {full}")
    return f"WITH RECURSIVE {tables.strip()},\ng AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE src <> dst),\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


@query(many_sql(D.TRANSITIONS_SQL, TWENTY))
def sim_many(spark: SparkSession, d: str) -> DataFrame:
    """Twenty patterns in one fixpoint, over words of two longs a vertex."""
    return MP.simulate_many(D.transitions(spark, d), TWENTY)


@query(many_sql(D.SESSIONS_SQL, TWENTY, 40))
def sim_many_sessions(spark: SparkSession, d: str) -> DataFrame:
    return MP.simulate_many(D.sessions(spark, d), TWENTY)


#: Needles of all lengths: none, characters, whole words, long ones, some that nothing has, signs of patterns, other letters.
NEEDLES = ["the", "a", "zq", "Licensed under the Apache License", "erst", "é", "%", "idiot", "no such needle at all", "</article>", "\n", "schö", "a\nb", "<p>"]


def _search_sql(needles: list[str]) -> str:
    values = ", ".join(f"({i}, '{n}')" if "\n" not in n else f"({i}, '" + n.replace("\n", "' || chr(10) || '") + "')" for i, n in enumerate(needles))
    return f"WITH n(needle, s) AS (VALUES {values}) SELECT 'documents' AS origin, needle, doc_id AS id FROM documents, n WHERE contains(text, s) UNION ALL SELECT 'pages', needle, page_id FROM pages, n WHERE contains(html, s)"


@query(_search_sql(NEEDLES))
def label_search(spark: SparkSession, d: str) -> DataFrame:
    """All texts and pages that contain each needle, by indexes of both tables."""
    docs = L.LabelIndex.build(D.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text")
    pages = L.LabelIndex.build(D.read(spark, d, "pages").select(F.col("page_id").alias("id"), "html"), "html")
    found = [x.search(NEEDLES).select(F.lit(n).alias("origin"), "needle", "id") for n, x in (("documents", docs), ("pages", pages))]
    return reduce(DataFrame.unionByName, found)


PART_NAMES = Pattern(({"name": "BUILD", "kind": 0}, {"name": "URGENT"}, {"kind": 2, "name": "Brand#1"}, {"kind": 3}, {"name": "A"}), ())


@query(f"WITH {D.COMMERCE_SQL}, k AS (SELECT id, label, id % 8 AS kind FROM v) " + " UNION ALL ".join(f"SELECT {q} AS q, id FROM k WHERE {c}" for q, c in enumerate(["contains(label, 'BUILD') AND kind = 0", "contains(label, 'URGENT')", "contains(label, 'Brand#1') AND kind = 2", "kind = 3", "contains(label, 'A')"])))
def candidates_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a pattern by the index of the vertices' labels."""
    g = D.commerce(spark, d)
    g = Graph(g.vertices.select("id", F.col("label").alias("name"), (F.col("id") % 8).cast("int").alias("kind")), g.edges)
    return L.indexed_candidates(g, PART_NAMES, {"name": L.LabelIndex.build(g.vertices, "name")})


INCREMENTAL = Pattern.labelled(["view", "click", "signup", "error"], [(0, 1), (1, 2), (2, 0), (2, 3)])
#: Edges that are there after each batch: before, an insertion, a deletion, an insertion.
STATES = ["(src * 7 + dst) % 9 < 1", "(src * 7 + dst) % 9 < 2", "(src * 7 + dst) % 9 = 1", "(src * 7 + dst) % 9 BETWEEN 1 AND 3"]


def _incremental_sql() -> str:
    parts, ctes = [], []
    full = (1 << len(INCREMENTAL.nodes)) - 1
    for k, state in enumerate(STATES):
        ctes.append(f"g{k} AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE src <> dst AND {state})")
        ctes.append(f"""s{k}(r, id, mask) AS (SELECT 0, id, ({_start_sql(INCREMENTAL)})::BIGINT FROM v WHERE id IN (SELECT src FROM g{k} UNION SELECT dst FROM g{k})
  UNION ALL
  SELECT p.r + 1, p.id, ({_kept_sql(INCREMENTAL, False)})::BIGINT FROM s{k} p LEFT JOIN (SELECT g.src, bit_or(c.mask) AS cm FROM g{k} g JOIN s{k} c ON c.id = g.dst GROUP BY 1) k ON k.src = p.id WHERE p.r < 40)""")
        parts.append(f"SELECT {k} AS batch, q::INTEGER AS q, id FROM s{k}, range(4) n(q) WHERE r = 40 AND mask & (1::BIGINT << q::INTEGER) > 0 AND (SELECT bit_or(mask) FROM s{k} WHERE r = 40) = {full}")
    return f"WITH RECURSIVE {D.TRANSITIONS_SQL.strip()},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(parts)


@query(_incremental_sql())
def sim_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Matches after each of three batches of edges, and before, none of them matched anew."""
    from graphloom.operators.incremental import IncrementalMatch
    from graphloom.runtime import table

    g = D.transitions(spark, d)
    edges = table(g.edges, "transitions")
    at = lambda k: edges.where(STATES[k])
    m = IncrementalMatch(Graph(g.vertices, at(0)), INCREMENTAL)
    found = []
    for k in range(len(STATES)):
        if k:
            (m.delete if k == 2 else m.insert)(at(k - 1).join(at(k), ["src", "dst"], "left_anti") if k == 2 else at(k))
        found.append(table(m.matches().select(F.lit(k).alias("batch"), "q", "id"), "matches"))
    return reduce(DataFrame.unionByName, found)


# --- arrays, cuts, filters ---------------------------------------------------------------------------------------------------


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority || ', \"' || o_orderstatus || ']' END AS priority, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS customer FROM orders")
def parse_attributes_array(spark: SparkSession, d: str) -> DataFrame:
    """All orders as one JSON array on one line, with commas, quotes and brackets in strings, as a reader gets it that cuts at commas."""
    from graphloom.runtime import in_order
    from graphloom.sources import readers as R

    o = in_order(D.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"), "o_orderkey")
    said = F.concat(F.col("o_orderpriority"), F.lit(', "'), F.col("o_orderstatus"), F.lit("]"))
    element = F.when(F.col("o_orderkey") % 11 == 0, F.lit("null")).otherwise(F.to_json(F.struct(said.alias("p"), F.array(F.array("o_custkey"), F.array(F.lit(0))).alias("c"))))
    last = o.agg(F.max("index")).first()[0]
    text = F.concat(F.when(F.col("index") == 0, F.lit("[")).otherwise(F.lit("")), element, F.when(F.col("index") == F.lit(last), F.lit("]")).otherwise(F.lit("")))
    rows = o.select("index", F.posexplode(F.split(text, ",")).alias("k", "value"))
    fragments = rows.select(F.lit("f").alias("file"), F.floor(F.col("index") / 700).alias("block"), (F.col("index") * 100 + F.col("k")).alias("at"), "value")
    attrs = F.parse_json("value")
    out = R.array_elements(fragments).select(F.col("n").cast("long").alias("id"), attrs.alias("a"))
    return out.select("id", F.try_variant_get("a", "$.p", "string").alias("priority"), F.try_variant_get("a", "$.c[0][0]", "long").alias("customer"))


CUTS = 7


def _cut_sql(edges: str, shards: int) -> str:
    """Each shard from the one before it: where the running sum has reached what it should hold."""
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT dst, sum(count(*)) OVER (ORDER BY dst)::BIGINT AS running FROM ({edges}) GROUP BY dst),
a AS (SELECT count(*)::BIGINT AS total, max(greatest(src, dst)) AS most FROM ({edges})),
c(shard, first, last, before, after) AS (
  SELECT 0, 0::BIGINT, (SELECT min(dst) FROM t WHERE running >= total // {shards} + 1), 0::BIGINT, coalesce((SELECT min(running) FROM t WHERE running >= total // {shards} + 1), total) FROM a
  UNION ALL
  SELECT shard + 1, last + 1, (SELECT min(dst) FROM t WHERE running >= c.after + (total - c.after) // ({shards} - 1 - shard)), c.after, (SELECT min(running) FROM t WHERE running >= c.after + (total - c.after) // ({shards} - 1 - shard)) FROM c, a WHERE c.after < total)
SELECT shard, first, CASE WHEN after = total THEN most ELSE last END AS last, after - before AS n_edges FROM c, a"""


@query(_cut_sql("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey", CUTS))
def balanced_cut(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.operators import analytics as A

    e = D.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).where("src <> dst")
    return A.balanced_cut(e, CUTS)


_H = "(('0x' || substr(md5('{i}:' || id), 1, 15))::BIGINT)"
# Keys a block of 512 bits, on average, and bits a key: filters grow with their keys.
_BLOOM_KEYS, _BLOOM_BITS = 32, 10
_BLOOM_FIRST, _BLOOM_SECOND = "id % 5 = 0", "id % 7 < 2"


def _bloom_sql() -> str:
    bit = lambda i: f"1::UBIGINT << ({_H.format(i=i + 1)} % 64)"
    words = [" | ".join(f"({bit(i)})" for i in range(_BLOOM_BITS) if i % 8 == w) for w in range(8)]
    placed = lambda t: f"SELECT id, {_H.format(i=0)} % blocks AS block, {', '.join(f'{x} AS b{w}' for w, x in enumerate(words))} FROM {t}"
    built = lambda c: f"SELECT block, {', '.join(f'bit_or(b{w}) AS w{w}' for w in range(8))} FROM p WHERE {c} GROUP BY block"
    has = lambda f: "coalesce(" + " AND ".join(f"{f}.w{w} & b{w} = b{w}" for w in range(8)) + ", false)"
    joined = lambda op: " AND ".join(f"{op(f'coalesce(f.w{w}, 0)', f'coalesce(g.w{w}, 0)')} & b{w} = b{w}" for w in range(8))
    return f"""WITH k AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), s AS (SELECT count(*) // {_BLOOM_KEYS} + 1 AS blocks FROM k WHERE {_BLOOM_FIRST} OR {_BLOOM_SECOND}),
p AS MATERIALIZED ({placed("k, s")}), f AS ({built(_BLOOM_FIRST)}), g AS ({built(_BLOOM_SECOND)})
SELECT id, {has("f")} AS in_first, {joined(lambda a, b: f"({a} | {b})")} AS in_either, {joined(lambda a, b: f"({a} & {b})")} AS in_both, {joined(lambda a, b: f"xor({a}, {b})")} AS in_one
FROM p LEFT JOIN f USING (block) LEFT JOIN g USING (block)"""


@query(_bloom_sql())
def bloom_blocked(spark: SparkSession, d: str) -> DataFrame:
    """What filters of some orders, and combinations of them, say of all orders, false positives and all: by a hash that SQL has too."""
    from graphloom.operators import sets as B
    from graphloom.runtime import table

    ids = table(D.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct(), "orders")
    blocks = ids.where(f"{_BLOOM_FIRST} OR {_BLOOM_SECOND}").count() // _BLOOM_KEYS + 1
    empty = B.BlockedBloom(spark, blocks, _BLOOM_BITS, hasher=B.md5_hash)
    f, g = empty.insert(ids.where(_BLOOM_FIRST)), empty.insert(ids.where(_BLOOM_SECOND))
    return empty.contains_each(ids, {"in_first": f, "in_either": f | g, "in_both": f & g, "in_one": f ^ g})


@query("SELECT DISTINCT ON (src, dst) src, dst, line, quantity FROM (SELECT l_partkey AS src, l_suppkey % 3 AS dst, l_orderkey * 8 + l_linenumber AS line, l_quantity AS quantity FROM lineitem) ORDER BY src, dst, quantity DESC, line")
def fold_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Of all lines of a part and a third of the suppliers, the first in order of those of the largest quantity: an ordered filter."""
    from graphloom.operators import analytics as A

    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = D.read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") % 3).alias("dst"), line.alias("line"), F.col("l_quantity").alias("quantity"))
    return A.fold_duplicates(lines, lambda a, b: a["quantity"] >= b["quantity"], ["line"])


class _Runs:
    """Runs of neighbours whose ids rise by at most ten."""

    def __init__(self) -> None:
        self.first = self.last = self.src = None
        self.n = 0

    def edge(self, row):
        if self.last is not None and row.dst > self.last + 10:
            yield self.src, self.first, self.last, self.n
            self.first, self.n = None, 0
        self.first = row.dst if self.first is None else self.first
        self.src, self.last, self.n = row.src, row.dst, self.n + 1

    def end(self):
        yield self.src, self.first, self.last, self.n


@query(f"""WITH {D.TRANSITIONS_SQL}, s AS (SELECT src, dst, CASE WHEN dst <= lag(dst) OVER w + 10 THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS (PARTITION BY src ORDER BY dst)),
r AS (SELECT src, dst, sum(starts) OVER (PARTITION BY src ORDER BY dst) AS run FROM s) SELECT src AS id, min(dst) AS first, max(dst) AS last, count(*) AS n FROM r GROUP BY src, run""")
def emit_udtf(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each vertex's neighbours, emitted by a table function that gets them one after the other."""
    from graphloom.operators import programs as P

    return P.emit_rows(D.transitions(spark, d).edges, _Runs, "id long, first long, last long, n long")


@query("SELECT user_id AS id, min(event_id) AS first, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id")
def state_stream(spark: SparkSession, d: str) -> DataFrame:
    """What events say of their users, kept in a state store over a stream that stops halfway and is started again."""
    from graphloom.runtime import new_path
    from graphloom.streaming.state import VertexState

    folder = new_path(spark, "state")
    events = D.read(spark, d, "events").select(F.col("event_id").alias("src"), F.col("user_id").alias("dst"), "value")
    kept = VertexState(spark, f"{folder}/values")
    for k in (0, 1):
        events.where(F.col("src") % 2 == k).repartition(2).write.mode("append").parquet(f"{folder}/edges")
        stream = spark.readStream.schema("src long, dst long, value double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/edges")
        kept.follow(stream, f"{folder}/checkpoint", {"first": F.min("src"), "n": F.count("*"), "total": F.sum("value")}).awaitTermination()
    return kept.values()


@query(f"WITH RECURSIVE {D.TRANSITIONS_SQL}, r(a, b) AS (SELECT DISTINCT id, id FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT b AS id, min(a) AS value FROM r GROUP BY b")
def kernel_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The least id that leads to each user, by blocks that are each run until they settle."""
    from graphloom.operators import blocks as K

    edges = D.transitions(spark, d).edges
    return K.run_blocks(edges, F.col("id"), K.BlockKernel(lambda v: v), block_edges=2000)
