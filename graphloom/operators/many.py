"""Many patterns in one fixpoint.

Each query node of each pattern is a bit; a vertex holds as many words of 63 bits as that takes. A round joins the edges once with
the words of all patterns that are not done. A pattern is done when a round has changed nothing of it, after as many rounds as its
longest path has edges if it has no cycle, or when one of its query nodes has no vertex left; its bits are then taken out, and vertices
without bits go.

What a round asks of a row is a few shifts for all query nodes together, not a test for each: the JVM does not compile methods of over
8,000 bytes, and tests of 66 nodes made one of 14,866.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import node_matches
from graphloom.model import RESERVED, Graph, Pattern
from graphloom.operators.simulate import _between, _Edges, _reversed
from graphloom.runtime import table

WORD = 63
#: So few edges are joined as they are, as dealing those that are left anew takes longer than a round.
FEW = 1_000_000


class Layout:
    """Where the query nodes of patterns stand in the words."""

    def __init__(self, patterns: list[Pattern]) -> None:
        self.patterns = patterns
        self.first = [sum(len(p.nodes) for p in patterns[:i]) for i in range(len(patterns))]
        self.nodes = [(p, q) for p, x in enumerate(patterns) for q in range(len(x.nodes))]
        self.words = max(1, -(-len(self.nodes) // WORD))

    def place(self, pattern: int, q: int) -> tuple[int, int]:
        """(word, bit)"""
        return divmod(self.first[pattern] + q, WORD)

    def masks(self, nodes: list[tuple[int, int]]) -> list[int]:
        """One mask a word with the bits of nodes (pattern, q)."""
        out = [0] * self.words
        for p, q in nodes:
            w, b = self.place(p, q)
            out[w] |= 1 << b
        return out

    def of(self, pattern: int) -> list[int]:
        return self.masks([(pattern, q) for q in range(len(self.patterns[pattern].nodes))])


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _word(w: int) -> str:
    return f"w{w}"


def _any(words: int) -> Column:
    return reduce(lambda a, b: a | b, (F.col(_word(w)) != 0 for w in range(words)))


def start_words(graph: Graph, layout: Layout) -> DataFrame:
    """(id, words): candidates of all query nodes. A predicate that several have is evaluated once."""
    same: dict[str, tuple[dict, list[tuple[int, int]]]] = {}
    for p, q in layout.nodes:
        node = {k: v for k, v in layout.patterns[p].nodes[q].items() if k not in RESERVED}
        same.setdefault(repr(sorted(node.items(), key=lambda kv: kv[0])), (node, []))[1].append((p, q))
    found = graph.vertices.select("id", *(node_matches(graph, node).alias(f"p{i}") for i, (node, _) in enumerate(same.values())))
    masks = [layout.masks(nodes) for _, nodes in same.values()]
    words = [reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"p{i}"), _long(m[w])).otherwise(_long(0)) for i, m in enumerate(masks) if m[w]), _long(0)).alias(_word(w)) for w in range(layout.words)]
    return found.where(reduce(lambda a, b: a | b, (F.col(f"p{i}") for i in range(len(masks))))).select("id", *words)


def longest_path(pattern: Pattern) -> int | None:
    """Edges of a pattern's longest path; None if it has a cycle. So many rounds settle it, as a node waits for its children alone."""
    height = [0] * len(pattern.nodes)
    for _ in pattern.nodes:
        last = list(height)
        for s, t in pattern.edges:
            height[s] = max(height[s], last[t] + 1)
        if height == last:
            return max(height)
    return None


def _shifted(word: Column, by: int) -> Column:
    return F.shiftright(word, by) if by > 0 else F.shiftleft(word, -by) if by else word


def surviving_words(layout: Layout, reverse: bool = False) -> list[Column]:
    """Words w0, w1, … without the bits whose needs are not all in b0, b1, … (null: no bits).

    Edges of all patterns whose ends are as far apart, in the same words, are one shift. Patterns that are done have no bits left to test.
    """
    apart: dict[tuple[int, int, int], int] = {}
    for p, x in enumerate(layout.patterns):
        for edge in x.edges:
            (w, b), (v, c) = (layout.place(p, q) for q in (edge[::-1] if reverse else edge))
            apart[w, v, c - b] = apart.get((w, v, c - b), 0) | 1 << b
    out = [F.col(_word(w)) for w in range(layout.words)]
    for (w, v, by), sources in sorted(apart.items()):
        out[w] = out[w].bitwiseAND(_shifted(F.coalesce(f"b{v}", _long(0)), by).bitwiseOR(_long(~sources)))
    return out


def _round(state: DataFrame, edges: _Edges, layout: Layout, reverse: bool = False) -> DataFrame:
    """A round on state (id, words, and what they were as o0, o1, …); vertices without bits stay for what they were."""
    ors = [F.bit_or(_word(w)).alias(f"b{w}") for w in range(layout.words)]
    below = edges.joined(state.where(_any(layout.words)).select("id", *map(_word, range(layout.words)))).groupBy("src").agg(*ors)
    words = [x.alias(_word(w)) for w, x in enumerate(surviving_words(layout, reverse))]
    return state.join(below, state.id == below.src, "left").select("id", *words, *(f"o{w}" for w in range(layout.words)))


def _told(state: DataFrame, layout: Layout) -> tuple[list[int], list[int], int]:
    """(bits of all words that some vertex has lost, bits that some vertex has, vertices that have any)."""
    words = range(layout.words)
    ors = [F.coalesce(F.bit_or(x), _long(0)) for x in (*(F.col(f"o{w}").bitwiseAND(F.bitwise_not(_word(w))) for w in words), *map(_word, words))]
    row = state.agg(F.count_if(_any(layout.words)), *ors).first()
    return list(row[1 : 1 + layout.words]), list(row[1 + layout.words :]), row[0]


def _cleared(state: DataFrame, layout: Layout, keep: list[int]) -> DataFrame:
    """(id, words) of state without the bits of patterns that are not to be kept."""
    kept = layout.masks([(p, q) for p in keep for q in range(len(layout.patterns[p].nodes))])
    return state.select("id", *(F.col(_word(w)).bitwiseAND(_long(kept[w])).alias(_word(w)) for w in range(layout.words))).where(_any(layout.words))


def _matches(state: DataFrame, layout: Layout, patterns: list[int]) -> DataFrame:
    """(pattern, q, id) of the given patterns."""
    names = ((p, q, *layout.place(p, q)) for p in patterns for q in range(len(layout.patterns[p].nodes)))
    nodes = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(q).alias("q"), *(_long(1 << b if v == w else 0).alias(f"m{v}") for v in range(layout.words))) for p, q, w, b in names))
    found = _cleared(state, layout, patterns).withColumn("n", F.explode(nodes))
    held = (F.col(_word(w)).bitwiseAND(F.col(f"n.m{w}")) != 0 for w in range(layout.words))
    return found.where(reduce(lambda a, b: a | b, held)).select("n.pattern", "n.q", "id")


def simulate_many(graph: Graph, patterns: list[Pattern], *, include_isolated: bool = False, max_rounds: int | None = None, dual: bool = False, history: list[dict] | None = None) -> DataFrame:
    """(pattern, q, id): simulate() of each pattern, by its place in the list. Patterns may be of any size and number.

    history, where given, gets a dict a round: how many patterns took part, and how many are then done or without a match.
    """
    layout = Layout(patterns)
    active = [p for p, x in enumerate(patterns) if x.nodes]
    simple = source = graph.simple().persist()
    state = start_words(graph, layout) if active else graph.vertices.select("id", _long(0).alias(_word(0))).where(F.lit(False))
    # Only query nodes without edges can match a vertex without any: others need a child.
    if not include_isolated and any(0 in patterns[p].out_degrees() for p in active):
        touched = simple.select(F.col("src").alias("id")).union(simple.select(F.col("dst").alias("id")))
        state = state.join(touched, "id", "left_semi")
    was = [F.col(_word(w)).alias(f"o{w}") for w in range(layout.words)]
    held = table(state, "words")
    _, union, size = _told(held.select("*", *was), layout)
    changed = [-1] * layout.words
    # With parents to wait for, too, only a round without changes tells.
    after = [None if dual and x.edges else longest_path(x) for x in patterns]
    done: list[DataFrame] = []
    dealt: list[_Edges] = []
    size_then, rounds = size, 0
    while True:
        lost = [p for p in active if any(m & ~union[w] for w, m in enumerate(layout.of(p)))]
        settled = [p for p in active if p not in lost and (rounds == after[p] or not any(m & changed[w] for w, m in enumerate(layout.of(p))))]
        if settled:
            done.append(_matches(held, layout, settled))
        if history is not None:
            history.append({"patterns": len(active), "settled": len(settled), "lost": len(lost), "vertices": size})
        active = [p for p in active if p not in lost and p not in settled]
        if not active:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        held = _cleared(held, layout, active)
        if lost or settled:
            size = held.count()
        if not dealt or (2 * size < size_then and dealt[0].total > FEW):
            old, size_then = dealt, size
            if dealt:
                simple = table(_between(simple, held), "edges")
            dealt = [_Edges(simple)] + ([_Edges(_reversed(simple))] if dual else [])
            for x in old:
                x.unpersist()
        new = _round(held.select("*", *was), dealt[0], layout)
        if dual:
            new = _round(new, dealt[1], layout, reverse=True)
        held = table(new, "words")
        rounds += 1
        changed, union, size = _told(held, layout)
    for x in (source, *dealt):
        x.unpersist()
    if not done:
        return graph.vertices.select(F.lit(0).alias("pattern"), F.lit(0).alias("q"), "id").where(F.lit(False))
    return reduce(DataFrame.unionByName, done)
