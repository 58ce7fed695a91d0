"""N-gram Jaccard join: near copies by word shingles, filtered under several global orders of the shingles.

1. Each document's set of shingle hashes is made; which of its shingles another document has too is asked of buckets (see
   _shared). A document with fewer than `similarity` of its shingles shared is linked with nothing and goes no further. Documents
   with equal sets are one class, of which only the smallest id goes on.
2. In a global order the unshared shingles come first. A link needs a common shingle in both prefixes, whatever the order of
   the rest, so documents are grouped by chains of common prefix shingles under a first order, groups over REFINE documents are
   split by those under the order that has a group's rarest shingles first, and all groups by those under further orders.
3. Within a group, pairs whose prefixes meet under all orders are verified by their exact overlap, taken for blocks of documents at
   once. Groups over BLOCK documents are split into blocks: each is compared with itself and with PIVOTS documents of the whole
   group, which joins nearly all of a group of near copies into one class. What is not in a group's largest class is then
   compared with all of the group. Only spanning links leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import cut, join_by_weight, mix, powers, prefix_hash
from graphloom.llm._components import components
from graphloom.llm._shared import ANSWER, META, distinct, shared_hashes, unpack48

WORDS = 5
#: Link at PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Documents of a block, and shingles of each on average, at most; documents of a group that all its blocks are compared with.
BLOCK, BLOCK_SHINGLES, PIVOTS = 2048, 512, 64
#: Groups of more documents are split by the order that has their rarest shingles first.
REFINE = 200
ORDERS = 3
#: Shingles held by so many documents of a block are multiplied as dense columns.
DENSE = 32
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of rows of text and their rows; a shorter row has one of all its words."""
    data = _LOWER[data]
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    mask = ~_SPACE[data]
    change = np.zeros(n + 1, bool)
    change[1:n] = mask[1:] != mask[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    inside = mask[at[:-1]]
    starts, ends = at[:-1][inside], at[1:][inside]
    c = prefix_hash(data)
    words = mix((c[ends] - c[starts]) * powers(n + 1)[1][starts])
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    h = words.copy()
    for i in range(1, k):
        h[: len(h) - i] = h[: len(h) - i] * _U(0x9E3779B97F4A7C15) + words[i:] if i < len(h) else h[: len(h) - i]
    row = np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(words)) - first[row] <= count[row] - k
    out_h, out_row = [mix(h[whole] + _U(k))], [row[whole]]
    for r in np.flatnonzero((count > 0) & (count < k)):
        x = 0
        for w in words[first[r] : first[r + 1]].tolist():
            x = (x * 0xD6E8FEB86659FD93 + w) & (1 << 64) - 1
        out_h.append(mix(np.array([(x + int(count[r])) & (1 << 64) - 1], _U)))
        out_row.append(np.array([r]))
    return np.concatenate(out_h), np.concatenate(out_row)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of each row, and the size and a digest of each row's set."""
    h, row = shingles(data, offsets)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
    h, row = h[new], row[new]
    at = np.searchsorted(row, np.arange(len(offsets)))
    told = [int(b - a).to_bytes(8, "big") + (hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else b"") for a, b in zip(at[:-1], at[1:], strict=True)]
    return h, row, told


def least_shared(n: int | np.ndarray, percent: int = PERCENT):
    """How many of n shingles a partner must have at the least."""
    return -(-percent * n // 100)


def keys(h: np.ndarray, order: int) -> np.ndarray:
    """Hashes as numbers that give the place in a global order."""
    if order == 0:
        return h
    if order == 1:
        return ~h
    return mix(h * _U(2 * order + 1) + _U(order))


def prefix(h: np.ndarray, n: int, order: int, percent: int = PERCENT) -> np.ndarray:
    """The shared shingles in the prefix of a set of n under an order that has the unshared ones first."""
    size = len(h) - least_shared(n, percent) + 1
    return h[np.argpartition(keys(h, order), size - 1)[:size]] if 0 < size < len(h) else h[: max(size, 0)]


def overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of common elements of each set of a and each of b."""
    ta, tb = np.concatenate([*a, np.zeros(0, _U)]), np.concatenate([*b, np.zeros(0, _U)])
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    token, index = np.unique(np.concatenate([ta, tb]), return_inverse=True)
    ia, ib = index[: len(ta)], index[len(ta) :]
    ca, cb = np.bincount(ia, minlength=len(token)), np.bincount(ib, minlength=len(token))
    out = np.zeros((len(a), len(b)), np.int32)
    dense = np.flatnonzero((ca > 0) & (cb > 0) & (np.maximum(ca, cb) >= DENSE))
    place = np.full(len(token), -1)
    place[dense] = np.arange(len(dense))
    for s in range(0, len(dense), 1024):
        w = min(1024, len(dense) - s)
        x, y = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        for m, rows, i in ((x, ra, ia), (y, rb, ib)):
            p = place[i] - s
            own = (p >= 0) & (p < w)
            m[rows[own], p[own]] = 1
        out += (x @ y.T).astype(np.int32)
    thin = (ca > 0) & (cb > 0) & (place < 0)
    ka, kb = np.flatnonzero(thin[ia]), np.flatnonzero(thin[ib])
    if len(ka):
        kb = kb[np.argsort(ib[kb], kind="stable")]
        begin = np.searchsorted(ib[kb], ia[ka])
        times = cb[ia[ka]]
        for s in range(0, len(ka), 100_000):
            t = times[s : s + 100_000]
            left = np.repeat(ra[ka[s : s + 100_000]], t)
            right = rb[kb[np.arange(t.sum()) + np.repeat(begin[s : s + 100_000] - np.cumsum(t) + t, t)]]
            out += np.bincount(left * len(b) + right, minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def linked(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> np.ndarray:
    """Which sets (size, shared shingles) of a link with which of b: filters of all orders, then the exact overlap."""
    na, nb = np.array([x for x, _ in a]), np.array([x for x, _ in b])
    ok = np.ones((len(a), len(b)), bool)
    for order in range(ORDERS):
        ok &= overlap([prefix(h, n, order, percent) for n, h in a], [prefix(h, n, order, percent) for n, h in b]) > 0
    rows, cols = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    if len(rows):
        both = overlap([a[i][1] for i in rows], [b[j][1] for j in cols])
        union = na[rows][:, None] + nb[cols][None] - both
        ok[np.ix_(rows, cols)] &= 100 * both.astype(np.int64) >= percent * union
    return ok


def forest(ids_a: np.ndarray, ids_b: np.ndarray, link: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spanning links of the graph between ids_a and ids_b, found breadth first over the rows and columns of link."""
    left_a, left_b = link.any(axis=1), link.any(axis=0)
    while left_a.any():
        i = int(np.argmax(left_a))
        front_a = np.array([i])
        left_a[i] = False
        while len(front_a):
            hit = link[front_a] & left_b
            cols = np.flatnonzero(hit.any(axis=0))
            if not len(cols):
                break
            yield from zip(ids_a[front_a[hit[:, cols].argmax(axis=0)]].tolist(), ids_b[cols].tolist(), strict=True)
            left_b[cols] = False
            hit = link[:, cols] & left_a[:, None]
            front_a = np.flatnonzero(hit.any(axis=1))
            yield from zip(ids_a[front_a].tolist(), ids_b[cols[hit[front_a].argmax(axis=1)]].tolist(), strict=True)
            left_a[front_a] = False


def chains(sets: list[tuple[int, np.ndarray]], order: int, percent: int = PERCENT) -> list[list[int]]:
    """Sets grouped by chains of common prefix shingles under an order."""
    up = list(range(len(sets)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first: dict[int, int] = {}
    for i, (n, h) in enumerate(sets):
        for t in prefix(h, n, order, percent).tolist():
            j = first.setdefault(t, i)
            if j != i:
                up[find(i)] = find(j)
    out: dict[int, list[int]] = {}
    for i in range(len(sets)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def group_links(ids: np.ndarray, sets: list[tuple[int, np.ndarray]], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Spanning links of one group of at most a block."""
    todo = [list(range(len(ids)))]
    for order in range(1, ORDERS):
        todo = [[g[i] for i in part] for g in todo if len(g) > 1 for part in chains([sets[i] for i in g], order, percent)]
    for g in todo:
        if len(g) > 1:
            own = [sets[i] for i in g]
            yield from ((a, b) for a, b in forest(ids[g], ids[g], linked(own, own, percent)) if a != b)


def candidates(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(about: doc_id, n, digest of each row; sets: doc_id, n, shared of one document of each class that may link)."""
    told = cut(shared_hashes(docs, shingle_sets), "shared-shingles")
    about = told.where(F.col("kind") == META).select("doc_id", F.conv(F.hex(F.substring("blob", 1, 8)), 16, 10).cast("long").alias("n"), F.expr("substring(blob, 9)").alias("digest"))
    return about, told


def _sets(told: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, shared) of the classes' representatives of whose shingles enough are shared."""
    answers = told.where(F.col("kind") == ANSWER).groupBy("doc_id").agg(F.collect_list("blob").alias("blobs"))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("shared", pa.binary())])

    def join(batches):
        for batch in batches:
            out = []
            for doc, n, blobs in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["blobs"], strict=True):
                blobs = blobs.as_py()
                if sum(map(len, blobs)) // 6 < least_shared(n, percent):
                    continue
                h = distinct(unpack48(b"".join(blobs)))
                if len(h) >= least_shared(n, percent):
                    out.append((doc, n, h.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return classes.join(answers, "doc_id").select("doc_id", "n", "blobs").mapInArrow(join, "doc_id long, n long, shared binary")


def _postings(sets: DataFrame, pick: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(g, t, doc_id, n): a row for each shingle that pick takes of a set (g, doc_id, n, shared)."""
    schema = pa.schema([("g", pa.int64()), ("t", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def emit(batches):
        held, size = [], 0
        for batch in batches:
            for g, doc, n, shared in zip(*(batch[c].to_pylist() for c in ("g", "doc_id", "n", "shared")), strict=True):
                t = pick(np.frombuffer(shared, _U), n).astype(np.int64)
                held.append((t, g, doc, n))
                size += len(t)
                if size >= 50_000:
                    yield gathered(held)
                    held, size = [], 0
        if held:
            yield gathered(held)

    def gathered(held):
        times = [len(x[0]) for x in held]
        columns = [np.repeat([x[k] for x in held], times).astype(np.int64) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(np.concatenate([x[0] for x in held])), pa.array(columns[1]), pa.array(columns[2])], schema=schema)

    return sets.select("g", "doc_id", "n", "shared").mapInArrow(emit, "g long, t long, doc_id long, n long")


def _chained(postings: DataFrame) -> DataFrame:
    """(doc_id, g): documents chained by common rows (g, t) of a written table; one that shares none is left out."""
    heads = postings.groupBy("g", "t").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last"), F.count("*").alias("held")).where("b < last").select("g", "t", "b", "held")
    edges = join_by_weight(postings, heads, ["g", "t"], "held", postings.count()).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("g"))


def _first_order(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, g): groups by chains of common prefix shingles under the first order."""
    return _chained(cut(_postings(sets.withColumn("g", F.lit(0).cast("long")), lambda h, n: prefix(h, n, 0, percent)), "prefixes"))


def _rarest_first(grouped: DataFrame, percent: int) -> DataFrame:
    """(doc_id, g): groups (g, doc_id, n, shared) split by chains under the order that has a group's rarest shingles first.

    It parts documents that only passages held by many chain together. Shingles that no other of the group has stand before all.
    """
    rows = cut(_postings(grouped, lambda h, n: h), "shingles")
    counts = cut(rows.groupBy("g", "t").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts")
    placed = join_by_weight(rows, counts, ["g", "t"], "df", rows.count())
    # Of a document's shingles, by how many hold them, so many stand in its prefix that a partner can't lack them all.
    least = F.floor((F.col("n") * percent + 99) / 100)
    ordered = placed.groupBy("g", "doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("held"))
    head = F.slice("held", 1, F.greatest(F.size("held") - least + 1, F.lit(0)).cast("int"))
    return _chained(cut(ordered.select("g", "doc_id", "n", F.explode(head.getField("t")).alias("t")), "rare-prefixes"))


def _sized(groups: DataFrame) -> DataFrame:
    """groups (doc_id, n, g) with the number of documents (size) and of shingles (weight) of each group."""
    total = groups.count()
    sizes = cut(groups.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "group-sizes", total)
    return join_by_weight(groups, sizes, "g", "size", total)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(dealt: DataFrame, found: Callable[[np.ndarray, np.ndarray, list], Iterable[tuple[int, int]]]) -> DataFrame:
    """(a, b) links that found gives for the documents of each task: rows (g, i, j, side, doc_id, n, shared) with equal g, i, j."""

    def verify(batches):
        key, rows = None, []

        def flush():
            side, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            links = list(found(side, ids, [(r[2], np.frombuffer(r[3], _U)) for r in rows]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=LINKS)

        for batch in batches:
            for g, i, j, side, doc, n, shared in zip(*(batch[c].to_pylist() for c in ("g", "i", "j", "side", "doc_id", "n", "shared")), strict=True):
                if (g, i, j) != key:
                    if len(rows) > 1:
                        yield from flush()
                    key, rows = (g, i, j), []
                rows.append((side, doc, n, shared))
        if len(rows) > 1:
            yield from flush()

    # Partitions of the session's number at least, and of about BLOCK documents where that is more.
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // (4 * BLOCK))
    return dealt.repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id").mapInArrow(verify, "a long, b long")


def _between(side: np.ndarray, ids: np.ndarray, sets: list, percent: int) -> Iterator[tuple[int, int]]:
    """Spanning links between the documents of side 0 and those of other sides."""
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    if len(x) and len(y):
        yield from ((a, b) for a, b in forest(ids[x], ids[y], linked([sets[i] for i in x], [sets[i] for i in y], percent)) if a != b)


def links(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(a, b) links that span each class of linked documents, for a written table of sets (doc_id, n, shared).

    Groups are told apart on narrow rows (doc_id, g); sets are joined to them by doc_id, so a large group is no large partition.
    """
    sizes, total = sets.select("doc_id", "n"), sets.count()
    rough = cut(_sized(cut(sizes.join(_first_order(sets, percent), "doc_id"), "first-groups", total)), "rough-groups", total)
    many = sets.join(rough.where(F.col("size") > REFINE).select("doc_id", "g"), "doc_id")
    fine = rough.where(F.col("size") <= REFINE).select("doc_id", "n", "g").unionByName(sizes.join(_rarest_first(many, percent), "doc_id"))
    grouped = _sized(cut(fine, "fine-groups", total))
    # A block has a bounded number of documents and of shingles.
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("weight") / (block * BLOCK_SHINGLES)))
    grouped = cut(grouped.select("doc_id", "g", "size", blocks.cast("int").alias("blocks")), "groups", total).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    is_pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("size")) < pivots)
    tasks = grouped.select("doc_id", "g", F.col("own").alias("i"), F.lit(0).alias("side")).unionByName(
        grouped.where(is_pivot).select("doc_id", "g", "own", others).where("i <> own").select("doc_id", "g", "i", F.lit(1).alias("side"))
    )

    def in_block(side, ids, own):
        mine = np.flatnonzero(side == 0)
        yield from group_links(ids[mine], [own[i] for i in mine], percent)
        yield from _between(side, ids, own, percent)

    first = cut(_verify(tasks.withColumn("j", F.lit(0)).join(sets, "doc_id"), in_block), "links", 2 * total)
    large = grouped.where("blocks > 1")
    if large.isEmpty():
        return first
    # What pivots did not join to the largest class of its group is compared with all of the group: two documents of that class
    # need no link of their own.
    roots = components(first).select(F.col("node").alias("doc_id"), "root")
    large = cut(large.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "large-groups", total)
    classes = large.groupBy("g", "root").agg(F.count("*").alias("held")).groupBy("g").agg(F.max(F.struct("held", "root"))["root"].alias("main"), F.sum("held").alias("size"))
    classed = join_by_weight(large.drop("size"), cut(classes, "main-classes", total), "g", "size", large.count())
    rest = cut(classed.where("root <> main"), "rest", total)
    left = cut(rest.groupBy("g").agg(F.count("*").alias("held"), F.ceil(F.count("*") / block).cast("int").alias("rests")), "rests", total)
    of_rest = F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("j")
    rest_own = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("rests")).cast("int").alias("j")
    others_of_rest = join_by_weight(rest, left, "g", "held", rest.count()).select("doc_id", "g", rest_own, others, F.lit(0).alias("side"))
    all_of_group = join_by_weight(large, left, "g", "held", large.count()).select("doc_id", "g", of_rest, F.col("own").alias("i"), F.lit(1).alias("side"))
    second = _verify(others_of_rest.unionByName(all_of_group).join(sets, "doc_id"), lambda side, ids, own: _between(side, ids, own, percent))
    return first.unionByName(second)


def near_copies(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links lead to, itself included. A text without words (null, empty, blank) has no
    shingle and links with nothing. Rows that share a doc_id are one document, each with its row; a null doc_id gives a row with
    null n_shingles and component_id. An empty table gives no rows.
    """
    about, told = candidates(docs.select("doc_id", "text"), percent)
    filled = about.where("n > 0")
    total = filled.count()
    heads = cut(filled.groupBy("digest").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.count("*").alias("held")), "heads", total)
    sets = cut(_sets(told, heads.select(F.col("head").alias("doc_id"), "n").groupBy("doc_id").agg(F.max("n").alias("n")), percent), "sets")
    roots = components(links(sets, percent, block, pivots)).select(F.col("node").alias("head"), F.col("root"))
    classes = cut(heads.join(roots, "head", "left").select("digest", "held", F.coalesce("root", "head").alias("component_id")), "classes", total)
    # A text that very many documents are copies of is a digest whose class is broadcast.
    out = join_by_weight(filled, classes, "digest", "held", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = about.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    unnamed = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(empty).unionByName(unnamed)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without all but one document of each class of near copies: the one with the smallest id stays, each of its rows if it has
    several. Rows whose doc_id is null stay."""
    found = near_copies(docs, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(found, "doc_id", "left_anti").unionByName(docs.where("doc_id is null"))


def brute_force(texts: dict[int, str | None], percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """The same for a few texts by comparing all pairs."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))} if w else set()
    root = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            r = min(root[a], root[b])
            if root[a] != r or root[b] != r:
                root[a] = root[b] = r
                changed = True
    return {i: (len(s), root[i]) for i, s in sets.items()}
