"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automata of blocks of items (about BLOCK_CHARS characters each; WAVE blocks a pass, which bounds what is broadcast) are sent to
the executors, which stream the words of each document through it and track the longest match that ends at each
word. A match as long as a window of `window` words marks the last `window` words as hit, a whole shorter item marks its words.
Stretches whose word k-grams are not all in the block cannot hold a window and send the automaton back to its root, so they
are skipped: a vectorised test on word hashes finds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import boxed, cut, mix, powers, prefix_hash, slices, small_batches, strings, unboxed

WINDOW = 13
#: A document is contaminated if at least 1 of so many words is hit.
COVER = 20
#: Characters of a block of items, whose automaton takes about 25 MB, and blocks that a pass over the documents holds.
BLOCK_CHARS, WAVE = 2_000_000, 8
#: Word k-grams that the skipping test looks at, and the bits of its table.
GRAM, BITS = 4, 22

#: Bytes of words: digits, letters and all of non-ASCII. A-Z count after lower-casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
_U = np.uint64


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of rows of lower-cased text."""
    mask = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = mask[1:] != mask[:-1]
    change |= edge
    at = np.flatnonzero(change)
    starts = at[:-1][mask[at[:-1]]]
    ends = at[1:][mask[at[:-1]]]
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = prefix_hash(data)
    return mix((c[ends] - c[starts]) * powers(len(c))[1][starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * _U(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(h)


def words_of(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(*word_spans(data, np.array([0, len(data)])), strict=True)]


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """Clone q for the strings that end with token after p."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, tokens: Iterable[int]) -> None:
        last = 0
        for t in tokens:
            last = self.extend(last, t)


class ItemIndex:
    """The automaton of a block of items [(id or None, text)] packed in arrays, with the items of each window's state.

    Transitions are rows sorted by state; a state's become a dict when a walk first meets it, as most never are. Everything is linear
    in the words of the items, however repetitive.
    """

    #: States whose transitions are kept as dicts.
    KEPT = 200_000

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        split = [(i, w) for i, text in items if (w := words_of(text))]
        tokens = [[self.ids.setdefault(x, len(self.ids)) for x in w] for _, w in split]
        a = SuffixAutomaton()
        for t in tokens:
            a.add(t)
        self.link, self.length = np.array(a.link, np.int32), np.array(a.length, np.int32)
        by_length = np.argsort(self.length, kind="stable")
        # The state of the last `window` words of a state's strings, for strings that long.
        self.top = np.full(len(self.link), -1, np.int32)
        for v in by_length[np.searchsorted(self.length[by_length], window) :].tolist():
            up = a.link[v]
            self.top[v] = v if a.length[up] < window else self.top[up]
        # Of states with a string of `window` words: the items. Of states with a whole shorter item: its length and item.
        held: list[tuple[int, int]] = []
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.names = [i for i, _ in split]
        for k, t in enumerate(tokens):
            v = 0
            for n, x in enumerate(t, 1):
                v = a.next[v][x]
                if n >= window:
                    held.append((int(self.top[v]), k))
            if len(t) < window:
                self.short.setdefault(v, []).append((len(t), k))
        pairs = np.unique(np.array(held, np.int64).reshape(-1, 2), axis=0)
        self.long_state, at = np.unique(pairs[:, 0], return_index=True)
        self.long_at, self.long_item = np.append(at, len(pairs)), pairs[:, 1].astype(np.int32)
        # The nearest state with a shorter item, from each state upwards along the links.
        self.mark = np.full(len(self.link) if self.short else 1, -1, np.int32)
        for v in by_length[1:].tolist() if self.short else ():
            self.mark[v] = v if v in self.short else self.mark[a.link[v]]
        count = np.array([len(x) for x in a.next])
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.token = np.fromiter((t for x in a.next for t in x), np.int32, self.first[-1])
        self.to = np.fromiter((v for x in a.next for v in x.values()), np.int32, self.first[-1])
        self.seen: dict[int, dict[int, int]] = {}
        self.least = min((min(len(t), window) for t in tokens), default=0)
        self.gram = min(GRAM, self.least)
        self.table = np.zeros(1 << BITS, bool)
        for _, w in split:
            if len(w) >= self.gram:
                data = np.frombuffer(b" ".join(w), np.uint8)
                h = gram_hashes(word_hashes(data, *word_spans(data, np.array([0, len(data)]))), self.gram)
                self.table[(h >> _U(64 - BITS)).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "table": np.packbits(self.table)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"table": np.unpackbits(state["table"]).astype(bool)}

    def _next(self, v: int) -> dict[int, int]:
        found = self.seen.get(v)
        if found is None:
            if len(self.seen) >= self.KEPT:
                self.seen.clear()
            a, b = self.first[v], self.first[v + 1]
            found = self.seen[v] = dict(zip(self.token[a:b].tolist(), self.to[a:b].tolist(), strict=True))
        return found

    def walk(self, tokens: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(state, longest match) after each token."""
        v = n = 0
        for t in tokens:
            to = self._next(v).get(t)
            while to is None and v:
                v = int(self.link[v])
                n = int(self.length[v])
                to = self._next(v).get(t)
            if to is not None:
                v, n = to, n + 1
            yield v, n

    def match(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(first, last + 1, state, size) of each occurrence in words: of a window, with size 0, or of a shorter item."""
        for k, (v, n) in enumerate(self.walk(self.ids.get(w, -1) for w in words), 1):
            if n >= self.window:
                yield k - self.window, k, int(self.top[v]), 0
            m = int(self.mark[v]) if self.short else -1
            while m > 0:
                for size in {size for size, _ in self.short[m]}:
                    if size <= n:
                        yield k - size, k, m, size
                m = int(self.mark[self.link[m]])

    def items(self, state: int, size: int) -> set[str | None]:
        """The ids of the items of an occurrence."""
        if size:
            return {self.names[i] for n, i in self.short[state] if n == size}
        k = int(np.searchsorted(self.long_state, state))
        return {self.names[i] for i in self.long_item[self.long_at[k] : self.long_at[k + 1]].tolist()}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
        """Number of words of each row; for rows with a hit, the occurrences (first word, last + 1) and items."""
        data = LOWER[data]
        starts, ends = word_spans(data, offsets)
        first = np.searchsorted(starts, offsets)
        found: dict[int, tuple[list, set]] = {}
        if not self.least or not len(starts):
            return np.diff(first), found
        h = gram_hashes(word_hashes(data, starts, ends), self.gram)
        ok = np.zeros(len(starts) + 1, bool)
        ok[: len(h)] = self.table[(h >> _U(64 - BITS)).astype(np.int64)]
        for i in range(1, self.gram):  # a k-gram may not reach into the next row
            cut = first[1:] - i
            ok[cut[cut >= first[:-1]]] = False
        # Runs of such words end with their row.
        fresh = np.zeros(len(starts) + 1, bool)
        fresh[first] = True
        begins = np.flatnonzero(ok & (fresh | np.concatenate([[True], ~ok[:-1]])))
        ends_at = np.flatnonzero(ok[:-1] & (fresh[1:] | ~ok[1:])) + 1
        raw = None
        for a, b in zip(begins, ends_at, strict=True):
            b = b + self.gram - 1
            if b - a < self.least:
                continue
            raw = raw if raw is not None else data.tobytes()
            row = int(np.searchsorted(first, a, "right")) - 1
            for s, e, state, size in self.match([raw[starts[k] : ends[k]] for k in range(a, b)]):
                spans, states = found.setdefault(row, ([], set()))
                s, e = int(a - first[row]) + s, int(a - first[row]) + e
                if spans and spans[-1][0] <= s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                else:
                    spans.append((s, e))
                states.add((state, size))
        return np.diff(first), {row: (spans, set().union(*(self.items(*x) for x in states))) for row, (spans, states) in found.items()}


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str | None]]]:
    """Items in blocks of about block_chars characters (a longer item alone), read one at a time."""
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        rows.append((r.i, r.text))
        size += len(r.text or "")
        if size >= block_chars:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


TOLD = "struct<words:bigint,spans:array<struct<s:bigint,e:bigint>>,items:array<string>>"
_TOLD = pa.struct([("words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))])


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, told) of each row of docs: the row as a struct, and what is told of it: the number of words, the
    spans of hit words, sorted and joined, as [s, e), and the ids of items, sorted.

    Null or empty texts have no words; null item ids take part but are not listed; no items, or items without words, hit
    nothing. Only texts go through Python, and once for WAVE blocks of items.
    """
    sc = docs.sparkSession.sparkContext
    out = boxed(small_batches(docs), F.lit(None).cast(TOLD).alias("told"))
    of_blocks = (ItemIndex(block, window) for block in blocks(items, block_chars))
    wave = list(islice(of_blocks, WAVE)) or [ItemIndex([], window)]
    while wave:
        out = out.select("row", _scanner(sc.broadcast(wave))(F.col("row")["text"], "told").alias("told"))
        wave = list(islice(of_blocks, WAVE))
        if wave:
            # No worker holds more than one wave.
            out = cut(out, "overlaps", compression="zstd")
    return out


def _scanner(wave: Broadcast[list[ItemIndex]]) -> Callable[..., Column]:
    """A function of (text, told) that adds to what is told what the blocks of a wave find."""

    @F.arrow_udf(TOLD)
    def scan(text: pa.Array, told: pa.Array) -> pa.Array:
        data, offsets = strings(text)
        out = [x or {"words": 0, "spans": [], "items": []} for x in told.to_pylist()]
        for i, j in slices(offsets, 1 << 20):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            for index in wave.value:
                words, found = index.scan(part, at)
                for k, n in enumerate(words.tolist(), i):
                    out[k]["words"] = n
                for k, (where, which) in found.items():
                    x = out[i + k]
                    x["spans"] = [{"s": s, "e": e} for s, e in joined([(y["s"], y["e"]) for y in x["spans"]] + where)]
                    x["items"] = sorted({*x["items"], *(y for y in which if y is not None)})
        return pa.array(out, _TOLD)

    return scan


def hits() -> tuple[Column, Column, Column]:
    """n_words, n_hit and, for `cover`, the verdict, of a row of overlaps()."""
    n_hit = F.aggregate("told.spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return F.col("told.words"), n_hit, lambda cover: (n_hit > 0) & (n_hit * cover >= F.col("told.words"))


def scored(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: int = COVER) -> DataFrame:
    """docs with n_words, n_hit, items (ids, sorted) and contaminated (a hit, and at least 1 of `cover` words hit).

    Columns of docs with these names are replaced, all others pass; see overlaps for nulls. An empty table stays empty.
    """
    n_words, n_hit, verdict = hits()
    return unboxed(overlaps(docs, items, window), n_words=n_words, n_hit=n_hit, items=F.col("told.items"), contaminated=verdict(cover))


def _strip(text: str, spans: list[dict]) -> str:
    data = text.encode()
    low = LOWER[np.frombuffer(data, np.uint8)]
    starts, ends = word_spans(low, np.array([0, len(data)]))
    out, at = [], 0
    for x in spans:
        out.append(data[at : starts[x["s"]]])
        at = int(ends[x["e"] - 1])
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: int = COVER, action: str = "drop") -> DataFrame:
    """docs without contamination, in their own columns, whatever their names.

    action "drop" leaves out contaminated documents and keeps the others as they are; "spans" keeps all documents and cuts the
    hit words out of contaminated ones. Null texts are kept as they are.
    """
    if action not in ("drop", "spans"):
        raise ValueError(f"unknown action {action}")
    found = overlaps(docs, items, window)
    verdict = hits()[2](cover)
    if action == "drop":
        return unboxed(found.where(~verdict))

    @F.arrow_udf("string")
    def strip(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_strip(t, s) if t and s else t for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    own = F.col("row")["text"]
    text = F.when(verdict, strip(own, F.col("told.spans"))).otherwise(own)
    return unboxed(found.withColumn("row", F.col("row").withField("text", text)))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of the query: counts, the digest of the item ids, and the verdict."""
    out = scored(docs.select("doc_id", "text"), items)
    ids = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def brute_force(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW, cover: int = COVER) -> tuple:
    """The same for one text, by comparing each window with each place."""
    words, hit, ids = words_of(text), set(), set()
    for i, t in items:
        w = words_of(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == w[a : a + n]:
                    hit |= set(range(b, b + n))
                    ids.add(i)
    names = ",".join(sorted(ids))
    return len(words), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and cover * len(hit) >= len(words)
