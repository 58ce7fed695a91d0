"""Mixture-controlled packing by deficit round-robin over source queues.

`tokenize` turns documents into token ids; where the tokenizer allows it, each distinct white-space chunk of a batch is encoded
once. `pack` lays the documents of each source out as a queue. A queue's tokens are spread over the places of the whole output as
its target says, and documents are dealt to groups (of about GROUP_TOKENS places) by the place where they begin: so each group
gets its quota of each source, to within a document. A group is packed by one task: visiting the queues in turn, each gets its
share of a window as credit and sends pieces of its head document while its credit lasts; windows fill to exactly 2048 tokens,
documents are cut only where a window ends. Credit left over carries on to the next window, and into the next group: what the
groups before it sent of a source is where the source's first document of the group begins in its queue, so what the source is
owed is known without looking at other groups. What fills no window at a group's end becomes sequences whose lengths are
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm._common import cut, give_back, slices, small_batches, strings

LENGTH = 2048
END = 1
GROUP_TOKENS = 1_000_000
#: A task packs several groups one after the other: about EACH, and more where there would be more partitions than MOST_PARTITIONS.
EACH, MOST_PARTITIONS = 8, 20_000
#: Beyond so many rows (part, source) their starts are joined by a shuffle instead of a broadcast.
MOST_STARTS = 500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# The normalizer and pre-tokenizer of the tokenizer whose texts can be cut into chunks (see ChunkTokenizer).
CHUNKED_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CHUNKED_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def chunked(path: str) -> bool:
    """Whether the tokenizer in a file lower-cases, drops white space and cuts at the ends of runs of letters, as ChunkTokenizer needs."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    normalizers = (found.get("normalizer") or {}).get("normalizers")
    first = ((found.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    cuts = first.get("type") == "Split" and first.get("pattern") == {"Regex": CHUNKED_PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
    special = all(x["content"].startswith("<|") for x in found.get("added_tokens") or ())
    return normalizers == CHUNKED_NORMALIZERS and bool(cuts) and special and found["model"].get("end_of_word_suffix") == "</w>"


class TextTokenizer:
    """Ids of whole texts by the tokenizer in a file, whatever it does."""

    def __init__(self, path: str) -> None:
        # A task has a core; the tokenizer's own threads would only take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    @staticmethod
    def of(path: str) -> TextTokenizer:
        """The one of this Python worker, which may serve many tasks."""
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = (ChunkTokenizer if chunked(path) else TextTokenizer)(path)
        return _TOKENIZERS[path]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (none for null), without special tokens, as unsigned 32-bit numbers."""
        found = self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]


class ChunkTokenizer(TextTokenizer):
    """The same for a tokenizer whose words cross neither ASCII white space nor the end of a run of letters.

    A text is cut at both, A-Z are lower-cased (as the tokenizer does), and each distinct piece is encoded once. Up to KEPT pieces
    are kept from call to call. Texts that may hold a special token are encoded whole.
    """

    #: Words of letters are encoded so many at a time: each is one piece, whose last id is one that ends a word.
    KEPT, JOINED = 150_000, 64

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.slot: dict[str, int] = {}
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        size, ids = np.zeros(len(words), np.int64), np.zeros(0, np.uint32)
        at = np.flatnonzero(plain)
        easy = [words[i] for i in at]
        joined = [" ".join(easy[i : i + self.JOINED]) for i in range(0, len(easy), self.JOINED)]
        if joined:
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(at):  # some letter is more than one piece to the tokenizer
                plain[:], at, ids = False, at[:0], ids[:0]
            else:
                size[at] = np.diff(last, prepend=-1)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return size, ids
        found = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)]
        size[rest] = [len(x) for x in found]
        out, ends = np.zeros(size.sum(), np.uint32), np.cumsum(size)
        easy_ids = np.repeat(plain, size)
        out[easy_ids] = ids
        out[~easy_ids] = np.fromiter(chain.from_iterable(found), np.uint32)
        return size, out

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        special = np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))
        out = self._cut(texts)
        if len(special):
            for i, ids in zip(special, super().__call__(texts.take(pa.array(special))), strict=True):
                out[i] = ids
        return out

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        data, at = strings(texts)
        # Not pc.ascii_lower, which is wrong for arrays whose first offset is not 0.
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(_LOWER[data]))
        chunks = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-z])([.,!?;:%&$#*])", r"\1 \2"))
        offsets = np.asarray(chunks.offsets)
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        slots = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        fresh = [words[i] for i in new]
        n, ids = self._encode(fresh)
        slots[new] = len(self.size) + np.arange(len(new))
        size, flat = np.concatenate([self.size, n]), np.concatenate([self.flat, ids])
        room = max(0, self.KEPT - len(self.slot))
        if room:
            self.slot.update(zip(fresh[:room], range(len(self.size), len(self.size) + room)))
            self.size = size[: len(self.slot)]
            self.flat = flat[: self.size.sum()]
        begin = np.cumsum(size) - size
        index = slots[np.asarray(coded.indices)]
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[index] - ends[:-1], n)]
        cuts = ends[offsets - offsets[0]]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_TOKENIZERS: dict[str, TextTokenizer] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokenize(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(part, before, doc_id, source, doc_tokens, ids) of each row of docs (doc_id, source, text).

    ids are little-endian, with the end token, 2 bytes each if the tokenizer has at most 65536, else 4; a null text has only the end
    token, and null or repeated doc_ids are rows like others. part is the partition, before the tokens of the row's source that
    stand before it there. They say where a row stands in its source's queue once the table is written.
    """
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        tokenizer, part = TextTokenizer.of(path), TaskContext.get().partitionId()
        kind = f"<u{tokenizer.width}"
        last = np.array([end], np.uint32)
        so_far: dict[str | None, int] = {}
        for batch in batches:
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for i, j in slices(size, 2 << 20):
                rows = batch.slice(i, j - i)
                ids = [np.concatenate([x, last]) for x in tokenizer(rows["text"])]
                before = []
                for source, x in zip(rows["source"].to_pylist(), ids, strict=True):
                    n = so_far.get(source, 0)
                    before.append(n)
                    so_far[source] = n + len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(before, pa.int64()), rows["doc_id"], rows["source"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], schema=schema)
        give_back()

    return small_batches(docs).select("doc_id", "source", "text").mapInArrow(encode, "part int, before long, doc_id long, source string, doc_tokens long, ids binary")


#: documents [number, start, remaining] by source; what each source gets of a window; what each is owed at the start.
Queues = tuple[dict, dict, dict]


def deficit_round_robin(rounds: list[Queues], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, size, window, offset) of each piece.

    Queues are visited in turn, round by round. A visit adds a queue's share of one token to what it is owed, and while it is owed
    tokens it sends pieces of its head document. Most visits send nothing: a heap tells the next (round, queue) that does, so the
    rounds between are not run. Several sets of queues are packed one after another.
    """
    window, space = 0, length
    for queues, share, credit in rounds:
        names = sorted(queues, key=lambda s: (s is None, s))
        # What a queue is owed in round r is owed[k] + r * share: the first round in which that is over 0 is its turn.
        owed, shares = [credit[s] for s in names], [share[s] for s in names]
        turns = [(max(0, int(-owed[k] // shares[k]) + 1), k) for k in range(len(names))]
        heapify(turns)
        while turns:
            turn, k = turns[0]
            queue, left = queues[names[k]], owed[k] + turn * shares[k]
            while queue and left > 0:
                doc = queue[0]
                size = min(doc[2], space)
                yield doc[0], doc[1], size, window, length - space
                doc[1] += size
                doc[2] -= size
                left -= size
                owed[k] -= size
                space -= size
                if not doc[2]:
                    queue.popleft()
                if not space:
                    window, space = window + 1, length
            if queue:
                heapreplace(turns, (max(turn + 1, int(-owed[k] // shares[k]) + 1), k))
            else:
                heappop(turns)


def _powers_of_two(pieces: list[tuple], length: int) -> Iterator[tuple]:
    """Deal the pieces of an unfilled window to sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    if not total or total == length:
        yield from pieces
        return
    window, left, space = pieces[0][3], total, 0
    size = 0
    window -= 1
    for doc, start, n, _, _ in pieces:
        while n:
            if not space:
                size = space = 1 << (left.bit_length() - 1)
                window += 1
            take = min(n, space)
            yield doc, start, take, window, size - space
            start, n, space, left = start + take, n - take, space - take, left - take


def windows(pieces: Iterator[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """The pieces, those of the last window dealt out anew if they do not fill it."""
    held: list[tuple] = []
    for p in pieces:
        if held and held[-1][3] != p[3]:
            yield from held
            held = []
        held.append(p)
    yield from _powers_of_two(held, length)


def ways(totals: dict[str, int], targets: dict[str, float]) -> tuple[dict[str, list[tuple[float, float, float]]], float]:
    """How each source's tokens are spread over the places of the whole output, and where that ends.

    For each source (its token, the place, places a token) from which on they run evenly. All sources get their share of each window
    until one has no more; then the others share its part in proportion.
    """
    left = {s: float(totals[s]) for s in targets if targets[s] > 0 and totals.get(s, 0) > 0}
    out: dict[str, list[tuple[float, float, float]]] = {s: [] for s in left}
    place = 0.0
    while left:
        whole = sum(targets[s] for s in left)
        step, first = min((n * whole / targets[s], s) for s, n in left.items())
        for s in list(left):
            out[s].append((totals[s] - left[s], place, whole / targets[s]))
            left[s] -= step * targets[s] / whole
            if s == first or left[s] < 0.5:
                del left[s]
        place += step
    return out, place


def queue_starts(tokens: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(part, source, start, late, share, way): where the tokens of a part begin in the queue of their source, and the queue's way.

    Without targets, shares are the sources' parts of all tokens. Sources that targets does not name, or gives nothing, come
    late: after all others, in proportion to their tokens.
    """
    sums = cut(tokens.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")), "source-parts", tokens.count())
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"))
    # targets names a bounded number of sources; others are summed.
    named = F.col("source").isin(sorted(targets or {}))
    found = {r.source: r.total for r in totals.where(named).collect()} if targets else {}
    spread, end = ways(found, targets or {})
    late = ~F.coalesce(F.col("source").isin(sorted(spread)), F.lit(False)) if spread else F.lit(True)
    rest = totals.where(late).agg(F.sum("total")).first()[0] or 1
    step = "struct<token:double,place:double,places:double>"
    way = F.array(F.struct(F.lit(0.0).alias("token"), F.lit(float(end)).alias("place"), (F.lit(float(rest)) / F.col("total")).alias("places"))).cast(f"array<{step}>")
    share = F.col("total") / F.lit(float(rest))
    for s, steps in spread.items():
        is_it = F.coalesce(F.col("source") == s, F.lit(False))
        way = F.when(is_it, F.array(*(F.struct(*(F.lit(float(x)).alias(k) for k, x in zip(("token", "place", "places"), p, strict=True))) for p in steps)).cast(f"array<{step}>")).otherwise(way)
        share = F.when(is_it, F.lit(float(targets[s]))).otherwise(share)
    plan = totals.select(F.col("source").alias("own"), late.alias("late"), share.alias("share"), way.alias("way"))
    return starts.join(plan, F.col("source").eqNullSafe(F.col("own"))).drop("own")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())])


def packed(group: int, rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """The pieces of one group: rows (late, source, share, owed, doc_id, doc_tokens, ids) in the order of their queues."""
    sizes, source, doc_id = rows["doc_tokens"].to_numpy(), rows["source"].to_pylist(), rows["doc_id"].to_pylist()
    share, owed, late = rows["share"].to_pylist(), rows["owed"].to_pylist(), rows["late"].to_pylist()
    blobs = rows["ids"].combine_chunks().cast(pa.large_binary())
    _, at, data = blobs.buffers()
    at = np.frombuffer(at, np.int64)[blobs.offset : blobs.offset + len(sizes) + 1]
    width = int(at[-1] - at[0]) // int(sizes.sum())
    ids = memoryview(np.frombuffer(data, f"<u{width}", int(sizes.sum()), int(at[0])).astype("<u4")).cast("B")
    rounds: dict[bool, Queues] = {}
    for k, n in enumerate(sizes.tolist()):
        queues, shares, credit = rounds.setdefault(late[k], ({}, {}, {}))
        if source[k] not in queues:
            queues[source[k]], shares[source[k]], credit[source[k]] = deque(), max(share[k], 1e-12), owed[k]
        queues[source[k]].append([k, 0, n])
    out = list(windows(deficit_round_robin([rounds[k] for k in sorted(rounds)], length), length))
    doc, start, n, window, offset = np.array(out, np.int64).T
    begin = 4 * ((np.cumsum(sizes) - sizes)[doc] + start)
    crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * n).tolist(), strict=True)]
    # Not a table's take(), which copies the ids too.
    columns = [rows["doc_id"].take(pa.array(doc)), start, n, crc, sizes[doc], (group << 32) + window, offset, rows["source"].take(pa.array(doc))]
    table = pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)
    yield from table.combine_chunks().to_batches(50_000)


def pack_tokens(tokens: DataFrame, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of a written table of tokens (see tokenize) with the sequence and the offset of each.

    targets: weights of sources in each window; see queue_starts. A null source is a queue of its own; repeated rows are packed as
    often as they stand there. A sequence id is a group's number times 2**32 plus a number within the group.
    """
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    starts = cut(queue_starts(tokens, targets), "queue-starts", tokens.count())
    if starts.count() <= MOST_STARTS:
        starts = F.broadcast(starts)
    starts = starts.withColumnsRenamed({"part": "own_part", "source": "own"})
    own = tokens.join(starts, (F.col("part") == F.col("own_part")) & F.col("source").eqNullSafe(F.col("own")))
    own = own.withColumn("token", F.col("start") + F.col("before"))
    # The last step of the way that begins at or before a token, or a place.
    last = lambda field, value: F.aggregate("way", F.col("way")[0], lambda found, x: F.when(x[field] <= value, x).otherwise(found))
    step = last("token", F.col("token"))
    place = step["place"] + (F.col("token") - step["token"]) * step["places"]
    own = own.withColumn("g", F.least(F.floor(place / group_tokens), F.lit(groups - 1)).cast("long"))
    begin = F.greatest(F.col("g") * F.lit(float(group_tokens)), F.col("way")[0]["place"])
    step = last("place", begin)
    own = own.withColumn("owed", step["token"] + (begin - step["place"]) / step["places"] - F.col("token"))
    rows = own.select("g", "late", "source", "token", "share", "owed", "doc_id", "doc_tokens", "ids")
    parts = max(groups // EACH, min(groups, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.repartition(min(parts, MOST_PARTITIONS), "g").sortWithinPartitions("g", "source", "token")

    def deal(batches):
        group, held = None, []
        for batch in batches:
            g = batch["g"].to_numpy()
            at = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if a == b:
                    continue
                if held and g[a] != group:
                    yield from packed(group, pa.Table.from_batches(held), length)
                    held = []
                group = int(g[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed(group, pa.Table.from_batches(held), length)
        give_back()

    return rows.mapInArrow(deal, PIECES)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, targets: dict[str, float] | None = None) -> DataFrame:
    """Pack docs (doc_id, source, text) into sequences of at most `length` tokens; see pack_tokens.

    The tokens are written once to the shared folder, so they are made once and their order stands. A null text is packed as its end
    token, rows with a null or a repeated doc_id are packed like others, and other columns of docs are not looked at. An empty table
    gives no piece.
    """
    tokens = cut(tokenize(docs, path or tokenizer_path()), "tokens", compression="zstd")
    return pack_tokens(tokens, length, group_tokens, targets)
