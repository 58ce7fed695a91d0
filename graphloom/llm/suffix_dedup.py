"""Repeated substrings across documents, by sorting suffixes deep and shallow.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. Not all suffixes can be sorted at
100 TB, and few need to be:

1. Each 50-byte window has a seed, its least 24-byte gram by hash; equal windows have equal seeds. Which seeds of a document another
   document has too is asked of buckets (_shared). Windows whose seed is not shared are unique.
2. The windows of a shared seed form a segment of at most 76 bytes. A chunk of documents sends each distinct segment once, for its
   smallest document; copies of it in the chunk's other documents are removed at once.
3. A bucket of segments, dealt by seed, drops those equal to a smaller document's, and sorts the windows of what is left as
   suffixes: multikey quicksort, of 8-byte words and of all groups at once, to a shallow depth, then the groups that still agree are ordered by blind tries.
   Windows that end up equal go from all but the smallest document. A bucket that is too large for one task, since a seed of very
   many documents fills it, is passed on window by window instead, dealt by the window's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import give_back, gram_hash, mix, prefix_hash, row_of, slices, strings
from graphloom.llm._shared import ANSWER, QUESTION, SLICE, bucket_of, buckets_for, by_bucket, chunks, distinct, shared_hashes, unpack48

LENGTH = 50
GRAM = 24
#: Bytes to which multikey quicksort goes before the blind tries.
SHALLOW = 32
#: Bytes of input for each bucket. A document has a row of ranges from each bucket that holds some of its segments, so more buckets
#: are more rows.
BUCKET_BYTES = 16 << 20
#: Compressed bytes of segments that a task resolves, several times what a bucket should have. A bucket of more, which a seed that very
#: many documents hold within different surroundings fills, is parted by windows.
MOST_BYTES = 64 << 20
#: Segments that are sorted at once.
AT_ONCE = 20_000
#: A chunk of documents whose segments are made at once.
SEND_BYTES = 5 << 20
_U = np.uint64
_LOW = _U((1 << 20) - 1)


def seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first window, last window) of each run of windows with one seed; windows stay within a row of at most SLICE bytes."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, _U), none, none, none
    h = gram_hash(prefix_hash(data), GRAM)
    key = (h & ~_LOW) | np.arange(len(h), dtype=_U)
    width, least = 1, key
    span = LENGTH - GRAM + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    start = np.arange(n)
    row = row_of(offsets)[:n]
    at = np.flatnonzero(start + LENGTH <= offsets[row + 1])
    seed = (least[at] & _LOW).astype(np.int64)
    if not len(at):
        return np.zeros(0, _U), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (row[at[1:]] != row[at[:-1]])]))
    last = np.concatenate([new[1:] - 1, [len(at) - 1]])
    # A least hash is not even over all values; it is mixed once more.
    return mix(h[seed[new]]), row[at[new]], at[new], at[last]


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, rows, start in the row) of parts of rows; a row over SLICE bytes is cut into parts that overlap by a window."""
    for i, j in slices(offsets, SLICE - LENGTH):
        if offsets[j] - offsets[i] <= SLICE:
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.arange(i, j), 0
            continue
        a, end = int(offsets[i]), int(offsets[j])
        step = SLICE - LENGTH + 1
        for s in range(a, max(a + 1, end - LENGTH + 1), step):
            part = data[s : min(end, s + SLICE)]
            yield part, np.array([0, len(part)]), np.array([i]), s - a


def row_seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """seeds() for rows of any length; windows are counted from the start of their row."""
    out = []
    for part, at, rows, skip in pieces(data, offsets):
        h, r, lo, hi = seeds(part, at)
        out.append((h, rows[r], lo - at[r] + skip, hi - at[r] + skip))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)


def seed_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    h, row, _, _ = row_seeds(data, offsets)
    return h, row, None


# --- suffix sorting -------------------------------------------------------------------------------------------------------


class BlindTrie:
    """A trie that keeps at each node only the place at which its strings branch, and whole strings at its leaves.

    To insert, a string walks down by the bytes at the branching places without comparing what lies between, is compared once with the
    leaf it meets, and the first differing place tells where on the way it branches off.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | tuple | None = None

    def insert(self, key: bytes, value: int) -> None:
        if self.root is None:
            self.root = (key, [value])
            return
        way, node = [], self.root
        while isinstance(node, list):
            way.append(node)
            child = node[1].get(key[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = node[0]
        if other == key:
            node[1].append(value)
            return
        place = next(i for i, (a, b) in enumerate(zip(key, other, strict=True)) if a != b)
        leaf = (key, [value])
        parent, node = None, self.root
        for step in way:
            if step[0] >= place:
                break
            parent, node = step, step[1].get(key[step[0]])
            if node is None:
                step[1][key[step[0]]] = leaf
                return
        else:
            if way:
                node = way[-1][1][key[way[-1][0]]]
                parent = way[-1]
        if isinstance(node, list) and node[0] == place:
            node[1][key[place]] = leaf
            return
        branch = [place, {other[place]: node, key[place]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key[parent[0]]] = branch

    def groups(self) -> Iterator[list[int]]:
        """Values of equal strings, in the order of the strings."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                yield node[1]


def equal_suffixes(text: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Ranks of the suffixes at starts, cut to length, within their groups: equal for equal strings, ascending with group and string.

    text must have 8 more bytes than the last suffix needs.
    """
    n = len(starts)
    rank = np.zeros(n, np.int64)
    if not n:
        return rank
    words = np.lib.stride_tricks.sliding_window_view(text, 8)

    def word(at: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words[at + depth]).view(">u8")[:, 0].astype(_U)

    order = np.argsort(group, kind="stable")
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    deep = np.zeros(n, np.int64)
    while True:
        # All groups take a step of multikey quicksort at once: each is parted by a pivot into the suffixes whose word at the group's
        # depth is less, equal or greater, and those that are equal go one word deeper.
        lead = np.flatnonzero(new)
        size = np.diff(lead, append=n)
        part = np.flatnonzero(np.repeat(size > 1, size) & (deep < shallow))
        if not len(part):
            break
        own = (np.cumsum(new) - 1)[part]
        w = word(starts[order[part]], deep[part])
        middle = (lead + size // 2)[own]
        pivot = w[np.searchsorted(part, middle)]
        side = 1 + (w > pivot).astype(np.int64) - (w < pivot)
        key = 3 * own + side
        o = np.argsort(key, kind="stable")
        order[part] = order[part][o]
        deep[part] += 8 * (side[o] == 1)
        key = key[o]
        new[part[1:]] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(first, append=n)
    # Deep groups: those whose remaining bytes all agree need no tree.
    part = np.flatnonzero(np.repeat(size > 1, size))
    if len(part) and shallow < length:
        lead = np.repeat(first, size)[part]
        same = np.ones(len(part), bool)
        for depth in [*range(shallow, length - 8, 8), length - 8]:
            same &= word(starts[order[part]], depth) == word(starts[order[lead]], depth)
        odd = np.zeros(n, bool)
        odd[lead[~same]] = True
        raw = None
        for a in np.flatnonzero(odd):
            raw = raw if raw is not None else text.tobytes()
            b = a + size[np.searchsorted(first, a)]
            trie = BlindTrie()
            for k in order[a:b].tolist():
                s = int(starts[k])
                trie.insert(raw[s + shallow : s + length], k)
            at = a
            for values in trie.groups():
                order[at : at + len(values)] = values
                new[at] = True
                at += len(values)
    rank[order] = np.cumsum(new) - 1
    return rank


# --- segments -------------------------------------------------------------------------------------------------------------


def _gather(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + size, size)]


def _segment_ids(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Equal numbers, from 0, for equal segments (by seed, size and bytes): found by a hash, and compared byte by byte."""
    width = -(-(2 * LENGTH - GRAM) // 8) * 8
    table = np.zeros((len(size), width + 16), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    table[row, np.arange(len(flat)) - np.repeat(begin, size)] = flat
    table = table.view("<u8")
    table[:, -2], table[:, -1] = size, seed
    h = np.zeros(len(size), _U)
    for k in range(table.shape[1]):
        h = mix(h ^ table[:, k])
    order = np.argsort(h)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    number = np.cumsum(new) - 1
    if (table[order] != table[order[np.flatnonzero(new)][number]]).any():  # two segments have one hash
        return np.unique(np.ascontiguousarray(table).view(f"V{8 * table.shape[1]}")[:, 0], return_inverse=True)[1]
    out = np.empty(len(size), np.int64)
    out[order] = number
    return out


RANGES = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("blob", pa.binary())])
SEGMENTS = pa.schema([("bucket", pa.int32()), *RANGES])


def _ranges(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    """Rows (doc_id, tag, blob) of window ranges."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, pair = doc[order], tag[order], np.stack([lo[order], hi[order]], axis=1).astype("<u4")
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
    cuts = np.concatenate([new, [len(doc)]])
    return [pa.array(doc[new]), pa.array(tag[new]), pa.array([pair[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())]


def segments(table: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a chunk of documents (doc_id, tag, text, blobs of shared seeds) sends: see the module's step 2."""
    data, offsets = strings(table["text"])
    h, row, lo, hi = row_seeds(data, offsets)
    h48 = h >> _U(16)
    shared = [distinct(unpack48(b"".join(x.as_py()))) for x in table["blobs"]]
    told = np.concatenate([*shared, np.zeros(0, _U)]) << _U(16) >> _U(16)
    told_row = np.repeat(np.arange(len(shared)), [len(x) for x in shared])
    # Shared seeds of a row, found by one search over (row, seed).
    place = np.searchsorted(told_row, np.arange(len(shared) + 1))
    keep = np.zeros(len(h), bool)
    at = np.searchsorted(row, np.arange(len(shared) + 1)) if len(row) else np.zeros(len(shared) + 1, np.int64)
    for r in range(len(shared)):
        a, b = at[r], at[r + 1]
        own = told[place[r] : place[r + 1]]
        if b > a and len(own):
            keep[a:b] = own[np.minimum(np.searchsorted(own, h48[a:b]), len(own) - 1)] == h48[a:b]
    if not keep.any():
        return
    h48, row, lo, hi = h48[keep], row[keep], lo[keep], hi[keep]
    size = hi - lo + LENGTH
    flat = _gather(data, offsets[row] + lo, size)
    begin = np.cumsum(size) - size
    segment = _segment_ids(flat, begin, size, h48)
    ids, tags = table["doc_id"].to_numpy(), table["tag"].to_numpy()
    doc = ids[row]
    least = np.full(segment.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, segment, doc)
    gone = doc > least[segment]
    if gone.any():
        d, t, blob = _ranges(doc[gone], tags[row[gone]], lo[gone], hi[gone])
        yield pa.RecordBatch.from_arrays([pa.array((d.to_numpy() % buckets).astype(np.int32)), pa.array(np.full(len(d), ANSWER, np.int32)), d, t, blob], schema=SEGMENTS)
    ask = np.flatnonzero(~gone)
    ask = ask[np.argsort(h48[ask])]
    bucket = bucket_of(h48[ask], buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    pack = zstandard.ZstdCompressor(level=1)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = ask[a:b]
        body = b"".join((np.uint32(b - a).tobytes(), ids[row[k]].astype("<i8").tobytes(), tags[row[k]].astype("<i8").tobytes(), lo[k].astype("<u4").tobytes(), size[k].astype("<u1").tobytes(), _gather(flat, begin[k], size[k]).tobytes()))
        out.append(pack.compress(body))
    n = len(out)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(n, QUESTION, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(out, pa.binary())], schema=SEGMENTS)


def _opened(blob: bytes, unpack: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    """(document, tag, first window, size, bytes) of the segments, or windows, of a blob."""
    raw = unpack.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out = 4, []
    for kind, m in (("<i8", n), ("<i8", n), ("<u4", n), ("<u1", n), ("<u1", -1)):
        out.append(np.frombuffer(raw, kind, m, at))
        at += out[-1].nbytes
    return out


def resolve(blobs: list[bytes]) -> pa.RecordBatch | None:
    """The ranges of windows that go, of one bucket of segments."""
    unpack = zstandard.ZstdDecompressor()
    doc, tag, lo, size, flat = (np.concatenate(p) for p in zip(*(_opened(blob, unpack) for blob in blobs), strict=True))
    del blobs
    size = size.astype(np.int64)
    # All windows of a segment have one seed, which it tells itself.
    found, rows, _, _ = row_seeds(flat, np.concatenate([[0], np.cumsum(size)]))
    seed = found[np.searchsorted(rows, np.arange(len(size)))]
    del found, rows
    begin = np.cumsum(size) - size
    order = np.argsort(seed)
    new = np.flatnonzero(np.concatenate([[True], seed[order][1:] != seed[order][:-1]]))
    # Ranges of seeds of about AT_ONCE segments are resolved one after the other.
    out, a = [], 0
    while a < len(order):
        k = int(np.searchsorted(new, a + AT_ONCE, "right")) - 1
        b = int(new[k]) if k >= 0 and new[k] > a else int(new[k + 1]) if k + 1 < len(new) else len(order)
        b = len(order) if len(order) - a <= AT_ONCE else b
        part = order[a:b]
        own = _gather(flat, begin[part], size[part])
        out.extend(_settle(doc[part], tag[part], lo[part].astype(np.int64), size[part], own, seed[part]))
        a = b
    found = [np.concatenate(x) for x in zip(*out, strict=True)]
    if not len(found[0]):
        return None
    d, t, blob = _ranges(*found)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ANSWER, np.int32)), d, t, blob], schema=RANGES)


def bucket_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of the questions of rows sorted by bucket."""
    for batch in batches:
        asked = np.flatnonzero(batch["kind"].to_numpy() == QUESTION)
        for i, number in zip(asked.tolist(), batch["bucket"].to_numpy()[asked].tolist(), strict=True):
            yield number, batch["blob"][i].as_py()


def part_large(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """The windows of buckets of more than `most` bytes, dealt anew by a hash of each window: blob by blob, so nothing is gathered."""
    current, held, size = None, [], 0
    for number, blob in bucket_blobs(batches):
        if number != current:
            current, held, size = number, [], 0
        size += len(blob)
        if size <= most:
            held.append(blob)
            continue
        for x in [*held, blob]:
            yield from _windows(x, buckets)
        held = []


def _windows(blob: bytes, buckets: int) -> Iterator[pa.RecordBatch]:
    doc, tag, lo, size, flat = _opened(blob, zstandard.ZstdDecompressor())
    size = size.astype(np.int64)
    n = size - LENGTH + 1
    segment = np.repeat(np.arange(len(size)), n)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    # A window a row, filled up to whole words.
    table = np.zeros((len(segment), -(-LENGTH // 8) * 8), np.uint8)
    table[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[(np.cumsum(size) - size)[segment] + inner]
    h = np.zeros(len(segment), _U)
    for word in table.view("<u8").T:
        h = mix(h ^ word) + _U(1)
    h = mix(h) >> _U(16)
    order = np.argsort(h)
    bucket = bucket_of(h[order], buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    pack, out = zstandard.ZstdCompressor(level=1), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[a:b]
        s = segment[k]
        out.append(pack.compress(b"".join((np.uint32(b - a).tobytes(), doc[s].tobytes(), tag[s].tobytes(), (lo[s] + inner[k]).astype("<u4").tobytes(), np.full(b - a, LENGTH, "<u1").tobytes(), table[k, :LENGTH].tobytes()))))
    m = len(out)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(m, QUESTION, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(out, pa.binary())], schema=SEGMENTS)


def settle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that go, of buckets of single windows: all but those of the smallest document so far, which is all that is kept of
    a window, however many documents hold it."""
    current, first, gone = None, {}, []

    def told() -> pa.RecordBatch:
        doc, tag, lo = (np.array(x, np.int64) for x in zip(*gone, strict=True))
        d, t, blob = _ranges(doc, tag, lo, lo)
        gone.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ANSWER, np.int32)), d, t, blob], schema=RANGES)

    unpack = zstandard.ZstdDecompressor()
    for number, blob in bucket_blobs(batches):
        if number != current:
            current, first = number, {}
        doc, tag, lo, _, flat = _opened(blob, unpack)
        raw = flat.tobytes()
        for i, (d, t, p) in enumerate(zip(doc.tolist(), tag.tolist(), lo.tolist(), strict=True)):
            least, places = first.setdefault(raw[LENGTH * i : LENGTH * (i + 1)], (d, []))
            if d > least:
                gone.append((d, t, p))
                continue
            if d < least:
                gone.extend((least, *x) for x in places)
                first[raw[LENGTH * i : LENGTH * (i + 1)]] = (d, [(t, p)])
                continue
            places.append((t, p))
        if len(gone) >= 100_000:
            yield told()
    if gone:
        yield told()


def _settle(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, size: np.ndarray, flat: np.ndarray, seed: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, tag, first, last) of windows that go, of all segments of some seeds."""
    begin = np.cumsum(size) - size
    segment = _segment_ids(flat, begin, size, seed)
    count = segment.max() + 1
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, segment, doc)
    one = np.zeros(count, np.int64)
    one[segment] = np.arange(len(segment))
    # Distinct segments of seeds that have several: their windows are sorted as suffixes.
    _, seed_of, per_seed = np.unique(seed[one], return_inverse=True, return_counts=True)
    sort = np.flatnonzero(per_seed[seed_of] > 1)
    windows = size[one[sort]] - LENGTH + 1
    ends = np.cumsum(windows)
    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - windows, windows)
    starts = np.repeat(begin[one[sort]], windows) + inner
    rank = equal_suffixes(np.concatenate([flat, np.zeros(8, np.uint8)]), starts, np.repeat(seed_of[sort], windows))
    first = np.full(rank.max() + 1 if len(rank) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, rank, np.repeat(least[sort], windows))
    first = first[rank]
    place = np.full(count, -1)
    place[sort] = ends - windows
    whole = doc > least[segment]
    yield doc[whole], tag[whole], lo[whole], lo[whole] + size[whole] - LENGTH
    # A segment that is its document's own keeps the windows that no smaller document has.
    some = np.flatnonzero(~whole & (place[segment] >= 0))
    if len(some):
        n = size[some] - LENGTH + 1
        ends = np.cumsum(n)
        inner = np.arange(ends[-1]) - np.repeat(ends - n, n)
        entry = np.repeat(np.arange(len(some)), n)
        gone = first[place[segment[some]][entry] + inner] < doc[some][entry]
        e, i = entry[gone], inner[gone]
        if len(e):
            new = np.concatenate([[True], (e[1:] != e[:-1]) | (i[1:] != i[:-1] + 1)])
            a = np.flatnonzero(new)
            b = np.concatenate([a[1:] - 1, [len(e) - 1]])
            k = some[e[a]]
            yield doc[k], tag[k], lo[k] + i[a], lo[k] + i[b]


def _tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): rows with an id; the tag, a 64-bit hash of the text, tells apart different texts under one id.

    It is written alike for both joins, so that Spark shuffles the texts once and reads them twice.
    """
    return docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("tag"))


def repeated_ranges(docs: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, ranges): (tag, blob of (first, last) windows as 32-bit numbers) of windows that a smaller document holds too."""
    n = buckets_for(docs, BUCKET_BYTES)
    seen = shared_hashes(docs, seed_hashes, n).groupBy("doc_id").agg(F.collect_list("blob").alias("blobs"))

    def send(batches):
        for table in chunks(batches, ["doc_id", "tag", "text", "blobs"], SEND_BYTES):
            yield from segments(table, n)
        give_back()

    def settle(batches):
        yield from by_bucket(batches, resolve, most)
        give_back()

    def part(batches):
        yield from part_large(batches, n, most)

    rows, ranges = "bucket int, kind int, doc_id long, tag long, blob binary", "kind int, doc_id long, tag long, blob binary"
    sent = _tagged(docs).join(seen, "doc_id").select("doc_id", "tag", "text", "blobs").mapInArrow(send, rows)
    # Both read the same shuffle: the one resolves buckets, the other passes on those that are too large for one task.
    dealt = sent.repartitionById(n, "bucket").sortWithinPartitions("bucket")
    large = dealt.mapInArrow(part, rows).repartitionById(n, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(settle, ranges).unionByName(large.mapInArrow(settle_windows, ranges))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "blob")).alias("ranges"))


def _apply(text: bytes, blobs: list[bytes] | None) -> tuple[bytes, int, int]:
    """The kept bytes, how many go and in how many runs."""
    if not blobs:
        return text, 0, 0
    pair = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, pair[:, 0], 1)
    np.add.at(cover, np.minimum(pair[:, 1] + LENGTH, len(text)), -1)
    gone = np.cumsum(cover)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def dedup(docs: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of each row of docs (doc_id, text).

    Null texts are empty; texts under 50 bytes lose nothing. Rows that share a doc_id are one document and lose nothing to each
    other; a row whose doc_id is null has no smaller document, and is none. An empty table gives no rows.
    """
    ranges = repeated_ranges(docs, most)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def strip(batches):
        for batch in batches:
            out = []
            for doc, tag, text, blobs in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), batch["text"], batch["ranges"], strict=True):
                raw = (text.as_py() or "").encode()
                kept, gone, runs = _apply(raw, [x["blob"] for x in blobs.as_py() or () if x["tag"] == tag])
                out.append((doc, len(raw), gone, runs, kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    named = _tagged(docs).join(ranges, "doc_id", "left").select("doc_id", "tag", "text", "ranges")
    unnamed = docs.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("tag"), "text").withColumn("ranges", F.lit(None).cast("array<struct<tag:bigint,blob:binary>>"))
    return named.mapInArrow(strip, ddl).unionByName(unnamed.mapInArrow(strip, ddl))


def brute_force(texts: dict[int, str | None], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same for a few texts with a table of all strings."""
    first: dict[bytes, int] = {}
    out = {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out
