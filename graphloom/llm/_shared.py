"""Which hashes of a document does another document have too? Asked without sending every occurrence.

Documents are read in chunks. What two documents of a chunk share is known at once; for each other hash a chunk asks one question,
(hash, document), however often it saw it, so a hash that a third of all documents hold costs one row a chunk. Questions are
dealt to buckets by ranges of the hash, packed with 6 bytes a hash; a bucket answers those asked for two documents or more. Answers
are rows (doc_id, blob of 6-byte hashes). Hashes must be even over all 64 bits; false agreement of the 48 that are kept can only
add shared hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import give_back, slices, small_batches, strings

_U = np.uint64
#: A chunk ends after so many bytes of text or so many rows (which must fit 16 bits).
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 60_000
#: Bytes that are hashed at once: their arrays stay in a core's cache.
SLICE = 1 << 17
_DOC, _HASH = _U(0xFFFF), _U((1 << 48) - 1)
QUESTION, ANSWER, META = 0, 1, 2
#: (data, offsets) of some rows -> (hashes, row of each, what to tell about each row or None).
Hasher = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, list[bytes] | None]]
ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("blob", pa.binary())])


def size_of(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df: for a table, those of its files. Where it knows none, or multiplies sides of a join,
    the bytes of the texts are counted."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected < 1 << 40:
        return expected
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def buckets_for(df: DataFrame, bytes_each: int = 4 << 20) -> int:
    """So many buckets that each is of about bytes_each of input, whatever the size."""
    return max(16, size_of(df) // bytes_each)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct elements of x, which is sorted in place. Numbers sort faster, and in less memory, than they hash."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def bucket_of(h48: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of 48-bit hashes as buckets: ascending with the hash."""
    return (h48 >> _U(16)) * _U(buckets) >> _U(32)


def pack48(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8")[:, 0]


def by_group(keys: np.ndarray, values: np.ndarray, width: int = 6) -> tuple[np.ndarray, pa.Array]:
    """Distinct keys of sorted keys and for each the packed values."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    data = pack48(values)
    offsets = np.concatenate([first, [len(keys)]]).astype(np.int64) * width
    blobs = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return keys[first], blobs.cast(pa.binary())


def chunks(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of about `limit` bytes of text, or CHUNK_ROWS rows."""
    held, size, rows = [], 0, 0
    for batch in batches:
        batch = batch.select(columns)
        offsets = strings(batch["text"])[1]
        for i, j in slices(offsets, limit):
            for a in range(i, j, CHUNK_ROWS):
                b = min(j, a + CHUNK_ROWS)
                n = int(offsets[b] - offsets[a])
                if held and (size + n > limit or rows + b - a > CHUNK_ROWS):
                    yield pa.Table.from_batches(held)
                    held, size, rows = [], 0, 0
                held.append(batch.slice(a, b - a))
                size, rows = size + n, rows + b - a
    if held:
        yield pa.Table.from_batches(held)


def ask(table: pa.Table, of: Hasher, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk: its questions, what it knows by itself, and what is told about each row."""
    data, offsets = strings(table["text"])
    ids = table["doc_id"].to_numpy()
    docs, doc_of = np.unique(ids, return_inverse=True)
    doc_of = doc_of.astype(_U)
    keys, told = [np.zeros(0, _U)], []
    for i, j in slices(offsets, SLICE):
        h, rows, about = of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        keys.append((h & ~_DOC) | doc_of[i:j][rows])
        told.extend(about or ())
    if told:
        at = (ids % buckets).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(ids), META, np.int32)), pa.array(ids), pa.array(told, pa.binary())], schema=ROWS)
    key = distinct(np.concatenate(keys))
    del keys, data
    if not len(key):
        return
    h = key >> _U(16)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    more = np.concatenate([~first[1:], [False]]) | ~first
    # (document, hash) again as one number each, the other way round.
    known = ((key[more] & _DOC) << _U(48)) | h[more]
    known.sort()
    d, blobs = by_group((known >> _U(48)).astype(np.int64), known & _HASH)
    del known, more
    if len(d):
        yield pa.RecordBatch.from_arrays([pa.array((docs[d] % buckets).astype(np.int32)), pa.array(np.full(len(d), ANSWER, np.int32)), pa.array(docs[d]), blobs], schema=ROWS)
    key, h = key[first], h[first]
    bucket = bucket_of(h, buckets)
    # Within each bucket by document: bucket, document and place in one number. A chunk of more than one document has under 2**24
    # hashes, and one of a long document is in order.
    order = np.arange(len(key), dtype=_U)
    if len(docs) > 1:
        order |= ((bucket - bucket[0]) << _U(40)) | ((key & _DOC) << _U(24))
        order.sort()
        order &= _U((1 << 24) - 1)
    order = order.astype(np.int64)
    h, doc = h[order], (key[order] & _DOC).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        d = doc[a:b]
        at = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [b - a]])
        out.append(b"".join((np.uint32(len(at) - 1).tobytes(), docs[d[at[:-1]]].astype("<i8").tobytes(), np.diff(at).astype("<u4").tobytes(), pack48(h[a:b]))))
    n = len(out)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(out, pa.binary())], schema=ROWS)


def answer(blobs: list[bytes]) -> pa.RecordBatch | None:
    """The answers of one bucket, whose list is emptied: for each document its hashes that another one asked for too."""
    heads = [int(np.frombuffer(blob, "<u4", 1)[0]) for blob in blobs]
    ids = np.concatenate([np.frombuffer(blob, "<i8", n, 4) for blob, n in zip(blobs, heads, strict=True)])
    counts = np.concatenate([np.frombuffer(blob, "<u4", n, 4 + 8 * n) for blob, n in zip(blobs, heads, strict=True)])
    # The documents as numbers in ascending order of their ids, which take half the room.
    docs, number = np.unique(ids, return_inverse=True)
    h, at = np.empty(int(counts.sum()), _U), 0
    for n in heads:
        part = unpack48(blobs.pop(0)[4 + 12 * n :])
        h[at : at + len(part)] = part
        at += len(part)
    doc = np.repeat(number.astype(np.int32), counts)
    del ids, counts, number
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    two = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    keep = np.repeat(two, np.diff(first, append=len(h)))
    doc, h = doc[keep], h[keep]
    del keep, first, two
    if not len(doc):
        return None
    order = np.argsort(doc)
    d, packed = by_group(doc[order], h[order])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), ANSWER, np.int32)), pa.array(docs[d]), packed], schema=pa.schema(list(ROWS)[1:]))


def by_bucket(batches: Iterator[pa.RecordBatch], finish: Callable[[list[bytes]], pa.RecordBatch | None], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: those with an answer pass, the questions of each bucket are finished together.

    The questions of a bucket of more than `most` bytes are left to others.
    """
    current, held, size = None, [], 0
    for batch in batches:
        kinds = batch["kind"].to_numpy()
        passing = np.flatnonzero(kinds != QUESTION)
        if len(passing):
            yield batch.select([f.name for f in batch.schema if f.name != "bucket"]).take(pa.array(passing))
        asked = np.flatnonzero(kinds == QUESTION)
        numbers = batch["bucket"].to_numpy()
        for i in asked:
            if numbers[i] != current:
                if held and (out := finish(held)) is not None:
                    yield out
                current, held, size = numbers[i], [], 0
            blob = batch["blob"][int(i)].as_py()
            size += len(blob)
            if most is not None and size > most:
                held = []
            else:
                held.append(blob)
    if held and (out := finish(held)) is not None:
        yield out


def shared_hashes(docs: DataFrame, of: Hasher, buckets: int | None = None) -> DataFrame:
    """(kind, doc_id, blob) for docs (doc_id, text): kind ANSWER, a part of the hashes that the document shares with others;
    kind META, what the hasher tells about the row. Rows whose doc_id is null are left out; rows that share one are one document.
    """
    n = buckets or buckets_for(docs)

    def asking(batches):
        for table in chunks(batches, ["doc_id", "text"]):
            yield from ask(table, of, n)
        give_back()

    def answering(batches):
        yield from by_bucket(batches, answer)
        give_back()

    asked = small_batches(docs).select("doc_id", "text").where("doc_id is not null").mapInArrow(asking, "bucket int, kind int, doc_id long, blob binary")
    # A bucket a partition: hashing bucket numbers would put several into one and none into another.
    return asked.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(answering, "kind int, doc_id long, blob binary")
