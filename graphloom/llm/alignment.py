"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked in the corpus.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (pieces) the text, before which it puts the space itself. Byte
offsets where a token of A and one of B both end cut the tokens into groups, and each A token of a group is linked with each B token
of it. Both tokenizers end tokens where a space follows a character that is none, so a text falls into chunks that can be encoded on
their own: a block of documents is turned into its distinct chunks, and only those are encoded, laid end to end, and aligned.

Counts are of documents, corpus-wide. A task counts the pairs of a block before anything is shuffled; blocks' counts are added by
pair and salt and then by pair. To read the counts back, a block asks for each of its distinct pairs once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import cut, give_back, join_by_weight, slices, small_batches, strings
from graphloom.llm._shared import distinct

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 4 << 20
#: Bytes of chunks that are encoded in one call of a tokenizer.
RUN = 1 << 13
#: Links of a group that are laid out one by one; a larger group counts its distinct ids first.
MOST_LINKS = 4096
#: Parts that the blocks of a pair are dealt to before they meet.
SALTS = 16
#: Blocks of a file, and of a task that tells them their counts, about.
HELD, TOLD = 8, 4
_B = 32


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable Latin-1, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Tokenizer A: ids of texts, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        first = raw.get("pre_tokenizer") or {}
        #: Whether it cuts at each space behind a character that is none, by its pattern.
        self.cuts = raw.get("normalizer") is None and first.get("type") == "ByteLevel" and bool(first.get("use_regex", True)) and not first.get("add_prefix_space")

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """Tokenizer B: ids of texts given with the space that it adds itself, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: No piece goes on with a space behind something else, so that merges don't reach over such a place.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts])


@dataclass
class Tokenized:
    """Ids of texts laid end to end, with their number in each text. Texts that a tokenizer doesn't give back as they are have none."""

    ids: np.ndarray
    sizes: np.ndarray
    ok: np.ndarray


def encode(tokens: ByteTokens | PieceTokens, data: np.ndarray, offsets: np.ndarray, joinable: np.ndarray, skipped: np.ndarray, run: int = RUN) -> Tokenized:
    """The ids of each text but the skipped ones. Those that are joinable end where a token ends whatever follows, and are encoded
    several at a time."""
    n = len(offsets) - 1
    width = np.array([len(b) for b in tokens.bytes], np.int64)
    sizes, ok = np.zeros(n, np.int64), np.zeros(n, bool)
    parts: dict[int, np.ndarray] = {}

    def take(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Encodes ranges of texts as one each; returns the texts of those that did not come back as they were."""
        again = []
        joined = [data[offsets[i] : offsets[j]].tobytes() for i, j in runs]
        for (i, j), text, ids in zip(runs, joined, tokens([t.decode() for t in joined]), strict=True):
            found = np.array(ids, np.int64)
            ends, own = np.cumsum(width[found]), offsets[i + 1 : j + 1] - offsets[i]
            last = np.searchsorted(ends, own)
            if b"".join(map(tokens.bytes.__getitem__, ids)) != text or not np.array_equal(ends[last], own):
                again += [(k, k + 1) for k in range(i, j)] if j > i + 1 else []
                continue
            ok[i:j] = True
            sizes[i:j] = np.diff(last + 1, prepend=0)
            parts[i] = found
        return again

    # Ranges of joinable texts are cut to runs; each other text is encoded alone.
    bounds = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(skipped, -2, np.where(joinable, 0, np.arange(1, n + 1))), [-3]])))
    runs = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if not skipped[i]:
            runs += [(i + x, i + y) for x, y in slices(offsets[i : j + 1], run)]
    take(take(runs))
    return Tokenized(np.concatenate([np.zeros(0, np.int64), *(parts[i] for i in sorted(parts))]), sizes, ok)


@dataclass
class Groups:
    """Groups of tokens laid end to end: tokens of each side in each group, and the text that each belongs to."""

    n_a: np.ndarray
    n_b: np.ndarray
    text: np.ndarray


def align(a: Tokenized, b: Tokenized, width_a: np.ndarray, width_b: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, Groups]:
    """(group of each A token, group of each B token, groups) of texts of these lengths in bytes, all of which both give back."""
    ends_a, ends_b = np.cumsum(width_a[a.ids]), np.cumsum(width_b[b.ids])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    count = lambda g: np.bincount(g, minlength=len(cuts))
    return group_a, group_b, Groups(count(group_a), count(group_b), np.searchsorted(np.cumsum(lengths), cuts))


def links(ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups, most: int = MOST_LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair of ids, how many links it stands for, text) of all links: each A token of a group with each B token of it."""
    start_a, start_b = np.cumsum(groups.n_a) - groups.n_a, np.cumsum(groups.n_b) - groups.n_b
    small = groups.n_a * groups.n_b <= most
    token = np.repeat(small, groups.n_a)
    times = np.repeat(groups.n_b, groups.n_a)[token]
    left = np.repeat(ids_a[token], times)
    first = np.repeat(np.repeat(start_b, groups.n_a)[token], times)
    right = ids_b[first + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)]
    text = np.repeat(np.repeat(groups.text, groups.n_a)[token], times)
    out = [(left << _B | right, np.ones(len(left), np.int64), text)]
    for g in np.flatnonzero(~small):
        x, n = np.unique(ids_a[start_a[g] : start_a[g] + groups.n_a[g]], return_counts=True)
        y, m = np.unique(ids_b[start_b[g] : start_b[g] + groups.n_b[g]], return_counts=True)
        out.append(((x[:, None] << _B | y[None]).ravel(), (n[:, None] * m[None]).ravel(), np.full(len(x) * len(y), groups.text[g])))
    pair, weight, text = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(text, kind="stable")
    return pair[order], weight[order], text[order]


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below most, left-aligned in rows with room for one more byte, and how many each has."""
    n = np.arange(most)
    size = np.ones(most, np.int64)
    width = len(str(max(most - 1, 0)))
    for k in range(1, width):
        size += n >= 10**k
    table = np.zeros((most, width + 1), np.uint8)
    for k in range(width):
        some = size > k
        table[some, k] = 48 + n[some] // 10 ** (size[some] - 1 - k) % 10
    return table, size


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def rendered(ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups, n_texts: int) -> list[bytes]:
    """Groups of each text as `a1,a2|b1;`, one after the other."""
    most = 1 << int(max(ids_a.max(initial=0), ids_b.max(initial=0)) + 1).bit_length()
    if most not in _DIGITS:
        _DIGITS[most] = _digits(most)
    table, size = _DIGITS[most]
    place_a = np.arange(len(ids_a)) + np.repeat(np.cumsum(groups.n_b) - groups.n_b, groups.n_a)
    place_b = np.arange(len(ids_b)) + np.repeat(np.cumsum(groups.n_a), groups.n_b)
    ids = np.zeros(len(ids_a) + len(ids_b), np.int64)
    ids[place_a], ids[place_b] = ids_a, ids_b
    mark = np.full(len(ids), ord(","), np.uint8)
    ends = np.cumsum(groups.n_a + groups.n_b)
    mark[ends - 1] = ord(";")
    mark[ends - groups.n_b - 1] = ord("|")
    cells, n = table[ids], size[ids]
    cells[np.arange(len(ids)), n] = mark
    flat = cells[np.arange(cells.shape[1]) <= n[:, None]].tobytes()
    per = np.zeros(n_texts, np.int64)
    if len(ends):
        np.add.at(per, groups.text, np.add.reduceat(n + 1, ends - (groups.n_a + groups.n_b)))
    at = np.concatenate([[0], np.cumsum(per)])
    return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def chunks(data: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, offsets of each row in them): rows are cut before a space behind a character that surely is no white space.

    That is an ASCII one from 33 to 126, or one of two bytes from U+00C0 on; what is behind others isn't cut. whole: nothing is. Nor
    is a row's last space, as B makes nothing of a space alone.
    """
    start = np.zeros(len(data) + 1, bool)
    if not whole and len(data) > 1:
        start[1 : len(data)] = (data[1:] == 32) & safe(data)[:-1]
        start[np.maximum(offsets[1:] - 1, 0)] = False
    start[offsets] = True
    starts = np.flatnonzero(start)
    return starts[:-1], np.searchsorted(starts, offsets)


def safe(data: np.ndarray) -> np.ndarray:
    """Whether a character that is no white space ends at a byte; false where that isn't clear."""
    out = (data > 32) & (data < 127)
    out[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return out


_TOKENS: dict[str, ByteTokens | PieceTokens] = {}


def tokens_of(kind: type, path: str) -> ByteTokens | PieceTokens:
    """The one of this Python worker."""
    if path not in _TOKENS:
        _TOKENS[path] = kind(path)
    return _TOKENS[path]


@dataclass
class Block:
    """What a block of documents needs to be told its counts: see block()."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    #: Distinct pairs, and how many documents of the block hold each.
    pair: np.ndarray
    held: np.ndarray
    #: Chunks of each document, as numbers of distinct ones, and their number in it.
    chunk: np.ndarray
    size: np.ndarray
    #: For each distinct chunk how many rows it has of these: number of the pair, how many links it stands for (empty: one each).
    link_rows: np.ndarray
    link_pair: np.ndarray
    link_weight: np.ndarray


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space before each that isn't empty."""
    size = np.diff(offsets)
    more = offsets + np.concatenate([[0], np.cumsum(size > 0)])
    out = np.full(more[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(size > 0), size)] = data
    return out, more


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes."""
    at = np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def block(data: np.ndarray, offsets: np.ndarray, a: ByteTokens, b: PieceTokens) -> Block:
    """Documents (UTF-8 bytes and offsets) encoded and aligned."""
    data, offsets = _spaced(data, offsets)
    n = len(offsets) - 1
    starts, at = chunks(data, offsets, whole=not (a.cuts and b.cuts))
    ends = np.concatenate([starts, [len(data)]])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    chunk, size = np.asarray(coded.indices).astype(np.int64), np.diff(at)
    texts, own = strings(coded.dictionary.cast(pa.large_string()))
    n_texts, lengths = len(own) - 1, np.diff(own)
    joinable = safe(texts)[np.maximum(own[1:] - 1, 0)] & (texts[np.minimum(own[:-1], len(texts) - 1)] == 32) & (lengths > 1) if len(texts) else np.zeros(n_texts, bool)
    # B would write its own sign for a space, U+2581, where the text has that sign.
    sign = np.flatnonzero((texts[:-2] == 0xE2) & (texts[1:-1] == 0x96) & (texts[2:] == 0x81))
    odd = np.zeros(n_texts, bool)
    odd[np.searchsorted(own, sign, "right") - 1] = True
    ta, tb = (encode(t, texts, own, joinable, odd) for t in (a, b))
    ok = ta.ok & tb.ok
    # Documents with a chunk that one of them doesn't give back have no tokens.
    row = np.repeat(np.arange(n), size)
    bad = np.bincount(row, ~ok[chunk], minlength=n) > 0
    chunk, row = chunk[~bad[row]], row[~bad[row]]
    size = np.where(bad, 0, size)
    keep = lambda t: Tokenized(t.ids[np.repeat(ok, t.sizes)], np.where(ok, t.sizes, 0), ok)
    ta, tb = keep(ta), keep(tb)
    width = lambda t: np.array([len(x) for x in t.bytes], np.int64)
    *_, groups = align(ta, tb, width(a), width(b), np.where(ok, lengths, 0))
    pair, weight, text = links(ta.ids, tb.ids, groups)
    told = rendered(ta.ids, tb.ids, groups, n_texts)
    per = lambda values: _sums(values[chunk], size)
    n_groups, n_links = np.bincount(groups.text, minlength=n_texts), np.bincount(text, weight, minlength=n_texts).astype(np.int64)
    pairs, number = np.unique(pair, return_inverse=True)
    # Documents that hold a pair: distinct chunks of a document, distinct pairs of a chunk, and each pair once a document.
    uses = distinct(row * max(1, n_texts) + chunk)
    own = distinct(text * max(1, len(pairs)) + number)
    own_text, own_pair = own // max(1, len(pairs)), own % max(1, len(pairs))
    first = np.searchsorted(own_text, np.arange(n_texts + 1))
    used = uses % max(1, n_texts)
    times = first[used + 1] - first[used]
    index = np.arange(times.sum()) + np.repeat(first[used] - (np.cumsum(times) - times), times)
    of = distinct(np.repeat(uses // max(1, n_texts), times) * max(1, len(pairs)) + own_pair[index])
    held = np.bincount(of % max(1, len(pairs)), minlength=len(pairs))
    at = np.concatenate([[0], np.cumsum(size)])
    flat = chunk.tolist()
    joined = [b"".join(map(told.__getitem__, flat[i:j]))[:-1] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    some = held > 0
    alive = some[number]
    renumber = np.cumsum(some) - 1
    weight = weight[alive]
    weight = weight if (weight > 1).any() else weight[:0]
    return Block(per(ta.sizes), per(tb.sizes), per(n_groups), per(n_links), joined, pairs[some], held[some], chunk, size, np.bincount(text[alive], minlength=n_texts), renumber[number[alive]], weight)


def told(x: Block, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n_best, count_sum) of each document, from the count of each pair of the block and whether it is its A id's highest."""
    weight = x.link_weight if len(x.link_weight) else 1
    of = lambda v: _sums(v[x.link_pair] * weight, x.link_rows)
    return _sums(of(best.astype(np.int64))[x.chunk], x.size), _sums(of(counts)[x.chunk], x.size)


#: Of a written block: the columns of Block, with lists as blobs where they are for tasks alone.
_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pair array<long>, held array<int>, chunk binary, size array<int>, link_rows binary, link_pair binary, link_weight binary"
_COLUMNS = [c.split()[0] for c in _BLOCK.split(", ")]


def _list(values: list | np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """One list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind or pa.int64()))


def _blob(x: np.ndarray) -> bytes:
    return x.astype(np.int64 if x.max(initial=0) >= 1 << 31 else np.int32).tobytes() + (b"8" if x.max(initial=0) >= 1 << 31 else b"4")


def _unblob(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64 if x[-1:] == b"8" else np.int32, (len(x) - 1) // int(x[-1:])).astype(np.int64)


def _encoder(path_a: str, path_b: str, size: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokens_of(ByteTokens, path_a), tokens_of(PieceTokens, path_b)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for ids, data, offsets in _gathered(batches, size):
            x = block(data, offsets, a, b)
            digest = [hashlib.sha256(g).hexdigest() if g else "" for g in x.groups]
            columns = {"block": pa.array([number]), "doc_id": _list(ids), "groups_sha256": _list(digest, pa.string())}
            columns |= {k: _list(getattr(x, k)) for k in ("n_a", "n_b", "n_groups", "n_links", "pair")}
            columns |= {k: _list(getattr(x, k), pa.int32()) for k in ("held", "size")}
            columns |= {k: pa.array([_blob(getattr(x, k))], pa.binary()) for k in ("chunk", "link_rows", "link_pair", "link_weight")}
            yield pa.RecordBatch.from_pydict({k: columns[k] for k in _COLUMNS})
            number += 1
            del x, digest, columns, data, offsets
            give_back()

    return encoded


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of consecutive documents of about `size` bytes; batches are joined and split as that asks for."""
    ids: list = []
    parts: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    held = 0
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        keys = batch.column("doc_id").to_pylist()
        for i, j in slices(offsets, size):
            new = int(offsets[j] - offsets[i])
            if ids and held + new > size:
                yield ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
                ids, parts, lengths, held = [], [], [], 0
            ids = ids + keys[i:j]
            parts.append(data[offsets[i] : offsets[j]].copy())
            lengths.append(np.diff(offsets[i : j + 1]))
            held += new
    if ids:
        yield ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def encoded_blocks(docs: DataFrame, path_a: str, path_b: str, size: int = BLOCK) -> DataFrame:
    """Blocks of docs (doc_id, text), encoded and aligned, as a written table."""
    rows = small_batches(docs.select(F.col("doc_id").cast("long"), "text"))
    return cut(rows.mapInArrow(_encoder(path_a, path_b, size), _BLOCK), "aligned", compression="zstd", at_most=HELD)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, blocks, best): in how many documents and blocks each pair is linked, and whether no other pair of its A id is in more.

    Each block has counted its own documents. Its counts meet those of other blocks with the same salt, and then all.
    """
    each = blocks.select(F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.arrays_zip("pair", "held")).alias("x"))
    part = each.groupBy("x.pair", "salt").agg(F.sum("x.held").alias("n"), F.count("*").alias("blocks"))
    total = cut(part.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("blocks").alias("blocks")), "pairs")
    # One row for each id of tokenizer A, so bounded by its vocabulary.
    top = total.groupBy(F.shiftright("pair", _B).alias("a")).agg(F.max("n").alias("top"))
    joined = total.withColumn("a", F.shiftright("pair", _B)).join(F.broadcast(top), "a")
    return joined.select("pair", "n", "blocks", (F.col("n") == F.col("top")).alias("best"))


_TOLD = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block, from its row and the counts of its pairs."""
    whole = {k: left[k].combine_chunks() for k in left.column_names}
    x = {k: whole[k].flatten() if pa.types.is_list(whole[k].type) else whole[k][0].as_py() for k in whole}
    pairs = np.asarray(x["pair"])
    order = np.argsort(np.asarray(right["pair"]))
    counts, best = np.asarray(right["n"])[order], np.asarray(right["best"].combine_chunks())[order] if len(order) else np.zeros(0, bool)
    if len(order) != len(pairs):
        raise RuntimeError(f"a block of {len(pairs)} pairs was told {len(order)} counts")
    chunk = {k: _unblob(x[k]) for k in ("chunk", "link_rows", "link_pair", "link_weight")}
    own = Block(*(np.zeros(0, np.int64) for _ in range(4)), [], pairs, np.zeros(0), chunk["chunk"], np.asarray(x["size"]).astype(np.int64), chunk["link_rows"], chunk["link_pair"], chunk["link_weight"])
    n_best, count_sum = told(own, counts, best)
    columns = {k: x[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(columns | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": x["groups_sha256"]})


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, size: int = BLOCK) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts and those that a tokenizer doesn't give back byte for byte have no tokens: zeros and ''. Repeated rows are
    documents of their own. A null doc_id stays null; further columns of docs don't pass. An empty table gives an empty one.
    """
    blocks = encoded_blocks(docs, path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"), size)
    counts = cut(pair_counts(blocks), "counts")
    asked = blocks.select(F.col("block").alias("asker"), F.explode("pair").alias("pair"))
    total, top = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    answers = join_by_weight(asked, counts, "pair", "blocks", total, top).select("asker", "pair", "n", "best")
    # A task sorts its blocks whole, so their number, not Spark's settings, says how many tasks there are.
    parts = blocks.count() // TOLD + 1
    kept = blocks.drop("held").repartition(parts, "block")
    return kept.groupBy("block").cogroup(answers.repartition(parts, "asker").groupBy("asker")).applyInArrow(_answered, _TOLD)


def token_groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, size: int = BLOCK) -> DataFrame:
    """(doc_id, groups) of each row of docs (doc_id, text): its groups as `a1,a2|b1;a3|b2,b3`, '' without tokens."""
    path_a, path_b = path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokens_of(ByteTokens, path_a), tokens_of(PieceTokens, path_b)
        for ids, data, offsets in _gathered(batches, size):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "groups": pa.array([g.decode() for g in block(data, offsets, a, b).groups])})

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(found, "doc_id long, groups string")


def linked_pairs(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, size: int = BLOCK) -> DataFrame:
    """(a, b, n, best): pairs of ids that are linked in n documents, and whether no other pair of the A id is linked in more."""
    blocks = encoded_blocks(docs, path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"), size)
    mask = F.lit((1 << _B) - 1)
    return pair_counts(blocks).select(F.shiftright("pair", _B).alias("a"), F.col("pair").bitwiseAND(mask).alias("b"), "n", "best")


def brute_force(texts: list[str | None], path_a: str, path_b: str) -> list[tuple]:
    """The columns of alignments() without the id, text by text."""
    a, b = ByteTokens(path_a), PieceTokens(path_b)
    found, counts = [], {}
    for text in texts:
        groups: list[tuple[list[int], list[int]]] = []
        if text:
            want = (" " + text).encode()
            x, y = a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
            if b"".join(a.bytes[i] for i in x) == want == b"".join(b.bytes[i] for i in y):
                now, at_a, at_b, j = ([], []), 0, 0, 0
                for i in x:
                    now[0].append(i)
                    at_a += len(a.bytes[i])
                    while at_b < at_a and j < len(y):
                        at_b += len(b.bytes[y[j]])
                        now[1].append(y[j])
                        j += 1
                    if at_a == at_b:
                        groups.append(now)
                        now = ([], [])
        pairs = [(i, j) for g in groups for i in g[0] for j in g[1]]
        for p in set(pairs):
            counts[p] = counts.get(p, 0) + 1
        found.append((groups, pairs))
    top: dict[int, int] = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for groups, pairs in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(pairs), sum(counts[p] == top[p[0]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return out
