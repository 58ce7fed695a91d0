"""ISO base media containers: written from byte payloads, and described without decoding their payloads.

A container is a sequence of nested boxes. `walk` yields them, `tracks` decodes the sample tables (stts, stsc, stsz or stz2, stco or
co64, stss) and the movie fragments (tfhd, trun) of each track into codec, duration and the byte ranges of its keyframes, and
`media_columns` does so for a column.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import boxed, cut, small_batches, unboxed

#: Boxes that hold boxes. Fixed values of the format.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"})
CHUNK = 65536
RATE = 8000
PAD = 64


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """One sound track of unsigned 8-bit mono samples, one byte of the payload each."""
    n = len(payload)
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")
    mdat = box(b"mdat", payload)
    first = len(head) + len(mdat) - n
    starts = range(first, first + n, chunk)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    wide = n >= 1 << 32
    num, version = (">Q", 1) if wide else (">I", 0)
    zero = struct.pack(num, 0)
    length = struct.pack(num, n)
    runs = [(1, chunk)] if n >= chunk else []
    if n % chunk:
        runs.append((n // chunk + 1, n % chunk))
    entry = struct.pack(">6xHHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", k, per, 1) for k, per in runs)),
        full(b"stsz", struct.pack(">II", 1, n)),
        full(b"co64", struct.pack(f">I{len(starts)}Q", len(starts), *starts)) if first + n >= 1 << 32 else full(b"stco", struct.pack(f">I{len(starts)}I", len(starts), *starts)),
    )
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", zero, zero, struct.pack(">I", rate), length, struct.pack(">HH", 0x55C4, 0), version=version), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", zero, zero, struct.pack(">II", 1, 0), length, bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), matrix, bytes(8), version=version, flags=7)
    mvhd = full(b"mvhd", zero, zero, struct.pack(">I", rate), length, struct.pack(">IH", 0x10000, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=version)
    return head + mdat + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


#: Boxes are nested at most so deep; the format's own boxes are not half as deep.
DEPTH = 32


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """(path, start, body start, body end) of each box in file order.

    A box that overruns its parent, and boxes nested deeper than DEPTH, raise ValueError.
    """
    todo: list[tuple[tuple[bytes, ...], int, int]] = [((), 0, len(data))]
    while todo:
        path, start, end = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} overruns its parent")
        yield (*path, kind), start, body, stop
        todo.append((path, stop, end))
        if kind in CONTAINERS:
            if len(path) >= DEPTH:
                raise ValueError("boxes are nested too deep")
            todo.append(((*path, kind), body, stop))


def _numbers(data: bytes, at: int, stop: int, layout: str) -> tuple[int, ...]:
    """Numbers of a box, which must lie within it."""
    if at + struct.calcsize(layout) > stop:
        raise ValueError("box is cut off")
    return struct.unpack_from(layout, data, at)


def _table(data: bytes, body: int, stop: int, skip: int, width: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a table whose count stands at body + skip - 4."""
    (count,) = _numbers(data, body + skip - 4, stop, ">I")
    size = np.dtype(kind).itemsize * width
    if body + skip + count * size > stop:
        raise ValueError("table overruns its box")
    out = np.frombuffer(data, kind, count * width, body + skip)
    # What exceeds 63 bits lies outside any file.
    if out.dtype.itemsize == 8 and len(out) and int(out.max()) >= 1 << 63:
        raise ValueError("offset lies outside the file")
    return out.astype(np.int64).reshape(count, width)


def _compact_sizes(data: bytes, body: int, stop: int) -> np.ndarray:
    """The sizes of a table with 4, 8 or 16 bits for each."""
    bits, count = _numbers(data, body + 4, stop, ">3xBI")
    if bits not in (4, 8, 16) or body + 12 + (count * bits + 7) // 8 > stop:
        raise ValueError("table overruns its box")
    if bits == 4:
        pair = np.frombuffer(data, np.uint8, (count + 1) // 2, body + 12)
        return np.stack([pair >> 4, pair & 15], axis=1).reshape(-1)[:count].astype(np.int64)
    return np.frombuffer(data, np.uint8 if bits == 8 else ">u2", count, body + 12).astype(np.int64)


#: Of a sample's flags: it is no keyframe.
NOT_SYNC = 0x10000


def _fragment(data: bytes, body: int, stop: int, run: dict, defaults: dict, samples: dict) -> None:
    """Add the samples of a track run to those of its track: (offset, bytes, duration, keyframe)."""
    flags, count = _numbers(data, body, stop, ">II")
    flags &= 0xFFFFFF
    at = body + 8
    if flags & 1:
        run["at"] = run["base"] + _numbers(data, at, stop, ">i")[0]
        at += 4
    first = None
    if flags & 4:
        (first,) = _numbers(data, at, stop, ">I")
        at += 4
    names = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if at + 4 * len(names) * count > stop:
        raise ValueError("table overruns its box")
    if not names and count > len(data):
        raise ValueError("more samples than bytes")
    told = np.frombuffer(data, ">u4", len(names) * count, at).astype(np.int64).reshape(count, len(names))
    column = lambda name: told[:, names.index(name)] if name in names else np.full(count, run.get(name, defaults.get(name, 0)), np.int64)
    size, kind = column("size"), column("flags").copy()
    if first is not None and count:
        kind[0] = first
    samples["offset"].append(run["at"] + np.cumsum(size) - size)
    samples["size"].append(size)
    samples["sync"].append(kind & NOT_SYNC == 0)
    samples["duration"] += int(column("duration").sum())
    run["at"] += int(size.sum())


def tracks(data: bytes) -> list[dict]:
    """For each track: codec, handler, timescale, duration, samples, chunks and keyframes, as (offset, bytes) ranges.

    Samples of movie fragments follow those of the sample tables. Ranges that touch are joined. A track without a table of sync
    samples has keyframes only. Malformed or cut off files raise ValueError.
    """
    out: list[dict] = []
    raw: dict = {}
    defaults: dict[int, dict] = {}
    fragments: dict[int, dict] = {}
    moof, run, track = 0, {}, 0
    for path, start, body, stop in walk(data):
        kind = path[-1]
        if kind == b"trak":
            raw = {}
            out.append(raw)
        elif kind == b"tkhd":
            raw["id"] = _numbers(data, body + (20 if _numbers(data, body, stop, ">B")[0] == 1 else 12), stop, ">I")[0]
        elif kind == b"mdhd":
            wide = _numbers(data, body, stop, ">B")[0] == 1
            raw["timescale"], raw["duration"] = _numbers(data, body + (20 if wide else 12), stop, ">IQ" if wide else ">II")
        elif kind == b"hdlr" and path[-2:-1] == (b"mdia",):
            raw["handler"] = _numbers(data, body + 8, stop, "4s")[0].decode("latin-1")
        elif kind == b"stsd":
            raw["codec"] = _numbers(data, body + 12, stop, "4s")[0].decode("latin-1")
        elif kind == b"stts":
            raw["stts"] = _table(data, body, stop, 8, 2)
        elif kind == b"stsc":
            raw["stsc"] = _table(data, body, stop, 8, 3)
        elif kind == b"stsz":
            raw["size"], raw["samples"] = _numbers(data, body + 4, stop, ">II")
            if not raw["size"]:
                raw["sizes"] = _table(data, body, stop, 12, 1)[:, 0]
        elif kind == b"stz2":
            raw["sizes"] = _compact_sizes(data, body, stop)
            raw["samples"] = len(raw["sizes"])
        elif kind in (b"stco", b"co64"):
            raw["chunks"] = _table(data, body, stop, 8, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            raw["sync"] = _table(data, body, stop, 8, 1)[:, 0] - 1
        elif kind == b"trex":
            n, _, duration, size, flags = _numbers(data, body + 4, stop, ">5I")
            defaults[n] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            moof, run = start, {}
        elif kind == b"tfhd":
            flags, track = _numbers(data, body, stop, ">II")
            at = body + 8
            # A run begins where the file says, or at the fragment, or after the run before it.
            base = moof if flags & 0x20000 or "at" not in run else run["at"]
            run = {"base": base, "at": base}
            for bit, name, layout in ((1, "base", ">Q"), (2, "entry", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
                if flags & bit:
                    (run[name],) = _numbers(data, at, stop, layout)
                    at += struct.calcsize(layout)
            run["at"] = run["base"]
        elif kind == b"trun" and run:
            samples = fragments.setdefault(track, {"offset": [], "size": [], "sync": [], "duration": 0})
            _fragment(data, body, stop, run, defaults.get(track, {}), samples)
    return [_decode(x, len(data), fragments.get(x.get("id", 0))) for x in out]


def _joined(ranges: list[tuple[int, int]], n_bytes: int) -> list[tuple[int, int]]:
    """The ranges, which must lie in the file, with those that touch as one."""
    out: list[list[int]] = []
    for at, size in ranges:
        if at < 0 or at + size > n_bytes:
            raise ValueError("sample lies outside the file")
        if out and sum(out[-1]) == at:
            out[-1][1] += size
        else:
            out.append([at, size])
    return [tuple(x) for x in out]


def _decode(raw: dict, n_bytes: int, fragments: dict | None) -> dict:
    samples, chunks, stsc = raw.get("samples", 0), raw.get("chunks", np.zeros(0, np.int64)), raw.get("stsc", np.zeros((0, 3), np.int64))
    if len(stsc) and (stsc[0, 0] != 1 or (np.diff(stsc[:, 0]) <= 0).any()):
        raise ValueError("chunk table is not ascending")
    per = np.zeros(len(chunks), np.int64)
    for k, (first, count, _) in enumerate(stsc):
        per[first - 1 : stsc[k + 1, 0] - 1 if k + 1 < len(stsc) else None] = count
    first_of = np.concatenate([[0], np.cumsum(per)])
    if first_of[-1] != samples:
        raise ValueError("sample tables disagree")
    if "stts" in raw and int(raw["stts"][:, 0].sum()) != samples:
        raise ValueError("time table disagrees")
    if "sizes" in raw:
        ends = np.concatenate([[0], np.cumsum(raw["sizes"])])
        span = lambda i, j: int(ends[j] - ends[i])
    else:
        span = lambda i, j: (int(j) - int(i)) * raw.get("size", 0)
    whole = [(int(c), span(i, j)) for c, i, j in zip(chunks, first_of[:-1], first_of[1:], strict=True)]
    keys = whole
    if "sync" in raw:
        if len(raw["sync"]) and (raw["sync"].min() < 0 or raw["sync"].max() >= samples):
            raise ValueError("keyframe is no sample")
        at = np.searchsorted(first_of, raw["sync"], "right") - 1
        keys = [(int(chunks[c]) + span(first_of[c], s), span(s, s + 1)) for c, s in zip(at, raw["sync"], strict=True)]
    duration = raw.get("duration")
    if fragments:
        offset, size, sync = (np.concatenate(fragments[k]) for k in ("offset", "size", "sync"))
        more = list(zip(offset.tolist(), size.tolist(), strict=True))
        whole, keys = whole + more, keys + [x for x, s in zip(more, sync, strict=True) if s]
        samples, duration = samples + len(more), (duration or 0) + fragments["duration"]
    out = {k: raw.get(k) for k in ("codec", "handler", "timescale")}
    return out | {"duration": duration, "samples": samples, "chunks": _joined(whole, n_bytes), "keyframes": _joined(keys, n_bytes)}


def read_payload(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track, gathered chunk by chunk."""
    return b"".join(data[a : a + n] for a, n in track["chunks"])


def feature(track: dict, payload: bytes) -> str:
    """Codec, duration and keyframe ranges of the stored track, with the mean and the spread of its samples."""
    x = np.frombuffer(payload, np.uint8)
    return json.dumps({"codec": track["codec"].strip(), "timescale": track["timescale"], "duration": track["duration"], "samples": track["samples"], "keyframes": track["keyframes"], "mean": round(float(x.mean()), 6), "std": round(float(x.std()), 6)})


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes(-len(data) % PAD if data else PAD), len(data)


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """df with codec, duration (seconds), n_tracks and keyframes (offset, bytes) of each container's first picture track, or else of
    its first track.

    Null, empty or malformed containers give nulls; columns of df with these names are replaced, all others pass.
    """
    kind = pa.struct([("codec", pa.string()), ("duration", pa.float64()), ("n_tracks", pa.int32()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())])))])

    def one(data: bytes | None) -> dict | None:
        try:
            found = tracks(data or b"")
        except ValueError:
            return None
        if not found:
            return None
        t = next((x for x in found if x["handler"] == "vide"), found[0])
        return {"codec": t["codec"], "duration": t["duration"] / t["timescale"] if t["timescale"] and t["duration"] is not None else None, "n_tracks": len(found), "keyframes": [{"offset": a, "bytes": n} for a, n in t["keyframes"]]}

    @F.arrow_udf("struct<codec:string,duration:double,n_tracks:int,keyframes:array<struct<offset:bigint,bytes:bigint>>>")
    def describe(media: pa.Array) -> pa.Array:
        return pa.array([one(x.as_py()) for x in media], kind)

    told = boxed(df, describe(F.col(column)).alias("told"))
    return unboxed(told, **{c: F.col("told")[c] for c in ("codec", "duration", "n_tracks", "keyframes")})


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of docs (doc_id, text): its text as a container.

    A null text is empty; an empty text is stored as 64 zero bytes. Rows with a null or a repeated doc_id are stored like others.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def store(batches):
        for batch in batches:
            # A few rows at a time: containers of long texts would make a batch large.
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                payloads = [padded(x.as_py()) for x in part["text"]]
                columns = [part["doc_id"], pa.array([n for _, n in payloads], pa.int64()), pa.array([write_container(x) for x, _ in payloads], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return small_batches(docs).select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def describe_stored(stored: DataFrame) -> DataFrame:
    """What the containers of store_texts hold: payloads are gathered from the stored bytes by their sample tables."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("feature", pa.string())])

    def read(batches):
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"], strict=True):
                media = media.as_py()
                (track,) = tracks(media)
                back = read_payload(media, track)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), track["codec"], track["duration"] / track["timescale"], feature(track, back)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration double, feature string"
    return stored.mapInArrow(read, ddl)


def stored_texts(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): its text written as a container to the shared folder, read back and described.

    See store_texts for nulls; repeated rows give repeated rows, an empty table none.
    """
    return describe_stored(cut(store_texts(docs), "media", compression="zstd"))
