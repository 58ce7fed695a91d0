"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import new_path

_U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


#: Bytes of a batch that Python gets, which is held several times over; and what the session has if nobody has set it.
BATCH_BYTES, DEFAULT_BYTES = "4m", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Python batches of BATCH_BYTES at most, unless it was told a size."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", DEFAULT_BYTES) == DEFAULT_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def give_back() -> None:
    """Return freed memory to the system, for other processes of the machine; a worker that waits for its next task keeps none."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that has it
        return


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(spark: SparkSession) -> None:
    """Let Spark drop what past rounds of a loop broadcast and shuffled, which it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a file, and the least number of files, where the number of rows is known beforehand.
FILE_ROWS, LEAST_FILES = 250_000, 8


def cut(df: DataFrame, name: str, rows: int | None = None, compression: str = "snappy", at_most: int = 0) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    rows: df has at most so many, which are narrow. They are written to files of about FILE_ROWS instead of one for each partition.
    at_most: of rows that are megabytes each no file gets more, as writer and reader hold a file's first hundred rows at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if rows is not None:
        df = df.coalesce(files(rows))
    # Ids and hashes do not compress, and zstd's contexts take native memory of each writer: it is for texts and tokens.
    df.write.option("compression", compression).option("maxRecordsPerFile", at_most).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(rows: int) -> int:
    return max(LEAST_FILES, rows // FILE_ROWS)


#: At most so many keys are broadcast by join_by_weight, and none of fewer rows than LIGHT.
HEAVY, LIGHT = 20_000, 1_000


def join_by_weight(rows: DataFrame, keys: DataFrame, on: str | list[str], weight: str, total: int, top: int | None = None) -> DataFrame:
    """The inner join of rows with keys (one row a key), where `weight` is at most the number of rows that have the key.

    Keys of more than total / HEAVY rows would gather in few tasks. They are broadcast: as weights sum up to at most total, there are
    fewer than HEAVY. The rest is joined by a shuffle that no such key takes part in. keys is read up to four times: it should be
    a written table, or cheap to make. top: the largest weight, or more, where that is known.
    """
    limit = max(total // HEAVY, LIGHT)
    if (top if top is not None else keys.agg(F.max(weight)).first()[0] or 0) <= limit:
        return rows.join(keys, on)
    names = [on] if isinstance(on, str) else on
    many, few = F.broadcast(keys.where(F.col(weight) > limit)), keys.where(F.col(weight) <= limit)
    return rows.join(many, on).unionByName(rows.join(many.select(*names), on, "left_anti").join(few, on))


def boxed(df: DataFrame, *own: Column) -> DataFrame:
    """df with each row as one struct `row` beside columns of the operator's own, which so can't clash with those of df."""
    return df.select(F.struct("*").alias("row"), *own)


def unboxed(df: DataFrame, **added: Column) -> DataFrame:
    """The rows that boxed() held, with columns added; a column of the same name is replaced where it stands."""
    if not added:
        return df.select("row.*")
    # In two steps: a name that is added could stand for a column of df in an expression of the same step.
    df = df.select("row", F.struct(*(c.alias(n) for n, c in added.items())).alias("added"))
    names = df.schema["row"].dataType.names
    return df.select(*(F.col("added" if n in added else "row")[n].alias(n) for n in dict.fromkeys([*names, *added])))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(m, b, _U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a hash over all 64 bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of (data[k] + 1) * BASE**k over i <= k < j."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data))[0], out=out[1:])
    return out


def gram_hash(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram from a prefix hash; empty if there are fewer than k symbols."""
    n = len(c) - k
    if n <= 0:
        return np.zeros(0, _U)
    return mix((c[k:] - c[:n]) * powers(n)[1])


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and len + 1 offsets into them."""
    # The system's allocator gives memory back to other workers.
    pa.set_memory_pool(pa.system_memory_pool())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each element of rows given by offsets, its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def records(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
