"""Graph files as DataFrames: edge lists, adjacency lists, METIS, Cassovary, binary edge lists, vertex attributes.

Malformed lines fail the query, or are dropped with mode="drop". Self-edges are dropped.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from graphloom.functions.scalars import parse_value, tokens

#: numpy types of the values in binary edge lists.
BINARY_TYPES = {"int": "i4", "uint": "u4", "short": "i2", "long": "i8", "float": "f4", "double": "f8", "char": "S1", "bool": "?"}
SPARK_TYPES = {"int": "int", "uint": "long", "short": "smallint", "long": "long", "float": "float", "double": "double", "char": "string", "bool": "boolean"}


def content_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither comments (# or %) nor blank."""
    return lines.where(~F.col("value").rlike(r"^[#%]") & (F.trim("value") != ""))


def _sound(rows: DataFrame, ok: Column, mode: str) -> DataFrame:
    ok = F.coalesce(ok, F.lit(False))
    if mode == "drop":
        return rows.where(ok)
    if mode != "fail":
        raise ValueError(f"unknown mode {mode}")
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("boolean")))


def parse_edge_list(lines: DataFrame, value: str | None = None, mode: str = "fail") -> DataFrame:
    """(src, dst[, value]) of lines (value): two ids and, for a value type, a third token; see functions.scalars.parse_value."""
    rows = content_lines(lines).withColumn("t", tokens(F.col("value")))
    src, dst = F.get("t", F.lit(0)).try_cast("long"), F.get("t", F.lit(1)).try_cast("long")
    rows = rows.withColumns({"src": src, "dst": dst})
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") >= 0) & (F.col("dst") >= 0)
    if value is None:
        return _sound(rows, ok, mode).where("src <> dst").select("src", "dst")
    rows = rows.withColumn("v", parse_value(F.get("t", F.lit(2)), value))
    return _sound(rows, ok & F.col("v").isNotNull(), mode).where("src <> dst").select("src", "dst", F.col("v").alias("value"))


def parse_adjacency(lines: DataFrame, mode: str = "fail") -> DataFrame:
    """(src, dst) of lines `src n dst1 ... dstn`; a source alone has no edges."""
    rows = content_lines(lines).withColumn("t", F.transform(tokens(F.col("value")), lambda x: x.try_cast("long")))
    n = F.size("t")
    ok = F.forall("t", lambda x: x.isNotNull()) & ((n == 1) | (F.get("t", F.lit(1)) == n - 2))
    rows = _sound(rows, ok, mode).where(F.size("t") > 2)
    out = rows.select(F.get("t", F.lit(0)).alias("src"), F.explode(F.slice("t", F.lit(3), F.size("t") - 2)).alias("dst"))
    return out.where("src <> dst")


def numbered(lines: DataFrame) -> DataFrame:
    """(file, n, value): the lines that count of (file, block, at, value), numbered from 0 within their file.

    A file is read in blocks by many tasks; `at` ascends within a block. Blocks are counted (one row each), and lines get a place from
    the counts of the blocks before theirs, so no task sees a whole file.
    """
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("lines"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1
    return lines.withColumn("k", place).join(starts, ["file", "block"]).select("file", "block", (F.col("start") + F.col("k")).alias("n"), "value")


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value) of the lines of text files, which are split among tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return rows.where(~F.endswith("file", F.lit(".tmp")))


def blocks_of(files: DataFrame, lines: int = 1000) -> DataFrame:
    """The same of whole texts (value), each taken for a file."""
    rows = files.select(F.monotonically_increasing_id().cast("string").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    return rows.select("file", F.floor(F.col("at") / lines).alias("block"), "at", "value")


def parse_metis(lines: DataFrame, base: int = 1, mode: str = "fail", loops: bool = False) -> DataFrame:
    """(src, dst) of (file, block, at, value): a header `n m [fmt]` and a line of neighbours for each vertex, which may be empty.

    Vertices and neighbours count from 1 in the file and from 0 in the result. Each undirected edge is taken once, from its smaller
    end; loops are dropped like in all formats unless asked for. base=0 takes neighbours as they stand, for files that mix both ways
    of counting. Weights are not supported.
    """
    rows = numbered(lines.where(~F.startswith("value", F.lit("%"))))
    rows = rows.withColumn("t", F.transform(tokens(F.col("value")), lambda x: x.try_cast("long")))
    head = (F.size("t").isin(2, 3)) & (F.coalesce(F.get("t", F.lit(2)), F.lit(0)) == 0)
    ok = F.forall("t", lambda x: x.isNotNull()) & ((F.col("n") > 0) | head)
    rows = _sound(rows, ok, mode).where("n > 0")
    out = rows.select((F.col("n") - 1).cast("long").alias("src"), F.explode("t").alias("x")).select("src", (F.col("x") - base).alias("dst"))
    return out.where("src <= dst" if loops else "src < dst")


def parse_cassovary(lines: DataFrame, mode: str = "fail") -> DataFrame:
    """(src, dst) of (file, block, at, value): lines `src n`, each followed by n lines with one target.

    A line with two numbers is a source, one with one is a target of the last source before it: within its block, or of the last one of
    an earlier block. A line that is neither, a target before any source and a wrong count fail, or are dropped with mode="drop" (of
    a wrong count, nothing is dropped).
    """
    rows = content_lines(lines).withColumn("t", F.transform(tokens(F.col("value")), lambda x: x.try_cast("long")))
    # Said here, as the join below says it for one of its sides alone, which would then deal the lines for itself.
    rows = rows.where("file is not null and block is not null")
    rows = _sound(rows, F.forall("t", lambda x: x.isNotNull() & (x >= 0)) & F.size("t").isin(1, 2), mode).select("file", "block", "at", "t")
    # Blocks are sorted once. Counts are places that are subtracted: of a source that another follows in its block at once, and of the
    # last one of a block from a row a block.
    own = W.partitionBy("file", "block").orderBy("at")
    rows = rows.withColumn("place", F.row_number().over(own))
    head = F.when(F.size("t") == 2, F.struct("place", F.get("t", F.lit(0)).alias("src"), F.get("t", F.lit(1)).alias("due")))
    rows = rows.withColumn("previous", F.last(head, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1)))
    if mode == "fail":
        rows = _counted(rows, F.size("t") == 2, F.col("previous"), F.col("place") - F.col("previous.place") - 1)
    rows = rows.withColumn("head", F.coalesce(head, "previous"))
    ends = rows.groupBy("file", "block").agg(F.max("head").alias("end"), F.count_if(F.col("head").isNull()).alias("lead"), F.max("place").alias("lines"))
    blocks = W.partitionBy("file").orderBy("block")
    ends = ends.withColumn("led", F.sum("lead").over(blocks.rowsBetween(W.unboundedPreceding, 0))).withColumn("final", F.lead("block").over(blocks).isNull())
    still = F.when(F.col("end").isNotNull(), F.struct("end.src", "end.due", (F.col("lines") - F.col("end.place") - F.col("led")).alias("had")))
    ends = ends.withColumn("open", still).withColumn("carried", F.last("open", ignorenulls=True).over(blocks.rowsBetween(W.unboundedPreceding, -1)))
    if mode == "fail":
        ends = _counted(ends, F.col("end").isNotNull(), F.col("carried"), F.col("led") + F.col("carried.had"))
        ends = ends.withColumn("open", F.coalesce("open", "carried"))
        ends = _counted(ends, F.col("final"), F.col("open"), F.col("led") + F.col("open.had"))
    rows = rows.join(ends.select("file", "block", F.col("carried.src").alias("carried")), ["file", "block"])
    rows = rows.select("t", F.coalesce("head.src", "carried").alias("src"), F.array_join(F.col("t").cast("array<string>"), " ").alias("value"))
    rows = _sound(rows, F.col("src").isNotNull(), mode)
    return rows.where(F.size("t") == 1).select("src", F.get("t", F.lit(0)).alias("dst")).where("src <> dst")


def _counted(rows: DataFrame, closed: Column, head: Column, had: Column) -> DataFrame:
    """rows; where one closes a source and its targets are not as many as it tells, the query fails."""
    told = F.concat(F.lit("source "), head["src"], F.lit(" tells "), head["due"], F.lit(" targets and has "), had)
    return rows.where(F.when(closed & head.isNotNull() & (head["due"] != had), F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))


def _record(value: str | None) -> np.dtype:
    return np.dtype([("src", "<u4"), ("dst", "<u4")] + ([("value", "<" + BINARY_TYPES[value])] if value else []))


def read_binary(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """(src, dst[, value]) of files of packed little-endian records of two unsigned 32-bit ids and, if given, a value.

    Files are split at records; a file whose size is no multiple of a record's fails.
    """
    record = _record(value)
    odd = [name for name, _, size in _files(spark, path, inside=True) if size % record.itemsize]
    if odd:
        raise ValueError(f"malformed file: {odd[0]} is not made of records of {record.itemsize} bytes")
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    records = context.binaryRecords(path, record.itemsize, spark.sparkContext._jsc.hadoopConfiguration())
    return parse_binary(DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark), value)


def parse_binary(rows: DataFrame, value: str | None = None) -> DataFrame:
    """The same of rows that are one record each."""
    record = _record(value)
    ddl = "src long, dst long" + (f", value {SPARK_TYPES[value]}" if value else "")

    def decode(batches):
        for batch in batches:
            column = batch.column(0)
            rows = np.frombuffer(column.buffers()[2] or b"", np.uint8)[record.itemsize * column.offset :][: record.itemsize * len(column)].view(record)
            rows = rows[rows["src"] != rows["dst"]]
            columns = [pa.array(rows["src"].astype(np.int64)), pa.array(rows["dst"].astype(np.int64))]
            if value:
                columns.append(pa.array([x.decode("latin-1") for x in rows["value"]] if value == "char" else rows["value"].astype("i8") if value == "uint" else rows["value"]))
            yield pa.RecordBatch.from_arrays(columns, ["src", "dst"] + ["value"] * bool(value))

    return rows.mapInArrow(decode, ddl)


FORMATS = ("edgelist", "multivalueedgelist", "adjlist", "metis", "cassovary", "binedgelist", "binedgelistval")


def read_graph(spark: SparkSession, path: str, file_type: str = "edgelist", value: str | None = None, mode: str = "fail", max_vertex: int | None = None) -> DataFrame:
    """Edges of a file or folder by format; folders skip names that end with .tmp."""
    if file_type not in FORMATS:
        raise ValueError(f"file_type must be one of {', '.join(FORMATS)}")
    if file_type.startswith("bin"):
        if file_type == "binedgelistval" and not value:
            raise ValueError("binedgelistval needs a value type")
        out = read_binary(spark, path, value)
    elif file_type in ("metis", "cassovary"):
        lines = text_blocks(spark, path)
        out = parse_metis(lines, mode=mode) if file_type == "metis" else parse_cassovary(lines, mode)
    else:
        lines = spark.read.text(path).where(~F.endswith(F.input_file_name(), F.lit(".tmp")))
        if file_type == "adjlist":
            out = parse_adjacency(lines, mode)
        elif file_type == "multivalueedgelist":
            out = parse_edge_list(lines, f"{value or 'int'}:list", mode)
        else:
            out = parse_edge_list(lines, value, mode)
    return out if max_vertex is None else out.where(F.greatest("src", "dst") <= max_vertex)


def _files(spark: SparkSession, path: str, inside: bool = False) -> list[tuple[str, int, int]]:
    """(name, time, size) of what a path or pattern names; with inside, of the files in the folders it names, but hidden ones."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(store.globStatus(p) or ())
    if inside:
        found = [x for s in found for x in (store.listStatus(s.getPath()) if s.isDirectory() else [s]) if not x.isDirectory() and x.getPath().getName()[0] not in "._"]
    return [(s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in found]


def cached_graph(spark: SparkSession, path: str, cache: str, file_type: str = "edgelist", value: str | None = None, check_time: bool = True, **options) -> DataFrame:
    """read_graph, kept as Parquet in a folder named after path, format and, unless check_time is off, the source's time."""
    seen = _files(spark, path) if check_time else path
    key = hashlib.sha256(repr((path, seen, file_type, value, sorted(options.items()))).encode()).hexdigest()[:24]
    to = f"{cache.rstrip('/')}/graph-{key}"
    if not _files(spark, f"{to}/_SUCCESS"):
        write_shards(read_graph(spark, path, file_type, value, **options), to)
    return spark.read.parquet(to)


def write_shards(edges: DataFrame, path: str, shards: int | None = None) -> None:
    """Parquet files by ranges of targets, each sorted by source, target."""
    dealt = edges.repartitionByRange(shards, "dst") if shards else edges.repartitionByRange("dst")
    dealt.sortWithinPartitions("src", "dst").write.mode("overwrite").option("compression", "zstd").parquet(path)


def delete_shards(spark: SparkSession, path: str) -> bool:
    """Delete a folder that write_shards or cached_graph made."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def parse_attributes(lines: DataFrame) -> DataFrame:
    """(id, attrs variant) of (file, block, at, value): an array with one element a line, whose places are the vertex ids.

    The brackets stand on lines of their own or beside the first and the last element; each element but the last has a comma.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\[\s*", ""), r"\s*(,|\]\s*)$", "")
    rows = numbered(lines.select("file", "block", "at", bare.alias("value")).where("value <> ''"))
    attrs = F.parse_json("value")
    return rows.select(F.col("n").cast("long").alias("id"), F.when(~F.is_variant_null(attrs), attrs).alias("attrs"))


def _blockwise(rows: DataFrame, measure: Column, name: str) -> DataFrame:
    """rows (file, block, at, ...) with `name`, the sum of a measure over the rows before each in its file.

    Blocks are summed up (one row each), and a row gets what its block's rows before it add to the blocks before its own.
    """
    rows = rows.withColumn("__m", measure)
    sums = rows.groupBy("file", "block").agg(F.sum("__m").alias("__s"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("file", "block", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    own = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum("__m").over(own), F.lit(0))
    return rows.withColumn(name, within).join(starts, ["file", "block"]).withColumn(name, F.col(name) + F.col("__s")).drop("__m", "__s")


def array_elements(fragments: DataFrame) -> DataFrame:
    """(file, n, value): the elements, as text, of JSON arrays given as (file, block, at, value), cut at each comma.

    An array may be written in any form, on one line or many. Where a fragment begins, inside a string or not, is told by the quotes
    before it, and how deep it begins by the brackets before it that stand outside of strings; both are sums over fragments. An
    element begins with a fragment that stands at depth 1 outside of strings. Files that hold something else than an array fail.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(plain, '"')
    # Brackets outside of strings, for a fragment that begins outside (0) or inside (1) of one.
    outside = lambda s: F.array_join(F.filter("parts", lambda x, i: i % 2 == s), "")
    depth = lambda x: F.regexp_count(x, F.lit(r"[\[{]")) - F.regexp_count(x, F.lit(r"[\]}]"))
    told = fragments.withColumn("parts", parts).select("file", "block", "at", "value", (F.size("parts") - 1).alias("quotes"), depth(outside(0)).alias("d0"), depth(outside(1)).alias("d1"))
    told = _blockwise(told, F.col("quotes"), "quoted").withColumn("inside", F.col("quoted") % 2)
    told = _blockwise(told.withColumn("change", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))), F.col("change"), "depth")
    starts = ((F.col("inside") == 0) & (F.col("depth") == 1)).cast("int")
    told = _blockwise(told.withColumn("starts", starts), F.col("starts"), "n").withColumn("n", F.col("n") + F.col("starts"))
    ends = F.col("depth") + F.col("change") == 0
    whole = told.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("f"), F.bool_or(ends).alias("last"))
    text = F.array_join(F.transform("f", lambda x: x["value"]), ",")
    opened = F.when(F.col("n") > 0, text).when(text.rlike(r"^\s*\["), F.regexp_replace(text, r"^\s*\[", "")).otherwise(F.raise_error(F.concat(F.lit("not an array: "), F.substring(text, 1, 80))))
    closed = whole.select("file", "n", "last", opened.alias("value"))
    value = F.trim(F.when(F.col("last"), F.regexp_replace("value", r"\]\s*$", "")).otherwise(F.col("value")))
    # An empty array has one fragment, which is no element.
    return closed.select("file", "n", F.regexp_replace(value, r"^\s+|\s+$", "").alias("value")).where("not (n = 0 and value = '')")


def comma_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value) of text files cut at each comma; files are split among tasks wherever a comma stands."""
    rows = spark.read.option("lineSep", ",").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read_attributes(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """(id, attrs variant) of vertices; null elements have null attributes. Files are split among tasks. Layouts:

    "array": a JSON array in any form, whose places are the ids; an element must fit a variant.
    "array_lines": the same with one element a line, which takes fewer steps.
    "lines": JSON objects, one a line, whose key `id` is the vertex and the rest of which are its attributes.
    """
    if layout == "array":
        attrs = F.parse_json("value")
        return array_elements(comma_blocks(spark, path)).select(F.col("n").cast("long").alias("id"), F.when(~F.is_variant_null(attrs), attrs).alias("attrs"))
    if layout == "array_lines":
        return parse_attributes(text_blocks(spark, path))
    if layout != "lines":
        raise ValueError("layout must be array, array_lines or lines")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("attrs"))
    return rows.select(F.variant_get("attrs", "$.id", "long").alias("id"), "attrs")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
