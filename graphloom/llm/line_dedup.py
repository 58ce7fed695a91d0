"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table (h, n_docs, last_doc), sorted by h: the hashes that its batch was the first to hold. `LineRuns` keeps runs on
levels. Each batch of lines is counted by hash and merge-anti-joined with all runs; what no run holds is added as a run of level
0, and `fanout` runs of a level are merged into one run of the next. As runs hold different hashes, merging needs no
aggregation. What a run does hold, the batch's repeats, is the rest of the batch against the run it added. Only repeats are ever
summed, so a line that one batch alone holds is counted once and never moved again but by merges.

`drop_repeated_lines` loads a table batch by batch and rewrites the texts that lose lines.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Its hash is the MD5 of the key's
bytes read as Latin-1 and lower-cased, which is one to one on valid UTF-8: continuation bytes stay as they are, and the number
of those tells which lead byte stood before them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._common import boxed, cut, files, join_by_weight, new_path, unboxed

#: White space that is stripped: a fixed set of the contract.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
#: Batches that a table is loaded in: at least so many, and one for so many documents; and runs of a level that are merged.
BATCHES, BATCH_DOCS, FANOUT = 4, 50_000_000, 3


def line_hash(line: Column) -> Column:
    """16 bytes that equal lines (by key) share."""
    stripped = F.btrim(line, F.lit(BLANKS))
    return F.unhex(F.md5(F.encode(F.lower(F.decode(F.encode(stripped, "UTF-8"), "ISO-8859-1")), "ISO-8859-1")))


def long_line(line: Column, min_chars: int) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) >= min_chars


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs of line hashes in a folder, one subfolder a run, on levels; the driver holds the names of runs only.

    Runs are disjoint by hash. `repeated` names the batches that held hashes of earlier runs: (batch, the run it added). With a path of
    one's own the index lasts: each batch ends with a manifest in the folder, and whoever opens the folder goes on from the newest
    that was written whole, so a batch whose driver died may be added again.
    """

    SCHEMA = "h binary, n_docs bigint, last_doc bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "line-runs"), fanout
        self.levels: list[list[tuple[str, int]]] = [[]]
        self.repeated: list[tuple[str, str]] = []
        self.made = 0
        self.lasting = path is not None
        if self.lasting:
            self._open()

    def _open(self) -> None:
        """Go on from the newest manifest whose marker is written, if there is one."""
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = Path(self.path)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in store.listStatus(folder)] if store.exists(folder) else []
        whole = sorted(p.getName() for p in found if p.getName().startswith("manifest-") and store.exists(Path(p, "_SUCCESS")))
        if not whole:
            return
        state = json.loads(self.spark.read.text(f"{self.path}/{whole[-1]}").first().value)
        self.levels = [[(f"{self.path}/{name}", most) for name, most in level] for level in state["levels"]]
        self.repeated = [(f"{self.path}/{batch}", f"{self.path}/{run}") for batch, run in state["repeated"]]
        self.made = state["made"]

    def _save(self) -> None:
        """Write what runs there are, by names in the folder, which so may be moved."""
        name = lambda path: path.rsplit("/", 1)[1]
        state = {"levels": [[(name(p), n) for p, n in level] for level in self.levels], "repeated": [(name(b), name(r)) for b, r in self.repeated], "made": self.made}
        rows = self.spark.range(1, numPartitions=1).select(F.lit(json.dumps(state)).alias("value"))
        rows.write.mode("overwrite").text(f"{self.path}/manifest-{self.made:08d}")

    def runs(self) -> list[str]:
        return [path for level in self.levels for path, _ in level]

    def _write(self, rows: DataFrame, name: str, most: int) -> tuple[str, int]:
        """The path of a run of at most `most` rows, and that number."""
        path = f"{self.path}/{name}-{self.made:05d}"
        self.made += 1
        rows.select("h", "n_docs", "last_doc").coalesce(files(most)).sortWithinPartitions("h").write.mode("overwrite").option("compression", "snappy").parquet(path)
        return path, most

    def read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows (with a column h) whose hash no run holds: a merge anti-join with each run."""
        for path in self.runs():
            rows = rows.join(self.read(path).select("h").hint("merge"), "h", "left_anti")
        return rows

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (h, doc_id), a table that is cheap to read; no document may be in two batches. Rows without doc_id don't
        count."""
        self._add(lines)
        if self.lasting:
            self._save()

    def _add(self, lines: DataFrame) -> None:
        most = lines.count()
        per_doc = lines.where("doc_id is not null").groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
        batch = self._write(per_doc.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")), "batch", most)
        if not self.runs():
            self.levels[0].append(batch)
            return
        run = self._write(self.unseen(self.read(batch[0])), "L0", most)
        self.levels[0].append(run)
        self.repeated.append((batch[0], run[0]))
        self.compact()

    def compact(self) -> None:
        """While a level has `fanout` runs, merge them into one run of the next level."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                # Sorted parts of one range of hashes from each run: a merge of sorted files.
                self.levels[level + 1].append(self._write(self.read(*(path for path, _ in merged)).repartition("h"), f"L{level + 1}", sum(n for _, n in merged)))
            level += 1

    def repeats(self) -> DataFrame:
        """Rows of batches whose hash an earlier batch held."""
        out = self.read()
        for batch, run in self.repeated:
            out = out.unionByName(self.read(batch).join(self.read(run).select("h").hint("merge"), "h", "left_anti"))
        return out

    def counted(self, min_docs: int) -> DataFrame:
        """(h, n_docs, last_doc) over all batches, of the hashes that at least min_docs documents hold."""
        again = self.repeats().groupBy("h").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later"))
        return (
            self.read(*self.runs())
            .join(again.hint("merge"), "h", "left")
            .select("h", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))
            .where(F.col("n_docs") >= min_docs)
        )


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(batch, doc_id, text_hash, pos, h) of the lines that count; documents are dealt to batches by a hash of doc_id."""
    line = F.posexplode(F.transform(split_lines(F.col("text")), lambda x: F.when(long_line(x, min_chars), line_hash(x)))).alias("pos", "h")
    return (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), line)
        .where("h is not null")
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "text_hash", "pos", "h")
    )


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """(doc_id, text_hash, drops): the numbers of the lines that a document loses, for documents that lose any.

    By default a batch is of BATCH_DOCS documents at most, about, so that its size does not grow with the table's.
    """
    spark = docs.sparkSession
    batches = batches or max(BATCHES, -(-docs.count() // BATCH_DOCS))
    lines = cut(long_lines(docs, min_chars, batches), "long-lines")
    runs = LineRuns(spark)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k).select("h", "doc_id"))
    total = lines.count()
    hot = cut(runs.counted(min_docs), "hot-lines", total // min_docs)
    # A hash that many documents hold would gather in one task of a shuffle; there are few such hashes, and they are broadcast.
    found = join_by_weight(lines.select("doc_id", "text_hash", "pos", "h"), hot, "h", "n_docs", total)
    return found.where(F.col("doc_id") < F.col("last_doc")).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drops"))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) of each row of docs, which is a struct; see drop_repeated_lines."""
    drops = repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches).select(F.struct("doc_id", "text_hash").alias("key"), "drops")
    named = boxed(docs.where("doc_id is not null"), F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key")).join(drops, "key", "left").drop("key")
    # Rows without doc_id stay out of the shuffle: they may be many, and have one key.
    both = named.unionByName(boxed(docs.where("doc_id is null"), F.lit(None).cast("array<int>").alias("drops")))
    text, lost = F.coalesce(F.col("row")["text"], F.lit("")), F.col("drops")
    # An array of one element, so that a lambda names the lines and they are split once, not for each place.
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    rest = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(places(lines), lambda i: F.get(lines, i)), "\n"))[0]
    return both.select(
        "row",
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(lost.isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long").alias("n_dropped"),
        F.when(lost.isNull(), text).otherwise(rest).alias("kept_text"),
    )


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; columns of docs with these names are replaced, all others pass as they are.

    A key of at least min_chars code points found in at least min_docs documents stays only in the largest doc_id that holds
    it (all its lines there). A null or empty text is one empty line and stays empty. Rows that share a doc_id are one
    document; a row whose doc_id is null counts for no key and loses no line. An empty table gives an empty table.
    """
    return unboxed(kept_lines(docs, min_chars, min_docs, batches), **{c: F.col(c) for c in ("n_lines", "n_dropped", "kept_text")})
