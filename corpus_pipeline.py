"""Corpus pipeline: quality, repeated lines, near copies, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Any column may hold nulls, texts may be empty or very long, rows may repeat, and
the table may be empty or have more columns, which pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, line_dedup, ngram_join, packing, quality
from graphloom.llm._common import boxed, new_path, read, unboxed


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1, unchanged; a null or empty text has the score of the labels' shares.

    The classifier is fitted on labelled rows that the query's split leaves for it.
    """
    labels = read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return unboxed(quality.score(boxed(docs, F.col("text").alias("text")), model).where("predicted = 1").select("row"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeats of lines; n_chars, where docs has it, follows the text of those that lose lines.

    Null texts stay null, rows with a null doc_id lose nothing, and rows that share a doc_id are one document.
    """
    found = line_dedup.kept_lines(docs)
    lost = F.col("n_dropped") > 0
    row = F.col("row").withField("text", F.when(lost, F.col("kept_text")).otherwise(F.col("row")["text"]))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(lost, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"]))
    return unboxed(found.select(row.alias("row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, unchanged: that with the smallest doc_id, all its rows if it has several.

    Texts without words and rows with a null doc_id have no copies and stay.
    """
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item, unchanged; null texts are not."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that the documents are packed into; a null text is its end token, a null source a queue of its own."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_copies", drop_near_copies), ("benchmark", drop_contaminated), ("packing", pack)]

#: The classifier, the tokenizer and the packing cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what each keeps is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
