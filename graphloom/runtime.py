"""Where intermediate tables go, and small helpers on DataFrames."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset a local session gets a temporary folder; on a cluster
    that fails, as no folder of one machine will do."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # The setting can't be changed in a running session, so the folder is kept here.
        found = _own.get(spark.sparkContext.applicationId)
        if not found:
            found = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


#: Folders of local sessions that have none.
_own: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder belongs to it
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: str | Column, index: str = "index", total: str | Column | None = None, running: str = "running") -> DataFrame:
    """df with its place (from 0) in a global order, and the running sum of `total` up to and with each row.

    No single task sees all rows: the table is range-partitioned and written once, each part is counted, and the driver hands each
    part the counts of those before it (one number a part).
    """
    value = F.lit(0) if total is None else F.col(total) if isinstance(total, str) else total
    parts = table(df.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__sum"))
    own = W.partitionBy("__part").orderBy(*order)
    out = parts.join(F.broadcast(starts), "__part").withColumn(index, (F.row_number().over(own) - 1 + F.col("__rows")).cast("long"))
    if total is not None:
        out = out.withColumn(running, F.sum("__v").over(own.rowsBetween(W.unboundedPreceding, 0)) + F.col("__sum"))
    return out.drop("__part", "__v", "__rows", "__sum")
