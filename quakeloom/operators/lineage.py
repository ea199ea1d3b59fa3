"""Cutting lineage in iterative jobs by tables in the shared folder, and numbering without a single task."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds after which the next cut has the driver collect its garbage, and when that was done last.
COLLECT_S = 15.0
_collected = [0.0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the session's checkpoint folder, which all executors see: spark.checkpoint.dir, or where that is
    unset, on one machine (as in tests) a new temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir is not set: no folder is known that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return f"{sc.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def join_by_measured_sizes(spark: SparkSession) -> None:
    """From now on the session broadcasts a table for its size only once that is measured, not by the estimate before.

    The estimate is the size of compressed files, before rows are repeated for cells or copies, so tables of 600,000 rows were
    taken for small ones and filled the driver. Where adaptive execution is off there is no measured size, and nothing changes.
    """
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if spark.conf.get("spark.sql.adaptive.enabled") != "true" or most.startswith("-"):
        return
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the checkpoint folder and read back.

    Later plans start from the table and its real size. A checkpoint would carry the estimated size of all the joins before
    on, which in a loop grows to numbers of many digits, and joins of small tables would be planned as large ones.

    Plans of rounds that are over are garbage in the driver, which would let its heap grow to the limit first, and keep the
    shuffle files that belong to them; so it collects that at times.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    if time.monotonic() - _collected[0] > COLLECT_S:
        df.sparkSession.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """df with its rows' numbers 1, 2, ... in the order of the columns `order`, which must tell rows apart.

    Rows are dealt by ranges of the order, numbered within each range, and moved on by the counts of the ranges before.
    """
    p = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = p.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return p.withColumn(name, inside).join(ends, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
