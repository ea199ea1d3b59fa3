"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in the contracts, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, the session's checkpoint
    folder, or on one machine (as in tests) a new temporary one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: no folder is known that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
            base = spark.sparkContext.getCheckpointDir()
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written inside the scratch() blocks that are open, innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the tables that materialize() wrote in it without keep."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. In a scratch()
    block the table lives until the block's end, or with keep as long as one outside."""
    path, blocks = new_path(df.sparkSession, name), _SCRATCH.get()
    if keep:
        blocks = blocks[:-1]
    if blocks:
        blocks[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_heavy(left: DataFrame, right: DataFrame, keys: str | list[str], count: str, share: float = 1 / 256) -> DataFrame:
    """Inner join of left with right, which has one row per key and in `count` the key's rows in left.

    Keys with at least `share` of left's rows number at most 1 / share, so their rows of right are broadcast;
    the other keys are joined by a shuffle in which no key has more than that share. left is read twice.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) >= F.lit(max(2.0, total * share))
    keys = [keys] if isinstance(keys, str) else keys
    hot = right.filter(heavy)
    first = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(right.filter(~heavy), keys)
    return first.unionByName(rest)


def likely(df: DataFrame, keys: DataFrame, names: list[str], inside: bool = True, bits: int = 24) -> DataFrame:
    """The rows of df that may be among keys (or, if not inside, those that surely aren't), by a bitmap of hashes.

    As KeyFilter, but without Python on the executors: the bitmap is a broadcast table of at most 2 ** (bits - 6) words.
    df must not have columns _p, _w and _b.
    """
    place = F.pmod(F.xxhash64(*names), F.lit(1 << bits))
    words = keys.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")).alias("_b"))
    joined = df.withColumn("_p", place).withColumn("_w", F.shiftright("_p", 6)).join(F.broadcast(words), "_w", "inner" if inside else "left")
    hit = F.expr("coalesce(shiftright(_b, CAST(_p & 63 AS INT)) & 1, 0)") == F.lit(1 if inside else 0)
    return joined.filter(hit).drop("_p", "_w", "_b")


class KeyFilter:
    """A bitmap of fixed size (2 ** bits) of the keys' hashes: rows that it refuses are surely not among the keys.

    Filtering a wide table by it before a join with the keys keeps rows without a match out of the shuffle. With more
    keys than bits it lets all rows through, which costs the saving and nothing else.
    """

    def __init__(self, keys: DataFrame, names: list[str], bits: int = 25):
        place = F.pmod(F.xxhash64(*names), F.lit(1 << bits))
        words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[words["w"].to_numpy()] = words["b"].to_numpy()
        shared = keys.sparkSession.sparkContext.broadcast(table)
        self.names, self.place = names, place

        @F.pandas_udf("boolean")
        def maybe(p: pd.Series) -> pd.Series:
            at = p.to_numpy(np.int64)
            return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

        self._maybe = maybe

    def may_hold(self) -> Column:
        """Condition on a table with the key's columns."""
        return self._maybe(self.place)
