"""The fault database with versions: tables are written beside the old ones, and one commit record makes them all current.

A commit names the folder of every table. It is moved into place under a name that must not exist, so readers see a whole
version or none of it, of two writers of one version the second fails, and a job that dies leaves only files that nothing names.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.matching import upsert
from .database import write_database

RECORDS = "_commits"


class CommitConflict(RuntimeError):
    """Another writer has published this version first."""


def _hadoop(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The published versions, oldest first."""
    jvm, path, fs, _ = _hadoop(spark, folder)
    records = jvm.org.apache.hadoop.fs.Path(path, RECORDS)
    if not fs.exists(records):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(records)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def _record(spark: SparkSession, folder: str, version: int) -> dict[str, str]:
    text = spark.read.text(f"{folder.rstrip('/')}/{RECORDS}/{version:08d}.json", wholetext=True).first()[0]
    return json.loads(text)["tables"]


def load(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the latest by default; none where nothing is published yet."""
    known = versions(spark, folder)
    if not known:
        return {}
    tables = _record(spark, folder, known[-1] if version is None else version)
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{where}") for name, where in tables.items()}


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, base: int | None = None) -> int:
    """Write tables and make them current, with the other tables as they were; returns the new version.

    Tables named in keys are merged with the version before: by that column, new rows win. base: the version that the caller
    has read (the latest by default, 0 for none); if another one was published since, CommitConflict is raised and nothing
    changes. If a write fails, the version before stays current.
    """
    base = max(versions(spark, folder), default=0) if base is None else base
    before = _record(spark, folder, base) if base else {}
    data = f"data/{uuid.uuid4().hex}"
    held = load(spark, folder, base) if base else {}
    merged = {n: upsert(held[n], df, keys[n]) if keys and n in keys and n in held else df for n, df in tables.items()}
    write_database(merged, f"{folder.rstrip('/')}/{data}")
    _commit(spark, folder, base + 1, before | {n: f"{data}/{n}" for n in tables})
    return base + 1


def _commit(spark: SparkSession, folder: str, version: int, tables: dict[str, str]) -> None:
    jvm, path, fs, context = _hadoop(spark, folder)
    records = jvm.org.apache.hadoop.fs.Path(path, RECORDS)
    fs.mkdirs(records)
    draft, final = (jvm.org.apache.hadoop.fs.Path(records, n) for n in (f".{uuid.uuid4().hex}.tmp", f"{version:08d}.json"))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "tables": tables}, sort_keys=True).encode()))
    out.close()
    gateway = spark.sparkContext._gateway
    plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # without overwriting
    try:
        context.rename(draft, final, plain)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise CommitConflict(f"version {version} of {folder} was published by another writer") from e
        raise
