"""Snapshot store: tables as Parquet in versioned folders, published by swapping one pointer file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "current.json"


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the published snapshot, or None. Names that lead out of the root are refused."""
    fs, p = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        name = json.loads(bytes(stream.readAllBytes()).decode())["snapshot"]
    finally:
        stream.close()
    if "/" in name or ".." in name:
        raise ValueError("the pointer leads out of the store")
    return f"{root}/{name}"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable[[str], DataFrame]], overwrite: bool = True, partition_by: dict[str, list[str]] | None = None) -> str:
    """Write all tables into a new snapshot, then point to it: readers see the old tables or all new ones.

    A table may be a function of the snapshot's folder, which has the tables before it by then.
    """
    if not overwrite and current(spark, root):
        raise FileExistsError(root)
    name = f"snapshot-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df = df(f"{root}/{name}") if callable(df) else df
        df.write.option("compression", "zstd").partitionBy(*(partition_by or {}).get(table, [])).parquet(f"{root}/{name}/{table}")
    fs, staged = _fs(spark, f"{root}/.{name}.json")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(json.dumps({"snapshot": name}).encode()))
    finally:
        out.close()
    _, pointer = _fs(spark, f"{root}/{POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged.makeQualified(fs.getUri(), fs.getWorkingDirectory()), pointer.makeQualified(fs.getUri(), fs.getWorkingDirectory()), options)
    return f"{root}/{name}"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    at = current(spark, root)
    if at is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{at}/{table}")


def collect_garbage(spark: SparkSession, root: str) -> int:
    """Delete snapshots that are not the current one; returns how many."""
    keep, n = current(spark, root), 0
    fs, p = _fs(spark, root)
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("snapshot-") and keep and not keep.endswith(name):
            n += bool(fs.delete(status.getPath(), True))
    return n


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders right below root, sorted."""
    fs, p = _fs(spark, root)
    return sorted(f"{root}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
