"""Record operations on plain DataFrames: requested order, upsert, delete, duplicates, latest versions, file changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ids(df: DataFrame, id_column: str, ids: list) -> DataFrame:
    """Rows in the order of `ids`, with repeats, unknown ids left out; `place` is the position from 1."""
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids, 1)], f"place bigint, {id_column} {dict(df.dtypes)[id_column]}")
    return df.join(F.broadcast(wanted), id_column).orderBy("place")


def duplicate_ids(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str]) -> DataFrame:
    """old with the rows of new: replaced rows keep the columns `keep_old` (creation time, place)."""
    columns = old.columns
    o, n = F.struct(*[F.col(c) for c in columns]).alias("o"), F.struct(*[F.col(c) for c in columns]).alias("n")
    joined = old.select(*key, o).join(new.select(*key, n), key, "full_outer")
    value = lambda c: F.when(F.col("n").isNull() | (F.col("o").isNotNull() & F.lit(c in keep_old)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return joined.select(*[value(c) for c in columns])


def insert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new together; a key that is there already, or twice in new, is an error."""
    if not old.join(new, key, "left_semi").unionByName(new.join(duplicate_ids(new, key), key, "left_semi")).isEmpty():
        raise ValueError("duplicate ids")
    return old.unionByName(new)


def delete(tables: dict[str, DataFrame], gone: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows of the keys that are gone (children follow their parents)."""
    return {name: df.join(gone.select(*key).distinct(), key, "left_anti") for name, df in tables.items()}


def restrict_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """parents without gone; an error if a child still refers to one of them."""
    if not children.join(gone, key, "left_semi").isEmpty():
        raise ValueError("still referenced")
    return parents.join(gone, key, "left_anti")


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: added, removed, changed, moved, unchanged files (path, hash). Moves are matched by hash first."""
    both = before.select("path", F.col("hash").alias("old")).join(after.select("path", F.col("hash").alias("new")), "path", "full_outer")
    same = both.agg(F.count(F.when(F.col("old") == F.col("new"), 1)).alias("unchanged"), F.count(F.when(F.col("old") != F.col("new"), 1)).alias("changed"), F.count(F.when(F.col("old").isNull(), 1)).alias("a"), F.count(F.when(F.col("new").isNull(), 1)).alias("r"))
    moved = both.where("old is null or new is null").groupBy(F.coalesce("old", "new").alias("hash")).agg(F.least(F.count("old"), F.count("new")).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("moved"))
    return same.crossJoin(moved).select((F.col("a") - F.col("moved")).alias("added"), (F.col("r") - F.col("moved")).alias("removed"), "changed", "moved", "unchanged")


def staleness(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, reason for files that make an index stale (path, size, mtime on both sides)."""
    d, i = discovered.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1")), indexed.select("path", F.col("size").alias("s2"), F.col("mtime").alias("m2"))
    reason = F.when(F.col("s2").isNull(), "new").when(F.col("s1").isNull(), "missing").when(F.col("s1") != F.col("s2"), "size").when(F.col("m1") != F.col("m2"), "time")
    return d.join(i, "path", "full_outer").select("path", reason.alias("reason")).where("reason is not null")
