"""Incremental ingest: new files of a folder are merged into a bucketed table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.records import latest, upsert
from siltstone.session import cut_lineage
from siltstone.sources import store

BUCKETS = 256


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def records(spark: SparkSession, root: str) -> DataFrame:
    """The merged rows: every bucket has a store of its own."""
    found = [store.read(spark, at, "records") for at in store.folders(spark, root) if store.current(spark, at)]
    if not found:
        raise FileNotFoundError(root)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def merge_stream(spark: SparkSession, source: str, schema: T.StructType, root: str, key: list[str], version: str, keep_old: list[str], checkpoint: str, buckets: int = BUCKETS):
    """Start a query that upserts the rows of new Parquet files into the table at `root` and stops when all are in.

    A batch rewrites only the buckets of its own keys. One that is repeated after a failure gives the same table, since
    rows are replaced by key. `buckets` must stay the same for a table: its size over `buckets` is what a rewrite costs.
    """

    def merge(batch: DataFrame, _: int) -> None:
        new = cut_lineage(latest(batch, key, [F.desc(version)]).withColumn("_bucket", _bucket(key, buckets)))
        for b in sorted(r[0] for r in new.select("_bucket").distinct().collect()):  # at most `buckets`
            at, own = f"{root}/bucket={b}", new.where(F.col("_bucket") == b).drop("_bucket")
            known = store.current(spark, at)
            store.publish(spark, at, {"records": upsert(store.read(spark, at, "records"), own, key, keep_old) if known else own})
            store.collect_garbage(spark, at)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream by event-time window and kind, with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select("w.start", kind, "n")
