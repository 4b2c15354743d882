"""Problem 7: mix sources to target shares of the total size by weighted fair queueing.

The documents of a source are shuffled by a hash and queue one after the other, as often as the source may be repeated.
A document's virtual finish time is the source's tokens up to its end, divided by the source's weight. Documents are
taken in the order of that time until the total is reached. Running sums are two-level (hash ranges, then inside a
range), so that a hot source isn't summed in one task; the cut through the global order is found on a histogram over
ranges of the time, and only the one range that holds it is sorted row by row.

Without a given total, a mix is made as large as its scarcest source allows at exact shares.

Defined results: documents with a null source, one outside the mix or without tokens take no part; a target without
documents gets the actual share 0 and the others share the total by their weights; a source that runs out after
max_repeats rounds leaves its rest to the others. Null or non-positive shares and repeats take no part. Repeated rows
(two rows with one doc_id) count as documents of their own. The last document is only taken if it fits the total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import cut_lineage

RANGES, BINS, SEED = 1024, 4096, 7


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull()).select("mix_name", "source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats"))


def queue_positions(sizes: DataFrame, seed: int = SEED, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, upto: tokens of the source up to the document's end), (source, source_tokens)."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    placed = sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens", place.alias("place"))
    placed = placed.withColumn("range", (F.col("place") / F.lit(2.0**63) * ranges).cast("int"))
    sums = placed.groupBy("source", "range").agg(F.sum("n_tokens").alias("range_tokens"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("range_tokens").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = placed.withColumn("own", F.sum("n_tokens").over(within)).join(starts, ["source", "range"])
    return queued.select("doc_id", "source", "n_tokens", (F.col("start") + F.col("own")).alias("upto")), sums.groupBy("source").agg(F.sum("range_tokens").alias("source_tokens"))


def _cut_times(rows: list, totals: dict[str, float] | float | None) -> dict[str, tuple[float, float]]:
    """mix_name to (total, virtual time at which the queues have given the total, as if tokens were a fluid)."""
    out = {}
    for mix in {r.mix_name for r in rows}:
        own = [(r.target_share, r.max_repeats * r.source_tokens) for r in rows if r.mix_name == mix]
        weight = sum(w for w, _ in own)
        total = totals.get(mix) if isinstance(totals, dict) else totals
        total = min(have / w for w, have in own) * weight if total is None else min(float(total), float(sum(have for _, have in own)))
        time, given, left = 0.0, 0.0, sorted((have / w, w) for w, have in own)
        for ends, w in left:
            if given + (ends - time) * weight >= total:
                break
            given, time, weight = given + (ends - time) * weight, ends, weight - w
        out[mix] = (total, time + (total - given) / weight if weight > 1e-12 else time)
    return out


def mix_documents(sizes: DataFrame, targets: DataFrame, totals: dict[str, float] | float | None = None, seed: int = SEED, bins: int = BINS) -> DataFrame:
    """mix_name, source, doc_id, repeat_no (from 1), n_tokens, finish_time of every use of a document.

    totals: tokens of each mix, one number for all, or None. mix_targets is a fixed small table.
    """
    spark = sizes.sparkSession
    queued, source_tokens = queue_positions(sizes, seed)
    queued = cut_lineage(queued)
    wanted = _targets(targets)
    known = F.broadcast(cut_lineage(wanted.join(source_tokens, "source")))  # one row for each target at most
    times = _cut_times(known.collect(), totals)
    if not times:
        return spark.createDataFrame([], "mix_name string, source string, doc_id bigint, repeat_no int, n_tokens bigint, finish_time double")
    cuts = F.broadcast(spark.createDataFrame([(m, float(b), float(t)) for m, (b, t) in times.items()], "mix_name string, total double, cut_time double"))
    # A queue is at most one document ahead of or behind the fluid; later rounds than the cut needs are never made.
    rounds = F.least(F.col("max_repeats"), F.ceil(F.col("cut_time") * F.col("target_share") / F.col("source_tokens")).cast("long") + 1)
    uses = queued.join(known, "source").join(cuts, "mix_name").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), rounds.cast("int"))))
    uses = uses.withColumn("finish_time", ((F.col("repeat_no") - 1) * F.col("source_tokens") + F.col("upto")) / F.col("target_share"))
    uses = uses.withColumn("bin", F.least(F.floor(F.col("finish_time") / F.col("cut_time") * (bins // 2)), F.lit(bins)).cast("int"))
    per_bin = uses.groupBy("mix_name", "bin", "total").agg(F.sum("n_tokens").alias("bin_tokens"))
    upto = Window.partitionBy("mix_name").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    per_bin = F.broadcast(per_bin.withColumn("bin_upto", F.sum("bin_tokens").over(upto)).select("mix_name", "bin", "bin_tokens", "bin_upto"))  # bins rows for each mix
    judged = uses.join(per_bin, ["mix_name", "bin"])
    whole = judged.where(F.col("bin_upto") <= F.col("total"))
    part = judged.where((F.col("bin_upto") > F.col("total")) & (F.col("bin_upto") - F.col("bin_tokens") < F.col("total")))
    order = Window.partitionBy("mix_name").orderBy("finish_time", "source", "doc_id", "repeat_no").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("upto_here", F.col("bin_upto") - F.col("bin_tokens") + F.sum("n_tokens").over(order)).where(F.col("upto_here") <= F.col("total"))
    columns = ["mix_name", "source", "doc_id", "repeat_no", "n_tokens", "finish_time"]
    return whole.select(*columns).unionByName(part.select(*columns))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, actual_share, n_tokens, n_uses, most_repeats for every target."""
    used = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), F.max("repeat_no").cast("long").alias("most_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = targets.select("mix_name", "source", "target_share").join(used, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", zero("n_tokens"), zero("n_uses"), zero("most_repeats"))
    all_of = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    return joined.withColumn("actual_share", F.coalesce(F.col("n_tokens") / all_of, F.lit(0.0)))
