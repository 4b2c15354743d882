"""Ranking: min-max fusion, reciprocal rank fusion, top-k, quality cutoff, labels, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.archive import BUCKET, numbered

RRF_K, LEAST_CANDIDATES = 60, 50
STRICT, BALANCED, PERMISSIVE = 0.85, 0.55, 0.0


def top_k(scored: DataFrame, k: int, by: list[str], ties: list[str], score: str = "score") -> DataFrame:
    """The k best rows of each group, with `rank` from 1; ties by the given columns."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def candidates(k: int) -> int:
    """How many candidates a list contributes before lists are fused."""
    return max(5 * k, LEAST_CANDIDATES)


def min_max(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """`normalized` in 0..1 within each group; a constant list is 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn("normalized", F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)))


def hybrid_scores(semantic: DataFrame, keyword: DataFrame, by: list[str], item: str = "id", semantic_weight: float = 0.5, keyword_weight: float = 0.5) -> DataFrame:
    """by..., item, score, semantic_score, keyword_score; a row that one list lacks counts 0 there."""
    total = semantic_weight + keyword_weight
    if total <= 0 or min(semantic_weight, keyword_weight) < 0:
        raise ValueError("weights must not be negative and must sum to more than 0")
    lists = []
    for name, df in (("semantic", semantic), ("keyword", keyword)):
        n = min_max(df, by).select(*by, item, F.col("score").alias(name), F.col("normalized").alias(f"{name}_n"))
        lists.append(n)
    fused = lists[0].join(lists[1], [*by, item], "full_outer")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = part("semantic_n") * (semantic_weight / total) + part("keyword_n") * (keyword_weight / total)
    return fused.select(*by, item, score.alias("score"), F.col("semantic").alias("semantic_score"), F.col("keyword").alias("keyword_score"))


def rrf(lists: list[DataFrame], by: list[str], item: str = "id", k: int = RRF_K) -> DataFrame:
    """by..., item, score: sum of 1 / (k + rank) over lists that have `rank`."""
    ranked = reduce(DataFrame.unionByName, [x.select(*by, item, "rank") for x in lists])
    return ranked.groupBy(*by, item).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def quality_cutoff(scored: DataFrame, by: list[str], ratio: float, ties: list[str]) -> DataFrame:
    """Rows with at least `ratio` of their group's best score; the best row is always kept."""
    best = F.max("score").over(Window.partitionBy(*by))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *ties)) == 1
    return scored.withColumn("_keep", first | ((best > 0) & (F.col("score") >= ratio * best)) | (best <= 0)).where("_keep").drop("_keep")


def number_labels(items: DataFrame, order: list[str | Column], by: list[str], start: int = 0) -> DataFrame:
    """`label` C1, C2, ... by first appearance, going on after `start`."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) + start
    return items.withColumn("label", F.concat(F.lit("C"), n.cast("string")))


def neighbours(hits: DataFrame, chunks: DataFrame, group: str, seq: str, n: int, id_column: str) -> DataFrame:
    """hit columns, side (before / after), distance, neighbour id: up to n chunks on either side in the same group.

    A range around each hit meets the chunks of its group. `hits` have `pos`; chunks without one are numbered first.
    """
    near = hits.select("*", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("distance")).where("distance <> 0")
    at = near.withColumn("_at", F.col("pos") + F.col("distance"))
    chunks = chunks if "pos" in chunks.columns else with_position(chunks, group, seq, id_column)
    placed = chunks.select(F.col(group).alias("_g"), F.col("pos").alias("_p"), F.col(id_column).alias("neighbour"))
    joined = at.join(placed, (F.col(group) == F.col("_g")) & (F.col("_at") == F.col("_p"))).drop("_g", "_p", "_at")
    return joined.withColumn("side", F.when(F.col("distance") < 0, "before").otherwise("after"))


def with_position(chunks: DataFrame, group: str, seq: str, id_column: str) -> DataFrame:
    """`pos`: place in the group's storage order, from 1. Ranges of seq are numbered apart, so no group is one task's."""
    return numbered(chunks, [group], F.floor(F.col(seq) / BUCKET), [seq, id_column])
