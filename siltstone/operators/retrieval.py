"""Retrieval calls made of scores and fusion: fan-out hybrid search, and hits for an agent's session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.embed import Embedder, get_embedder
from siltstone.operators import best_hits, fusion, semantic


def fanout_hybrid(docs: DataFrame, queries: DataFrame, id_column: str, k: int, embedder: Embedder | None = None, archive: str = "archive_id") -> DataFrame:
    """query_id, id, score: each archive gives its max(5k, 50) best of either list, lists merge by score and fuse by rank.

    Keyword statistics are those of each archive. Ties go by archive, then id.
    """
    n, embedder = fusion.candidates(k), embedder or get_embedder("hashing-sha256")
    # What is among the n best of all archives is so in its own: both lists are cut at once.
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(archive, F.lit("")).alias("archive"), "text")
    s = semantic.sparse_top_k(semantic.sparse_vectors(texts, "id", embedder, ["archive"]), queries, n, embedder, "archive")
    w = best_hits.best_hits_by(docs, queries, id_column, n, archive)
    lists = [x.select("query_id", "id", "rank") for x in (s, w)]
    return fusion.rrf(lists, ["query_id"])


def fresh_hits(hits: DataFrame, seen: DataFrame, ratio: float, labels_before: int = 0, budget: int = 20) -> DataFrame:
    """hits (query_id, id, rank, score) without those seen before, within `budget`, at least `ratio` of the best one's
    score, with labels going on after `labels_before`."""
    fresh = hits.where(F.col("rank") <= min(max(budget, 1), 20)).join(seen.select("id").distinct(), "id", "left_anti")
    return fusion.number_labels(fusion.quality_cutoff(fresh, ["query_id"], ratio, ["rank"]), ["rank"], ["query_id"], labels_before)
