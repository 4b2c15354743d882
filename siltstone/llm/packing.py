"""Problem 6: fill containers of fixed capacity with documents, shortest pack first, over the histogram of lengths.

Only the histogram (at most `capacity` different lengths) reaches the driver. There, lengths are placed longest first:
all items of a length go into the open packs with the most space left, group by group, a group being a pattern of packs
that are filled alike, with their count and their range of container numbers. What doesn't fit opens new packs. Each
placement is an interval of ranks within a length; documents are then ranked within their length (in hash buckets, so
that a hot length is not ranked in one task) and find their interval by binary search.

Defined results: a document longer than the capacity is split into pieces of exactly the capacity and one rest; other
documents are never split. Documents without tokens (null or empty text) need no space: they come back with one piece,
size 0 and no container. A null or non-positive capacity gives no rows. Repeated rows count as rows of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tokens import VOCABULARY, token_count
from siltstone.session import cut_lineage


@dataclass
class Placement:
    """Items of one length by rank: from `rank` on, `per_pack` go into each container from `container` on, at `offset`."""

    length: int
    rank: int
    container: int
    per_pack: int
    offset: int


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements for a histogram of lengths (1..capacity), and the number of containers."""
    placements: list[Placement] = []
    opened = 0
    groups: list[tuple[int, int, int]] = []  # (-space left, first container, containers): the shortest packs on top
    for length in sorted((n for n, k in histogram.items() if k > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            if groups and -groups[0][0] >= length:
                space, first, packs = heapq.heappop(groups)
                space = -space
            else:
                space, first = capacity, opened
                packs = -(-left // (capacity // length))
                opened += packs
            fit = min(space // length, left)
            used = min(packs, left // fit)
            if used < packs:
                heapq.heappush(groups, (-space, first + used, packs - used))
            placements.append(Placement(length, rank, first, fit, capacity - space))
            heapq.heappush(groups, (-(space - fit * length), first, used))
            left -= used * fit
            rank += used * fit
    return placements, opened


def document_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of every row. Kept, since it is read several times and tokenizing is what costs."""
    return cut_lineage(documents.select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens")))


def _pieces(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """Documents, or the pieces of those beyond the capacity, for each profile (a fixed small table)."""
    n, c = F.col("n_tokens"), F.col("capacity_tokens").cast("long")
    both = sizes.select("doc_id", "n_tokens").crossJoin(F.broadcast(capacities.where(c > 0).select("profile", c.alias("capacity_tokens"))))
    pieces = F.greatest(F.ceil(n / c), F.lit(1)).cast("int")
    cut = both.select("profile", "capacity_tokens", "doc_id", "n_tokens", pieces.alias("n_pieces"), F.explode(F.sequence(F.lit(1), pieces)).alias("piece_no"))
    start = (F.col("piece_no") - 1) * c
    return cut.select("profile", "capacity_tokens", "doc_id", "piece_no", "n_pieces", start.alias("start_token"), F.least(n - start, c).alias("size"))


def fill_containers(sizes: DataFrame, capacities: DataFrame, buckets: int | None = None) -> DataFrame:
    """profile, doc_id, piece_no, n_pieces, start_token, n_tokens, container_id, container_offset."""
    spark = sizes.sparkSession
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = _pieces(sizes, capacities).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    filled = pieces.where("size > 0")
    # At most capacity * buckets rows for each profile, however many documents there are.
    counts = cut_lineage(filled.groupBy("profile", "capacity_tokens", "size", "bucket").agg(F.count("*").alias("k")))
    histograms: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts.groupBy("profile", "capacity_tokens", "size").agg(F.sum("k").alias("k")).toLocalIterator():
        histograms.setdefault((r.profile, r.capacity_tokens), {})[r["size"]] = r.k
    plan = {}
    for (profile, capacity), histogram in histograms.items():
        placed = sorted(shortest_pack_first(histogram, capacity)[0], key=lambda p: (p.length, p.rank))
        plan[profile] = {k: np.array([getattr(p, k) for p in placed], dtype=np.int64) for k in ("length", "rank", "container", "per_pack", "offset")}
    shared = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("profile", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("profile", "size", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ranked_before"))
    own = Window.partitionBy("profile", "size", "bucket").orderBy("doc_id", "piece_no")
    ranked = filled.withColumn("own_rank", F.row_number().over(own)).join(offsets, ["profile", "size", "bucket"])
    ranked = ranked.select("profile", "doc_id", "piece_no", "n_pieces", "start_token", "size", (F.col("ranked_before") + F.col("own_rank") - 1).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for profile, rows in pdf.groupby("profile", sort=False):
                p = shared.value[profile]
                size, rank = rows["size"].to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
                # Placements are sorted by (length, rank); both fit one float-free key: position of the length, then rank.
                lo, hi = np.searchsorted(p["length"], size, "left"), np.searchsorted(p["length"], size, "right")
                at = lo.copy()
                span = int((hi - lo).max()) if len(rows) else 0
                step = 1 << max(span.bit_length(), 1)
                while step:
                    nxt = at + step
                    ok = nxt < hi
                    ok[ok] = p["rank"][nxt[ok]] <= rank[ok]
                    at = np.where(ok, nxt, at)
                    step >>= 1
                nth = rank - p["rank"][at]
                yield pd.DataFrame({
                    "profile": profile, "doc_id": rows["doc_id"], "piece_no": rows["piece_no"], "n_pieces": rows["n_pieces"], "start_token": rows["start_token"], "n_tokens": size,
                    "container_id": p["container"][at] + nth // p["per_pack"][at], "container_offset": p["offset"][at] + nth % p["per_pack"][at] * size,
                })

    schema = "profile string, doc_id bigint, piece_no int, n_pieces int, start_token bigint, n_tokens bigint, container_id bigint, container_offset bigint"
    empty = pieces.where("size = 0").select("profile", "doc_id", "piece_no", "n_pieces", "start_token", F.col("size").alias("n_tokens"), F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("long").alias("container_offset"))
    return ranked.mapInPandas(place, schema).unionByName(empty)


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """profile, capacity_tokens, n_containers, n_items, n_tokens, fill (share of the capacity in use), least_containers."""
    used = placed.groupBy("profile", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens")).where("container_id is not null")
    by = used.groupBy("profile").agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("most_tokens"))
    c = F.col("capacity_tokens").cast("long")
    return by.join(F.broadcast(capacities.select("profile", "capacity_tokens")), "profile").select(
        "profile", c.alias("capacity_tokens"), "n_containers", "n_items", "n_tokens", "most_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * c), 6).alias("fill"), F.ceil(F.col("n_tokens") / c).alias("least_containers")
    )
