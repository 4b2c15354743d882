"""Retrieval quality: which ranked results match a case, hit rate and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_pages(pages: Column, page: Column) -> Column:
    """expected_pages and expected_page as one array."""
    return F.concat(F.coalesce(pages, F.array().cast("array<int>")), F.when(page.isNotNull(), F.array(page)).otherwise(F.array().cast("array<int>")))


def matches(page_start: Column, page_end: Column, text: Column, pages: Column, terms: Column) -> Column:
    """Pages overlap, if pages are expected, and all terms are contained, case ignored."""
    on_page = (F.size(pages) == 0) | F.coalesce(F.exists(pages, lambda p: p.between(page_start, F.coalesce(page_end, page_start))), F.lit(False))
    terms = F.coalesce(terms, F.array().cast("array<string>"))
    return on_page & F.forall(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def first_ranks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """mode, query_id, first_rank (null for a miss) for results (mode, query_id, rank, archive_id, page_start, page_end, text)."""
    wanted = cases.select("query_id", F.col("archive_id").alias("wanted_archive"), all_pages(F.col("expected_pages"), F.col("expected_page")).alias("pages"), F.col("expected_terms").alias("terms"))
    modes = results.select("mode").distinct()
    hit = matches(F.col("page_start"), F.col("page_end"), F.col("text"), F.col("pages"), F.col("terms")) & (F.col("archive_id") == F.col("wanted_archive"))
    found = results.join(wanted, "query_id").where(hit).groupBy("mode", "query_id").agg(F.min("rank").alias("first_rank"))
    return cases.select("query_id").crossJoin(F.broadcast(modes)).join(found, ["mode", "query_id"], "left")  # three modes


def report(ranks: DataFrame) -> DataFrame:
    """mode, n_queries, hits, hit_rate, mrr."""
    return ranks.groupBy("mode").agg(
        F.count("*").alias("n_queries"), F.count("first_rank").alias("hits"), F.round(F.avg(F.when(F.col("first_rank").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr")
    )
