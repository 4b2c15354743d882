"""Validation and lint rules as unions of rule queries, and statistics of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import geometry as g
from siltstone.operators.layout import overlapping

BUCKET = 50


def _issues(df: DataFrame, code: str, subject: str | Column) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select("archive_id", F.lit(code).alias("code"), subject.cast("string").alias("subject"))


def validate(archives: DataFrame, chunks: DataFrame, version: str = "0.2") -> DataFrame:
    """archive_id, code, subject of every broken rule."""
    policies = ["l2", "none", "unknown"]
    rules = [
        _issues(archives.where(F.coalesce(F.col("format_version") != version, F.lit(True))), "format_version", "archive_id"),
        _issues(archives.where(F.coalesce(F.col("embedding_dimension") <= 0, F.lit(True))), "embedding_dimension", "archive_id"),
        _issues(archives.where(~F.coalesce(F.col("embedding_normalization"), F.lit("")).isin(policies)), "embedding_normalization", "archive_id"),
        _issues(archives.where(F.get_json_object("archive_metadata", "$.title").isNull()), "missing_title", "archive_id"),
        _issues(chunks.where(F.trim(F.coalesce("text", F.lit(""))) == ""), "blank_text", "chunk_row_id"),
        _issues(chunks.where(F.get_json_object("metadata", "$").isNull()), "metadata_json", "chunk_row_id"),
        _issues(chunks.where("page_end < page_start"), "page_order", "chunk_row_id"),
        _issues(chunks.join(archives.select("archive_id"), "archive_id", "left_anti"), "unknown_archive", "chunk_row_id"),
    ]
    return reduce(DataFrame.unionByName, rules)


def lint_ids(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Empty, repeated and unknown ids: one issue for each repeat."""
    again = lambda df, i, row: df.withColumn("_n", F.row_number().over(Window.partitionBy("archive_id", i).orderBy(row))).where("_n > 1")
    known = blocks.select("archive_id", "block_id").distinct()
    refs = chunks.select("archive_id", "chunk_row_id", F.explode("block_ids").alias("block_id"))
    rules = [
        _issues(blocks.where(F.trim(F.coalesce("block_id", F.lit(""))) == ""), "empty_block_id", "block_row_id"),
        _issues(chunks.where(F.trim(F.coalesce("chunk_id", F.lit(""))) == ""), "empty_chunk_id", "chunk_row_id"),
        _issues(again(blocks, "block_id", "block_row_id"), "duplicate_block_id", "block_row_id"),
        _issues(again(chunks, "chunk_id", "chunk_row_id"), "duplicate_chunk_id", "chunk_row_id"),
        _issues(refs.join(known, ["archive_id", "block_id"], "left_anti"), "unknown_block", F.concat_ws(":", "chunk_row_id", "block_id")),
    ]
    return reduce(DataFrame.unionByName, rules)


def lint_layout(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The eight layout rules."""
    covered = chunks.select("archive_id", F.explode("block_ids").alias("block_id")).distinct()
    loose = blocks.join(covered, ["archive_id", "block_id"], "left_anti")
    held = blocks.join(covered, ["archive_id", "block_id"], "left_semi")
    with_image = blocks.where("block_type = 'image'").select("archive_id", "page_number").distinct()
    pairs = overlapping(blocks).select(F.col("row_a").alias("block_row_id"), "row_b").join(blocks.select("block_row_id", "archive_id"), "block_row_id")
    rules = [
        _issues(chunks.where("page_start <> page_end"), "cross_page_chunk", "chunk_row_id"),
        _issues(loose.where("block_type = 'image'"), "unlinked_image_block", "block_row_id"),
        _issues(loose.where("block_type = 'table'"), "orphan_table_text", "block_row_id"),
        _issues(loose.where("block_type not in ('image', 'table', 'heading')"), "uncovered_block", "block_row_id"),
        _issues(held.where("block_type not in ('image', 'heading') and bbox is null"), "missing_bbox", "block_row_id"),
        _issues(blocks.where((F.size("bbox") == 4) & g.is_degenerate(F.col("bbox"))), "degenerate_bbox", "block_row_id"),
        _issues(blocks.where("block_type = 'caption'").join(with_image, ["archive_id", "page_number"], "left_anti"), "caption_without_figure", "block_row_id"),
        _issues(pairs, "overlapping_bboxes", F.concat_ws(":", "block_row_id", "row_b")),
    ]
    return reduce(DataFrame.unionByName, rules)


def token_histogram(chunks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """bucket_start, bucket_end, n_chunks of the buckets that have a chunk."""
    start = (F.floor(F.col("token_count") / bucket) * bucket).cast("long")
    return chunks.where("token_count is not null").groupBy(start.alias("bucket_start")).agg(F.count("*").alias("n_chunks")).select("bucket_start", (F.col("bucket_start") + bucket).alias("bucket_end"), "n_chunks")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: sizes of chunks, and how many cite no, one or several blocks."""
    n = F.size(F.coalesce("block_ids", F.array().cast("array<string>")))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.coalesce(F.median("token_count"), F.lit(0.0)).alias("median_tokens"),
        F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.sum("token_count").cast("long").alias("total_tokens"),
        F.count(F.when(n == 0, 1)).alias("unlinked"), F.count(F.when(n == 1, 1)).alias("single"), F.count(F.when(n > 1, 1)).alias("multi"),
    )


def chunks_per_page(chunks: DataFrame) -> DataFrame:
    spans = chunks.select("archive_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_number"))
    return spans.groupBy("archive_id", "page_number").agg(F.count("*").alias("n_chunks"))
