"""Tables of the ingest corpus in the shapes that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import table


def page_and_block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_kind, row_id, archive_id, page_number, text over all pages and blocks."""
    pages = table(spark, sf_dir, "parsed_pages").select(F.lit("page").alias("record_kind"), F.col("page_row_id").alias("row_id"), "archive_id", "page_number", "text")
    blocks = table(spark, sf_dir, "ingest_blocks").select(F.lit("block").alias("record_kind"), F.col("block_row_id").alias("row_id"), "archive_id", "page_number", "text")
    return pages.unionByName(blocks)


def block_and_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_kind, row_id, text over all blocks and chunks."""
    blocks = table(spark, sf_dir, "ingest_blocks").select(F.lit("block").alias("record_kind"), F.col("block_row_id").alias("row_id"), "text")
    chunks = table(spark, sf_dir, "ingest_chunks").select(F.lit("chunk").alias("record_kind"), F.col("chunk_row_id").alias("row_id"), "text")
    return blocks.unionByName(chunks)
