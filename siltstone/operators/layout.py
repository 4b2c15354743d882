"""Joins over the boxes of a page: captions, tables, images, overlaps, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import geometry as g
from siltstone.functions.text import is_caption

CAPTION_GAP, TABLE_SHARE, HEAVY = 60.0, 0.5, 0.8
PAGE = ["archive_id", "page_number"]


def _side(df: DataFrame, s: str, *columns: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(f"{c}_{s}") for c in columns])


def captions(blocks: DataFrame) -> DataFrame:
    """block_row_id of paragraphs and headings that label an image near them on their page."""
    texts = blocks.where(F.col("block_type").isin("paragraph", "heading") & is_caption(F.col("text")) & F.col("bbox").isNotNull())
    images = blocks.where("block_type = 'image' and bbox is not null")
    near = _side(texts, "t", "block_row_id", "bbox").join(_side(images, "i", "bbox"), PAGE).where(g.vertical_gap(F.col("bbox_t"), F.col("bbox_i")) <= CAPTION_GAP)
    return near.select(F.col("block_row_id_t").alias("block_row_id")).distinct()


def nearest_captions(blocks: DataFrame) -> DataFrame:
    """figure_row_id, caption_row_id: captions below the figure first, then the least distance, then storage order."""
    figures = _side(blocks.where("block_type = 'image'"), "f", "block_row_id", "bbox")
    texts = _side(blocks.where("block_type = 'caption'"), "c", "block_row_id", "bbox")
    below = g.at(F.col("bbox_c"), 1) - g.at(F.col("bbox_f"), 3)
    rank = F.struct(F.when(below.isNull(), 2).when(below >= 0, 0).otherwise(1).alias("side"), F.coalesce(F.abs(below), F.lit(0.0)).alias("gap"), F.col("block_row_id_c").alias("row"))
    return figures.join(texts, PAGE).groupBy(F.col("block_row_id_f").alias("figure_row_id")).agg(F.min_by("block_row_id_c", rank).alias("caption_row_id"))


def without_table_text(blocks: DataFrame) -> DataFrame:
    """blocks without the paragraphs whose box lies mostly inside a table's on the same page."""
    tables = _side(blocks.where("block_type = 'table' and bbox is not null"), "t", "bbox")
    covered = blocks.where("block_type = 'paragraph' and bbox is not null").select(*PAGE, "block_row_id", "bbox").join(tables, PAGE).where(g.overlap_fraction(F.col("bbox"), F.col("bbox_t")) >= TABLE_SHARE)
    return blocks.join(covered.select("block_row_id").distinct(), "block_row_id", "left_anti")


def overlapping(blocks: DataFrame) -> DataFrame:
    """row_a < row_b of blocks of one type on one page whose boxes overlap heavily. Pages are small, by their nature."""
    boxed = blocks.where(F.size("bbox") == 4)
    a, b = _side(boxed, "a", "block_row_id", "block_type", "bbox"), _side(boxed, "b", "block_row_id", "block_type", "bbox")
    pairs = a.join(b, PAGE).where("block_row_id_a < block_row_id_b and block_type_a = block_type_b")
    return pairs.where(g.overlap_ratio(F.col("bbox_a"), F.col("bbox_b")) >= HEAVY).select(F.col("block_row_id_a").alias("row_a"), F.col("block_row_id_b").alias("row_b"))


def image_chunks(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """block_row_id, chunk_row_id: each image and the last chunk that covers its page."""
    images = blocks.where("block_type = 'image'").select("archive_id", "page_number", "block_row_id")
    spans = chunks.select("archive_id", "chunk_row_id", "seq", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_number"))
    return images.join(spans, PAGE).groupBy("block_row_id").agg(F.max_by("chunk_row_id", F.struct("seq", "chunk_row_id")).alias("chunk_row_id"))


def regions(chunks: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_row_id, regions: the boxes of a chunk's blocks with their page's size, in the order of block_ids; images apart."""
    refs = chunks.select("archive_id", "chunk_row_id", F.posexplode("block_ids").alias("place", "block_id"))
    boxes = blocks.where("block_type <> 'image' and bbox is not null").groupBy("archive_id", "block_id").agg(F.min_by(F.struct("page_number", "bbox"), "block_row_id").alias("b"))
    sizes = pages.groupBy(*PAGE).agg(F.min_by(F.struct("width", "height"), "page_row_id").alias("s"))
    joined = refs.join(boxes, ["archive_id", "block_id"]).withColumn("page_number", F.col("b.page_number")).join(sizes, PAGE, "left")
    region = F.struct("place", "block_id", "page_number", F.col("b.bbox").alias("bbox"), F.col("s.width").alias("page_width"), F.col("s.height").alias("page_height"))
    return joined.groupBy("chunk_row_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))


def repeated_images(blocks: DataFrame) -> DataFrame:
    """block_row_id of images whose bytes an earlier image of the archive has."""
    images = blocks.where("block_type = 'image' and image_bytes is not null").select("archive_id", "block_row_id", F.sha2("image_bytes", 256).alias("h"))
    first = images.groupBy("archive_id", "h").agg(F.min("block_row_id").alias("first"))
    return images.join(first, ["archive_id", "h"]).where("block_row_id > first").select("block_row_id")
