"""Stored archives: attachments and figures, pages, payloads, page repairs, numbering, conversion plans and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import geometry as g
from siltstone.operators.layout import PAGE, nearest_captions

BUCKET = 1024


def numbered(df: DataFrame, by: list[str], coarse: Column, order: list[str | Column], into: str = "pos") -> DataFrame:
    """`into`: place within `by`, from 1, in the order of `coarse`, then `order`.

    Two levels: rows are numbered inside their (by, coarse) group, groups by a running sum of their sizes. So a hot group
    is never sorted in one task, as long as `coarse` parts it; `coarse` must not contradict `order`.
    """
    placed = df.withColumn("_coarse", coarse)
    sizes = placed.groupBy(*by, "_coarse").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_coarse", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*by, "_coarse").orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*by, "_coarse"]])
    joined = placed.withColumn("_own", within).alias("r").join(starts.alias("s"), same, "left")
    return joined.select("r.*", (F.col("s._start") + F.col("r._own")).cast("long").alias(into)).drop("_coarse", "_own")


def numbered_ids(df: DataFrame, prefix: str, by: list[str], coarse: Column, order: list[str | Column]) -> DataFrame:
    """df with `numbered_id`: prefix_000001, prefix_000002, ... in order."""
    return numbered(df, by, coarse, order, "_n").withColumn("numbered_id", F.format_string(f"{prefix}_%06d", "_n")).drop("_n")


def unique_ids(df: DataFrame, by: list[str], column: str, order: list[str | Column]) -> DataFrame:
    """df with `unique_id`: repeats of an id get _2, _3, ...; further numbers where the suffixed id is another row's own."""
    n = F.row_number().over(Window.partitionBy(*by, column).orderBy(*order))
    first = df.withColumn("_n", n).withColumn("unique_id", F.when(F.col("_n") == 1, F.col(column)).otherwise(F.concat_ws("_", column, F.col("_n").cast("string"))))
    taken = df.select(*by, F.col(column).alias("unique_id")).distinct().withColumn("_taken", F.lit(True))
    joined = first.join(taken, [*by, "unique_id"], "left")
    again = F.when((F.col("_n") > 1) & F.col("_taken"), F.concat_ws("_", "unique_id", F.col("_n").cast("string"))).otherwise(F.col("unique_id"))
    return joined.withColumn("unique_id", again).drop("_n", "_taken")


# ---- attachments and figures ----------------------------------------------------------------------------------------


def attachments(blocks: DataFrame) -> DataFrame:
    """archive_id, attachment_id, media_type, filename, data, size, checksum, page_number, block_row_id of stored images.

    Sizes are columns, so that descriptors never read the bytes. A block stored again counts once.
    """
    images = blocks.where("block_type = 'image' and image_bytes is not null")
    first = images.groupBy("archive_id", "block_id").agg(F.min("block_row_id").alias("block_row_id"))
    own = images.join(first, ["archive_id", "block_id", "block_row_id"], "left_semi")
    ext = F.coalesce(F.when(F.col("image_ext") != "", F.col("image_ext")), F.lit("png"))
    name = F.concat(F.lit("image_"), "block_id")
    return own.select(
        "archive_id", name.alias("attachment_id"), F.concat(F.lit("image/"), ext).alias("media_type"), F.concat(name, F.lit("."), ext).alias("filename"),
        F.col("image_bytes").alias("data"), F.octet_length("image_bytes").cast("long").alias("size"), F.sha2("image_bytes", 256).alias("checksum"), "page_number", "block_row_id",
    )


def block_id_of(attachment_id: Column) -> Column:
    return F.regexp_replace(attachment_id, "^image_", "")


def data_url(media_type: Column, data: Column) -> Column:
    """The bytes as a data URL; RFC 4648 without line breaks."""
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def attachment_refs(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """chunk_row_id, attachment_ids: links of every chunk in the order of its block ids; empty without one."""
    refs = chunks.select("archive_id", "chunk_row_id", F.posexplode("block_ids").alias("place", "block_id"))
    met = refs.join(stored.select("archive_id", block_id_of(F.col("attachment_id")).alias("block_id"), "attachment_id"), ["archive_id", "block_id"])
    lists = met.groupBy("chunk_row_id").agg(F.array_sort(F.collect_list(F.struct("place", "attachment_id"))).alias("refs"))
    ids = F.coalesce(F.transform("refs", lambda r: r["attachment_id"]), F.array().cast("array<string>"))
    return chunks.select("chunk_row_id").join(lists, "chunk_row_id", "left").select("chunk_row_id", ids.alias("attachment_ids"))


def figures(blocks: DataFrame, pages: DataFrame, page_start: int | None = None, page_end: int | None = None) -> DataFrame:
    """archive_id, attachment_id, page_number, page_width, page_height, caption, url of stored images in a page range.

    Both ends count; an image without a page passes. The caption is the nearest one, below first.
    """
    stored = attachments(blocks)
    ok = F.col("page_number").isNull() | (F.col("page_number").between(page_start if page_start is not None else -(1 << 31), page_end if page_end is not None else (1 << 31) - 1))
    captions = nearest_captions(blocks).join(blocks.select(F.col("block_row_id").alias("caption_row_id"), F.col("text").alias("caption")), "caption_row_id")
    sizes = pages.groupBy(*PAGE).agg(F.min_by("width", "page_row_id").alias("page_width"), F.min_by("height", "page_row_id").alias("page_height"))
    joined = stored.where(ok).join(captions.select(F.col("figure_row_id").alias("block_row_id"), "caption"), "block_row_id", "left").join(sizes, PAGE, "left")
    return joined.select("archive_id", "attachment_id", "page_number", "page_width", "page_height", "caption", data_url(F.col("media_type"), F.col("data")).alias("url"))


def captioned_chunk(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """block_row_id, chunk_row_id: for each image the first chunk that covers its page, one with its caption's block before."""
    images = blocks.where("block_type = 'image'").select("archive_id", "page_number", "block_row_id")
    spans = chunks.select("archive_id", "chunk_row_id", "seq", "block_ids", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_number"))
    captions = nearest_captions(blocks).join(blocks.select(F.col("block_row_id").alias("caption_row_id"), F.col("block_id").alias("caption_id")), "caption_row_id").select(F.col("figure_row_id").alias("block_row_id"), "caption_id")
    met = images.join(captions, "block_row_id", "left").join(spans, PAGE)
    rank = F.struct(F.when(F.coalesce(F.array_contains("block_ids", F.col("caption_id")), F.lit(False)), 0).otherwise(1).alias("other"), "seq", "chunk_row_id")
    return met.groupBy("block_row_id").agg(F.min_by("chunk_row_id", rank).alias("chunk_row_id"))


# ---- pages and payloads ---------------------------------------------------------------------------------------------


def page_rows(pages: DataFrame) -> DataFrame:
    """archive_id, page_id, page_number, text of the first copy of every page."""
    first = pages.groupBy(*PAGE).agg(F.min_by("text", "page_row_id").alias("text"))
    return first.select("archive_id", F.format_string("page_%06d", "page_number").alias("page_id"), "page_number", "text")


def missing_pages(pages: DataFrame) -> DataFrame:
    """archive_id, from_page, to_page: the gaps between page 1 and the last page. Gaps, not pages, are rows."""
    numbers = pages.where("page_number >= 1").select(*PAGE).distinct()
    before = F.coalesce(F.lag("page_number").over(Window.partitionBy("archive_id").orderBy("page_number")), F.lit(0))
    gaps = numbers.select("archive_id", (before + 1).alias("from_page"), (F.col("page_number") - 1).alias("to_page"))
    return gaps.where("from_page <= to_page")


def with_recovered_pages(pages: DataFrame, recovered: DataFrame) -> DataFrame:
    """pages with the recovered ones in place of their old copies, renumbered row by row in page order as `place`."""
    kept = pages.join(recovered.select(*PAGE).distinct(), PAGE, "left_anti")
    columns = ["archive_id", "page_number", "page_row_id", "text"]
    return numbered(kept.select(*columns).unionByName(recovered.select(*columns)), ["archive_id"], F.floor(F.col("page_number") / BUCKET), ["page_number", "page_row_id"], "place")


def shifted_regions(regions: Column, offset: int) -> Column:
    """Regions with their page numbers moved."""
    return F.transform(regions, lambda r: r.withField("page_number", r["page_number"] + offset))


def as_json(result: list[str], context: str | None = None) -> Column:
    """A result row as JSON: null fields are left out, and the context if it is empty."""
    fields = [F.col(c) for c in result] + ([F.when(F.size(context) > 0, F.col(context)).alias(context)] if context else [])
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def payload_rows(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of a JSON array in `column`, beside the other columns; null and malformed arrays have none."""
    rest = [c for c in payloads.columns if c != column]
    return payloads.select(*rest, F.explode(F.from_json(F.col(column).cast("string"), f"array<struct<{schema}>>")).alias("_r")).select(*rest, "_r.*")


def chunk_block_ids(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """chunk_row_id, block_ids: a chunk's own blocks without images, then those of its figures, each once, first seen first."""
    own = F.coalesce("block_ids", F.array().cast("array<string>"))
    linked = attachment_refs(chunks, stored).withColumnRenamed("attachment_ids", "_refs")
    images = F.transform("_refs", block_id_of)
    return chunks.select("chunk_row_id", own.alias("_own")).join(linked, "chunk_row_id").select("chunk_row_id", F.array_distinct(F.concat(F.array_except("_own", images), images)).alias("block_ids"))


# ---- layout derivations ---------------------------------------------------------------------------------------------


def spans(blocks: DataFrame) -> DataFrame:
    """blocks with `size` (height of a line) and `chars`; the size is null without a box."""
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return blocks.withColumn("size", F.round((g.at(F.col("bbox"), 3) - g.at(F.col("bbox"), 1)) / lines, 1)).withColumn("chars", F.length(F.coalesce("text", F.lit(""))))


def body_sizes(sized: DataFrame, default: float = 11.0) -> DataFrame:
    """archive_id, body_size: the size that most characters have, the smaller one of equals."""
    counted = sized.where("size is not null and block_type <> 'image'").groupBy("archive_id", "size").agg(F.sum("chars").alias("n"))
    best = counted.groupBy("archive_id").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("best"))
    return sized.select("archive_id").distinct().join(best, "archive_id", "left").select("archive_id", F.coalesce("best", F.lit(default)).alias("body_size"))


def looks_like_heading(size: Column, body: Column, text: Column) -> Column:
    """Larger than the body by 0.9 points, at most 300 characters and 3 lines."""
    return F.coalesce((size >= body + 0.9) & (F.length(text) <= 300) & (F.size(F.split(text, "\n")) <= 3), F.lit(False))


def heading_levels(sized: DataFrame, deepest: int = 6) -> DataFrame:
    """archive_id, block_row_id, level of the blocks that look like headings: their sizes ranked per archive, largest first."""
    heads = sized.join(body_sizes(sized), "archive_id").where(F.col("block_type").isin("heading", "paragraph") & looks_like_heading(F.col("size"), F.col("body_size"), F.col("text")))
    distinct = heads.select("archive_id", "size").distinct()  # a page has few sizes, an archive not many more
    ranked = distinct.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy("archive_id").orderBy(F.desc("size"))), F.lit(deepest)).cast("int"))
    return heads.select("archive_id", "block_row_id", "size").join(ranked, ["archive_id", "size"]).select("archive_id", "block_row_id", "level")


def large_figures(blocks: DataFrame, least: float = 20.0) -> DataFrame:
    """Images that are not small in both directions; those without a box stay."""
    w, h = g.at(F.col("bbox"), 2) - g.at(F.col("bbox"), 0), g.at(F.col("bbox"), 3) - g.at(F.col("bbox"), 1)
    return blocks.where("block_type = 'image'").where(~F.coalesce((w < least) & (h < least), F.lit(False)))


def pages_to_read_optically(pages: DataFrame, blocks: DataFrame, share: float = 0.5, least_chars: int = 200) -> DataFrame:
    """page_row_id of pages with an image over half of them and little text."""
    covered = blocks.where("block_type = 'image' and size(bbox) = 4").select(*PAGE, "bbox").join(pages.select(*PAGE, "page_row_id", "width", "height", "text"), PAGE)
    little = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]", "")) < least_chars
    return covered.where(little & (g.coverage(F.col("bbox"), F.col("width"), F.col("height")) >= share)).select("page_row_id").distinct()


def reading_order(blocks: DataFrame) -> DataFrame:
    """block_row_id, place on its page: by top edge, then left edge, blocks without a box last."""
    w = Window.partitionBy(*PAGE).orderBy(F.asc_nulls_last(g.at(F.col("bbox"), 1)), F.asc_nulls_last(g.at(F.col("bbox"), 0)), "block_row_id")
    return blocks.select("block_row_id", F.row_number().over(w).alias("place"))


def crop_shifted(box: Column, crop: Column, width: Column, height: Column) -> Column:
    """A box moved to the crop's origin and clipped to the page; null if nothing is left."""
    x0, y0 = F.greatest(g.at(box, 0) - g.at(crop, 0), F.lit(0.0)), F.greatest(g.at(box, 1) - g.at(crop, 1), F.lit(0.0))
    x1, y1 = F.least(g.at(box, 2) - g.at(crop, 0), width), F.least(g.at(box, 3) - g.at(crop, 1), height)
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


# ---- conversion and counts ------------------------------------------------------------------------------------------


def conversion_plan(sources: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status of every source (path, hash): skipped if it is stored with the same hash, malformed without a hash."""
    known = stored.select("path", F.col("hash").alias("_old"))
    status = F.when(F.col("hash").isNull(), "malformed").when(F.col("hash") == F.col("_old"), "skipped").when(F.col("_old").isNull(), "new").otherwise("changed")
    return sources.join(known, "path", "left").select("path", status.alias("status"))


def conversion_report(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("n_files"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("kind"), "n_rows") for name, df in tables.items()])


def corpus_totals(summary: DataFrame, archives: DataFrame) -> DataFrame:
    """One row: n_files, n_pages, n_chunks, models (sorted)."""
    models = archives.agg(F.array_sort(F.collect_set("embedding_model")).alias("models"))  # as many as there are models
    return summary.agg(F.count("*").alias("n_files"), F.sum("n_pages").alias("n_pages"), F.sum("n_chunks").alias("n_chunks")).crossJoin(F.broadcast(models))


def upper_middle(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., upper_middle: the middle value, the upper one of two. Values are counted first, so no group is collected."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("_k").over(Window.partitionBy(*by))
    return counted.withColumn("_upto", upto).withColumn("_total", total).where(F.col("_upto") > F.floor(F.col("_total") / 2)).groupBy(*by).agg(F.min(value).alias("upper_middle"))


def vector_rows(chunks: DataFrame, archives: DataFrame) -> DataFrame:
    """chunk_row_id, embedding_model, embedding_dimension, vector_row: place within its model's matrix, from 0."""
    joined = chunks.select("archive_id", "seq", "chunk_row_id").join(archives.select("archive_id", "embedding_model", "embedding_dimension"), "archive_id")
    placed = numbered(joined, ["embedding_model", "embedding_dimension"], F.floor(F.col("chunk_row_id") / BUCKET), ["chunk_row_id"], "_n")
    return placed.select("chunk_row_id", "embedding_model", "embedding_dimension", (F.col("_n") - 1).alias("vector_row"))
