"""Pages and blocks into chunks: heading paths, sliding windows, and the block fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import heading_line, paragraphs, space_tokens, windows

SIZE, OVERLAP, DEEPEST = 500, 75, 6


def heading_paths(blocks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """blocks with heading_path: the headings above each block, " > " between levels.

    A heading of level n closes all headings of level n and deeper. Per level, the last heading counts if no shallower
    one came after it.
    """
    level = F.least(F.coalesce("heading_level", F.lit(DEEPEST)), F.lit(DEEPEST))
    is_heading = F.col("block_type") == "heading"
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = blocks.withColumn("_n", n).withColumn("_level", F.when(is_heading, level))
    for k in range(1, DEEPEST + 1):
        here = F.when(F.col("_level") == k, F.struct(F.col("_n").alias("n"), F.col("text").alias("t")))
        out = out.withColumn(f"_h{k}", F.last(here, ignorenulls=True).over(w)).withColumn(f"_c{k}", F.max(F.when(F.col("_level") < k, F.col("_n"))).over(w))
    alive = [F.when(F.col(f"_h{k}.n") > F.coalesce(F.col(f"_c{k}"), F.lit(0)), F.col(f"_h{k}.t")) for k in range(1, DEEPEST + 1)]
    drop = ["_n", "_level", *[f"_h{k}" for k in range(1, DEEPEST + 1)], *[f"_c{k}" for k in range(1, DEEPEST + 1)]]
    return out.withColumn("heading_path", F.concat_ws(" > ", *alive)).drop(*drop)


def long_paragraph_windows(pages: DataFrame, key: list[str], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, paragraph_no, window_no, token_count, text of the paragraphs of more than `size` words."""
    each = pages.select(*key, F.posexplode(paragraphs(F.col("text"))).alias("paragraph_no", "paragraph")).withColumn("words", space_tokens(F.col("paragraph"))).where(F.size("words") > size)
    cut = each.select(*key, "paragraph_no", F.posexplode(windows(F.col("words"), size, overlap)).alias("window_no", "w"))
    return cut.select(*key, "paragraph_no", "window_no", F.size("w").alias("token_count"), F.array_join("w", " ").alias("text"))


def _overflow(words: list[str], size: int, overlap: int) -> tuple[list[list[str]], list[str]]:
    full = []
    while len(words) > size:
        full.append(words[:size])
        words = words[size - overlap :]
    return full, words


def page_chunks(pages: DataFrame, by: list[str], page: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """by..., page_number, chunk_no, heading, token_count, text: windows over the paragraphs of each page.

    A page's heading is its first heading line or the last one before it. With that known, pages are independent.
    """
    overlap = max(0, min(overlap, size - 1))
    carried = F.last(heading_line(F.col("text")), ignorenulls=True).over(Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    ready = pages.select(*by, F.col(page).alias("page_number"), F.coalesce(carried, F.lit("")).alias("heading"), F.transform(paragraphs(F.col("text")), space_tokens).alias("paragraphs"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                done: list[list[str]] = []
                buffer: list[str] = []
                for para in r["paragraphs"] if r["paragraphs"] is not None else []:
                    words = list(para)
                    if len(words) > size:
                        if buffer:
                            done.append(buffer)
                        buffer = []
                        last = max(0, -(-(len(words) - size) // (size - overlap)))
                        done += [words[i * (size - overlap) :][:size] for i in range(last + 1)]
                    elif buffer and len(buffer) + len(words) > size:
                        done.append(buffer)
                        full, buffer = _overflow((buffer[-overlap:] if overlap else []) + words, size, overlap)
                        done += full
                    else:
                        buffer = buffer + words
                if buffer:
                    done.append(buffer)
                rows += [{**{c: r[c] for c in by}, "page_number": r["page_number"], "chunk_no": i, "heading": r["heading"], "token_count": len(w), "text": " ".join(w)} for i, w in enumerate(done, 1)]
            yield pd.DataFrame(rows, columns=[*by, "page_number", "chunk_no", "heading", "token_count", "text"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"page_number {kinds[page]}", "chunk_no int, heading string, token_count int, text string"])
    return ready.mapInPandas(fold, schema)


def block_chunks(blocks: DataFrame, by: list[str], order: list[str], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """by..., page_number, chunk_no, heading_path, token_count, block_ids, text: heading-aware chunks of layout blocks.

    Chunks end at pages, headings, tables and the size; only an overflow carries words over, without their block ids.
    Images go to the chunk that is open on their page, else to the next one there, else to the page's last. Heading
    paths are made first; with them a page is all the state there is, so pages are folded independently.
    """
    overlap = max(0, min(overlap, size - 1))
    ready = heading_paths(blocks, by, order).withColumn("_order", F.row_number().over(Window.partitionBy(*by, "page_number").orderBy(*order)))
    per_page = ready.groupBy(*by, "page_number").agg(F.array_sort(F.collect_list(F.struct("_order", "block_id", "block_type", "text", "heading_path"))).alias("blocks"))

    def fold_page(blocks) -> list[dict]:
        chunks: list[dict] = []
        words: list[str] = []
        ids: list[str] = []
        waiting: list[str] = []
        path = ""

        def close(part: list[str], own: list[str]) -> None:
            chunks.append({"heading_path": path, "token_count": len(part), "block_ids": list(dict.fromkeys(own)), "text": " ".join(part)})

        def flush() -> None:
            nonlocal words, ids
            if words:
                close(words, ids)
            words, ids = [], []

        for b in blocks:
            kind = b["block_type"]
            if kind == "image":
                (ids if words else waiting).append(b["block_id"])
                continue
            if kind == "heading" or kind == "table":
                flush()
            path = b["heading_path"] or ""
            new = (b["text"] or "").split()
            if kind == "heading" or not new:
                continue
            if len(new) > size:
                flush()
                for start in range(0, max(1, len(new) - overlap), size - overlap):
                    close(new[start : start + size], [b["block_id"], *waiting])
                    waiting = []
                continue
            if words and len(words) + len(new) > size:
                carry = words[-overlap:] if overlap else []
                flush()
                words = carry
            fresh = not words
            words = words + new
            ids.append(b["block_id"])
            if fresh:
                ids, waiting = ids + waiting, []
            full, words = _overflow(words, size, overlap)
            for part in full:
                close(part, ids)
        flush()
        if waiting and chunks:
            chunks[-1]["block_ids"] += waiting
        return chunks

    names = [*by, "page_number", "chunk_no", "heading_path", "token_count", "block_ids", "text"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{**{c: r[c] for c in by}, "page_number": r["page_number"], "chunk_no": i, **c} for r in pdf.to_dict("records") for i, c in enumerate(fold_page(r["blocks"]), 1)]
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object if c in ("block_ids", "text", "heading_path") else None) for c in names})

    kinds = dict(blocks.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"page_number {kinds['page_number']}", "chunk_no int, heading_path string, token_count int, block_ids array<string>, text string"])
    return per_page.mapInPandas(fold, schema)


def overlaps_pages(page_start: Column, page_end: Column, pages: list[int]) -> Column:
    """Whether a chunk covers one of the pages, both ends included; an end before the start counts as the start."""
    return F.exists(F.array(*map(F.lit, pages)), lambda p: p.between(page_start, F.greatest(page_start, page_end)))
