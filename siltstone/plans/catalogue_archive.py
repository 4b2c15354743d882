"""Registered queries over stored archives: attachments, figures, pages, layout, conversion, counts, payloads, agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import values
from siltstone.operators import archive, best_hits, chunking, fusion, layout, records, retrieval
from siltstone.plans import library
from siltstone.plans.catalogue import _AREA, _BY_ARCHIVE, _GLOBAL, _HASHED_ALL, _INTER, _TOP, K, _cases, _chunks, _rounded_corpus, _score, _top, query
from siltstone.session import table


def _blocks(spark, d):
    return table(spark, d, "ingest_blocks")


def _pages(spark, d):
    return table(spark, d, "parsed_pages")


def _archives(spark, d):
    return table(spark, d, "archives")


# ---- scans ----------------------------------------------------------------------------------------------------------


@query("SELECT archive_id, chunk_row_id, seq, label, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM ingest_chunks JOIN embeddings ON vec_id = chunk_row_id")
def raw_chunks_with_embeddings(spark, d):
    """Chunks with their vectors, one to one."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_row_id"), "label", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _chunks(spark, d).join(e, "chunk_row_id").select("archive_id", "chunk_row_id", "seq", "label", F.round(total, 5).alias("total"))


@query("SELECT archive_id, format_version, embedding_model, embedding_dimension, coalesce(embedding_normalization, 'unknown') AS embedding_normalization, created_at FROM archives")
def archive_headers(spark, d):
    return _archives(spark, d).select("archive_id", "format_version", "embedding_model", "embedding_dimension", F.coalesce("embedding_normalization", F.lit("unknown")).alias("embedding_normalization"), "created_at")


@query("SELECT place, relative_path, reason FROM (SELECT *, row_number() OVER (ORDER BY lower(relative_path), relative_path) AS place FROM (SELECT relative_path, CASE WHEN format_version = '0.2' THEN 'indexed' ELSE 'skipped' END AS reason FROM archives))")
def document_paths(spark, d):
    """Indexed and skipped files by lower-cased path."""
    a = _archives(spark, d)
    ok = F.coalesce(F.col("format_version") == "0.2", F.lit(False))
    both = a.where(ok).select("relative_path", F.lit("indexed").alias("reason")).unionByName(a.where(~ok).select("relative_path", F.lit("skipped").alias("reason")))
    return archive.numbered(both.withColumn("_all", F.lit(1)), ["_all"], F.substring(F.lower("relative_path"), 1, 12), [F.lower("relative_path"), "relative_path"], "place").select("place", "relative_path", "reason")


@query("SELECT count(*) AS n_chunks, count(DISTINCT archive_id) AS n_files FROM ingest_chunks JOIN archives USING (archive_id) WHERE starts_with(relative_path, 'transportation/') AND format_version = '0.2'")
def corpus_from_paths(spark, d):
    """A corpus of given files without the invalid ones."""
    a = _archives(spark, d)
    bad = a.where(~F.coalesce(F.col("format_version") == "0.2", F.lit(False))).select("archive_id")
    own = library.from_paths(a, _chunks(spark, d), a.where(F.col("relative_path").startswith("transportation/")).select("relative_path"), bad)
    return own.chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("archive_id").alias("n_files"))


# ---- attachments and figures ----------------------------------------------------------------------------------------

_ATT = """att AS (SELECT archive_id, 'image_' || block_id AS attachment_id, block_id, 'image/' || CASE WHEN coalesce(image_ext, '') = '' THEN 'png' ELSE image_ext END AS media_type, image_bytes AS data, page_number, block_row_id FROM ingest_blocks
  WHERE block_type = 'image' AND image_bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY archive_id, block_id ORDER BY block_row_id) = 1)"""
_CAPTION = """cap AS (SELECT f.block_row_id AS block_row_id, c.block_row_id AS caption_row_id, c.text AS caption, c.block_id AS caption_id FROM ingest_blocks f JOIN ingest_blocks c USING (archive_id, page_number)
  WHERE f.block_type = 'image' AND c.block_type = 'caption' QUALIFY row_number() OVER (PARTITION BY f.block_row_id
  ORDER BY CASE WHEN c.bbox[2] - f.bbox[4] IS NULL THEN 2 WHEN c.bbox[2] >= f.bbox[4] THEN 0 ELSE 1 END, coalesce(abs(c.bbox[2] - f.bbox[4]), 0), c.block_row_id) = 1)"""


@query(f"WITH {_ATT} SELECT archive_id, attachment_id, media_type, octet_length(data) AS size, sha256(data) AS checksum FROM att")
def attachment_metadata(spark, d):
    """Descriptors of stored images."""
    return archive.attachments(_blocks(spark, d)).select("archive_id", "attachment_id", "media_type", "size", "checksum")


@query(f"WITH {_ATT} SELECT archive_id, attachment_id, 'data:' || media_type || ';base64,' || base64(data) AS url FROM att WHERE octet_length(data) > 10")
def attachments_where(spark, d):
    a = archive.attachments(_blocks(spark, d)).where("size > 10")
    return a.select("archive_id", "attachment_id", archive.data_url(F.col("media_type"), F.col("data")).alias("url"))


@query(
    f"""WITH {_ATT}, {_CAPTION}, s AS (SELECT archive_id, page_number, arg_min(struct_pack(w := width, h := height), page_row_id) AS s FROM parsed_pages GROUP BY 1, 2)
SELECT att.archive_id, attachment_id, att.page_number, caption, 'data:' || media_type || ';base64,' || base64(data) AS url, s.s.w AS page_width, s.s.h AS page_height FROM att LEFT JOIN cap USING (block_row_id) LEFT JOIN s ON s.archive_id = att.archive_id AND s.page_number = att.page_number
WHERE att.page_number IS NULL OR att.page_number BETWEEN 2 AND 8"""
)
def figures(spark, d):
    return archive.figures(_blocks(spark, d), _pages(spark, d), 2, 8)


@query(
    f"""WITH {_ATT}, r AS (SELECT archive_id, chunk_row_id, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) AS place FROM ingest_chunks),
m AS (SELECT chunk_row_id, list(attachment_id ORDER BY place) AS ids FROM r JOIN att USING (archive_id, block_id) GROUP BY 1)
SELECT chunk_row_id, coalesce(array_to_string(ids, ','), '') AS attachment_ids FROM ingest_chunks LEFT JOIN m USING (chunk_row_id)"""
)
def attachment_refs(spark, d):
    return archive.attachment_refs(_chunks(spark, d), archive.attachments(_blocks(spark, d))).withColumn("attachment_ids", F.array_join("attachment_ids", ","))


@query(
    f"""WITH {_ATT}, o AS (SELECT archive_id, chunk_row_id, unnest(coalesce(block_ids, [])) AS block_id, generate_subscripts(coalesce(block_ids, []), 1) AS p FROM ingest_chunks),
k AS (SELECT chunk_row_id, block_id, min(CASE WHEN attachment_id IS NULL THEN p ELSE 1000000 + p END) AS p FROM o LEFT JOIN att USING (archive_id, block_id) GROUP BY 1, 2)
SELECT chunk_row_id, coalesce(string_agg(block_id, ',' ORDER BY p), '') AS block_ids FROM ingest_chunks c LEFT JOIN k USING (chunk_row_id) GROUP BY 1"""
)
def chunk_block_ids(spark, d):
    """Own blocks, then figures."""
    return archive.chunk_block_ids(_chunks(spark, d), archive.attachments(_blocks(spark, d))).withColumn("block_ids", F.array_join("block_ids", ","))


@query(
    f"""WITH {_CAPTION} SELECT i.block_row_id, arg_min(c.chunk_row_id, struct_pack(o := CASE WHEN coalesce(list_contains(c.block_ids, caption_id), FALSE) THEN 0 ELSE 1 END, s := c.seq, r := c.chunk_row_id)) AS chunk_row_id
FROM ingest_blocks i LEFT JOIN cap USING (block_row_id) JOIN ingest_chunks c ON c.archive_id = i.archive_id AND i.page_number BETWEEN c.page_start AND greatest(c.page_start, c.page_end) WHERE i.block_type = 'image' GROUP BY 1"""
)
def captioned_chunks(spark, d):
    return archive.captioned_chunk(_blocks(spark, d), _chunks(spark, d))


# ---- pages, blocks, payloads ----------------------------------------------------------------------------------------


@query("SELECT archive_id, printf('page_%06d', page_number) AS page_id, page_number, md5(arg_min(text, page_row_id)) AS text_hash FROM parsed_pages GROUP BY archive_id, page_number")
def get_pages(spark, d):
    return archive.page_rows(_pages(spark, d)).select("archive_id", "page_id", "page_number", F.md5("text").alias("text_hash"))


@query("SELECT archive_id, block_row_id, block_id, block_type FROM ingest_blocks WHERE page_number = 2")
def get_blocks(spark, d):
    return _blocks(spark, d).where("page_number = 2").select("archive_id", "block_row_id", "block_id", "block_type")


@query("SELECT archive_id, p + 1 AS from_page, page_number - 1 AS to_page FROM (SELECT archive_id, page_number, coalesce(lag(page_number) OVER (PARTITION BY archive_id ORDER BY page_number), 0) AS p FROM (SELECT DISTINCT archive_id, page_number FROM parsed_pages WHERE page_number >= 1 AND page_number % 4 <> 0)) WHERE page_number - p > 1")
def missing_pages(spark, d):
    """Gaps, were every fourth page lost."""
    return archive.missing_pages(_pages(spark, d).where("page_number % 4 <> 0"))


@query(
    """WITH rec AS (SELECT archive_id, page_number, page_row_id, 'recovered ' || page_row_id AS text FROM parsed_pages WHERE page_number % 4 = 0 QUALIFY row_number() OVER (PARTITION BY archive_id, page_number ORDER BY page_row_id) = 1),
u AS (SELECT archive_id, page_number, page_row_id, text FROM parsed_pages ANTI JOIN rec USING (archive_id, page_number) UNION ALL SELECT * FROM rec)
SELECT archive_id, page_number, page_row_id, md5(text) AS text_hash, row_number() OVER (PARTITION BY archive_id ORDER BY page_number, page_row_id) AS place FROM u"""
)
def merge_recovered_pages(spark, d):
    """Every fourth page is read again and takes the place of its old copies."""
    pages = _pages(spark, d)
    again = records.latest(pages.where("page_number % 4 = 0"), ["archive_id", "page_number"], [F.asc("page_row_id")]).withColumn("text", F.concat(F.lit("recovered "), "page_row_id"))
    return archive.with_recovered_pages(pages, again).withColumn("text_hash", F.md5("text")).drop("text")


@query("SELECT c.chunk_row_id, list_sum(list_transform(list_filter(c.block_ids, lambda b: list_contains(k.ids, b)), lambda b: 1)) AS n_regions FROM ingest_chunks c JOIN (SELECT archive_id, list(DISTINCT block_id) AS ids FROM ingest_blocks WHERE block_type <> 'image' AND bbox IS NOT NULL GROUP BY 1) k USING (archive_id) WHERE len(list_filter(c.block_ids, lambda b: list_contains(k.ids, b))) > 0")
def region_counts(spark, d):
    """Regions of a chunk, one for each of its blocks with a box."""
    r = layout.regions(_chunks(spark, d), _blocks(spark, d), _pages(spark, d))
    return r.select("chunk_row_id", F.size("regions").cast("long").alias("n_regions"))


@query("SELECT archive_id, chunk_row_id, b.block_id AS block_id, b.page_number + 10 AS page_number FROM (SELECT archive_id, chunk_row_id, unnest(block_ids) AS block_id FROM ingest_chunks) JOIN (SELECT archive_id, block_id, arg_min(page_number, block_row_id) AS page_number FROM ingest_blocks WHERE block_type <> 'image' AND bbox IS NOT NULL GROUP BY 1, 2) b USING (archive_id, block_id)")
def shifted_regions(spark, d):
    """Regions moved by ten pages, as rows."""
    chunks = _chunks(spark, d)
    r = layout.regions(chunks, _blocks(spark, d), _pages(spark, d)).join(chunks.select("chunk_row_id", "archive_id"), "chunk_row_id")
    rows = r.select("archive_id", "chunk_row_id", F.explode(archive.shifted_regions(F.col("regions"), 10)).alias("r"))
    return rows.select("archive_id", "chunk_row_id", "r.block_id", "r.page_number")


@query("SELECT archive_id, page_number, block_id, sort_order FROM ingest_blocks WHERE archive_id IS NOT NULL AND page_number IS NOT NULL")
def payload_rows(spark, d):
    """A page's blocks as a JSON attachment, read back as rows."""
    packed = _blocks(spark, d).groupBy("archive_id", "page_number").agg(F.to_json(F.collect_list(F.struct("block_id", "sort_order"))).cast("binary").alias("data"))
    return archive.payload_rows(packed, "data", "block_id string, sort_order int")


@query("SELECT chunk_row_id, CASE WHEN coalesce(heading_path, '') = '' THEN text ELSE heading_path || chr(10) || text END AS embedding_text FROM ingest_chunks WHERE trim(coalesce(text, '')) <> ''")
def embedding_texts(spark, d):
    """What an external chunker hands to the embedder; blank chunks are dropped."""
    return _chunks(spark, d).where(F.trim(F.coalesce("text", F.lit(""))) != "").select("chunk_row_id", values.embedding_text(F.col("heading_path"), F.col("text")).alias("embedding_text"))


@query("SELECT 'page' AS kind, archive_id, count(*) AS n_rows FROM (SELECT DISTINCT archive_id, page_number FROM parsed_pages) GROUP BY 2 UNION ALL SELECT 'block', archive_id, count(DISTINCT block_id) FROM ingest_blocks GROUP BY 2 UNION ALL SELECT 'chunk', archive_id, count(DISTINCT chunk_id) FROM ingest_chunks GROUP BY 2 UNION ALL SELECT 'figure', archive_id, count(DISTINCT block_id) FROM ingest_blocks WHERE block_type = 'image' AND image_bytes IS NOT NULL GROUP BY 2")
def archive_documents(spark, d):
    """Pages, blocks, chunks and figures rebuilt from an archive, as counts per kind."""
    doc = library.document(_pages(spark, d), _blocks(spark, d), _chunks(spark, d))
    out = [df.groupBy("archive_id").agg(F.count("*").alias("n_rows")).select(F.lit(kind).alias("kind"), "archive_id", "n_rows") for kind, df in doc.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# ---- layout ---------------------------------------------------------------------------------------------------------

_SPANS = "sp AS (SELECT *, round((bbox[4] - bbox[2]) / len(string_split(coalesce(text, ''), chr(10))), 1) AS size, length(coalesce(text, '')) AS chars FROM ingest_blocks)"
_BODY = f"{_SPANS}, body AS (SELECT archive_id, coalesce((SELECT size FROM (SELECT size, sum(chars) AS n FROM sp s WHERE s.archive_id = a.archive_id AND size IS NOT NULL AND block_type <> 'image' GROUP BY size) ORDER BY n DESC, size LIMIT 1), 11.0) AS body_size FROM (SELECT DISTINCT archive_id FROM sp) a)"


@query(f"WITH {_BODY} SELECT archive_id, body_size FROM body")
def body_sizes(spark, d):
    return archive.body_sizes(archive.spans(_blocks(spark, d)))


@query(
    f"""WITH {_BODY}, h AS (SELECT archive_id, block_row_id, size FROM sp JOIN body USING (archive_id) WHERE block_type IN ('heading', 'paragraph') AND size >= body_size + 0.9 AND length(text) <= 300 AND len(string_split(text, chr(10))) <= 3)
SELECT archive_id, block_row_id, CAST(least(dense_rank() OVER (PARTITION BY archive_id ORDER BY size DESC), 6) AS INTEGER) AS level FROM h"""
)
def heading_levels(spark, d):
    return archive.heading_levels(archive.spans(_blocks(spark, d)))


@query("SELECT block_row_id FROM ingest_blocks WHERE block_type = 'image' AND NOT coalesce(bbox[3] - bbox[1] < 200 AND bbox[4] - bbox[2] < 200, FALSE)")
def large_figures(spark, d):
    return archive.large_figures(_blocks(spark, d), 200.0).select("block_row_id")


@query(
    """SELECT DISTINCT page_row_id FROM parsed_pages p JOIN ingest_blocks b USING (archive_id, page_number) WHERE block_type = 'image' AND width > 0 AND height > 0 AND len(bbox) = 4 AND length(regexp_replace(coalesce(p.text, ''), '[^\\p{L}\\p{N}]', '', 'g')) < 2000
AND greatest(least(bbox[3], width) - greatest(bbox[1], 0), 0) * greatest(least(bbox[4], height) - greatest(bbox[2], 0), 0) / (width * height) >= 0.01"""
)
def pages_to_read_optically(spark, d):
    return archive.pages_to_read_optically(_pages(spark, d), _blocks(spark, d), 0.01, 2000)


@query("SELECT block_row_id, CAST(row_number() OVER (PARTITION BY archive_id, page_number ORDER BY bbox[2] NULLS LAST, bbox[1] NULLS LAST, block_row_id) AS INTEGER) AS place FROM ingest_blocks")
def reading_order(spark, d):
    return archive.reading_order(_blocks(spark, d))


@query(
    f"""WITH k AS (SELECT * FROM ingest_blocks WHERE block_type <> 'table' AND block_row_id NOT IN (SELECT a.block_row_id FROM ingest_blocks a JOIN ingest_blocks b ON a.archive_id = b.archive_id AND a.page_number = b.page_number
WHERE a.block_type = 'paragraph' AND b.block_type = 'table' AND a.bbox IS NOT NULL AND b.bbox IS NOT NULL AND {_AREA.format("a")} > 0 AND {_INTER} / ({_AREA.format("a")}) >= 0.5) UNION ALL SELECT * FROM ingest_blocks WHERE block_type = 'table')
SELECT block_row_id, CAST(row_number() OVER (PARTITION BY archive_id, page_number ORDER BY bbox[2] NULLS LAST, bbox[1] NULLS LAST, block_row_id) AS INTEGER) AS place FROM k"""
)
def blocks_with_tables(spark, d):
    """Blocks without the text of tables, and the tables, in reading order."""
    blocks = _blocks(spark, d)
    both = layout.without_table_text(blocks).where("block_type <> 'table'").unionByName(blocks.where("block_type = 'table'"))
    return archive.reading_order(both)


@query("SELECT block_row_id, round(greatest(bbox[1] - 20, 0), 3) AS x0, round(least(bbox[4] - 30, h), 3) AS y1 FROM ingest_blocks JOIN (SELECT archive_id, page_number, max(width) AS w, max(height) AS h FROM parsed_pages GROUP BY 1, 2) USING (archive_id, page_number) WHERE len(bbox) = 4 AND least(bbox[3] - 20, w) > greatest(bbox[1] - 20, 0) AND least(bbox[4] - 30, h) > greatest(bbox[2] - 30, 0)")
def crop_shift(spark, d):
    sizes = _pages(spark, d).groupBy("archive_id", "page_number").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    b = _blocks(spark, d).where(F.size("bbox") == 4).join(sizes, ["archive_id", "page_number"])
    box = archive.crop_shifted(F.col("bbox"), F.array(F.lit(20.0), F.lit(30.0)), F.col("w"), F.col("h"))
    return b.select("block_row_id", box.alias("box")).where("box is not null").select("block_row_id", F.round(F.get("box", F.lit(0)), 3).alias("x0"), F.round(F.get("box", F.lit(3)), 3).alias("y1"))


@query("SELECT block_row_id, printf('block_%06d', row_number() OVER (PARTITION BY archive_id ORDER BY page_number, sort_order, block_row_id)) AS numbered_id FROM ingest_blocks WHERE page_number IS NOT NULL AND sort_order IS NOT NULL")
def block_numbering(spark, d):
    blocks = _blocks(spark, d).where("page_number is not null and sort_order is not null").select("archive_id", "page_number", "sort_order", "block_row_id")
    return archive.numbered_ids(blocks, "block", ["archive_id"], F.col("page_number"), ["sort_order", "block_row_id"]).select("block_row_id", "numbered_id")


@query("SELECT block_row_id, CASE WHEN n = 1 THEN block_id ELSE block_id || '_' || n END AS unique_id FROM (SELECT block_row_id, block_id, row_number() OVER (PARTITION BY archive_id, block_id ORDER BY block_row_id) AS n FROM ingest_blocks)")
def unique_block_ids(spark, d):
    return archive.unique_ids(_blocks(spark, d).select("archive_id", "block_id", "block_row_id"), ["archive_id"], "block_id", ["block_row_id"]).select("block_row_id", "unique_id")


# ---- conversion, counts ---------------------------------------------------------------------------------------------

_SOURCES = "src AS (SELECT relative_path AS path, CASE WHEN site IS NULL THEN NULL ELSE sha256(archive_metadata) END AS h FROM archives), old AS (SELECT relative_path AS path, CASE WHEN pipeline = 'docling' THEN 'x' ELSE sha256(archive_metadata) END AS h FROM archives WHERE pipeline IS DISTINCT FROM 'plainpages')"


@query(f"WITH {_SOURCES} SELECT CASE WHEN s.h IS NULL THEN 'malformed' WHEN s.h = o.h THEN 'skipped' WHEN o.h IS NULL THEN 'new' ELSE 'changed' END AS status, count(*) AS n_files FROM src s LEFT JOIN old o USING (path) GROUP BY 1")
def conversion_report(spark, d):
    a = _archives(spark, d).withColumn("hash", F.sha2("archive_metadata", 256))
    sources = a.select(F.col("relative_path").alias("path"), F.when(F.col("site").isNotNull(), F.col("hash")).alias("hash"))
    old = a.where(~F.col("pipeline").eqNullSafe("plainpages")).select(F.col("relative_path").alias("path"), F.when(F.col("pipeline") == "docling", "x").otherwise(F.col("hash")).alias("hash"))
    return archive.conversion_report(archive.conversion_plan(sources, old))


@query("SELECT 'archives' AS kind, count(*) AS n_rows FROM archives UNION ALL SELECT 'pages', count(*) FROM parsed_pages UNION ALL SELECT 'blocks', count(*) FROM ingest_blocks UNION ALL SELECT 'chunks', count(*) FROM ingest_chunks")
def table_counts(spark, d):
    return archive.table_counts({"archives": _archives(spark, d), "pages": _pages(spark, d), "blocks": _blocks(spark, d), "chunks": _chunks(spark, d)})


_INSPECT = """i AS (SELECT a.archive_id, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN coalesce(stored, 0) > 0 THEN stored ELSE coalesce(last_page, 0) END AS n_pages FROM archives a
LEFT JOIN (SELECT archive_id, count(*) AS n_chunks, CAST(max(coalesce(page_end, page_start, 0)) AS BIGINT) AS last_page FROM ingest_chunks GROUP BY 1) USING (archive_id)
LEFT JOIN (SELECT archive_id, count(DISTINCT page_number) AS stored FROM parsed_pages GROUP BY 1) USING (archive_id))"""


@query(f"WITH {_INSPECT} SELECT count(*) AS n_files, CAST(sum(n_pages) AS BIGINT) AS n_pages, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, (SELECT string_agg(DISTINCT embedding_model, ',' ORDER BY embedding_model) FROM archives) AS models FROM i")
def corpus_totals(spark, d):
    a = _archives(spark, d)
    return archive.corpus_totals(library.summary(a, _chunks(spark, d), _pages(spark, d)), a).withColumn("models", F.array_join("models", ","))


@query("SELECT embedding_model, CAST(sum(n) AS BIGINT) AS n_indexed, CAST(sum(coalesce(s, n)) AS BIGINT) AS n_source FROM (SELECT archive_id, count(*) AS n FROM ingest_chunks GROUP BY 1) JOIN archives USING (archive_id) LEFT JOIN (SELECT archive_id, count(DISTINCT chunk_id) AS s FROM ingest_chunks WHERE page_start > 1 GROUP BY 1) USING (archive_id) GROUP BY 1")
def source_totals(spark, d):
    """Chunks in the index and in the sources, a missing source counting as indexed."""
    chunks = _chunks(spark, d)
    source = chunks.where("page_start > 1").groupBy("archive_id").agg(F.count_distinct("chunk_id").alias("n_source"))
    return library.source_totals(chunks.groupBy("archive_id").agg(F.count("*").alias("n_indexed")), source, _archives(spark, d))


@query("SELECT lang, upper_middle FROM (SELECT lang, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_middle FROM documents WHERE n_chars IS NOT NULL GROUP BY lang)")
def upper_middle_sizes(spark, d):
    return archive.upper_middle(table(spark, d, "documents").where("n_chars is not null"), ["lang"], "n_chars")


@query("SELECT chunk_row_id, embedding_model, embedding_dimension, row_number() OVER (PARTITION BY embedding_model, embedding_dimension ORDER BY chunk_row_id) - 1 AS vector_row FROM ingest_chunks JOIN archives USING (archive_id)")
def vector_rows(spark, d):
    return archive.vector_rows(_chunks(spark, d), _archives(spark, d))


# ---- values ---------------------------------------------------------------------------------------------------------


@query("SELECT archive_id, '{\"ocr_mode\":' || to_json(json_extract_string(archive_metadata, '$.ocr_mode')) || ',\"pipeline\":' || coalesce(to_json(pipeline), 'null') || '}' AS canonical FROM archives WHERE json_extract_string(archive_metadata, '$.ocr_mode') IS NOT NULL")
def canonical_metadata(spark, d):
    mode = F.get_json_object("archive_metadata", "$.ocr_mode")
    loose = F.to_json(F.struct(F.col("pipeline").alias("pipeline"), mode.alias("ocr_mode")), {"ignoreNullFields": "false", "pretty": "true"})
    return _archives(spark, d).where(mode.isNotNull()).select("archive_id", values.canonical_json(loose).alias("canonical"))


@query("SELECT chunk_row_id, json_valid(coalesce(metadata, '')) AND coalesce(json_type(CASE WHEN json_valid(coalesce(metadata, '')) THEN metadata END) = 'OBJECT', FALSE) AS ok FROM ingest_chunks")
def metadata_objects(spark, d):
    return _chunks(spark, d).select("chunk_row_id", values.is_json_object(F.col("metadata")).alias("ok"))


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def vector_bytes(spark, d):
    """Vectors as bytes and back."""
    e = table(spark, d, "embeddings").withColumn("b", values.vector_bytes(F.col("embedding"))).withColumn("v", values.bytes_vector(F.col("b")))
    return e.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT vec_id, i, round((e[i] + e[i + 16] + e[i + 32]) / 3, 5) AS mean FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, 17)) AS i FROM embeddings)")
def mean_pool(spark, d):
    """Each vector as four states of 16 numbers, of which the last is masked."""
    e = table(spark, d, "embeddings").withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16)))
    pooled = e.select("vec_id", F.posexplode(values.mean_pool(F.col("h"), F.array(F.lit(1), F.lit(1), F.lit(1), F.lit(0)))).alias("i", "mean"))
    return pooled.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("mean", 5).alias("mean"))


@query("SELECT archive_id, regexp_extract(json_extract_string(archive_metadata, '$.source_filename'), '[^/]*$') AS name, regexp_replace(relative_path, '/', '_', 'g') AS id, printf('page_%06d', 7) AS page FROM archives WHERE json_extract_string(archive_metadata, '$.source_filename') IS NOT NULL")
def safe_names(spark, d):
    """Stored names without folders, references as ids, ids of pages."""
    name = F.get_json_object("archive_metadata", "$.source_filename")
    a = _archives(spark, d).where(name.isNotNull())
    page = F.format_string("page_%06d", values.page_of_message(F.concat(F.lit("cannot read page 7 of "), "archive_id")))
    return a.select("archive_id", values.safe_filename(F.concat(F.lit("../up/"), name)).alias("name"), values.block_id_of_ref(F.concat(F.lit("#/"), "relative_path")).alias("id"), page.alias("page"))


@query("SELECT doc_id, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM documents")
def utc_times(spark, d):
    return table(spark, d, "documents").select("doc_id", values.utc_seconds(F.col("fetched_at")).alias("at"))


@query("SELECT chunk_row_id, page_start <= 5 AND greatest(page_start, page_end) >= 5 OR page_start <= 2 AND greatest(page_start, page_end) >= 2 AS overlaps FROM ingest_chunks")
def chunks_on_pages(spark, d):
    """Whether a chunk overlaps pages 2 or 5."""
    return _chunks(spark, d).select("chunk_row_id", chunking.overlaps_pages(F.col("page_start"), F.col("page_end"), [2, 5]).alias("overlaps"))


@query("SELECT chunk_row_id, json_extract_string(j, '$.id') AS id, json_extract_string(j, '$.heading') AS heading FROM (SELECT chunk_row_id, to_json(struct_pack(id := chunk_id, heading := CASE WHEN heading_path = '' THEN NULL ELSE heading_path END)) AS j FROM ingest_chunks)")
def result_dicts(spark, d):
    """Results as JSON without null fields, read again."""
    rows = _chunks(spark, d).select("chunk_row_id", F.col("chunk_id").alias("id"), F.when(F.col("heading_path") != "", F.col("heading_path")).alias("heading"), F.array().cast("array<string>").alias("context"))
    packed = rows.select("chunk_row_id", archive.as_json(["id", "heading"], "context").alias("j"))
    return packed.select("chunk_row_id", F.get_json_object("j", "$.id").alias("id"), F.get_json_object("j", "$.heading").alias("heading"))


# ---- retrieval for agents -------------------------------------------------------------------------------------------


@query(
    _GLOBAL
    + f""", best AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 9) AS score FROM scored QUALIFY rank <= {K}),
fresh AS (SELECT * FROM best WHERE id % 3 <> 0), kept AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM fresh)
SELECT query_id, id, rank, 'C' || CAST(4 + row_number() OVER (PARTITION BY query_id ORDER BY rank) AS VARCHAR) AS label FROM kept WHERE n = 1 OR score >= 0.55 * top"""
)
def agent_retrieval(spark, d):
    """Hits that the session hasn't seen, cut at the balanced quality, labelled on from C4."""
    hits = best_hits.best_hits(_chunks(spark, d), _cases(spark, d), "chunk_row_id", K)
    seen = _chunks(spark, d).where("chunk_row_id % 3 = 0").select(F.col("chunk_row_id").alias("id"))
    full = retrieval.fresh_hits(hits, seen, fusion.BALANCED, 4)
    return full.select("query_id", "id", "rank", "label")


@query(
    _BY_ARCHIVE
    + ", x AS (SELECT 1), "
    + _HASHED_ALL
    + f""", sf AS (SELECT query_id, archive_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id, archive_id ORDER BY round(score, 9) DESC, id) AS fr FROM sem JOIN ingest_chunks c ON c.chunk_row_id = sem.id QUALIFY fr <= 50),
kf AS (SELECT query_id, archive_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id, archive_id ORDER BY round(score, 9) DESC, id) AS fr FROM scored QUALIFY fr <= 50),
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, archive_id, id) AS rank FROM sf QUALIFY rank <= 50
UNION ALL SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, archive_id, id) FROM kf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, archive_id, id) <= 50),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM l GROUP BY ALL)"""
    + _TOP.format("f", K)
)
def fanout_hybrid(spark, d):
    """Per archive the best of both lists, merged into one list each, fused by rank."""
    return _top(retrieval.fanout_hybrid(_chunks(spark, d), _cases(spark, d), "chunk_row_id", K))
