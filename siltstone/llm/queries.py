"""Registered queries of the training-data operators. p4_found and p5_found have SQL; the others' results are tested."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import canonical, corpus, mixing, mojibake, near_duplicates, oversize, packing, scan_noise, site_lines
from siltstone.session import table


def _noise_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return corpus.page_and_block_texts(spark, d), table(spark, d, "archives"), table(spark, d, "ingest_chunks").where("text is not null")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.defects(*_noise_inputs(spark, d))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(*_noise_inputs(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unstable_rows(corpus.block_and_chunk_texts(spark, d)).select("record_kind", "row_id")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonicalize(corpus.block_and_chunk_texts(spark, d)).select("record_kind", "row_id", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.similar_rows(table(spark, d, "ingest_chunks"), "chunk_row_id", threshold=0.6, shingle=3)
    return pairs.select(F.col("id_a").alias("chunk_row_id_a"), F.col("id_b").alias("chunk_row_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_groups(table(spark, d, "ingest_chunks"), "chunk_row_id", threshold=0.6, shingle=3).withColumnRenamed("id", "chunk_row_id")


def _split_inputs(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("ingest_chunks", "archives", "split_rules")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return oversize.oversized(*_split_inputs(spark, d))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return oversize.chunk_pieces(*_split_inputs(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.excessive_lines(corpus.page_and_block_texts(spark, d), table(spark, d, "archives"))


def p5_templates(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.line_templates(corpus.page_and_block_texts(spark, d), table(spark, d, "archives")).drop("leaf", "letters")


def p5_without_lines(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.without_site_lines(corpus.page_and_block_texts(spark, d), table(spark, d, "archives"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(packing.document_sizes(table(spark, d, "documents")), table(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d), table(spark, d, "pack_capacities"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(packing.document_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(p7_mixed(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.affected(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_repaired, p2_found, p2_canonical, p3_found, p3_groups, p4_found, p4_pieces, p5_found, p5_templates, p5_without_lines, p6_containers, p6_fill, p7_mixed, p7_shares, p8_found, p8_restored)
}

_LINES = r"""
WITH texts AS (
  SELECT 'page' AS record_kind, page_row_id AS row_id, archive_id, text FROM parsed_pages
  UNION ALL SELECT 'block', block_row_id, archive_id, text FROM ingest_blocks),
split AS (SELECT record_kind, row_id, archive_id, string_split(text, chr(10)) AS ls FROM texts WHERE text IS NOT NULL AND text <> ''),
lines AS (SELECT record_kind, row_id, archive_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no FROM split),
own AS (SELECT archive_id, min(site) AS site FROM archives WHERE site IS NOT NULL GROUP BY archive_id),
keyed AS (
  SELECT record_kind, row_id, line_no, archive_id, site, regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g') AS k
  FROM lines JOIN own USING (archive_id) WHERE length(regexp_replace(line, '[^\p{L}]+', '', 'g')) >= 8),
sizes AS (SELECT site, count(*) AS n FROM own GROUP BY site),
bad AS (
  SELECT site, k FROM keyed JOIN sizes USING (site) GROUP BY site, k, n
  HAVING count(DISTINCT archive_id) >= 6 AND count(DISTINCT archive_id) >= 0.05 * n)
"""

# Only what the consistent form does to white space and to characters without a shape can change the number of words.
_OVER = r"""
WITH owners AS (SELECT archive_id, min(pipeline) AS pipeline FROM archives GROUP BY 1),
plain AS (SELECT chunk_row_id, archive_id, regexp_replace(regexp_replace(text, '[\p{Cf}\x{34f}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{180b}-\x{180d}\x{fe00}-\x{fe0f}]', '', 'g'), '[\p{Zs}]', ' ', 'g') AS t FROM ingest_chunks WHERE text IS NOT NULL),
counted AS (SELECT chunk_row_id, archive_id, len(regexp_extract_all(t, '[^ \t\n\r\f\x0b]+')) AS n FROM plain)
SELECT chunk_row_id FROM counted LEFT JOIN owners USING (archive_id) LEFT JOIN split_rules r ON r.pipeline = owners.pipeline CROSS JOIN (SELECT max_tokens AS m FROM split_rules WHERE pipeline = 'default') WHERE n > coalesce(r.max_tokens, m)"""

ORACLE_SQL: dict[str, str] = {"p4_found": _OVER, "p5_found": _LINES + "SELECT record_kind, row_id, line_no FROM keyed JOIN bad USING (site, k)"}
