"""The best hits equal those of all scores, and no hit beyond them is written."""

import glob
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import best_hits, fusion, keyword

WORDS = ["basin", "basins", "permit", "curb", "drain", "drainage", "outlet", "hearing", "notice", "setback", "parking"]
EXPRESSIONS = ["basin permit", "basin OR curb", "drain* NOT curb", '"basin permit"', "^outlet", "^dra*", "(basin OR outlet) AND permit", "what basin?", "4.2", None, "", "dra", "curb curb", '"notice of drain"*', "zzz", "sub_bas basi_per", '"-" basin', "basin permit"]


def chunks(spark, n=400):
    text = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, WORDS)), (F.abs(F.xxhash64("id", F.lit(i))) % len(WORDS) + 1).cast("int")) for i in range(7)])
    rows = spark.range(0, n, 1, 5).select("id", F.concat(F.lit("ar"), F.col("id") % 7).alias("archive_id"), F.when(F.col("id") % 50 != 0, text).alias("text"))
    return rows.withColumn("text", F.when(F.col("id") % 9 == 0, F.concat("text", F.lit(" sub-basin perfect notice, of drainage"))).otherwise(F.col("text")))


def cases(spark, expressions=EXPRESSIONS):
    return spark.createDataFrame(list(enumerate(expressions)), "query_id bigint, query_text string")


def plain(df, *columns):
    return sorted((*[r[c] for c in columns], r["rank"], round(r["score"], 8)) for r in df.collect())


@pytest.mark.parametrize("fallback", [True, False])
def test_best_hits_like_all_scores(spark, monkeypatch, fallback):
    monkeypatch.setattr(best_hits, "BLOCK", 7)
    every = keyword.keyword_scores(chunks(spark), cases(spark), "id", fallback=fallback).withColumn("score", F.round("score", 9))
    wanted = plain(fusion.top_k(every, 5, ["query_id"], ["id"]), "query_id", "id")
    assert len({r[0] for r in wanted}) > 8
    assert plain(best_hits.best_hits(chunks(spark), cases(spark), "id", 5, fallback=fallback), "query_id", "id") == wanted


@pytest.mark.parametrize("big", [16384, 57])
@pytest.mark.parametrize("per_group", [None, 2])
def test_best_hits_by_group_like_all_scores(spark, monkeypatch, big, per_group):
    monkeypatch.setattr(best_hits, "BIG_GROUP", big)
    every = keyword.keyword_scores(chunks(spark), cases(spark), "id", by=["archive_id"]).withColumn("score", F.round("score", 9))
    ranked = fusion.top_k(every, per_group or 1000, ["query_id", "archive_id"], ["id"]).withColumnRenamed("rank", "file_rank")
    wanted = plain(fusion.top_k(ranked, 9, ["query_id"], [*(["file_rank"] if per_group else []), "archive_id", "id"]), "query_id", "archive_id", "id")
    assert len({r[0] for r in wanted}) > 8
    assert plain(best_hits.best_hits_by(chunks(spark), cases(spark), "id", 9, "archive_id", per_group), "query_id", "archive_id", "id") == wanted


def test_segments_part_between_groups_only(monkeypatch):
    monkeypatch.setattr(best_hits, "SEGMENT", 10)
    monkeypatch.setattr(best_hits, "SLICE", 4)
    groups = sorted(f"g{i % 5 if i < 30 else 9}" for i in range(60))
    batches = [pa.RecordBatch.from_pydict({"a": pa.array(groups[i : i + 13]), "id": pa.array(range(i, min(i + 13, 60)), pa.int64()), "length": pa.array([3] * min(13, 60 - i), pa.int32()), "phrases": pa.array([[0, 1]] * min(13, 60 - i), pa.list_(pa.int32())), "tfs": pa.array([[1, i]] * min(13, 60 - i), pa.list_(pa.int32()))}) for i in range(0, 60, 13)]
    plan = best_hits.Plan([(1, "b a")])
    found = list(best_hits._segments(iter(batches), plan, best_hits._from_compact("a"), True))
    assert len(found) > 2 and [i for s in found for i in s.ids] == list(range(60))
    assert not any(set(a.groups) & set(b.groups) for a in found for b in found if a is not b)
    assert all(list(s.of(p)) == list(range(len(s.ids))) for s in found for p in (0, 1))


def written(spark, tmp_path, run):
    """Bytes of checkpoints that a call writes."""
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        run().count()
        return sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/**/part-*", recursive=True))
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)


QUERIES = ["keyword_topk_global", "keyword_per_archive_topk", "fanout_hybrid", "eval_first_ranks", "hybrid_rrf_corpus", "evidence_list", "quality_cutoff_labels", "keyword_index_fields", "context_window", "agent_retrieval"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_hits_are_written(spark, tmp_path, name):
    """All chunks have the word of every query."""
    from siltstone.plans import catalogue, catalogue_archive  # noqa: F401

    rows = chunks(spark, 3000).select(
        F.col("id").alias("chunk_row_id"), "archive_id", F.col("id").alias("seq"), F.concat_ws(" ", "text", F.lit("basin")).alias("text"), F.lit("A > B").alias("heading_path"),
        F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("{}").alias("metadata"),
    )
    d = str(tmp_path / "in")
    rows.write.parquet(f"{d}/ingest_chunks.parquet")
    archives = rows.select("archive_id", F.lit("p").alias("relative_path"), F.lit("m").alias("embedding_model"), F.lit(4).alias("embedding_dimension"), F.lit('{"source_filename": "x.pdf"}').alias("archive_metadata")).distinct()
    archives.write.parquet(f"{d}/archives.parquet")
    asked = cases(spark, [f"basin {w}" for w in WORDS] * 8 + [f"basi, {w}" for w in WORDS] * 8).withColumn("archive_id", F.lit("ar1"))
    asked.selectExpr("*", "array(1) AS expected_pages", "1 AS expected_page", "array('basin') AS expected_terms").coalesce(1).write.parquet(f"{d}/query_cases.parquet")
    size = sum(os.path.getsize(f) for f in glob.glob(f"{d}/**/part-*.parquet", recursive=True))
    assert written(spark, tmp_path / "checkpoints", lambda: catalogue.QUERIES[name](spark, d)) < 20 * size


def test_vectors_in_place_like_shuffled_ones(spark, monkeypatch):
    from siltstone.functions.embed import get_embedder
    from siltstone.operators import semantic

    texts = chunks(spark).unionByName(spark.createDataFrame([(900, "x", ""), (901, "x", "?"), (902, None, "basin")], "id bigint, archive_id string, text string"))
    for model in ("hashing", "hashing-sha256:7"):
        made = lambda: sorted((r.id, str(r.archive_id), r.buckets, r.amounts) for r in semantic.sparse_vectors(texts, "id", get_embedder(model), ["archive_id"]).collect())  # noqa: B023, E731
        monkeypatch.setattr(semantic, "MOST_WORDS", 500_000)
        own = made()
        monkeypatch.setattr(semantic, "MOST_WORDS", 1)
        assert own == made() and len(own) > 380


@pytest.mark.parametrize(("segment", "most_terms"), [(16384, 1000), (60, 3)])
def test_stored_hits_like_all_scores(spark, monkeypatch, tmp_path, segment, most_terms):
    monkeypatch.setattr(best_hits, "SEGMENT", segment)
    monkeypatch.setattr(best_hits, "SLICE", min(segment // 3, best_hits.SLICE))
    monkeypatch.setattr(best_hits, "MOST_TERMS", most_terms)
    docs = chunks(spark).withColumn("heading", F.when(F.col("id") % 4 == 0, F.lit("Outlet hearing")))
    every = keyword.keyword_scores(docs, cases(spark), "id", ["text", "heading"]).withColumn("score", F.round("score", 9))
    wanted = plain(fusion.top_k(every, 5, ["query_id"], ["id"]), "query_id", "id")
    assert len({r[0] for r in wanted}) > 8
    best_hits.stored_postings(keyword.token_table(docs, "id", ["text", "heading"], [])).write.parquet(str(tmp_path / "p"))
    postings = spark.read.parquet(str(tmp_path / "p"))
    assert (postings.where("term = ''").count() > 6) == (segment == 60)
    words = postings.where("term <> ''").select("term").distinct()
    assert plain(best_hits.stored_hits(postings, words, cases(spark), 5), "query_id", "id") == wanted
    assert best_hits.stored_hits(postings.limit(0), words.limit(0), cases(spark), 5).count() == 0


@pytest.mark.parametrize("name", ["stored_index_keyword", "stored_index_hybrid"])
def test_stored_index_writes_little(spark, tmp_path, name):
    """Neither building the index nor searching it writes more than the index and the best hits; all chunks are hits."""
    from siltstone.plans import catalogue

    rows = chunks(spark, 12000).select(F.col("id").alias("chunk_row_id"), "archive_id", F.col("id").alias("seq"), F.concat_ws(" ", "text", F.lit("basin")).alias("text"), F.lit("A > B").alias("heading_path"))
    d = str(tmp_path / "in")
    rows.write.parquet(f"{d}/ingest_chunks.parquet")
    archives = rows.select("archive_id", F.col("archive_id").alias("relative_path"), F.lit("m").alias("embedding_model"), F.lit(4).alias("embedding_dimension"), F.lit('{"source_filename": "x.pdf"}').alias("archive_metadata")).distinct()
    archives.write.parquet(f"{d}/archives.parquet")
    cases(spark, [f"basin {w}" for w in WORDS] * 4 + [f"basi, {w}" for w in WORDS] * 4).coalesce(1).write.parquet(f"{d}/query_cases.parquet")
    size = rows.agg(F.sum(F.length("text"))).first()[0]
    assert written(spark, tmp_path / "checkpoints", lambda: catalogue.QUERIES[name](spark, d)) < size
