"""The stored index, archive operators and values on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import values
from siltstone.operators import archive, fusion, keyword, retrieval, semantic
from siltstone.plans import library
from siltstone.session import CLEANUP, broadcast_if_small, cut_lineage, shuffles_released
from siltstone.streaming import ingest


@pytest.fixture
def tables(spark):
    archives = spark.createDataFrame([(f"a{i}", f"x/a{i}.file", "m" if i % 2 else "n", 384, '{"source_filename": "zoning_manual.pdf"}') for i in range(4)], "archive_id string, relative_path string, embedding_model string, embedding_dimension int, archive_metadata string")
    chunks = spark.createDataFrame([(i, f"a{i % 4}", i, f"chunk {i} about basin number {i % 5} and its drain", "Chapter 1 Parking" if i == 7 else None, [f"b{i}"]) for i in range(40)], "chunk_row_id bigint, archive_id string, seq bigint, text string, heading_path string, block_ids array<string>")
    return archives, chunks


def test_index(spark, tmp_path, tables):
    archives, chunks = tables
    root = str(tmp_path)
    first = library.build_index(spark, root, archives, chunks)
    corpus = library.Corpus.open(spark, root, archives)
    queries = spark.createDataFrame([(1, "basin drain"), (2, "parking"), (3, "zoning"), (4, "chu"), (5, "nothing")], "query_id bigint, query_text string")
    hits = corpus.search(queries, "keyword", 100).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in hits} == {1: 40, 2: 1, 3: 40, 4: 40}
    rows = chunks.join(archives.select("archive_id", F.get_json_object("archive_metadata", "$.source_filename").alias("source_filename")), "archive_id")
    fresh = {(r.query_id, r.id): round(r.score, 9) for r in keyword.keyword_scores(rows, queries, "chunk_row_id", library.FIELDS).collect()}
    assert {(r.query_id, r.id): r.score for r in corpus.keyword(queries).collect()} == pytest.approx(fresh)
    assert corpus.search(queries, "hybrid", 3).where("query_id = 1").count() == 3
    assert library.index_status(spark, root, archives).count() == 0 and library.update_index(spark, root, archives, chunks) is None
    other = archives.where("archive_id <> 'a3'").unionByName(archives.where("archive_id = 'a3'").withColumn("relative_path", F.lit("y")))
    assert {tuple(r) for r in library.index_status(spark, root, other).collect()} == {("y", "new"), ("x/a3.file", "missing")}
    with pytest.raises(RuntimeError):
        library.Corpus.open(spark, root, other)
    assert library.update_index(spark, root, other, chunks) != first
    assert library.Corpus.open(spark, root, other).index["chunks"].where("pos is null").count() == 0


def test_dense_top_k(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8)).round(1)
    m[5] = 0
    m[9] = m[8]
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(m)] + [(999, None)], "i bigint, v array<float>").repartition(4)
    got = semantic.dense_top_k(v, v.where("i % 50 = 5 or i = 8"), "i", "v", "i", 7, 8).collect()
    unit = m.astype("float32").astype(float) / np.maximum(np.sqrt((m.astype("float32").astype(float) ** 2).sum(1)), 1e-300)[:, None]
    s = np.round(unit @ unit.T, 9) + 0.0
    for q in (8, 55, 105):
        wanted = sorted(range(300), key=lambda i: (-s[q, i], i))[:7]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == wanted
    assert not [r for r in got if r.query_id == 5]
    assert semantic.dense_top_k(v, v.limit(0), "i", "v", "i", 7, 8).count() == 0


def test_positions_in_two_levels(spark):
    df = spark.createDataFrame([("a", i * 37 % 5000, i) for i in range(3000)] + [(None, 5, -1), ("b", None, -2)], "g string, seq bigint, id bigint")
    got = {(r.g, r.id): r.pos for r in fusion.with_position(df, "g", "seq", "id").collect()}
    order = sorted((i * 37 % 5000, i) for i in range(3000))
    assert all(got[("a", i)] == n for n, (_, i) in enumerate(order, 1)) and got[(None, -1)] == 1 and got[("b", -2)] == 1


def test_unique_ids_and_gaps(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "x_2", 3), ("a", "x", 4), ("b", "x", 5)], "archive_id string, block_id string, row bigint")
    ids = [r.unique_id for r in archive.unique_ids(df, ["archive_id"], "block_id", ["row"]).orderBy("row").collect()]
    assert ids[0] == "x" and ids[2] == "x_2" and len(set(ids[:4])) == 4 and ids[4] == "x"
    pages = spark.createDataFrame([("a", 2), ("a", 2), ("a", 1_000_000_000), ("b", 1), ("c", None)], "archive_id string, page_number int")
    assert sorted(map(tuple, archive.missing_pages(pages).collect())) == [("a", 1, 1), ("a", 3, 999_999_999)]


def test_values(spark):
    rows = [('{"b": 1, "a": {"d": "é", "c": null}}',), ("[1]",), ('{"a": NaN}',), (None,), ("{",)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(values.canonical_json(F.col("j"))).collect()]
    assert got == ['{"a":{"c":null,"d":"é"},"b":1}', None, None, None, None]
    names = [r[0] for r in spark.createDataFrame([("a/b.pdf",), ("..",), ("c:\\x\\..\\y.pdf",), ("",), ("d/",)], "s string").select(values.safe_filename(F.col("s"))).collect()]
    assert names == ["b.pdf", None, "y.pdf", None, None]
    pooled = spark.sql("select array(array(1.0D, 2.0D), array(3.0D, 6.0D), array(9.0D, 9.0D)) h, array(1, 1, 0) m").select(values.mean_pool(F.col("h"), F.col("m"))).first()[0]
    assert pooled == [2.0, 4.0]
    assert spark.range(1).select(values.page_of_message(F.lit("bad Page 12."))).first()[0] == 12 and spark.range(1).select(values.page_of_message(F.lit("bad"))).first()[0] is None


def test_session_retrieval(spark):
    hits = spark.createDataFrame([(1, i, i, 10.0 - i) for i in range(1, 9)], "query_id bigint, id bigint, rank bigint, score double")
    got = retrieval.fresh_hits(hits, hits.where("id in (1, 3)"), fusion.BALANCED, 2, 6).orderBy("rank").collect()
    assert [(r.id, r.label) for r in got] == [(2, "C3"), (4, "C4"), (5, "C5")]


def test_broadcast_is_counted(spark):
    big, small = spark.range(50), spark.range(3)
    plan = lambda df: big.join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(broadcast_if_small(small, 10)) and "merge" in plan(broadcast_if_small(big, 10))


def test_stream_merges(spark, tmp_path):
    schema = "id bigint, text string, version bigint"
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1), (2, "bb", 2)], [(2, "c", 3), (3, "d", 1)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest.merge_stream(spark, source, spark.createDataFrame([], schema).schema, root, ["id"], "version", [], str(tmp_path / "log")).awaitTermination()
    assert sorted(map(tuple, ingest.records(spark, root).collect())) == [(1, "a", 1), (2, "c", 3), (3, "d", 1)]


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_shuffle_files_go_at_once(spark):
    before, set_before = _shuffle_files(spark), spark.conf.get(CLEANUP, None)
    got = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    with shuffles_released(spark):
        rows = spark.range(1000).groupBy((F.col("id") % 5).alias("k")).count()
    assert len(rows.collect()) == 5 and _shuffle_files(spark) <= before
    assert {r.k: r["count"] for r in got.collect()} == {k: 1000 // 7 + (k < 1000 % 7) for k in range(7)}
    assert spark.conf.get(CLEANUP, None) == set_before


@pytest.mark.parametrize("density", [0.0, 0.02, 0.9])
def test_query_matrix_is_sent_small(density):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(50, 384)) * (rng.random((50, 384)) < density)
    sent = semantic._without_zeros(m)
    assert np.array_equal(semantic._with_zeros(*sent), m)
    assert sum(x.nbytes for x in sent[1:] if x is not None) <= m.nbytes
    assert density > 0.5 or sum(x.nbytes for x in sent[1:]) < m.nbytes / 20
