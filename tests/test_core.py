"""Value-level tests of the core operators on small tables."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone.functions import fts, geometry, vectors
from siltstone.functions.embed import get_embedder, register_embedder, sparse_embed, unregister_embedder
from siltstone.functions.metadata import citation, where_equals
from siltstone.functions.text import markdown_table, page_selection
from siltstone.operators import chunking, evaluation, fusion, keyword, layout, records, semantic
from siltstone.sources import store

ROWS = ["Detention is required when impervious area increases; detention basins.", "Restaurants require one parking space per 100 square feet.", "Stormwater detention pond requirements for Café areas.", "Landscape buffer of trees", "the the the detention the basin requires", "x_y foo-bar Section 4.2 detention"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(ROWS)), "id bigint, text string")


@pytest.mark.parametrize("expression", ["detention requirements", "cafe", "buffer OR basin", "det* OR req*", "detention NOT basin", '"detention pond"', "^the", "(basin OR pond) AND detention", "detention NOT basin requires", "x_y"])
def test_bm25_like_fts5(spark, expression):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text)")
    con.executemany("insert into t(rowid, text) values (?, ?)", [(i + 1, r) for i, r in enumerate(ROWS)])
    wanted = {i - 1: round(-s, 9) for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (expression,))}
    queries = spark.createDataFrame([(1, expression)], "query_id bigint, query_text string")
    got = {r.id: round(r.score, 9) for r in keyword.keyword_scores(docs(spark), queries, "id", fallback=False).collect()}
    assert got == pytest.approx(wanted)


def test_fallback_and_invalid(spark):
    assert fts.parse("when is it required?") is None and fts.parse("4.2") is None and fts.parse("") is None and fts.parse('"open') is None
    queries = spark.createDataFrame([(1, "when is it required?"), (2, "park landscap"), (3, None), (4, "zzz")], "query_id bigint, query_text string")
    got = keyword.keyword_scores(docs(spark), queries, "id").groupBy("query_id").agg(F.collect_set("id").alias("ids")).collect()
    assert {r.query_id: set(r.ids) for r in got} == {1: {0}, 2: {1, 3}}


def test_min_max_hybrid_rrf(spark):
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (1, "c", 6.0), (2, "a", 5.0)], "query_id int, id string, score double")
    n = {(r.query_id, r.id): r.normalized for r in fusion.min_max(s, ["query_id"]).collect()}
    assert n == {(1, "a"): 0.0, (1, "b"): 0.5, (1, "c"): 1.0, (2, "a"): 1.0}
    one = lambda i: spark.createDataFrame([(1, i, 1.0)], "query_id int, id string, score double")
    assert {r.id: r.score for r in fusion.hybrid_scores(one("a"), one("b"), ["query_id"]).collect()} == {"a": 0.5, "b": 0.5}
    with pytest.raises(ValueError):
        fusion.hybrid_scores(one("a"), one("b"), ["query_id"], semantic_weight=0, keyword_weight=0)
    ranked = lambda *ids: spark.createDataFrame([(1, v, i) for i, v in enumerate(ids, 1)], "query_id int, id string, rank int")
    top = fusion.top_k(fusion.rrf([ranked("b", "a"), ranked("a", "b")], ["query_id"]), 5, ["query_id"], ["id"]).orderBy("rank").collect()
    assert [r.id for r in top] == ["a", "b"] and top[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_hashing_goldens(spark):
    words = spark.createDataFrame([("detention",), ("stormwater",), ("requirements",), ("parking",), ("restaurants",)], "w string")
    got = {r.w: (r.b.bucket, r.b.sign) for r in words.select("w", get_embedder("hashing").bucket_of(F.col("w"), 384).alias("b")).collect()}
    assert got == {"detention": (353, 1), "stormwater": (315, -1), "requirements": (317, 1), "parking": (160, -1), "restaurants": (253, -1)}
    other = {r.w: (r.b.bucket, r.b.sign) for r in words.select("w", get_embedder("hashing-sha256").bucket_of(F.col("w"), 384).alias("b")).collect()}
    assert other["detention"] == (45, -1) and other["parking"] == (150, 1)
    texts = spark.createDataFrame([(1, "Stormwater detention pond requirements."), (2, "Unrelated landscaping guidance.")], "id bigint, text string")
    q = spark.createDataFrame([(1, "detention requirements")], "query_id bigint, query_text string")
    assert {r.id: r.score for r in semantic.sparse_scores(texts, q, "id", get_embedder("hashing")).collect()} == {1: pytest.approx(0.7071067811865475)}
    assert sparse_embed(texts.where("id = 9"), ["id"], get_embedder("hashing")).count() == 0
    with pytest.raises(ValueError):
        register_embedder("hashing", lambda: None)
    register_embedder("own", lambda dimension=4: get_embedder("hashing"))
    unregister_embedder("own")


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "id bigint, v array<float>")
    got = {(r.query_id, r.id): r.score for r in semantic.dense_scores(v, v.where("id <= 1"), "id", "v", "id").collect()}
    assert got == {(0, 0): pytest.approx(1), (0, 1): 0.0, (0, 2): pytest.approx(0.70710678)}
    assert [round(r[0], 6) for r in v.where("id < 3").orderBy("id").select(vectors.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(1.0)))).collect()] == [0.707107, 0.0, 1.0]


def test_heading_paths_and_chunks(spark):
    rows = [("a", "b1", 1, 1, "heading", "Chapter 1 Zoning", 1), ("a", "b2", 1, 2, "heading", "Section 1.1 Parking", 2), ("a", "b3", 1, 3, "paragraph", "one two three", None), ("a", "b4", 1, 4, "image", "", None), ("a", "b5", 2, 5, "heading", "Chapter 2 Stormwater", 1), ("a", "b6", 2, 6, "image", None, None), ("a", "b7", 2, 7, "paragraph", " ".join(f"w{i}" for i in range(50)), None)]
    blocks = spark.createDataFrame(rows, "archive_id string, block_id string, page_number int, sort_order int, block_type string, text string, heading_level int")
    chunks = chunking.block_chunks(blocks, ["archive_id"], ["page_number", "sort_order"], 10, 2).orderBy("page_number", "chunk_no").collect()
    assert chunks[0].heading_path == "Chapter 1 Zoning > Section 1.1 Parking" and chunks[0].block_ids == ["b3", "b4"]
    assert chunks[1].heading_path == "Chapter 2 Stormwater" and chunks[1].block_ids == ["b7", "b6"] and all(c.block_ids == ["b7"] for c in chunks[2:])
    assert [c.token_count for c in chunks[1:]] == [10] * 6 and chunks[2].text.startswith("w8 w9 w10")
    pages = spark.createDataFrame([("a", 1, " ".join(["x"] * 30)), ("a", 2, " ".join(["y"] * 30)), ("a", 3, None)], "archive_id string, page_number int, text string")
    assert [(c.page_number, c.token_count) for c in chunking.page_chunks(pages, ["archive_id"], "page_number").orderBy("page_number").collect()] == [(1, 30), (2, 30)]
    assert chunking.block_chunks(blocks.limit(0), ["archive_id"], ["sort_order"]).count() == 0


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "a", [2], None, ["Pond"]), (2, "a", None, None, None), (3, "a", None, 9, None)], "query_id bigint, archive_id string, expected_pages array<int>, expected_page int, expected_terms array<string>")
    results = spark.createDataFrame([("k", 1, 1, "a", 1, 1, "pond"), ("k", 1, 2, "a", 2, 3, "a POND"), ("k", 2, 1, "a", 5, 5, "x"), ("k", 3, 1, "a", 1, 1, "x")], "mode string, query_id bigint, rank bigint, archive_id string, page_start int, page_end int, text string")
    r = evaluation.report(evaluation.first_ranks(results, cases)).first()
    assert (r.n_queries, r.hits, r.hit_rate, r.mrr) == (3, 2, 0.666667, 0.5)


def test_records_and_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "t1"), ("b", 2, "t2")], "id string, seq int, text string")
    new = spark.createDataFrame([("b", 9, "n2"), ("c", 3, "n3")], "id string, seq int, text string")
    assert sorted(map(tuple, records.upsert(old, new, ["id"], ["seq"]).collect())) == [("a", 1, "t1"), ("b", 2, "n2"), ("c", 3, "n3")]
    with pytest.raises(ValueError):
        records.insert(old, new, ["id"])
    assert [r.id for r in records.by_ids(old, "id", ["b", "a", "b", "z"]).collect()] == ["b", "a", "b"]
    before = spark.createDataFrame([("p1", "h1"), ("p2", "h2"), ("p3", "h3")], "path string, hash string")
    after = spark.createDataFrame([("p1", "h1"), ("q2", "h2"), ("p4", "h4")], "path string, hash string")
    assert records.change_summary(before, after).first().asDict() == {"added": 1, "removed": 1, "changed": 0, "moved": 1, "unchanged": 1}
    root = str(tmp_path / "s")
    store.publish(spark, root, {"t": old})
    store.publish(spark, root, {"t": new})
    assert store.read(spark, root, "t").count() == 2 and {r.id for r in store.read(spark, root, "t").collect()} == {"b", "c"}
    assert store.collect_garbage(spark, root) == 1 and store.current(spark, root)
    with pytest.raises(FileExistsError):
        store.publish(spark, root, {"t": old}, overwrite=False)


def test_metadata_geometry_text(spark):
    m = spark.createDataFrame([('{"page_start": 3, "page_end": "4", "heading_path": true, "k": 1}',), ('{"page_start": true, "k": "1"}',), ("{}",)], "j string")
    got = m.select(*citation(F.col("j")), where_equals(F.col("j"), {"k": 1}).alias("w"), where_equals(F.col("j"), {"k": None}).alias("n")).collect()
    assert [(r.page_start, r.page_end, r.heading_path, r.w, r.n) for r in got] == [(3, None, None, True, False), (None, None, None, False, False), (None, None, None, False, True)]
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = spark.range(1).select(geometry.overlap_fraction(box(0, 0, 10, 10), box(5, 0, 20, 10)).alias("f"), geometry.overlap_ratio(box(0, 0, 10, 10), box(0, 0, 5, 5)).alias("r"), geometry.vertical_gap(box(0, 0, 1, 10), box(0, 30, 1, 40)).alias("g"), markdown_table(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1")))).alias("t"), page_selection(F.lit("1-3,2")).alias("p")).first()
    assert (r.f, r.r, r.g, r.p) == (0.5, 1.0, 20.0, [1, 2, 3]) and r.t == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_captions(spark):
    rows = [(1, "a", 1, "image", None, [0.0, 0.0, 10.0, 10.0]), (2, "a", 1, "caption", "Figure 1. x", [0.0, 20.0, 10.0, 30.0]), (3, "a", 1, "caption", "Figure 2. y", [0.0, 12.0, 10.0, 18.0]), (4, "a", 1, "paragraph", "Figure 3: z", [0.0, 60.0, 10.0, 65.0])]
    b = spark.createDataFrame(rows, "block_row_id bigint, archive_id string, page_number int, block_type string, text string, bbox array<double>")
    assert [tuple(r) for r in layout.nearest_captions(b).collect()] == [(1, 3)]
    assert [r.block_row_id for r in layout.captions(b).collect()] == [4]
