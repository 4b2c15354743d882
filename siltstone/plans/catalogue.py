"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import geometry as g
from siltstone.functions import vectors
from siltstone.functions.embed import get_embedder
from siltstone.functions.metadata import citation, where_equals
from siltstone.functions.text import ACCENTED, PLAIN, glob_match, heading_line, index_tokens, page_selection
from siltstone.operators import best_hits, chunking, evaluation, fusion, keyword, layout, quality, records, semantic
from siltstone.plans import library
from siltstone.session import cut_lineage, ensure_checkpoint_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, FILE_K = 10, 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _score(c: str = "score"):
    return F.round(c, 6).alias(c)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_chunks")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_cases")


# ---- keyword --------------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(translate(lower({0}), '" + ACCENTED + "', '" + PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(tokens: str, group: str = "") -> str:
    """SQL of hits: AND of a case's words, else any of them as a prefix. `tokens` selects [group,] id, t."""
    g_ = f"{group}, " if group else ""
    on = f" AND x.{group} = y.{group}" if group else ""
    stat_join = f"JOIN st USING ({group})" if group else "CROSS JOIN st"
    return f"""
WITH d AS ({tokens}),
st AS (SELECT {g_}count(*) AS n_docs, avg(len(t)) AS avg_len FROM d {"GROUP BY " + group if group else ""}),
p AS (SELECT {g_}id, len(t) AS l, unnest(t) AS term FROM d),
tf AS (SELECT {g_}id, l, term, count(*) AS tf FROM p GROUP BY ALL),
q0 AS (SELECT query_id, {_TOK.format("query_text")} AS w FROM query_cases),
q AS (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS pn, len(w) AS nw FROM q0),
valid AS (SELECT query_id FROM query_cases WHERE regexp_full_match(query_text, '[\\p{{L}}\\p{{N}}_\\s]+')),
h1 AS (SELECT {g_}query_id, pn, nw, id, l, tf FROM tf JOIN q USING (term) SEMI JOIN valid USING (query_id)),
full1 AS (SELECT {g_}query_id, id FROM h1 GROUP BY ALL HAVING count(DISTINCT pn) = max(nw)),
got AS (SELECT DISTINCT {g_}query_id FROM full1),
h2 AS (SELECT {g_}query_id, pn, nw, id, l, sum(tf) AS tf FROM tf x JOIN q ON starts_with(x.term, q.term)
       WHERE NOT EXISTS (SELECT 1 FROM got y WHERE y.query_id = q.query_id{on}) GROUP BY ALL),
hits AS (SELECT 1 AS k, * FROM h1 UNION ALL SELECT 2, * FROM h2),
df AS (SELECT k, {g_}query_id, pn, count(*) AS df FROM hits GROUP BY ALL),
idf AS (SELECT *, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS w FROM df {stat_join}),
sc AS (SELECT k, {g_}query_id, id, sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) AS score FROM hits JOIN idf USING (k, {g_}query_id, pn) GROUP BY ALL),
scored AS (SELECT sc.* EXCLUDE (k) FROM sc SEMI JOIN full1 USING ({g_}query_id, id) WHERE k = 1 UNION ALL SELECT sc.* EXCLUDE (k) FROM sc WHERE k = 2)
"""


_GLOBAL = _bm25(f"SELECT chunk_row_id AS id, {_TOK.format('text')} AS t FROM ingest_chunks")
_BY_ARCHIVE = _bm25(f"SELECT archive_id, chunk_row_id AS id, {_TOK.format('text')} AS t FROM ingest_chunks", "archive_id")
_INDEX = _bm25(
    f"""SELECT chunk_row_id AS id, list_concat(list_concat({_TOK.format("coalesce(text, '')")}, {_TOK.format("coalesce(heading_path, '')")}),
      {_TOK.format("coalesce(json_extract_string(archive_metadata, '$.source_filename'), '')")}) AS t FROM ingest_chunks JOIN archives USING (archive_id)"""
)
_TOP = "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM {0} QUALIFY rank <= {1}"


def _top(scored: DataFrame, k: int = K) -> DataFrame:
    ordered = scored.withColumn("score", F.round("score", 9))
    return fusion.top_k(ordered, k, ["query_id"], ["id"]).select("query_id", "id", "rank", _score())


@query(_GLOBAL + _TOP.format("scored", K))
def keyword_topk_global(spark, d):
    return best_hits.best_hits(_chunks(spark, d), _cases(spark, d), "chunk_row_id", K).select("query_id", "id", "rank", _score())


@query(
    _BY_ARCHIVE
    + f""", best AS (SELECT *, row_number() OVER (PARTITION BY query_id, archive_id ORDER BY round(score, 9) DESC, id) AS file_rank FROM scored QUALIFY file_rank <= {FILE_K})
SELECT query_id, archive_id, id, file_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, file_rank, archive_id, id) AS rank, round(score, 6) AS score FROM best QUALIFY rank <= {K}"""
)
def keyword_per_archive_topk(spark, d):
    """Fan-out: statistics and best rows per archive, merged by score, then by their rank there."""
    best = best_hits.best_hits_by(_chunks(spark, d), _cases(spark, d), "chunk_row_id", K, "archive_id", FILE_K).withColumnRenamed("group_rank", "file_rank")
    return best.select("query_id", "archive_id", "id", "file_rank", "rank", _score())


@query(_INDEX + f"SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(1 + score, 6) AS score FROM scored QUALIFY rank <= {K}")
def keyword_index_fields(spark, d):
    """Library index: text, heading path and file name are indexed together."""
    name = F.get_json_object("archive_metadata", "$.source_filename").alias("source_filename")
    docs = _chunks(spark, d).join(table(spark, d, "archives").select("archive_id", name), "archive_id")
    top = best_hits.best_hits(docs, _cases(spark, d), "chunk_row_id", K, ["text", "heading_path", "source_filename"])
    return top.select("query_id", "id", "rank", F.round(keyword.index_score(F.col("score")), 6).alias("score"))


EXPRESSIONS = [(1, '"shall be removed" OR "grading sheet"'), (2, "drain* NOT curb"), (3, "^the outlet"), (4, "(basin OR culvert) AND permit"), (5, "when is it required?"), (6, "4.2"), (7, '"lineal feet" hearing')]


@query()
def keyword_expressions(spark, d):
    """Phrases, prefixes, first words, NOT and the fallback, over all chunks."""
    return _top(keyword.keyword_scores(_chunks(spark, d), spark.createDataFrame(EXPRESSIONS, "query_id bigint, query_text string"), "chunk_row_id"))


_INDEX_OF: dict[tuple[str, str], str] = {}


def indexed(spark, d) -> library.Corpus:
    """The library's corpus over a stored index, built once a session in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEX_OF:
        ensure_checkpoint_dir(spark)
        root = f"{spark.sparkContext.getCheckpointDir()}/index-{len(_INDEX_OF)}"
        library.build_index(spark, root, table(spark, d, "archives"), _chunks(spark, d))
        _INDEX_OF[key] = root
    return library.Corpus.open(spark, _INDEX_OF[key], table(spark, d, "archives"))


@query(_INDEX + _TOP.format("scored", K))
def stored_index_keyword(spark, d):
    """Keyword search on the stored index: three fields, no text read."""
    return indexed(spark, d).search(_cases(spark, d), "keyword", K).select("query_id", "id", "rank", _score())


@query(
    f"""WITH d AS (SELECT chunk_row_id AS id, {_TOK.format('text')} AS t FROM ingest_chunks), p AS (SELECT id, unnest(t) AS term FROM d)
SELECT term, count(*) AS n_tokens, count(DISTINCT id) AS n_chunks FROM p GROUP BY term"""
)
def index_terms(spark, d):
    terms = _chunks(spark, d).select("chunk_row_id", F.explode(index_tokens(F.col("text"))).alias("term"))
    per = terms.groupBy("term", "chunk_row_id").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_chunks"))


# ---- semantic -------------------------------------------------------------------------------------------------------

_COS = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, label, CASE WHEN list_dot_product(v, v) = 0 THEN 0.0 ELSE list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))) END AS score
      FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) CROSS JOIN q WHERE list_dot_product(qv, qv) > 0)
"""


def _nearest(spark, d, of) -> DataFrame:
    e = table(spark, d, "embeddings")
    hits = semantic.dense_top_k(of(e), e.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", K, 64)
    return hits.select("query_id", "id", "rank", _score())


@query(_COS + _TOP.format("s", K))
def semantic_topk(spark, d):
    return _nearest(spark, d, lambda e: e)


@query(_COS + f"SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM s WHERE label = 3 QUALIFY rank <= {K}")
def semantic_where(spark, d):
    return _nearest(spark, d, lambda e: e.where("label = 3"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, abs(sqrt(list_dot_product(v, v)) - 1) <= 1e-6 + 1e-4 OR list_dot_product(v, v) = 0 AS unit, len(v) AS dimension FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def l2_check(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), vectors.is_unit_or_zero(v).alias("unit"), F.size(v).cast("long").alias("dimension"))


_HASHED = """
words AS (SELECT {g}id, word, count(*) AS tf FROM (SELECT {g}id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM docs) GROUP BY ALL),
qwords AS (SELECT {g}query_id, word, count(*) AS tf FROM (SELECT {g}query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9_]+')) AS word FROM qs) GROUP BY ALL),
voc AS (SELECT word, CAST(concat('0x', substr(sha256(word), 1, 8)) AS BIGINT) % 384 AS bucket, CASE WHEN CAST(concat('0x', substr(sha256(word), 9, 2)) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END AS s
        FROM (SELECT word FROM words UNION SELECT word FROM qwords)),
dv AS (SELECT {g}id, bucket, sum(tf * s) AS v FROM words JOIN voc USING (word) GROUP BY ALL HAVING sum(tf * s) <> 0),
qv AS (SELECT {g}query_id, bucket, sum(tf * s) AS v FROM qwords JOIN voc USING (word) GROUP BY ALL HAVING sum(tf * s) <> 0),
dn AS (SELECT {g}id, sqrt(sum(v * v)) AS dn FROM dv GROUP BY ALL), qn AS (SELECT {g}query_id, sqrt(sum(v * v)) AS qn FROM qv GROUP BY ALL),
near AS (SELECT {g}query_id, id, sum(dv.v * qv.v) AS dot FROM dv JOIN qv USING ({g}bucket) GROUP BY ALL),
sem AS (SELECT {g}query_id, id, dot / (dn * qn) AS score FROM near JOIN dn USING ({g}id) JOIN qn USING ({g}query_id))
"""
_HASHED_ALL = "docs AS (SELECT chunk_row_id AS id, text FROM ingest_chunks), qs AS (SELECT query_id, query_text FROM query_cases)," + _HASHED.format(g="")


def _hashed_top(spark, d, model: str) -> DataFrame:
    embedder = get_embedder(model)
    own = semantic.sparse_vectors(_chunks(spark, d).select(F.col("chunk_row_id").alias("id"), "text"), "id", embedder)
    return semantic.sparse_top_k(own, _cases(spark, d), K, embedder).select("query_id", "id", "rank", _score())


@query("WITH " + _HASHED_ALL + _TOP.format("sem", K))
def semantic_hashing_sha256(spark, d):
    return _hashed_top(spark, d, "hashing-sha256")


@query()
def semantic_hashing_blake2b(spark, d):
    return _hashed_top(spark, d, "hashing")


# ---- fusion ---------------------------------------------------------------------------------------------------------

_FUSED = (
    _GLOBAL
    + ", "
    + _HASHED_ALL
    + """, a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, score FROM sem QUALIFY rank <= 50),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, score FROM scored QUALIFY rank <= 50),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b) GROUP BY ALL)
"""
)


def _rounded_corpus(spark, d) -> library.Corpus:
    return library.Corpus(table(spark, d, "archives"), _chunks(spark, d), get_embedder("hashing-sha256"))


@query(
    _FUSED
    + f""", r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM f QUALIFY rank <= {K})
SELECT query_id, id, r.rank, round(r.score, 6) AS score, round(a.score, 6) AS semantic_score, round(b.score, 6) AS keyword_score FROM r LEFT JOIN a USING (query_id, id) LEFT JOIN b USING (query_id, id)"""
)
def hybrid_rrf_corpus(spark, d):
    hits = _rounded_corpus(spark, d).search(_cases(spark, d), "hybrid", K)
    return hits.select("query_id", "id", "rank", _score(), _score("semantic_score"), _score("keyword_score"))


_STORED = _FUSED.replace(_GLOBAL, _INDEX)


@query(
    _STORED
    + f""", r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score FROM f QUALIFY rank <= {K})
SELECT query_id, id, r.rank, round(r.score, 6) AS score, round(a.score, 6) AS semantic_score, round(b.score, 6) AS keyword_score FROM r LEFT JOIN a USING (query_id, id) LEFT JOIN b USING (query_id, id)"""
)
def stored_index_hybrid(spark, d):
    """Hybrid search on the stored index: stored postings and vectors."""
    hits = indexed(spark, d).search(_cases(spark, d), "hybrid", K)
    return hits.select("query_id", "id", "rank", _score(), _score("semantic_score"), _score("keyword_score"))


_ARCHIVE_SEARCH = (
    _BY_ARCHIVE
    + """, docs AS (SELECT archive_id, chunk_row_id AS id, text FROM ingest_chunks), qs AS (SELECT archive_id, query_id, query_text FROM query_cases),"""
    + _HASHED.format(g="archive_id, ")
    + """, every AS (SELECT archive_id, query_id, id, round(coalesce(score, 0.0), 9) AS score FROM (SELECT archive_id, id FROM docs) JOIN (SELECT archive_id, query_id FROM qn) USING (archive_id) LEFT JOIN sem USING (archive_id, query_id, id)),
kw AS (SELECT query_id, id, round(score, 9) AS score FROM scored JOIN qs USING (archive_id, query_id)),
sn AS (SELECT query_id, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n FROM every WINDOW w AS (PARTITION BY query_id)),
kn AS (SELECT query_id, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n FROM kw WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT query_id, id, {sw} * coalesce(sn.n, 0) + {kw} * coalesce(kn.n, 0) AS score, sn.score AS semantic_score, kn.score AS keyword_score FROM sn FULL JOIN kn USING (query_id, id))
"""
)


def _weighted(semantic_weight: float, keyword_weight: float) -> str:
    return _ARCHIVE_SEARCH.replace("{sw}", str(semantic_weight)).replace("{kw}", str(keyword_weight))


def _archive_hybrid(spark, d, sw: float, kw: float) -> DataFrame:
    """Search of each case within its own archive: min-max over all candidates, weighted."""
    chunks, cases = _chunks(spark, d), _cases(spark, d)
    s = semantic.sparse_scores(chunks, cases, "chunk_row_id", get_embedder("hashing-sha256"), by=["archive_id"]).select("query_id", "id", F.round("score", 9).alias("score"))
    k = keyword.keyword_scores(chunks, cases, "chunk_row_id", by=["archive_id"], only=cases.select("archive_id", "query_id")).select("query_id", "id", F.round("score", 9).alias("score"))
    return fusion.hybrid_scores(s, k, ["query_id"], semantic_weight=sw, keyword_weight=kw)


@query(_weighted(0.5, 0.5) + _TOP.format("fused", K))
def hybrid_minmax_archive(spark, d):
    return _top(_archive_hybrid(spark, d, 1, 1))


@query(_weighted(0.75, 0.25) + f"SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score, round(semantic_score, 6) AS semantic_score, round(keyword_score, 6) AS keyword_score FROM fused QUALIFY rank <= {K}")
def hybrid_weighted_archive(spark, d):
    top = fusion.top_k(_archive_hybrid(spark, d, 0.75, 0.25).withColumn("score", F.round("score", 9)), K, ["query_id"], ["id"])
    return top.select("query_id", "id", "rank", _score(), _score("semantic_score"), _score("keyword_score"))


@query(_weighted(0.5, 0.5) + ", kept AS (SELECT f.* FROM fused f JOIN ingest_chunks c ON c.chunk_row_id = f.id WHERE json_extract_string(c.metadata, '$.page') = '2')" + _TOP.format("kept", K))
def hybrid_where_after(spark, d):
    """The filter comes after fusion: it doesn't change the scores."""
    kept = _chunks(spark, d).where(where_equals(F.col("metadata"), {"page": 2})).select(F.col("chunk_row_id").alias("id"))
    return _top(_archive_hybrid(spark, d, 1, 1).join(kept, "id", "left_semi"))


@query(
    "WITH " + _HASHED_ALL + """, m AS (SELECT query_id, id, embedding_model AS model, row_number() OVER (PARTITION BY query_id, embedding_model ORDER BY round(score, 9) DESC, id) AS rank
    FROM sem JOIN ingest_chunks c ON c.chunk_row_id = sem.id JOIN archives USING (archive_id) QUALIFY rank <= 50),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM m GROUP BY ALL)
"""
    + _TOP.format("f", K)
)
def mixed_model_rrf(spark, d):
    """Archives of several models: one ranked list per model, fused by rank."""
    chunks = _chunks(spark, d).join(table(spark, d, "archives").select("archive_id", "embedding_model"), "archive_id")
    embedder, cases = get_embedder("hashing-sha256"), _cases(spark, d)
    own = cut_lineage(semantic.sparse_vectors(chunks.select(F.col("chunk_row_id").alias("id"), "text"), "id", embedder).join(chunks.select(F.col("chunk_row_id").alias("id"), "embedding_model"), "id"))
    models = [r.embedding_model for r in own.select("embedding_model").distinct().collect()]  # a library has few
    lists = [semantic.sparse_top_k(own.where(F.col("embedding_model").eqNullSafe(m)).drop("embedding_model"), cases, fusion.candidates(K), embedder) for m in models]
    return _top(fusion.rrf(lists, ["query_id"]))


@query(
    _GLOBAL
    + f""", ranked AS (SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored QUALIFY rank <= {K})
SELECT query_id, id, rank, round(score, 6) AS score, 'C' || CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS VARCHAR) AS label FROM ranked WHERE rank = 1 OR round(score, 9) >= 0.55 * round(best, 9)"""
)
def quality_cutoff_labels(spark, d):
    top = best_hits.best_hits(_chunks(spark, d), _cases(spark, d), "chunk_row_id", K)
    kept = fusion.quality_cutoff(top, ["query_id"], fusion.BALANCED, ["id"])
    return fusion.number_labels(kept, ["rank"], ["query_id"]).select("query_id", "id", "rank", _score(), "label")


_PLACED = "placed AS (SELECT archive_id, chunk_row_id, row_number() OVER (PARTITION BY archive_id ORDER BY seq, chunk_row_id) AS pos FROM ingest_chunks)"


@query(
    _GLOBAL
    + f""", best AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored QUALIFY rank <= {K}), {_PLACED}
SELECT query_id, id, rank, b.chunk_row_id AS neighbour, CASE WHEN b.pos < a.pos THEN 'before' ELSE 'after' END AS side, b.pos - a.pos AS distance
FROM best JOIN placed a ON a.chunk_row_id = best.id JOIN placed b ON b.archive_id = a.archive_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos"""
)
def context_window(spark, d):
    chunks = _chunks(spark, d)
    hits = cut_lineage(best_hits.best_hits(chunks, _cases(spark, d), "chunk_row_id", K).drop("score"))
    placed = fusion.with_position(chunks.select("archive_id", "seq", "chunk_row_id"), "archive_id", "seq", "chunk_row_id").select("archive_id", "pos", F.col("chunk_row_id").alias("id"))
    near = fusion.neighbours(hits.join(placed, "id"), chunks.select("archive_id", "seq", "chunk_row_id"), "archive_id", "seq", 2, "chunk_row_id")
    return near.select("query_id", "id", "rank", "neighbour", "side", F.col("distance").cast("long").alias("distance"))


@query(
    _GLOBAL
    + f""", best AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored QUALIFY rank <= 3)
SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] ' || text, chr(10) ORDER BY rank) AS evidence FROM best JOIN ingest_chunks c ON c.chunk_row_id = best.id GROUP BY query_id"""
)
def evidence_list(spark, d):
    """Numbered evidence of the three best chunks of each query; texts join the few hits alone."""
    chunks = _chunks(spark, d)
    hits = cut_lineage(best_hits.best_hits(chunks, _cases(spark, d), "chunk_row_id", 3)).join(chunks.select(F.col("chunk_row_id").alias("id"), "text"), "id")
    lines = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n").alias("evidence"))


# ---- evaluation -----------------------------------------------------------------------------------------------------

_RANKED = (
    _FUSED
    + f""", r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= {K}),
res AS (SELECT 'hybrid' AS mode, query_id, id, rank FROM r UNION ALL SELECT 'semantic', query_id, id, rank FROM a WHERE rank <= {K} UNION ALL SELECT 'keyword', query_id, id, rank FROM b WHERE rank <= {K}),
w AS (SELECT query_id, archive_id AS wa, list_concat(coalesce(expected_pages, CAST([] AS INTEGER[])), CASE WHEN expected_page IS NULL THEN CAST([] AS INTEGER[]) ELSE [expected_page] END) AS pages, coalesce(expected_terms, CAST([] AS VARCHAR[])) AS terms FROM query_cases),
hit AS (SELECT mode, query_id, min(rank) AS first_rank FROM res JOIN ingest_chunks c ON c.chunk_row_id = res.id JOIN w USING (query_id)
  WHERE c.archive_id = wa AND (len(pages) = 0 OR len(list_filter(pages, lambda p: p BETWEEN page_start AND coalesce(page_end, page_start))) > 0)
  AND len(list_filter(terms, lambda t: NOT contains(lower(c.text), lower(t)))) = 0 GROUP BY ALL),
ranks AS (SELECT mode, query_id, first_rank FROM (SELECT DISTINCT mode FROM res) CROSS JOIN (SELECT query_id FROM query_cases) LEFT JOIN hit USING (mode, query_id))
"""
)


def _ranks(spark, d) -> DataFrame:
    corpus, cases = _rounded_corpus(spark, d), _cases(spark, d)
    # The lists of hybrid search begin with the results of the other modes.
    n = fusion.candidates(K)
    s, w = cut_lineage(corpus.semantic(cases, n)), cut_lineage(corpus.keyword_top(cases, n))
    lists = {"hybrid": corpus.fused(s, w, K), "semantic": s.where(F.col("rank") <= K), "keyword": w.where(F.col("rank") <= K)}
    modes = [x.select(F.lit(m).alias("mode"), "query_id", "id", "rank") for m, x in lists.items()]
    results = corpus.hydrate(cut_lineage(modes[0].unionByName(modes[1]).unionByName(modes[2])), ["archive_id", "page_start", "page_end", "text"])
    return evaluation.first_ranks(results, cases)


@query(_RANKED + "SELECT mode, query_id, first_rank FROM ranks")
def eval_first_ranks(spark, d):
    return _ranks(spark, d)


@query(_RANKED + "SELECT mode, count(*) AS n_queries, count(first_rank) AS hits, round(avg(CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr FROM ranks GROUP BY mode")
def eval_by_mode(spark, d):
    return evaluation.report(_ranks(spark, d))


# ---- chunking -------------------------------------------------------------------------------------------------------


@query()
def chunk_pages(spark, d):
    return chunking.page_chunks(table(spark, d, "parsed_pages"), ["archive_id"], "page_number", 120, 20)


@query()
def chunk_blocks(spark, d):
    return chunking.block_chunks(records.latest(table(spark, d, "ingest_blocks"), ["archive_id", "block_id"], [F.asc("block_row_id")]), ["archive_id"], ["page_number", "sort_order", "block_row_id"], 120, 20)


@query(
    """WITH p AS (SELECT doc_id, string_split_regex(trim(text, chr(10) || ' '), '\\n\\s*\\n') AS ps FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) - 1 AS paragraph_no FROM p),
w AS (SELECT doc_id, CAST(paragraph_no AS INTEGER) AS paragraph_no, list_filter(string_split_regex(para, '\\s+'), lambda x: x <> '') AS ws FROM e),
i AS (SELECT *, unnest(range(CAST(greatest(ceil((len(ws) - 80) / 60.0), 0) AS BIGINT) + 1)) AS window_no FROM w WHERE len(ws) > 80)
SELECT doc_id, paragraph_no, CAST(window_no AS INTEGER) AS window_no, CAST(len(ws[window_no * 60 + 1 : window_no * 60 + 80]) AS INTEGER) AS token_count, array_to_string(ws[window_no * 60 + 1 : window_no * 60 + 80], ' ') AS text FROM i"""
)
def chunk_sliding_window(spark, d):
    """Windows of 80 words with 20 shared over the long paragraphs (parted by blank lines) of every document."""
    docs = table(spark, d, "documents").where("text is not null")
    split = F.transform(F.split(F.regexp_replace("text", r"^[\n ]+|[\n ]+$", ""), r"\n\s*\n"), lambda p: p)
    each = docs.select("doc_id", F.posexplode(split).alias("paragraph_no", "p")).withColumn("w", F.filter(F.split("p", r"\s+"), lambda x: x != "")).where(F.size("w") > 80)
    cut = each.select("doc_id", "paragraph_no", F.posexplode(chunking.windows(F.col("w"), 80, 20)).alias("window_no", "x"))
    return cut.select("doc_id", "paragraph_no", "window_no", F.size("x").alias("token_count"), F.array_join("x", " ").alias("text"))


_PATHS = ", ".join(f"max(CASE WHEN lvl = {k} THEN n END) OVER w AS h{k}, max(CASE WHEN lvl < {k} THEN n END) OVER w AS c{k}" for k in range(1, 7))
_ALIVE = ", ".join(f"CASE WHEN h{k} > coalesce(c{k}, 0) THEN (SELECT text FROM b x WHERE x.archive_id = s.archive_id AND x.n = s.h{k}) END" for k in range(1, 7))


@query(
    f"""WITH b AS (SELECT archive_id, block_row_id, text, row_number() OVER (PARTITION BY archive_id ORDER BY page_number, sort_order, block_row_id) AS n,
  CASE WHEN block_type = 'heading' THEN least(coalesce(heading_level, 6), 6) END AS lvl FROM ingest_blocks),
s AS (SELECT archive_id, block_row_id, {_PATHS} FROM b WINDOW w AS (PARTITION BY archive_id ORDER BY n ROWS UNBOUNDED PRECEDING))
SELECT block_row_id, concat_ws(' > ', {_ALIVE}) AS heading_path FROM s"""
)
def heading_paths(spark, d):
    return chunking.heading_paths(table(spark, d, "ingest_blocks"), ["archive_id"], ["page_number", "sort_order", "block_row_id"]).select("block_row_id", "heading_path")


@query(
    r"""WITH l AS (SELECT page_row_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: length(l) > 0 AND length(l) < 120
  AND regexp_matches(l, '(?i)^(chapter|section|article|part|appendix|stormwater|zoning|[0-9]+(?:\.[0-9]+)*)\b')) AS ls FROM parsed_pages)
SELECT page_row_id, ls[1] AS heading FROM l"""
)
def page_headings(spark, d):
    return table(spark, d, "parsed_pages").select("page_row_id", heading_line(F.col("text")).alias("heading"))


# ---- corpus reports -------------------------------------------------------------------------------------------------


@query(
    """SELECT a.archive_id, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN coalesce(stored, 0) > 0 THEN stored ELSE coalesce(last_page, 0) END AS n_pages FROM archives a
LEFT JOIN (SELECT archive_id, count(*) AS n_chunks, CAST(max(coalesce(page_end, page_start, 0)) AS BIGINT) AS last_page FROM ingest_chunks GROUP BY 1) USING (archive_id)
LEFT JOIN (SELECT archive_id, count(DISTINCT page_number) AS stored FROM parsed_pages GROUP BY 1) USING (archive_id)"""
)
def corpus_inspect(spark, d):
    return library.summary(table(spark, d, "archives"), _chunks(spark, d), table(spark, d, "parsed_pages"))


@query("SELECT embedding_model, embedding_dimension, count(DISTINCT archive_id) AS n_files, count(*) AS n_chunks FROM archives JOIN ingest_chunks USING (archive_id) GROUP BY 1, 2")
def index_model_groups(spark, d):
    return library.model_groups(table(spark, d, "archives"), _chunks(spark, d))


@query("SELECT CAST(floor(token_count / 50) * 50 AS BIGINT) AS bucket_start, CAST(floor(token_count / 50) * 50 AS BIGINT) + 50 AS bucket_end, count(*) AS n_chunks FROM ingest_chunks WHERE token_count IS NOT NULL GROUP BY 1, 2")
def token_histogram(spark, d):
    return quality.token_histogram(_chunks(spark, d))


@query(
    """SELECT count(*) AS n_chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens, CAST(median(token_count) AS DOUBLE) AS median_tokens, round(avg(token_count), 6) AS mean_tokens, CAST(sum(token_count) AS BIGINT) AS total_tokens,
count(CASE WHEN len(coalesce(block_ids, [])) = 0 THEN 1 END) AS unlinked, count(CASE WHEN len(block_ids) = 1 THEN 1 END) AS single, count(CASE WHEN len(block_ids) > 1 THEN 1 END) AS multi FROM ingest_chunks"""
)
def chunk_stats(spark, d):
    return quality.chunk_stats(_chunks(spark, d))


@query("SELECT block_type, count(*) AS n_blocks, count(DISTINCT archive_id) AS n_archives FROM ingest_blocks GROUP BY 1")
def blocks_by_type(spark, d):
    return table(spark, d, "ingest_blocks").groupBy("block_type").agg(F.count("*").alias("n_blocks"), F.countDistinct("archive_id").alias("n_archives"))


@query("SELECT archive_id, CAST(p AS INTEGER) AS page_number, count(*) AS n_chunks FROM (SELECT archive_id, unnest(range(page_start, greatest(page_start, page_end) + 1)) AS p FROM ingest_chunks) GROUP BY 1, 2")
def chunks_per_page(spark, d):
    return quality.chunks_per_page(_chunks(spark, d))


# ---- metadata and records -------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, value FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 7")
def metadata_where_json(spark, d):
    return table(spark, d, "events").where(where_equals(F.col("props"), {"k": 7})).select("event_id", "event_type", "value")


_CITED = "CASE WHEN json_type(m, '$.{0}') IN ({1}) THEN {2} END AS {0}"


@query(
    "SELECT chunk_row_id, "
    + ", ".join([_CITED.format(k, "'UBIGINT', 'BIGINT'", f"CAST(json_extract(m, '$.{k}') AS INTEGER)") for k in ("page_start", "page_end")] + [_CITED.format(k, "'VARCHAR'", f"json_extract_string(m, '$.{k}')") for k in ("heading_path", "source_filename", "document_id")])
    + " FROM (SELECT chunk_row_id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM ingest_chunks)"
)
def citations(spark, d):
    return _chunks(spark, d).select("chunk_row_id", *citation(F.col("metadata")))


@query("SELECT place, doc_id, title FROM (VALUES (1, 5), (2, 3), (3, 5), (4, 999999999), (5, 0)) AS i(place, id) JOIN documents ON doc_id = id")
def get_by_ids_order(spark, d):
    return records.by_ids(table(spark, d, "documents").select("doc_id", "title"), "doc_id", [5, 3, 5, 999999999, 0]).select(F.col("place").cast("int").alias("place"), "doc_id", "title")


_LATEST = "(SELECT * FROM ingest_chunks QUALIFY row_number() OVER (PARTITION BY archive_id, chunk_id ORDER BY updated_at DESC, chunk_row_id DESC) = 1)"


@query(f"SELECT archive_id, chunk_id, chunk_row_id, updated_at FROM {_LATEST}")
def latest_chunks(spark, d):
    return records.latest(_chunks(spark, d), ["archive_id", "chunk_id"], [F.desc("updated_at"), F.desc("chunk_row_id")]).select("archive_id", "chunk_id", "chunk_row_id", "updated_at")


@query("SELECT archive_id, chunk_id, count(*) AS n_rows FROM ingest_chunks GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_check(spark, d):
    return records.duplicate_ids(_chunks(spark, d), ["archive_id", "chunk_id"])


@query(
    f"""WITH old AS (SELECT archive_id, chunk_id, chunk_row_id, text, created_at, updated_at FROM ingest_chunks QUALIFY row_number() OVER (PARTITION BY archive_id, chunk_id ORDER BY chunk_row_id) = 1),
new AS (SELECT archive_id, chunk_id, chunk_row_id, '* ' || text AS text, 'now' AS created_at, updated_at FROM {_LATEST} WHERE page_start = 1)
SELECT archive_id, chunk_id, CASE WHEN o.chunk_row_id IS NULL THEN n.chunk_row_id ELSE o.chunk_row_id END AS chunk_row_id, coalesce(n.text, o.text) AS text, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
FROM old o FULL JOIN new n USING (archive_id, chunk_id)"""
)
def upsert_merge(spark, d):
    """First pages are written again: place and creation time stay."""
    columns = ["archive_id", "chunk_id", "chunk_row_id", "text", "created_at", "updated_at"]
    old = records.latest(_chunks(spark, d), ["archive_id", "chunk_id"], [F.asc("chunk_row_id")]).select(*columns)
    new = records.latest(_chunks(spark, d), ["archive_id", "chunk_id"], [F.desc("updated_at"), F.desc("chunk_row_id")]).where("page_start = 1")
    new = new.withColumn("text", F.concat(F.lit("* "), "text")).withColumn("created_at", F.lit("now")).select(*columns)
    return records.upsert(old, new, ["archive_id", "chunk_id"], ["chunk_row_id", "created_at"])


_GONE = "(SELECT archive_id FROM archives WHERE embedding_model LIKE 'alternate%')"


@query(f"SELECT 'chunks' AS kind, archive_id, count(*) AS n_rows FROM ingest_chunks WHERE archive_id NOT IN {_GONE} GROUP BY 2 UNION ALL SELECT 'blocks', archive_id, count(*) FROM ingest_blocks WHERE archive_id NOT IN {_GONE} GROUP BY 2")
def delete_cascade(spark, d):
    gone = table(spark, d, "archives").where("embedding_model like 'alternate%'").select("archive_id")
    left = records.delete({"chunks": _chunks(spark, d), "blocks": table(spark, d, "ingest_blocks")}, gone, ["archive_id"])
    counted = [df.groupBy("archive_id").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("kind"), "archive_id", "n_rows") for name, df in left.items()]
    return counted[0].unionByName(counted[1])


_BEFORE = "(SELECT relative_path AS path, sha256(archive_metadata) AS h FROM archives WHERE pipeline IS DISTINCT FROM 'plainpages')"
_AFTER = "(SELECT CASE WHEN pipeline = 'docling' THEN 'moved/' || relative_path ELSE relative_path END AS path, CASE WHEN site IS NULL THEN 'x' ELSE sha256(archive_metadata) END AS h FROM archives)"


@query(
    f"""WITH j AS (SELECT path, b.h AS o, a.h AS n FROM {_BEFORE} b FULL JOIN {_AFTER} a USING (path)),
m AS (SELECT coalesce(sum(least(k, l)), 0) AS moved FROM (SELECT count(o) AS k, count(n) AS l FROM j WHERE o IS NULL OR n IS NULL GROUP BY coalesce(o, n)))
SELECT CAST(count(*) FILTER (o IS NULL) - moved AS BIGINT) AS added, CAST(count(*) FILTER (n IS NULL) - moved AS BIGINT) AS removed, count(*) FILTER (o <> n) AS changed, CAST(moved AS BIGINT) AS moved, count(*) FILTER (o = n) AS unchanged FROM j CROSS JOIN m GROUP BY moved"""
)
def change_summary(spark, d):
    a = table(spark, d, "archives").withColumn("hash", F.sha2("archive_metadata", 256))
    before = a.where(~F.col("pipeline").eqNullSafe("plainpages")).select(F.col("relative_path").alias("path"), "hash")
    after = a.select(F.when(F.col("pipeline") == "docling", F.concat(F.lit("moved/"), "relative_path")).otherwise(F.col("relative_path")).alias("path"), F.when(F.col("site").isNull(), "x").otherwise(F.col("hash")).alias("hash"))
    return records.change_summary(before, after)


@query("SELECT relative_path FROM archives WHERE NOT (regexp_matches(relative_path, '(^|/)2020(/|$)') OR starts_with(relative_path, 'zoning/'))")
def path_excludes(spark, d):
    return table(spark, d, "archives").where(~glob_match(F.col("relative_path"), ["2020", "zoning/**"])).select("relative_path")


@query("SELECT * FROM (VALUES ('1-3,2,8', [1, 2, 3, 8]), ('7', [7]), ('5-4', CAST([] AS INTEGER[]))) AS t(spec, pages)")
def page_selections(spark, d):
    return spark.createDataFrame([("1-3,2,8",), ("7",), ("5-4",)], "spec string").select("spec", page_selection(F.col("spec")).alias("pages"))


# ---- quality and layout ---------------------------------------------------------------------------------------------


def _sql_issue(code: str, subject: str, rest: str) -> str:
    return f"SELECT archive_id, '{code}' AS code, CAST({subject} AS VARCHAR) AS subject FROM {rest}"


@query(
    " UNION ALL ".join(
        [
            _sql_issue("format_version", "archive_id", "archives WHERE format_version IS DISTINCT FROM '0.2'"),
            _sql_issue("embedding_dimension", "archive_id", "archives WHERE coalesce(embedding_dimension <= 0, TRUE)"),
            _sql_issue("embedding_normalization", "archive_id", "archives WHERE coalesce(embedding_normalization, '') NOT IN ('l2', 'none', 'unknown')"),
            _sql_issue("missing_title", "archive_id", "archives WHERE json_extract_string(archive_metadata, '$.title') IS NULL"),
            _sql_issue("blank_text", "chunk_row_id", "ingest_chunks WHERE trim(coalesce(text, '')) = ''"),
            _sql_issue("metadata_json", "chunk_row_id", "ingest_chunks WHERE NOT json_valid(coalesce(metadata, ''))"),
            _sql_issue("page_order", "chunk_row_id", "ingest_chunks WHERE page_end < page_start"),
            _sql_issue("unknown_archive", "chunk_row_id", "ingest_chunks WHERE archive_id NOT IN (SELECT archive_id FROM archives)"),
        ]
    )
)
def validate_issues(spark, d):
    return quality.validate(table(spark, d, "archives"), _chunks(spark, d))


@query(
    " UNION ALL ".join(
        [
            _sql_issue("empty_block_id", "block_row_id", "ingest_blocks WHERE trim(coalesce(block_id, '')) = ''"),
            _sql_issue("empty_chunk_id", "chunk_row_id", "ingest_chunks WHERE trim(coalesce(chunk_id, '')) = ''"),
            _sql_issue("duplicate_block_id", "block_row_id", "(SELECT * FROM ingest_blocks QUALIFY row_number() OVER (PARTITION BY archive_id, block_id ORDER BY block_row_id) > 1)"),
            _sql_issue("duplicate_chunk_id", "chunk_row_id", "(SELECT * FROM ingest_chunks QUALIFY row_number() OVER (PARTITION BY archive_id, chunk_id ORDER BY chunk_row_id) > 1)"),
            _sql_issue("unknown_block", "chunk_row_id || ':' || block_id", "(SELECT archive_id, chunk_row_id, unnest(block_ids) AS block_id FROM ingest_chunks) ANTI JOIN ingest_blocks USING (archive_id, block_id)"),
        ]
    )
)
def lint_ids(spark, d):
    return quality.lint_ids(table(spark, d, "ingest_blocks"), _chunks(spark, d))


_COVERED = "(SELECT DISTINCT archive_id, unnest(block_ids) AS block_id FROM ingest_chunks)"
_INTER = "greatest(least(a.bbox[3], b.bbox[3]) - greatest(a.bbox[1], b.bbox[1]), 0) * greatest(least(a.bbox[4], b.bbox[4]) - greatest(a.bbox[2], b.bbox[2]), 0)"
_AREA = "greatest({0}.bbox[3] - {0}.bbox[1], 0) * greatest({0}.bbox[4] - {0}.bbox[2], 0)"
_OVERLAPS = f"""SELECT a.archive_id, a.block_row_id AS row_a, b.block_row_id AS row_b FROM ingest_blocks a JOIN ingest_blocks b
ON a.archive_id = b.archive_id AND a.page_number = b.page_number AND a.block_type = b.block_type AND a.block_row_id < b.block_row_id
WHERE len(a.bbox) = 4 AND len(b.bbox) = 4 AND least({_AREA.format("a")}, {_AREA.format("b")}) > 0 AND {_INTER} / least({_AREA.format("a")}, {_AREA.format("b")}) >= 0.8"""


@query(
    " UNION ALL ".join(
        [
            _sql_issue("cross_page_chunk", "chunk_row_id", "ingest_chunks WHERE page_start <> page_end"),
            _sql_issue("unlinked_image_block", "block_row_id", f"(SELECT * FROM ingest_blocks ANTI JOIN {_COVERED} USING (archive_id, block_id)) WHERE block_type = 'image'"),
            _sql_issue("orphan_table_text", "block_row_id", f"(SELECT * FROM ingest_blocks ANTI JOIN {_COVERED} USING (archive_id, block_id)) WHERE block_type = 'table'"),
            _sql_issue("uncovered_block", "block_row_id", f"(SELECT * FROM ingest_blocks ANTI JOIN {_COVERED} USING (archive_id, block_id)) WHERE block_type NOT IN ('image', 'table', 'heading')"),
            _sql_issue("missing_bbox", "block_row_id", f"(SELECT * FROM ingest_blocks SEMI JOIN {_COVERED} USING (archive_id, block_id)) WHERE block_type NOT IN ('image', 'heading') AND bbox IS NULL"),
            _sql_issue("degenerate_bbox", "block_row_id", "ingest_blocks WHERE len(bbox) = 4 AND (bbox[3] <= bbox[1] OR bbox[4] <= bbox[2])"),
            _sql_issue("caption_without_figure", "block_row_id", "ingest_blocks ANTI JOIN (SELECT DISTINCT archive_id, page_number FROM ingest_blocks WHERE block_type = 'image') USING (archive_id, page_number) WHERE block_type = 'caption'"),
            _sql_issue("overlapping_bboxes", "row_a || ':' || row_b", f"({_OVERLAPS})"),
        ]
    )
)
def lint_layout(spark, d):
    return quality.lint_layout(table(spark, d, "ingest_blocks"), _chunks(spark, d))


@query(f"SELECT row_a, row_b FROM ({_OVERLAPS})")
def bbox_overlaps(spark, d):
    return layout.overlapping(table(spark, d, "ingest_blocks"))


@query(
    """SELECT f.block_row_id AS figure_row_id, c.block_row_id AS caption_row_id FROM ingest_blocks f JOIN ingest_blocks c USING (archive_id, page_number)
WHERE f.block_type = 'image' AND c.block_type = 'caption' QUALIFY row_number() OVER (PARTITION BY f.block_row_id
ORDER BY CASE WHEN c.bbox[2] - f.bbox[4] IS NULL THEN 2 WHEN c.bbox[2] >= f.bbox[4] THEN 0 ELSE 1 END, coalesce(abs(c.bbox[2] - f.bbox[4]), 0), c.block_row_id) = 1"""
)
def nearest_captions(spark, d):
    return layout.nearest_captions(table(spark, d, "ingest_blocks"))


@query(
    r"""SELECT DISTINCT t.block_row_id FROM ingest_blocks t JOIN ingest_blocks i USING (archive_id, page_number) WHERE t.block_type IN ('paragraph', 'heading', 'caption') AND i.block_type = 'image' AND t.bbox IS NOT NULL AND i.bbox IS NOT NULL
AND regexp_matches(trim(string_split(t.text, chr(10))[1], ' '), '(?i)^(figure|fig\.?|table|diagram|exhibit|chart|map|photo|illustration|plate|drawing)\s*[0-9]+([.:\-\x{2013}]|\s|$)') AND length(t.text) <= 500
AND greatest(0.0, i.bbox[2] - t.bbox[4], t.bbox[2] - i.bbox[4]) <= 60"""
)
def mark_captions(spark, d):
    return layout.captions(table(spark, d, "ingest_blocks").withColumn("block_type", F.when(F.col("block_type") == "caption", "paragraph").otherwise(F.col("block_type"))))


@query(
    f"""SELECT block_row_id FROM ingest_blocks WHERE block_row_id NOT IN (SELECT a.block_row_id FROM ingest_blocks a JOIN ingest_blocks b ON a.archive_id = b.archive_id AND a.page_number = b.page_number
WHERE a.block_type = 'paragraph' AND b.block_type = 'table' AND a.bbox IS NOT NULL AND b.bbox IS NOT NULL AND {_AREA.format("a")} > 0 AND {_INTER} / ({_AREA.format("a")}) >= 0.5)"""
)
def table_text_antijoin(spark, d):
    return layout.without_table_text(table(spark, d, "ingest_blocks")).select("block_row_id")


@query(
    """SELECT b.block_row_id, arg_max(c.chunk_row_id, struct_pack(s := c.seq, r := c.chunk_row_id)) AS chunk_row_id FROM ingest_blocks b JOIN ingest_chunks c
ON c.archive_id = b.archive_id AND b.page_number BETWEEN c.page_start AND greatest(c.page_start, c.page_end) WHERE b.block_type = 'image' GROUP BY 1"""
)
def image_chunks(spark, d):
    return layout.image_chunks(table(spark, d, "ingest_blocks"), _chunks(spark, d))


@query(
    """WITH r AS (SELECT archive_id, chunk_row_id, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) - 1 AS place FROM ingest_chunks),
b AS (SELECT archive_id, block_id, page_number, bbox FROM ingest_blocks WHERE block_type <> 'image' AND bbox IS NOT NULL QUALIFY row_number() OVER (PARTITION BY archive_id, block_id ORDER BY block_row_id) = 1),
s AS (SELECT archive_id, page_number, width, height FROM parsed_pages QUALIFY row_number() OVER (PARTITION BY archive_id, page_number ORDER BY page_row_id) = 1)
SELECT chunk_row_id, string_agg(r.block_id || '@' || CAST(b.page_number AS VARCHAR) || '/' || CAST(round(bbox[1] * 10) AS BIGINT) || '/' || coalesce(CAST(round(width * 10) AS BIGINT), -1), ' ' ORDER BY place) AS regions
FROM r JOIN b USING (archive_id, block_id) LEFT JOIN s ON s.archive_id = r.archive_id AND s.page_number = b.page_number GROUP BY 1"""
)
def chunk_regions(spark, d):
    """Regions in one line each: block@page/left edge/page width in tenths of a point."""
    found = layout.regions(_chunks(spark, d), table(spark, d, "ingest_blocks"), table(spark, d, "parsed_pages"))
    tenths = lambda x: F.round(x * 10).cast("long").cast("string")
    line = lambda r: F.concat(r["block_id"], F.lit("@"), r["page_number"].cast("string"), F.lit("/"), tenths(F.get(r["bbox"], F.lit(0))), F.lit("/"), F.coalesce(tenths(r["page_width"]), F.lit("-1")))
    return found.select("chunk_row_id", F.array_join(F.transform("regions", line), " ").alias("regions"))


@query("SELECT block_row_id FROM ingest_blocks WHERE block_type = 'image' AND image_bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY archive_id, octet_length(image_bytes) ORDER BY block_row_id) > 1")
def repeated_images(spark, d):
    """Images of equal size take the bytes of one another, since the tables repeat none."""
    blocks = table(spark, d, "ingest_blocks")
    return layout.repeated_images(blocks.withColumn("image_bytes", F.when(F.col("image_bytes").isNotNull(), F.octet_length("image_bytes").cast("string").cast("binary"))))


@query(
    """SELECT b.block_row_id, round(greatest(least(bbox[3], w) - greatest(bbox[1], 0), 0) * greatest(least(bbox[4], h) - greatest(bbox[2], 0), 0) / (w * h), 6) AS coverage
FROM ingest_blocks b JOIN (SELECT archive_id, page_number, max(width) AS w, max(height) AS h FROM parsed_pages GROUP BY 1, 2) USING (archive_id, page_number) WHERE len(bbox) = 4 AND w > 0 AND h > 0"""
)
def page_coverage(spark, d):
    sizes = table(spark, d, "parsed_pages").groupBy("archive_id", "page_number").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    b = table(spark, d, "ingest_blocks").where(F.size("bbox") == 4).join(sizes, ["archive_id", "page_number"]).where("w > 0 and h > 0")
    return b.select("block_row_id", F.round(g.coverage(F.col("bbox"), F.col("w"), F.col("h")), 6).alias("coverage"))
