"""Library index and corpus search: build once, then keyword, semantic and hybrid retrieval over all archives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.embed import Embedder, get_embedder
from siltstone.operators import archive, best_hits, fusion, keyword, records, semantic
from siltstone.session import broadcast_if_small, cut_lineage
from siltstone.sources import store

KEY = "chunk_row_id"


FIELDS = ["text", "heading_path", "source_filename"]


def file_table(archives: DataFrame) -> DataFrame:
    """archive_id, relative_path, embedding_model, embedding_dimension, hash of every archive."""
    return archives.select("archive_id", "relative_path", "embedding_model", "embedding_dimension", F.sha2(F.to_json(F.struct(*archives.columns)), 256).alias("hash"))


def build_index(spark: SparkSession, root: str, archives: DataFrame, chunks: DataFrame, model: str = "hashing-sha256", fields: list[str] | None = None) -> str:
    """Write the index snapshot: files, chunks, their places in the archives, postings in segments sorted by term,
    vocabulary, statistics, one vector for each chunk, and the settings that an update uses again.

    Texts are only shuffled if the archives are too many to be broadcast; all that follows is made in place from the
    stored chunks.
    """
    name = F.get_json_object("archive_metadata", "$.source_filename")
    rows = chunks.join(broadcast_if_small(archives.select("archive_id", name.alias("source_filename"), "embedding_model")), "archive_id")
    fields = fields or FIELDS
    stored = lambda at: spark.read.schema(rows.schema).parquet(f"{at}/chunks")
    postings = lambda at: spark.read.schema(best_hits.POSTINGS).parquet(f"{at}/postings")
    tables = {
        "files": file_table(archives), "chunks": rows, "places": lambda at: fusion.with_position(stored(at).select(KEY, "archive_id", "seq"), "archive_id", "seq", KEY).select(KEY, "pos"),
        "settings": spark.createDataFrame([(model, ",".join(fields))], "model string, fields string"),
        "vectors": lambda at: semantic.sparse_vectors(stored(at).select(F.col(KEY).alias("id"), "text", "embedding_model"), "id", get_embedder(model), ["embedding_model"]),
        "postings": lambda at: best_hits.stored_postings(keyword.token_table(stored(at), KEY, fields, [])),
        "vocabulary": lambda at: postings(at).where(F.col("term") != best_hits.DOCUMENTS).groupBy("term").agg(F.sum("n").alias("df")),
        "statistics": lambda at: best_hits.documents(postings(at)).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")),
    }
    return store.publish(spark, root, tables, partition_by={"chunks": ["embedding_model"], "vectors": ["embedding_model"]})


def index_status(spark: SparkSession, root: str, archives: DataFrame) -> DataFrame:
    """path, reason (new, missing, changed) for files that differ from the index; no rows if it is fresh."""
    now, then = file_table(archives).select("relative_path", F.col("hash").alias("now")), store.read(spark, root, "files").select("relative_path", F.col("hash").alias("then"))
    reason = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "relative_path", "full_outer").select(F.col("relative_path").alias("path"), reason.alias("reason")).where("reason is not null")


def update_index(spark: SparkSession, root: str, archives: DataFrame, chunks: DataFrame) -> str | None:
    """Build again with the settings of the current index if it is stale; old snapshots go. None if it was fresh."""
    if index_status(spark, root, archives).isEmpty():
        return None
    settings = store.read(spark, root, "settings").first()
    at = build_index(spark, root, archives, chunks, settings.model, settings.fields.split(","))
    store.collect_garbage(spark, root)
    return at


@dataclass
class Corpus:
    """All archives of a library; one call answers many queries (query_id, query_text).

    With `index` (the tables of build_index) nothing is tokenized or embedded but the queries. Scores are rounded to
    `digits` before ranking, so that ties don't hang on the order of additions.
    """

    archives: DataFrame
    chunks: DataFrame
    embedder: Embedder
    index: dict[str, DataFrame] | None = None
    digits: int = 9

    @classmethod
    def open(cls, spark: SparkSession, root: str, archives: DataFrame | None = None) -> Corpus:
        """Open the current index of a library; an error if it is stale against `archives`."""
        if archives is not None and not index_status(spark, root, archives).isEmpty():
            raise RuntimeError("the index is stale")
        tables = {t: store.read(spark, root, t) for t in ("files", "chunks", "places", "vectors", "settings", "statistics", "vocabulary", "postings")}
        plain = tables["chunks"]
        tables["chunks"] = plain.join(tables.pop("places"), KEY)
        return cls(tables["files"], plain, get_embedder(tables["settings"].first().model), tables)

    def keyword(self, queries: DataFrame) -> DataFrame:
        """query_id, id, score of every hit; over all fields with an index, over the text without."""
        scored = keyword.scores(keyword.Source(stored=self.index), queries) if self.index else keyword.keyword_scores(self.chunks, queries, KEY)
        return scored.withColumn("score", F.round("score", self.digits))

    def keyword_top(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, rank, score of the k best."""
        return best_hits.stored_hits(self.index["postings"], self.index["vocabulary"], queries, k) if self.index else best_hits.best_hits(self.chunks, queries, KEY, k)

    def vectors(self) -> DataFrame:
        return self.index["vectors"].select("id", "buckets", "amounts") if self.index else semantic.sparse_vectors(self.chunks.select(F.col(KEY).alias("id"), "text"), "id", self.embedder)

    def semantic(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, rank, score of the k best."""
        return semantic.sparse_top_k(self.vectors(), queries, k, self.embedder)

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = 10) -> DataFrame:
        """query_id, id, rank, score, semantic_score, keyword_score."""
        if mode not in ("keyword", "semantic", "hybrid"):
            raise ValueError(mode)
        if not 0 <= k <= 10000:
            raise ValueError("top_k must be from 0 to 10000")
        none = F.lit(None).cast("double")
        n = fusion.candidates(k) if mode == "hybrid" else max(k, 1)
        s = self.semantic(queries, n) if mode != "keyword" else None
        w = self.keyword_top(queries, n) if mode != "semantic" else None
        if mode != "hybrid":
            own, other = ("keyword_score", "semantic_score") if mode == "keyword" else ("semantic_score", "keyword_score")
            return (w if mode == "keyword" else s).where(F.col("rank") <= k).select("query_id", "id", "rank", "score", F.col("score").alias(own), none.alias(other))
        s, w = cut_lineage(s), cut_lineage(w)
        return self.fused(s, w, k)

    def fused(self, s: DataFrame, w: DataFrame, k: int) -> DataFrame:
        """The hybrid result of a semantic and a keyword list (query_id, id, rank, score)."""
        fused = fusion.top_k(fusion.rrf([s, w], ["query_id"]), k, ["query_id"], ["id"])
        parts = [x.select("query_id", "id", F.col("score").alias(c)) for x, c in ((s, "semantic_score"), (w, "keyword_score"))]
        return fused.join(parts[0], ["query_id", "id"], "left").join(parts[1], ["query_id", "id"], "left")

    def hydrate(self, hits: DataFrame, columns: list[str]) -> DataFrame:
        """Texts and metadata, for the hits alone."""
        chunks = self.index["chunks"] if self.index and "pos" in columns else self.chunks
        return hits.join(chunks.select(F.col(KEY).alias("id"), *columns), "id")


def summary(archives: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """archive_id, n_chunks, n_pages (stored pages, else the last page a chunk names)."""
    c = chunks.groupBy("archive_id").agg(F.count("*").alias("n_chunks"), F.max(F.coalesce("page_end", "page_start", F.lit(0))).cast("long").alias("last_page"))
    p = pages.groupBy("archive_id").agg(F.countDistinct("page_number").alias("stored"))
    joined = archives.select("archive_id").join(c, "archive_id", "left").join(p, "archive_id", "left")
    return joined.select("archive_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.coalesce("stored", F.lit(0)) > 0, F.col("stored")).otherwise(F.coalesce("last_page", F.lit(0))).alias("n_pages"))


def model_groups(archives: DataFrame, chunks: DataFrame) -> DataFrame:
    """embedding_model, embedding_dimension, n_files, n_chunks."""
    counted = chunks.groupBy("archive_id").agg(F.count("*").alias("k"))
    return archives.join(counted, "archive_id").groupBy("embedding_model", "embedding_dimension").agg(F.count("*").alias("n_files"), F.sum("k").alias("n_chunks"))


def from_paths(archives: DataFrame, chunks: DataFrame, paths: DataFrame, invalid: DataFrame | None = None) -> Corpus:
    """A corpus of the files in `paths` (relative_path) without the archives known to be invalid (archive_id)."""
    own = archives.join(paths.select("relative_path").distinct(), "relative_path", "left_semi")
    if invalid is not None:
        own = own.join(invalid.select("archive_id").distinct(), "archive_id", "left_anti")
    return Corpus(own, chunks.join(own.select("archive_id"), "archive_id", "left_semi"), get_embedder("hashing-sha256"))


def document(pages: DataFrame, blocks: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The parts of stored archives, each once: page, block, chunk, figure."""
    first = lambda df, key, row: records.latest(df, key, [F.asc(row)])
    return {
        "page": first(pages, ["archive_id", "page_number"], "page_row_id"),
        "block": first(blocks, ["archive_id", "block_id"], "block_row_id"),
        "chunk": first(chunks, ["archive_id", "chunk_id"], "chunk_row_id"),
        "figure": archive.attachments(blocks),
    }


def source_totals(indexed: DataFrame, source: DataFrame, archives: DataFrame) -> DataFrame:
    """embedding_model, n_indexed, n_source over archives (archive_id with n_indexed, n_source); a missing source counts as indexed."""
    joined = indexed.join(archives.select("archive_id", "embedding_model"), "archive_id").join(source, "archive_id", "left")
    return joined.groupBy("embedding_model").agg(F.sum("n_indexed").alias("n_indexed"), F.sum(F.coalesce("n_source", "n_indexed")).alias("n_source"))
