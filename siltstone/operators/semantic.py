"""Exact cosine retrieval over dense vectors and over sparse hashing vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.embed import Embedder, sparse_embed
from siltstone.functions.text import hashing_tokens
from siltstone.operators import fusion
from siltstone.session import cut_lineage

BLOCK = 4096
#: Up to so many different words are sent to all tasks with their buckets.
MOST_WORDS = 500_000


def dense_scores(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, query_id: str, keep: list[str] | None = None) -> DataFrame:
    """query_id, id, keep..., score: cosine of every vector to every query (a stated query set, in blocks).

    A zero query gives no rows, a zero vector scores 0. Queries are collected in blocks of at most 4096, so that neither
    the driver nor a task holds more; each block is one matrix product per Arrow batch.
    """
    keep = keep or []
    spark = vectors.sparkSession
    parts, block = [], []

    def scored(rows: list) -> DataFrame:
        q = np.array([r[1] for r in rows], dtype=np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        ids, q = np.array([r[0] for r in rows])[norms > 0], q[norms > 0] / norms[norms > 0][:, None]
        shared = spark.sparkContext.broadcast((ids, q))

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                n = np.sqrt((m * m).sum(axis=1))
                s = (m @ q.T) / np.where(n == 0, 1.0, n)[:, None]
                out = {"query_id": np.tile(ids, len(pdf)), "id": np.repeat(pdf["id"].to_numpy(), len(ids))}
                out |= {c: np.repeat(pdf[c].to_numpy(), len(ids)) for c in keep}
                yield pd.DataFrame(out | {"score": s.ravel()})

        kinds = dict(vectors.dtypes)
        schema = ", ".join(["query_id bigint", f"id {kinds[id_column]}", *[f"{c} {kinds[c]}" for c in keep], "score double"])
        return vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"), *keep).where("v is not null").mapInPandas(multiply, schema)

    for row in queries.select(query_id, vector_column).where(F.col(vector_column).isNotNull()).toLocalIterator():
        block.append(row)
        if len(block) == 4096:
            parts.append(scored(block))
            block = []
    if block or not parts:
        parts.append(scored(block) if block else scored([(0, [0.0])]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sparse_scores(docs: DataFrame, queries: DataFrame, id_column: str, embedder: Embedder, by: list[str] | None = None) -> DataFrame:
    """by..., query_id, id, score: cosine of hashing vectors for documents that share a bucket with the query.

    docs: by..., id, text; queries: by..., query_id, query_text. With `by`, a query meets only its own group, and the
    documents of the group without a shared bucket are there with score 0.
    """
    by = by or []
    d = sparse_embed(docs.select(*by, F.col(id_column).alias("id"), "text"), [*by, "id"], embedder)
    q = sparse_embed(queries.select(*by, "query_id", F.col("query_text").alias("text")), [*by, "query_id"], embedder)
    dn = d.groupBy(*by, "id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("dn"))
    qn = q.groupBy(*by, "query_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("qn"))
    shared = d.join(q.withColumnRenamed("value", "qv"), [*by, "bucket"]).groupBy(*by, "query_id", "id").agg(F.sum(F.col("value") * F.col("qv")).alias("dot"))
    scored = shared.join(dn, [*by, "id"]).join(qn, [*by, "query_id"]).select(*by, "query_id", "id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))
    if not by:
        return scored
    every = docs.select(*by, F.col(id_column).alias("id")).join(qn.select(*by, "query_id"), by)
    return every.join(scored, [*by, "query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _blocks(rows: DataFrame) -> Iterator[list]:
    """Rows of the stated query set, at most BLOCK at a time."""
    block: list = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _without_zeros(m: np.ndarray) -> tuple[tuple[int, int], np.ndarray | None, np.ndarray]:
    """Shape, places and values of a matrix, without zeros if that is smaller: every executor keeps a copy on its disk."""
    at = np.flatnonzero(m)
    return (m.shape, at.astype(np.int32), m.ravel()[at]) if 2 * len(at) < m.size else (m.shape, None, m)


def _with_zeros(shape: tuple[int, int], at: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    if at is None:
        return values
    m = np.zeros(shape)
    m.ravel()[at] = values
    return m


def best_products(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, matrix, shared_only: bool, tie: str | None = None) -> DataFrame:
    """query_id, id, rank, score (9 decimals): the k best cosines of every query over all vectors. Ties go by the string
    column `tie`, if one is named, then by id.

    Each task keeps k rows a query, so nothing near queries times vectors is ever written. matrix turns a batch of either
    side (its pandas columns beside the ids) into a dense matrix of unit rows. shared_only: vectors without a common
    non-zero position are no hits.
    """
    spark, parts = vectors.sparkSession, []
    for block in _blocks(queries):
        frame = pd.DataFrame([r.asDict() for r in block])
        shared = spark.sparkContext.broadcast((frame["query_id"].to_numpy(), *_without_zeros(matrix(frame, dimension))))

        def multiply(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value[0], _with_zeros(*shared.value[1:])
            kept: list[tuple[np.ndarray, ...]] = [(np.empty(0), np.empty(0, dtype="int64"), np.empty(0, dtype=str))] * len(ids)
            known = (q != 0).astype("float32")
            for pdf in batches:
                m, own = matrix(pdf, dimension), pdf["id"].to_numpy()
                first = pdf[tie].to_numpy().astype(str) if tie else np.zeros(len(pdf), dtype="U1")
                found = np.round(m @ q.T, 9) + 0.0
                hits = ((m != 0).astype("float32") @ known.T > 0) if shared_only else None
                for j in range(len(ids)):
                    here = np.arange(len(own)) if hits is None else np.flatnonzero(hits[:, j])
                    own_scores = found[here, j]
                    if len(here) > k:
                        good = np.flatnonzero(own_scores >= np.partition(own_scores, -k)[-k])
                        here, own_scores = here[good], own_scores[good]
                    s, i, t = (np.concatenate(x) for x in zip(kept[j], (own_scores, own[here], first[here])))
                    at = np.lexsort((i, t, -s))[:k]
                    kept[j] = (s[at], i[at], t[at])
            yield pd.DataFrame({"query_id": np.repeat(ids, [len(x[0]) for x in kept]), "id": np.concatenate([x[1] for x in kept]), "score": np.concatenate([x[0] for x in kept]), "tie": np.concatenate([x[2] for x in kept]).astype(object)})

        parts.append(vectors.mapInPandas(multiply, "query_id bigint, id bigint, score double, tie string"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, id bigint, rank bigint, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return fusion.top_k(out, k, ["query_id"], ["tie", "id"]).select("query_id", "id", "rank", "score")


def _dense(pdf: pd.DataFrame, dimension: int) -> np.ndarray:
    m = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.empty((0, dimension))
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n == 0, 1.0, n)[:, None]


def _sparse(pdf: pd.DataFrame, dimension: int) -> np.ndarray:
    m = np.zeros((len(pdf), dimension))
    for i, (b, v) in enumerate(zip(pdf["buckets"], pdf["amounts"])):
        m[i, np.asarray(b, dtype=int)] = v
    n = np.sqrt((m * m).sum(axis=1))
    return m / np.where(n == 0, 1.0, n)[:, None]


def dense_top_k(vectors: DataFrame, queries: DataFrame, id_column: str, vector_column: str, query_id: str, k: int, dimension: int) -> DataFrame:
    """query_id, id, rank, score: the k nearest vectors of every query by cosine, zero vectors at 0; zero queries have none."""
    nonzero = F.exists(vector_column, lambda x: x != 0)
    q = queries.where(F.col(vector_column).isNotNull() & nonzero).select(F.col(query_id).cast("long").alias("query_id"), F.col(vector_column).alias("v"))
    own = vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    return best_products(own, q, k, dimension, _dense, False)


def _vectors_in_place(words: DataFrame, rest: list[str], vocabulary: DataFrame, dimension: int) -> DataFrame:
    """As sparse_vectors, each text in its task: only the hashed vocabulary is sent, no word is shuffled."""
    known = words.sparkSession.sparkContext.broadcast({r.word: (r.bucket, r.sign) for r in vocabulary.toLocalIterator()})
    kinds = dict(words.dtypes)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(codes):
                continue
            bucket, sign = np.array([known.value[w] for w in coded.dictionary.to_pylist()], dtype=np.int64).T
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            at, where = np.unique(doc * dimension + bucket[codes], return_inverse=True)
            value = np.bincount(where, weights=sign[codes], minlength=len(at))
            at, value = at[value != 0], value[value != 0]
            docs, first = np.unique(at // dimension, return_index=True)
            offsets = pa.array(np.r_[first, len(at)].astype(np.int32))
            held = [b.column(c).take(pa.array(docs)) for c in rest]
            made = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((at % dimension).astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([*held, *made], names=[*rest, "buckets", "amounts"])

    return words.mapInArrow(embed, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "buckets array<int>", "amounts array<double>"]))


def sparse_vectors(texts: DataFrame, key: str, embedder: Embedder, keep: list[str] | None = None) -> DataFrame:
    """key, keep..., buckets, amounts: a text's hashing vector without zeros, at most `dimension` of them; texts without words are left out."""
    rest = [key, *(keep or [])]
    words = texts.select(*rest, hashing_tokens(F.col("text")).alias("words")).where("words is not null")
    vocabulary = words.select(F.explode("words").alias("word")).distinct().withColumn("b", embedder.bucket_of(F.col("word"), embedder.dimension))
    vocabulary = cut_lineage(vocabulary.select("word", "b.bucket", "b.sign"))
    if vocabulary.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
        return _vectors_in_place(words, rest, vocabulary, embedder.dimension)
    each = sparse_embed(texts, rest, embedder)
    packed = each.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct("bucket", "value"))).alias("b"))
    return packed.select(*rest, F.col("b.bucket").alias("buckets"), F.col("b.value").alias("amounts"))


def sparse_top_k(vectors: DataFrame, queries: DataFrame, k: int, embedder: Embedder, tie: str | None = None) -> DataFrame:
    """query_id, id, rank, score over sparse_vectors (id, buckets, amounts) that share a bucket with the query."""
    q = cut_lineage(sparse_vectors(queries.select("query_id", F.col("query_text").alias("text")), "query_id", embedder))
    return best_products(vectors, q, k, embedder.dimension, _sparse, True, tie)
