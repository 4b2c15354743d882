"""BM25 keyword retrieval for many queries at once, with statistics over all rows or per group (archive)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import fts
from siltstone.functions.text import index_tokens
from siltstone.session import broadcast_if_small, cut_lineage

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Up to so many terms are given to the scan of stored postings as a filter; more of them are only joined.
MOST_TERMS = 1000
_PHRASES = T.ArrayType(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("prefix", T.BooleanType()), T.StructField("initial", T.BooleanType())]))
_PARSED = T.StructType([T.StructField("phrases", _PHRASES), T.StructField("expression", T.StringType())])


@F.pandas_udf(_PARSED)
def _parsed(queries: pd.Series) -> pd.DataFrame:
    found = [fts.parse(q) or ([], None) for q in queries]
    return pd.DataFrame({"phrases": pd.Series([p for p, _ in found], dtype=object), "expression": pd.Series([e for _, e in found], dtype=object)})


@F.pandas_udf(_PARSED)
def _fallback(queries: pd.Series) -> pd.DataFrame:
    found = [fts.prefix_query(q) for q in queries]
    return pd.DataFrame({"phrases": pd.Series([p for p, _ in found], dtype=object), "expression": pd.Series([e for _, e in found], dtype=object)})


@F.pandas_udf(T.BooleanType())
def _holds(expressions: pd.Series, matched: pd.Series) -> pd.Series:
    return pd.Series([e is not None and fts.holds(e, set(m)) for e, m in zip(expressions, matched)], dtype=bool)


def token_table(docs: DataFrame, id_column: str, text_columns: list[str], by: list[str]) -> DataFrame:
    """by..., id, tokens: the tokens of all indexed fields, one after the other."""
    fields = [index_tokens(F.coalesce(F.col(c), F.lit(""))) for c in text_columns]
    return docs.select(*by, F.col(id_column).alias("id"), (F.concat(*fields) if len(fields) > 1 else fields[0]).alias("tokens"))


def statistics(tokens: DataFrame, by: list[str]) -> DataFrame:
    """by..., n_docs, avg_len."""
    return tokens.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))


class Source:
    """Where scoring reads: term occurrences, the vocabulary and the statistics of a token table or of a stored index."""

    def __init__(self, tokens: DataFrame | None = None, by: list[str] | None = None, stored: dict[str, DataFrame] | None = None):
        self.by, self.tokens, self.stored = by or [], tokens, stored

    def words(self) -> DataFrame:
        return self.stored["vocabulary"].select("term") if self.stored else self.tokens.select(F.explode("tokens").alias("term")).distinct()

    def stats(self) -> DataFrame:
        return self.stored["statistics"] if self.stored else statistics(self.tokens, self.by)

    def met(self, wanted: DataFrame, terms: list[str] | None) -> DataFrame:
        """by..., id, len, pos and the columns of wanted. Stored segments are sorted by term, so that given terms skip the rest."""
        if self.stored:
            from siltstone.operators import best_hits

            own = self.stored["postings"] if terms is None else self.stored["postings"].where(F.col("term").isin(terms))
            placed = best_hits.posted(own).join(wanted, "term").join(best_hits.documents(self.stored["postings"]), ["segment", "doc"])
            return placed.select("id", "len", "pos", *[c for c in wanted.columns if c != "term"])
        places = self.tokens.select(*self.by, "id", F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "term"))
        return places.join(wanted, "term")


def _score(source: Source, parsed: DataFrame, only: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """by..., query_id, id, score for queries with `phrases` and `expression`.

    only, without: (by..., query_id) pairs to score, or to leave out, before anything is counted.
    """
    by = source.by
    phrases = parsed.where(F.size("phrases") > 0).select("query_id", F.posexplode("phrases").alias("phrase_no", "p"))
    parts = phrases.select("query_id", "phrase_no", F.size("p.tokens").alias("n_parts"), "p.prefix", "p.initial", F.posexplode("p.tokens").alias("part", "token"))
    parts = parts.withColumn("open", F.col("prefix") & (F.col("part") == F.col("n_parts") - 1))
    exact = parts.where(~F.col("open")).withColumn("term", F.col("token"))
    # Prefixes meet the vocabulary, not the postings: each different term offers all its beginnings.
    wanted = exact
    if not parts.where("open").isEmpty():  # a look at the stated query set
        words = source.words()
        begins = words.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.substring(F.col("term"), F.lit(1), k))).alias("token"))
        wanted = exact.unionByName(begins.join(broadcast_if_small(parts.where("open")), "token").select(*exact.columns))
    # Prefixes may stand for any part of the vocabulary: what they became is counted before it is broadcast.
    wanted = cut_lineage(wanted.select("query_id", "phrase_no", "n_parts", "initial", "part", "term"))
    some = [r.term for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()] if source.stored else []
    met = source.met(broadcast_if_small(wanted), some if len(some) <= MOST_TERMS else None)
    for pairs, how in ((only, "left_semi"), (without, "left_anti")):
        if pairs is not None:
            met = met.join(broadcast_if_small(pairs), [*by, "query_id"], how)
    single = met.where("n_parts = 1 and (not initial or pos = 0)").groupBy(*by, "query_id", "phrase_no", "id", "len").agg(F.count("*").alias("tf"))
    starts = met.where("n_parts > 1").withColumn("start", F.col("pos") - F.col("part")).groupBy(*by, "query_id", "phrase_no", "id", "len", "start", "n_parts", "initial").agg(F.countDistinct("part").alias("k"))
    several = starts.where("k = n_parts and (not initial or start = 0)").groupBy(*by, "query_id", "phrase_no", "id", "len").agg(F.count("*").alias("tf"))
    hits = cut_lineage(single.unionByName(several))
    df = hits.groupBy(*by, "query_id", "phrase_no").agg(F.count("*").alias("df"))
    joined = hits.join(df, [*by, "query_id", "phrase_no"])
    joined = joined.join(source.stats(), by) if by else joined.crossJoin(F.broadcast(source.stats()))  # one row of statistics
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = joined.groupBy(*by, "query_id", "id").agg(F.sum(part).alias("score"), F.collect_set("phrase_no").alias("matched"))
    judged = scored.join(broadcast_if_small(parsed.select("query_id", "expression", F.size("phrases").alias("n_phrases"))), "query_id")
    plain_and = F.col("expression").rlike(r"^(\[\"and\"[0-9, ]+\]|0)$")
    plain_or = F.col("expression").rlike(r"^\[\"or\"[0-9, ]*\]$")
    full = F.size("matched") == F.col("n_phrases")
    other = _holds(F.when(~plain_or & ~plain_and, F.col("expression")), F.col("matched"))
    return judged.where(plain_or | (plain_and & full) | other).select(*by, "query_id", "id", "score")


def scores(source: Source, queries: DataFrame, fallback: bool = True, only: DataFrame | None = None) -> DataFrame:
    """by..., query_id, id, score of every hit of every query (queries: query_id, query_text).

    A query without hits (in a group, if the source has groups) is repeated as any of its words' prefixes; what had hits
    is left out of that before it is counted. only: the (by..., query_id) pairs to search.
    """
    by = source.by
    parsed = cut_lineage(queries.select("query_id", _parsed(F.col("query_text")).alias("q"), _fallback(F.col("query_text")).alias("f")))
    primary = _score(source, parsed.select("query_id", "q.*").where("expression is not null"), only)
    if not fallback:
        return primary
    primary = cut_lineage(primary)
    done = cut_lineage(primary.select(*by, "query_id").distinct())
    again = parsed.select("query_id", "f.*")
    if by:
        return primary.unionByName(_score(source, again, only, done))
    again = cut_lineage(again.join(done, "query_id", "left_anti"))
    return primary if again.isEmpty() else primary.unionByName(_score(source, again))


def keyword_scores(docs: DataFrame, queries: DataFrame, id_column: str, text_columns: list[str] | None = None, by: list[str] | None = None, fallback: bool = True, only: DataFrame | None = None) -> DataFrame:
    """As scores, over the text columns of docs; their tokens are made once and kept."""
    by = by or []
    return scores(Source(cut_lineage(token_table(docs, id_column, text_columns or ["text"], by)), by), queries, fallback, only)


def index_score(score: Column) -> Column:
    """Score of the library index: 1 + bm25."""
    return 1 + score
