"""Problem 4: cut texts that exceed a token limit at natural boundaries, with overlap.

A token is a white-space-separated word of the text in the consistent form (problem 2). The tokens are extracted by a
bounded quantifier, which cuts an unbroken run of more than MAX_RUN characters (character fallback: such a run counts as
several tokens). Each token is then one letter of the text's outline, by the strength of the boundary behind it, and one
regular expression per limit consumes the outline piece by piece: its alternatives, ordered by strength (end of text,
blank line, line end after a sentence, sentence, clause, any token), each take as many tokens as fit through a bounded
quantifier; the natural ones must fill at least half of the limit. Quantifiers over single letters need no stack, so
limits of many thousand tokens are no different from small ones. Offsets into the token array give the pieces, and,
looking back, the overlap.

Defined results: null text gives no piece; an empty or blank text, or one within the limit, comes back as one piece;
without the overlaps the pieces of a text give the text again, exactly. overlap_tokens is reduced to max_tokens - 1 if
larger, null or negative values count as 0; a null or non-positive max_tokens means no limit. Rows stored again are cut
again. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.canonical import canonical, needs_check

MAX_RUN = 1000
#: Boundaries by strength: letter of the outline, and what a token with its trailing space looks like there.
_CLOSE = r"[\"')\]]{0,3}"
BOUNDARIES = [("p", r"\n[^\S\n]*\n\s*\z"), ("l", rf"[.!?]{_CLOSE}[^\S\n]*\n\s*\z"), ("s", rf"[.!?]{_CLOSE}\s+\z"), ("c", r"[,;:]\s+\z")]


def word_count(text: Column) -> Column:
    """White-space-separated words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def outline(tokens: Column) -> Column:
    """One letter for each token: the boundary behind it."""

    def letter(token: Column) -> Column:
        out = F.lit("w")
        for name, pattern in reversed(BOUNDARIES):
            out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
        # Most tokens end in a letter and a space, which no boundary does.
        return F.when(token.rlike(r"[\p{L}\p{N}] ?\z"), F.lit("w")).otherwise(out)

    return F.array_join(F.transform(tokens, letter), "")


def piece_pattern(limit: Column) -> Column:
    """The regular expression that consumes one piece of at most `limit` letters of an outline, as a column."""
    most, half = (limit - 1).cast("string"), F.greatest(F.floor(limit / 2) - 1, F.lit(0)).cast("string")
    take = lambda least, last: F.concat(F.lit(".{"), least, F.lit(","), most, F.lit("}" + last))
    return F.concat_ws("|", take(F.lit("0"), r".\z"), *[take(half, name) for name, _ in BOUNDARIES], take(F.lit("0"), "."))


def split_pieces(df: DataFrame, limit: Column, overlap: Column, keep: list[str], run: int = MAX_RUN) -> DataFrame:
    """Pieces of df.text: the columns `keep`, piece_no (from 1), n_pieces, n_tokens, n_overlap, text.

    df.text must already be in the consistent form.
    """
    own = df.where(F.col("text").isNotNull()).select(*keep, "text", limit.alias("_max"), overlap.alias("_overlap"))
    own = own.withColumn("_max", F.when(F.col("_max") > 0, F.col("_max"))).withColumn("_overlap", F.greatest(F.least(F.coalesce("_overlap", F.lit(0)), F.col("_max") - 1), F.lit(0)))
    over = F.coalesce(word_count(F.col("text")) > F.col("_max"), F.lit(False)) | F.col("text").rlike(rf"\S{{{run + 1}}}")
    own = own.withColumn("_over", over & F.col("_max").isNotNull())
    whole = own.where(~F.col("_over")).select(
        *keep, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), word_count(F.col("text")).cast("int").alias("n_tokens"), F.lit(0).alias("n_overlap"), "text"
    )
    fresh = F.col("_max") - F.col("_overlap")  # tokens of a piece that no earlier piece has
    cut = own.where("_over").withColumn("_tokens", F.regexp_extract_all("text", F.lit(rf"\s*+\S{{1,{run}}}+\s*+"), F.lit(0)))
    cut = cut.withColumn("_parts", F.regexp_extract_all(outline(F.col("_tokens")), piece_pattern(fresh), F.lit(0)))
    ends = F.aggregate("_parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    cut = cut.withColumn("_ends", ends).select("*", F.posexplode("_parts").alias("_i", "_part"))
    start, end = F.get("_ends", F.col("_i")), F.get("_ends", F.col("_i") + 1)
    shared = F.least(start, F.col("_overlap"))
    text = F.array_join(F.slice("_tokens", start - shared + 1, end - start + shared), "")
    pieces = cut.select(*keep, (F.col("_i") + 1).alias("piece_no"), F.size("_parts").alias("n_pieces"), (end - start + shared).alias("n_tokens"), shared.alias("n_overlap"), text.alias("text"))
    return whole.unionByName(pieces)


def with_rules(chunks: DataFrame, archives: DataFrame, rules: DataFrame, default: str = "default") -> DataFrame:
    """chunks with max_tokens and overlap_tokens of their archive's pipeline; a null or unknown one, and an unknown
    archive, take the row `default`. split_rules is a fixed small table."""
    by_name = rules.select(F.col("pipeline").alias("_rule"), "max_tokens", "overlap_tokens")
    other = by_name.where(F.col("_rule") == default).select(F.col("max_tokens").alias("_max_other"), F.col("overlap_tokens").alias("_overlap_other"))
    owners = archives.groupBy(F.col("archive_id").alias("_archive")).agg(F.min("pipeline").alias("_pipeline"))
    joined = chunks.join(owners, F.col("archive_id") == F.col("_archive"), "left").join(F.broadcast(by_name), F.col("_pipeline") == F.col("_rule"), "left").join(F.broadcast(other), F.lit(True), "left")
    return joined.withColumn("max_tokens", F.coalesce("max_tokens", "_max_other")).withColumn("overlap_tokens", F.when(F.col("_rule").isNull(), F.col("_overlap_other")).otherwise(F.col("overlap_tokens"))).drop("_archive", "_pipeline", "_rule", "_max_other", "_overlap_other")


def oversized(chunks: DataFrame, archives: DataFrame, rules: DataFrame) -> DataFrame:
    """chunk_row_id of the rows that are cut into pieces because they have more words than their rule allows.

    Words are counted before the join: only texts that exceed the least limit of all rules meet their archive and are cut.
    """
    least = rules.agg(F.min("max_tokens").alias("_least"))
    # The consistent form may join or part words only where the quick check finds something.
    text = F.col("text")
    sure = chunks.select("chunk_row_id", "archive_id", "text").where(text.isNotNull() & (needs_check(text) | (word_count(text) > 0)))
    counted = sure.withColumn("text", canonical(text)).withColumn("n_words", word_count(text))
    likely = counted.join(F.broadcast(least), F.col("n_words") > F.col("_least")).drop("_least")
    ruled = with_rules(likely, archives, rules)
    pieces = split_pieces(ruled, F.col("max_tokens"), F.col("overlap_tokens"), ["chunk_row_id", "n_words", "max_tokens"])
    # An unbroken run may be cut though the words are few enough: the exact rule follows.
    return pieces.where("piece_no = 1 and n_pieces > 1 and n_words > max_tokens").select("chunk_row_id")


def chunk_pieces(chunks: DataFrame, archives: DataFrame, rules: DataFrame) -> DataFrame:
    """Pieces of every chunk under the rule of its pipeline, with heading_path."""
    keep = ["chunk_row_id", "archive_id", "chunk_id", "heading_path"]
    ruled = with_rules(chunks.select(*keep, "text"), archives, rules)
    return split_pieces(ruled.withColumn("text", canonical(F.col("text"))), F.col("max_tokens"), F.col("overlap_tokens"), keep)
