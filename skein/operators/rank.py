"""Free-text matching and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_text_match(post: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id) of documents with any of the terms."""
    return post.join(F.broadcast(terms), "term").select("doc_id").distinct()


def candidates(champs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id): the union of the terms' champion lists."""
    return champs.join(F.broadcast(terms), "term").select("doc_id").distinct()


def rank_cosine(weights: DataFrame, lengths: DataFrame, champs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, score): for each candidate, the weights of all query terms over its length, best first.

    Counts of terms in the query, and the query's own length, do not matter for the order and are left out. The
    candidates are at most r for each of the query's terms, so they and their scores are small.
    """
    own = weights.join(F.broadcast(terms), "term").select("doc_id", "weight")
    sums = own.join(candidates(champs, terms), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum("weight").alias("total"))
    return sums.join(lengths, "doc_id").select("doc_id", (F.col("total") / F.col("length")).alias("score")).orderBy(F.desc("score"), "doc_id")


def rank_simple(log_post: DataFrame, idfs: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, score): for every document the sum over known query terms of 1 + log10(tf) - idf, or of -idf where it lacks the term."""
    known = idfs.join(F.broadcast(terms), "term").select("term", "idf")
    # One row: the sum over all terms that a document without any gets.
    floor = known.agg(F.coalesce(F.sum("idf"), F.lit(0.0)).alias("floor"))
    have = log_post.join(F.broadcast(terms), "term").groupBy("doc_id").agg(F.sum("log_tf").alias("have"))
    scored = docs.select("doc_id").distinct().join(have, "doc_id", "left").crossJoin(F.broadcast(floor))
    return scored.select("doc_id", (F.coalesce("have", F.lit(0.0)) - F.col("floor")).alias("score"))


def top(ranked: DataFrame, n: int = 10) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "doc_id").limit(n)


def rank_combined(ranked: DataFrame, pagerank: DataFrame, share: float = 0.5) -> DataFrame:
    """Ranked (doc_id, score) joined with pagerank (doc_id, rank): the share of the one and the rest of the other."""
    both = ranked.join(pagerank, "doc_id", "left")
    return both.select("doc_id", (F.col("score") * share + F.coalesce("rank", F.lit(0.0)) * (1 - share)).alias("score"))


def with_url(ranked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ranked (doc_id, score) with the URL of each id, by vocabulary (doc_id, url); an id without one keeps null."""
    return ranked.join(vocabulary.select("doc_id", "url"), "doc_id", "left").select("doc_id", "url", "score")
