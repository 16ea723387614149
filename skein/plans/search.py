"""One entry for queries as a user types them, over a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import rank as R
from .boolean_query import lex, matches

CHAMPIONS, TOP = 50, 10


def is_boolean(query: str) -> bool:
    """Whether the query has an operator or a parenthesis."""
    return len(lex(query)) > 1 or query.strip() in {"(", ")", "AND", "OR", "NOT"}


def ranked(index: I.Index, query: str, r: int = CHAMPIONS) -> DataFrame:
    """(doc_id, score), best first, of the candidates from the champion lists of the query's terms."""
    terms = I.query_terms(index.postings.sparkSession, query)
    weights = index.weights(terms)
    return R.rank_cosine(weights, index.lengths, I.champions(weights, r), terms)


def search(index: I.Index, query: str, vocabulary: DataFrame | None = None, n: int = TOP) -> DataFrame:
    """(doc_id, score), with url if a vocabulary (doc_id, url) is given: all matches of a boolean query, in no order and with null scores, or the n best of a free-text one."""
    if is_boolean(query):
        found = matches(query, index.postings, index.lengths).withColumn("score", F.lit(None).cast("double"))
    else:
        found = R.top(ranked(index, query), n)
    return found if vocabulary is None else R.with_url(found, vocabulary)
