"""The inverted index as tables: postings, document frequency, weights, lengths and champions.

Weights are tf + log10(N / df), a sum, with tf the plain count; a document's length is the root of the sum over its
token occurrences of the squared weight. N counts all documents, those without a token included. Texts are read once, in
Arrow batches, each of which is inverted on its own: a block is a term with its documents of a batch. Blocks are dealt,
joined and stored as they are, so that rows are as many as terms of batches, and become postings last. Index stores what
every query needs; the functions work on any postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.stem import stem_word, with_stem
from ..functions.text import STOPWORDS, SYMBOLS, spaced_tokens, tokens
from ..session import materialize

#: Words that a worker keeps with their terms before it begins anew, and postings from which it hands its blocks on.
KNOWN, AT_ONCE = 1 << 19, 1 << 21
#: Bound of the number of terms whose idf is broadcast.
FREQUENT = 200_000


def url_vocabulary(urls: DataFrame, column: str = "url") -> DataFrame:
    """(doc_id, url): dense ids from 0 for distinct URLs, in order of the URL.

    Ids are two-pass: URLs are dealt by range, counted per range, and numbered from the sum of the ranges before.
    """
    # Range sampling need not deal alike twice, so the dealing is written down before it is counted.
    dealt = urls.select(F.col(column).alias("url")).where("url is not null").distinct().repartitionByRange("url").withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "urls")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_base")
    own = Window.partitionBy("_p").orderBy("url")
    return dealt.join(base, "_p").select((F.col("_base") + F.row_number().over(own) - 1).alias("doc_id"), "url")


def universe(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").distinct()


def pairs(docs: DataFrame) -> DataFrame:
    """(word, doc_id), one row per token occurrence, unstemmed and without stop words."""
    return docs.select(F.explode(tokens(F.col("text"))).alias("word"), "doc_id")


class Terms(dict):
    """Word to term, None for a stop word; filled as words are met, and bounded."""

    def __missing__(self, word: str) -> str | None:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = term = None if word in _STOP else stem_word(word)
        return term


_STOP = {*STOPWORDS, *SYMBOLS}
_TERMS = Terms()


class Numbers(dict):
    """Dense numbers from 0, in order of first sight."""

    def __missing__(self, term: str) -> int:
        self[term] = n = len(self)
        return n


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (doc_id, text), of texts as spaced_tokens() gives them."""
    for b in batches:
        numbers, codes, counts, rows, sizes = Numbers(), [], [], [], []

        def made() -> pa.RecordBatch:
            code = np.array(codes, np.int64)
            order = np.argsort(code, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(numbers)))]), pa.int32())
            ids = b.column("doc_id").take(pa.array(np.repeat(np.array(rows, np.int64), np.array(sizes, np.int64))[order]))
            tfs = pa.array(np.array(counts, np.int64)[order])
            return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, tfs)], ["term", "ids", "tfs"])

        for i, text in enumerate(b.column("text")):
            own = Counter(map(_TERMS.__getitem__, (text.as_py() or "").split()))
            own.pop(None, None)
            codes.extend(map(numbers.__getitem__, own))
            counts.extend(own.values())
            rows.append(i)
            sizes.append(len(own))
            if len(codes) >= AT_ONCE:
                yield made()
                numbers, codes, counts, rows, sizes = Numbers(), [], [], [], []
        yield made()


def blocks(docs: DataFrame) -> DataFrame:
    """(term, ids, tfs): postings in blocks, which have each pair of a term and an id once.

    Only where an id is not unique, which one look at the ids tells, are counts dealt by term and id and added.
    """
    schema = StructType([StructField("term", StringType()), StructField("ids", ArrayType(docs.schema["doc_id"].dataType)), StructField("tfs", ArrayType(LongType()))])
    inverted = docs.select("doc_id", spaced_tokens(F.col("text")).alias("text")).mapInArrow(_inverted, schema)
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return inverted
    return unblocked(inverted).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")).select("term", F.array("doc_id").alias("ids"), F.array("tf").alias("tfs"))


def unblocked(made: DataFrame, *more: str) -> DataFrame:
    """(term, doc_id, tf, *more): a row per posting of blocks; `more` are columns of the block's term."""
    return made.select("term", F.posexplode("ids").alias("_i", "doc_id"), "tfs", *more).select("term", "doc_id", F.get("tfs", F.col("_i")).alias("tf"), *more)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""
    return unblocked(blocks(docs))


class Index:
    """A stored index: postings (term, doc_id, tf), of blocks ranged by term so that a query's terms prune the scan, and lengths (doc_id, length)."""

    def __init__(self, spark: SparkSession, path: str):
        stored, self.lengths = (spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in ("postings", "lengths"))
        self.postings = unblocked(stored)
        self.size = self.lengths.agg(F.count("*").alias("n"))

    @staticmethod
    def build(docs: DataFrame, path: str, mode: str = "errorifexists") -> Index:
        """Writes the index of docs(doc_id, text) to path, in one pass over the texts, and opens it."""
        spark, path = docs.sparkSession, path.rstrip("/")
        # Lengths are summed from blocks in the order of documents, which adds up most of them before they are dealt.
        made = materialize(blocks(docs), "blocks")
        dealt = made.withColumn("_first", F.get("ids", F.lit(0))).repartitionByRange("term", "_first").sortWithinPartitions("term", "_first")
        dealt.drop("_first").write.mode(mode).parquet(f"{path}/postings")
        doc_length(block_weights(made, corpus_size(docs)), docs).write.mode(mode).parquet(f"{path}/lengths")
        return Index(spark, path)

    def weights(self, terms: DataFrame) -> DataFrame:
        """tf_idf() of a query's terms (term), a few rows, from their postings alone: as literals they prune the scan."""
        asked = self.postings.where(F.col("term").isin([r["term"] for r in terms.select("term").collect()]))
        return tf_idf(asked, self.size)


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: N."""
    return universe(docs).agg(F.count("*").alias("n"))


def with_idf(counts: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf) of counts (term, df); size is corpus_size's single row."""
    return counts.crossJoin(F.broadcast(size)).select("term", "df", F.log10(F.col("n") / F.col("df")).alias("idf"))


def idf(post: DataFrame, size: DataFrame) -> DataFrame:
    return with_idf(document_frequency(post), size)


def tf_idf(post: DataFrame, size: DataFrame) -> DataFrame:
    """(term, doc_id, tf, df, idf, weight)."""
    return post.join(idf(post, size), "term").withColumn("weight", F.col("tf") + F.col("idf"))


def block_frequency(made: DataFrame) -> DataFrame:
    """document_frequency() of blocks."""
    return made.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))


def block_weights(made: DataFrame, size: DataFrame) -> DataFrame:
    """tf_idf() of stored blocks.

    Blocks of frequent terms meet their idf where they lie; only those of other terms are dealt by term, so that none
    of these is large. A term is frequent if it has more than one FREQUENTth of all postings, so there are fewer such terms.
    """
    made = made.where("term is not null")  # as the joins ask for: so all that count share one exchange
    known = with_idf(block_frequency(made), size).crossJoin(F.broadcast(block_frequency(made).agg((F.sum("df") / FREQUENT).alias("share"))))
    frequent, rare = (known.where(of).drop("share") for of in (F.col("df") > F.col("share"), F.col("df") <= F.col("share")))
    dealt = made.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(rare.hint("shuffle_hash"), "term")
    met = made.join(F.broadcast(frequent), "term").unionByName(dealt)
    return unblocked(met, "df", "idf").withColumn("weight", F.col("tf") + F.col("idf"))


def log_tf(post: DataFrame) -> DataFrame:
    return post.withColumn("log_tf", 1 + F.log10("tf"))


def doc_length(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, length); 0 for documents without a token."""
    sums = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("weight") * F.col("weight"))).alias("length"))
    return universe(docs).join(sums, "doc_id", "left").select("doc_id", F.coalesce("length", F.lit(0.0)).alias("length"))


def champions(weights: DataFrame, r: int = 20) -> DataFrame:
    """(term, doc_id, weight, rank): each term's r heaviest documents, ties to the lesser id."""
    order = Window.partitionBy("term").orderBy(F.desc("weight"), "doc_id")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= r).select("term", "doc_id", "weight", "rank")


def query_terms(spark, query: str) -> DataFrame:
    """(term): the distinct terms of a free-text query, a few rows."""
    words = spark.range(1).select(F.lit(query).alias("text")).select(F.explode(tokens(F.col("text"))).alias("word"))
    return with_stem(words).select("term").distinct()
