"""Near-duplicates by shingles, MinHash sketches, supershingles and leaders.

Sketches are made in Arrow batches with numpy: 84 minima over every shingle are a matter of vector arithmetic there,
and of as many interpreted lambdas in SQL. Everything after is relational: identical sketches are one class, so that
many copies of a text never meet in a join; classes meet on equal supershingles, and for leaders only with those.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.text import whitespace_words
from ..session import materialize, stored

N, HASHES, BLOCK = 4, 84, 6


def moduli(n: int = HASHES, seed: int = 42) -> list[int]:
    """The hash family: h modulo each of these."""
    r = random.Random(seed)
    return [r.randint(1, 100_000) for _ in range(n)]


def short_docs(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id) of documents with fewer than n words, which have no shingle."""
    return docs.where(F.size(whitespace_words(F.coalesce("text", F.lit("")))) < n).select("doc_id")


def shingles(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, pos, shingle): n-grams of raw words, joined by the unit separator; pos counts from 0, repeats are kept."""
    words = docs.select("doc_id", whitespace_words(F.coalesce("text", F.lit(""))).alias("_w")).where(F.size("_w") >= n)
    # The array is bound to a lambda's variable, so that it is not split again for every shingle.
    grams = F.transform(F.array("_w"), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.concat_ws("\x1f", *[F.get(w, i + j) for j in range(n)])))
    return words.select("doc_id", F.posexplode(F.element_at(grams, 1)).alias("pos", "shingle"))


def shingle_hash(shingle: bytes) -> int:
    return int(hashlib.md5(shingle).hexdigest()[:15], 16)


def sketches(docs: DataFrame, n: int = N, mods: list[int] | None = None) -> DataFrame:
    """(doc_id, sketch): for each modulus the least remainder over the document's shingles; documents without one are left out."""
    m = np.array(mods or moduli(), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for i, t in enumerate(b.column("text")):
                # Words by ASCII and Unicode white space alike as in whitespace_words: [ \t\n\v\f\r].
                w = (t.as_py() or "").encode("utf-8", "replace").split()
                if len(w) < n:
                    continue
                h = np.array(list({shingle_hash(b"\x1f".join(w[j : j + n])) for j in range(len(w) - n + 1)}), dtype=np.int64)
                least = np.full(len(m), np.iinfo(np.int64).max)
                for lo in range(0, len(h), 4096):
                    least = np.minimum(least, (h[lo : lo + 4096, None] % m[None, :]).min(axis=0))
                keep.append(i)
                out.append(least)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(m), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), arrays], ["doc_id", "sketch"])

    schema = StructType([docs.schema["doc_id"], StructField("sketch", ArrayType(LongType()))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def supershingles(sketched: DataFrame, k: int = BLOCK, size: int = HASHES) -> DataFrame:
    """sketched plus supers: the distinct blocks of k consecutive minima, each as a hash; blocks' places do not count."""
    if size % k:
        raise ValueError("the sketch's size must be divisible by the block's")
    blocks = [F.md5(F.array_join(F.slice("sketch", i + 1, k), ",").cast("binary")) for i in range(0, size, k)]
    return sketched.withColumn("supers", F.array_distinct(F.array(*blocks)))


def jaccard(a, b):
    """Of two arrays as sets of values; null where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def classes(sketched: DataFrame) -> DataFrame:
    """(rep, sketch): one row per distinct sketch, with the least doc_id that has it."""
    return sketched.groupBy("sketch").agg(F.min("doc_id").alias("rep"))


def dup_candidates(reps: DataFrame, min_overlap: int = 2) -> DataFrame:
    """(a, b, overlap), a < b: representatives that share at least min_overlap supershingles. Copies are in classes()."""
    filed = supershingles(reps).select(F.col("rep"), F.explode("supers").alias("s"))
    # Supershingles that one class alone has can join nothing.
    shared = filed.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s")
    filed = filed.join(shared, "s")
    left, right = filed.select(F.col("rep").alias("a"), "s"), filed.select(F.col("rep").alias("b"), "s")
    return left.join(right, "s").where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= min_overlap)


def dup_pairs(reps: DataFrame, min_overlap: int = 2, min_similarity: float = 0.5) -> DataFrame:
    """(a, b, overlap, similarity) of candidates whose sketches' value sets have that Jaccard similarity."""
    c = dup_candidates(reps, min_overlap)
    c = c.join(reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    return c.select("a", "b", "overlap", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= min_similarity)


def leaders(reps: DataFrame, pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(rep, leader): null leader for a leader, else the least similar leader before it.

    Scanned in order of id, a document becomes a leader unless an earlier leader is similar. That is the first
    maximal independent set, found in rounds: who has no undecided or leading neighbour before it leads; who has a
    leading one is a duplicate.
    """
    edges = materialize(pairs.select("a", "b"), "pairs")
    state = materialize(reps.select("rep", F.lit(None).cast("boolean").alias("leads")), "leads")
    left = None
    for _ in range(most_rounds):
        before = edges.join(state.select(F.col("rep").alias("a"), "leads"), "a").groupBy(F.col("b").alias("rep"))
        seen = before.agg(F.max(F.coalesce("leads", F.lit(False))).alias("led"), F.max(F.col("leads").isNull()).alias("open"))
        fresh = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = materialize(state.join(seen, "rep", "left").select("rep", fresh.alias("leads")), "leads")
        left = state.where("leads is null").count()
        if not left:
            break
    if left:
        raise RuntimeError(f"{left} documents undecided after {most_rounds} rounds")
    first = edges.join(state.where("leads").select(F.col("rep").alias("a")), "a").groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("leader"))
    return state.join(first, "rep", "left").select("rep", F.when(~F.col("leads"), F.col("leader")).alias("leader"))


def overlap_keys(reps: DataFrame, min_overlap: int = 2) -> DataFrame:
    """(key, rep): a row for each choice of min_overlap supershingles of a class that another class has too, so that those that share a key are the candidates."""
    filed = supershingles(reps).select("rep", F.explode("supers").alias("s"))
    filed = filed.join(filed.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s"), "s")
    # A class has no more supershingles than blocks.
    keys = filed.groupBy("rep").agg(F.array_sort(F.collect_list("s")).alias("own"))
    choices = F.transform(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.struct(i.alias("last"), F.get("own", i).alias("key")))
    for _ in range(min_overlap - 1):
        choices = F.flatten(F.transform(choices, lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: i > c["last"]), lambda i: F.struct(i.alias("last"), F.concat(c["key"], F.get("own", i)).alias("key")))))
    found = keys.where(F.size("own") >= min_overlap).select("rep", F.explode(choices).alias("c")).select(F.unhex(F.md5(F.col("c.key").cast("binary"))).alias("key"), "rep")
    return found.join(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key")


def first_leaders(reps: DataFrame, min_overlap: int = 2, min_similarity: float = 0.5, most_rounds: int = 1000) -> DataFrame:
    """(rep, leader) as leaders() gives them for dup_pairs(), without making all pairs.

    Classes without a key lead; sketches of the others alone are carried on. A class whose keys have no undecided class
    before it leads. So a key has one new leader a round at most, and only leaders are compared with the classes after them
    that share a key: a round's pairs are as many as there are keys of undecided classes, and the next round has these
    alone. Rounds are as many as there are leaders in a row that share a key and aren't similar, plus a few. A duplicate's
    leader may be followed by a lesser one of a later round; those pairs are compared once, at the end.
    """
    spark, own = reps.sparkSession, materialize(reps.select("rep", "sketch"), "sketch")
    filed = materialize(overlap_keys(own, min_overlap), "keys")
    sketch = materialize(own.join(filed.select("rep").distinct(), "rep", "left_semi"), "keyed")
    path, waiting = stored(spark, "decided"), filed

    def least(met: DataFrame) -> DataFrame:
        """(rep, lead): of pairs (rep, lead), the least similar lead."""
        met = met.distinct().join(sketch, "rep").join(sketch.select(F.col("rep").alias("lead"), F.col("sketch").alias("its")), "lead")
        return met.where(jaccard(F.col("sketch"), F.col("its")) >= min_similarity).groupBy("rep").agg(F.min("lead").alias("lead"))

    for turn in range(most_rounds):
        blocked = waiting.join(waiting.groupBy("key").agg(F.min("rep").alias("first")), "key").where("first < rep").select("rep").distinct()
        fresh = materialize(waiting.select("rep").distinct().join(blocked, "rep", "left_anti"), "fresh")
        led = waiting.join(fresh, "rep").select("key", F.col("rep").alias("lead"))
        found = least(waiting.join(led, "key").where("rep > lead").select("rep", "lead"))
        decided = fresh.withColumn("lead", F.lit(None).cast(reps.schema["rep"].dataType)).unionByName(found)
        decided.write.parquet(f"{path}/turn={turn}")
        decided = spark.read.schema(decided.schema).parquet(f"{path}/turn={turn}")
        waiting = materialize(waiting.join(decided, "rep", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
    else:
        raise RuntimeError(f"documents undecided after {most_rounds} rounds")
    decided = spark.read.schema(StructType([*decided.schema, StructField("turn", LongType())])).parquet(path)
    led = filed.join(decided.where("lead is null").select(F.col("rep").alias("new"), F.col("turn").alias("later")), F.col("rep") == F.col("new")).select("key", "new", "later")
    after = decided.where("lead is not null").join(filed, "rep").join(led, "key").where("later > turn and new < lead").select("rep", F.col("new").alias("lead"))
    leader = decided.where("lead is not null").select("rep", F.col("lead").alias("found")).join(least(after), "rep", "left").select("rep", F.least("found", "lead").alias("leader"))
    return own.select("rep").join(leader, "rep", "left")


def duplicates(docs: DataFrame, min_overlap: int = 2, min_similarity: float = 0.5) -> DataFrame:
    """(doc_id, leader) for every document with a shingle: null for a leader; a copy's leader is its class's, or the class's first."""
    sketched = materialize(sketches(docs), "sketches")
    reps = classes(sketched)
    found = first_leaders(reps, min_overlap, min_similarity)
    members = sketched.join(reps, "sketch").select("doc_id", "rep")
    return members.join(found, "rep").select("doc_id", F.when(F.col("doc_id") == F.col("rep"), F.col("leader")).otherwise(F.coalesce("leader", "rep")).alias("leader"))


def exact_jaccard(docs: DataFrame, pairs: DataFrame, n: int = N) -> DataFrame:
    """(a, b, jaccard): the similarity of the shingle sets themselves, for given pairs."""
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = shingles(docs.join(asked, "doc_id", "left_semi"), n).groupBy("doc_id").agg(F.collect_set("shingle").alias("s"))
    p = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    return p.select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))
