"""A corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing and packing, each stage a table in the shared folder."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import langid, mixing, near, packing, suffix
from skein.llm.common import WORD, drop_tables, noting, remove, stage_table, table

#: The chance that a text like no language learned, of any length, is taken for one of them.
UNLIKE = 0.001
#: Texts of fewer distinct n-grams are too short to be judged and stay: their own language's cosine may be within the noise.
LEAST_GRAMS = 33


#: Tables that the last stage called has left in the shared folder.
_LEFT: list[str] = []


def stage(f):
    """A stage: when it is called, its predecessor's result has been written, so what that one left behind is deleted, unless docs still reads it."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _LEFT else []
        if not any(path.partition(":")[2].lstrip("/") in f for f in files for path in _LEFT):
            remove(spark, *_LEFT)
        _LEFT.clear()
        with noting(_LEFT):
            return f(spark, docs, sf_dir)

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or long enough and like no language learned, go; lang is that found, or the own of those too short to be judged.

    Null and empty texts go, having no letter; null ids, repeated rows and ties stay as they are. If no row has a lang
    to learn from, every text is without a language and goes. An empty table gives an empty one.
    """
    space = langid.Space()
    names, prototypes = langid.fit(langid.training_rows(docs), space)
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang")
    found = langid.identify(packed, names, prototypes, space, grams="grams").where(F.col("lang_pred") != "und")
    short = F.col("grams") < LEAST_GRAMS
    kept = found.where(short | (F.col("score") >= (1 + langid.noise(space, len(names), UNLIKE)) / 2))
    lang = F.when(short, F.coalesce("lang", "lang_pred")).otherwise(F.col("lang_pred"))
    return kept.select(*[lang.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one of the least id, or of the least hash where none has an id.

    Texts without a word are one component; rows of one id and unlike texts all stay.
    """
    return near.dedup(docs)


@stage
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings go; letters cut in two go with them, and so do documents left without a word.

    Null, empty and blank texts go, being without a word; repeated rows are copies of each other.
    """
    names = docs.columns
    found = suffix.dedup(docs.select(F.struct(*[c for c in names if c != "text"]).alias("row"), "text"), keep_text=True)
    # What isn't valid UTF-8 after cutting is marked by U+FFFD, then left out.
    valid = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    found = found.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(valid)).where(F.col("text").rlike(WORD))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in names])


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows find their share by id, source and text, null or not. Only rows alike in all three are interchangeable; they are
    numbered by what else they have.
    """
    same = ["doc_id", "source", "text_key"]
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), text_key=True)
    mixed = mixed.withColumn("number", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("taken")))).where("taken > 0")
    taken = mixed.select(*[F.col(c).alias(f"its_{c}") for c in (*same, "number")], (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    # Rows travel as one struct, so that no column of theirs is mistaken for one of these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("row"))))
    met = rows.join(taken, (F.col("number") == F.col("its_number")) & F.expr(" AND ".join(f"{c} <=> its_{c}" for c in same)))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, as pieces with their ids; a null text is an empty one, and every row is packed."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("mix", mix), ("pack", pack)]

#: Neither the language profiles nor the index nor the tokenizer can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, f in STAGES:
        docs = stage_table(f(spark, docs, sf_dir), name)
        drop_tables(*written)
        written = [docs]
    return docs
