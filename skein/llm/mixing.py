"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every document is a packet of its source's queue, in an order shuffled by a hash. Its virtual finish time is the
number of source words up to and including it, divided by the source's target; a document may be sent twice, the
second time after its whole source. The mix is what leaves first, in order of virtual finish time, until the total
budget is used up.

No queue is ever held by one task. A source's running totals are two-pass prefix sums: the hash order is cut into
2**key_bits ranges, the ranges' totals are summed per source (at most 2**key_bits small rows each), and only within
a range is there a window. The global order is dealt the same way: virtual time is cut into `time_ranges` ranges,
their totals give the range in which the budget ends, and that range alone is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage_table

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _exact(c: Column) -> Column:
    return c.cast("decimal(24,0)")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: tuple = (3, 2), most: int = 2) -> DataFrame:
    """One row per source: (s_null, s, source_size, weight, target).

    `sizes` has (s_null, s, size). Sources in order of code point, null last, take `weights` in turn and share
    share[0]/share[1] of all sizes; no target is above `most` times its source's size, and what is over is shared
    again by weight. Sources sorted by most*size/weight are capped from the left, so one pass of running sums
    finds the level; comparisons are in whole numbers.
    """
    num, den = share
    one = Window.orderBy("s_null", "s")
    by_level = Window.orderBy("_level", "s_null", "s")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    lcm = 1
    for w in weights:
        lcm *= w
    t = (
        sizes.groupBy("s_null", "s")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(turn, ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_level", _exact(F.col("source_size")) * (F.lit(lcm) / F.col("weight")).cast("int"))
        .withColumn("_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
        .withColumn("_wleft", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_left", F.col("_all") * num - F.col("_before") * den)
        .withColumn("_capped", _exact(F.col("source_size")) * F.col("_wleft") * (most * den) <= _exact(F.col("_left")) * F.col("weight"))
    )
    # After the capped prefix, what is left and its weight are those of the first row that isn't capped.
    free = F.when(~F.col("_capped"), F.struct(F.col("_wleft").alias("w"), F.col("_left").alias("l")))
    t = t.withColumn("_free", F.max(free).over(every))
    fair = F.col("weight").cast("double") * F.col("_free.l").cast("double") / (F.col("_free.w") * den).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    return t.select("s_null", "s", "source_size", "weight", F.when(F.col("_capped"), cap).otherwise(F.least(fair, cap)).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple = (3, 2), most: int = 2, seed: str = "mix", key_bits: int = 12, time_ranges: int = 65536, text_key: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs(doc_id, text, source), and text_key, the text's MD5, if asked for.

    taken is size times the number of copies in the mix (0, 1 or 2). A null text has size 0; a null source is a
    source of its own, the last; a null doc_id is hashed as empty; rows of equal id and size are interchangeable, unless
    text_key is asked for, which orders them too.
    Empty input gives an empty result. Other columns are ignored.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    rows = docs.select(
        "doc_id",
        F.col("source").isNull().alias("s_null"),
        F.coalesce("source", F.lit("")).alias("s"),
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("k"),
        *([F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key")] if text_key else []),
    ).withColumn("kb", F.shiftright("k", 60 - key_bits))
    # A few dozen bytes for each document; texts are scanned once.
    rows = stage_table(rows, "sizes")
    last_keys = ["k", "doc_id", "size", *(["text_key"] if text_key else [])]

    ranges = rows.groupBy("s_null", "s", "kb").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("s_null", "s").orderBy("kb").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        ranges.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(source_targets(ranges, weights, share, most), ["s_null", "s"])
        .select("s_null", "s", "kb", "base", "source_size", "target")
    )
    within = Window.partitionBy("s_null", "s", "kb").orderBy(*last_keys).rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.join(ranges, ["s_null", "s", "kb"]).withColumn("cum", F.col("base") + F.sum("size").over(within))
    finish = lambda copy: F.when(F.col("target") > 0, (F.col("cum") + F.col("source_size") * copy).cast("double") / F.col("target"))
    timed = timed.withColumn("v0", finish(0)).withColumn("v1", finish(1))
    timed = stage_table(timed.drop("kb", "base", "cum"), "timed")

    item = lambda copy: F.struct(F.col(f"v{copy}").alias("v"), "s_null", "s", F.lit(copy).alias("copy"), *last_keys)
    items = timed.where(F.col("size") > 0).select(F.explode(F.array(*[item(i) for i in range(2)])).alias("x")).where("x.v is not null")
    items = items.withColumn("vb", F.least(F.floor(F.col("x.v") * (time_ranges / 2)), F.lit(time_ranges)).cast("long"))
    totals = items.groupBy("vb").agg(F.sum("x.size").alias("size"))
    upto = Window.orderBy("vb").rowsBetween(Window.unboundedPreceding, 0)
    budget = timed.agg((F.coalesce(F.sum("size"), F.lit(0)) * share[0] / share[1]).alias("b")).first()["b"]
    # At most time_ranges + 1 rows, one of which goes to the driver.
    last = totals.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") > budget).orderBy("vb").first()
    if last is None:
        cut = F.lit(True), F.lit(True)
    else:
        order = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        inside = items.where(F.col("vb") == last["vb"]).withColumn("upto", F.sum("x.size").over(order) + (last["upto"] - last["size"]))
        end = inside.where(F.col("upto") <= budget).agg(F.max("x").alias("x")).first()["x"]
        if end is None:
            edge = F.lit(last["vb"])
            cut = tuple(F.least(F.floor(F.col(f"v{i}") * (time_ranges / 2)), F.lit(time_ranges)).cast("long") < edge for i in range(2))
        else:
            types = {f.name: f.dataType for f in items.schema["x"].dataType}
            edge = F.struct(*[F.lit(end[n]).cast(types[n]).alias(n) for n in types])
            cut = tuple(item(i) <= edge for i in range(2))
    copies = sum((F.coalesce(c, F.lit(False)).cast("long") for c in cut), F.lit(0))
    copies = F.when((F.col("size") > 0) & F.col("v0").isNotNull(), copies).otherwise(F.lit(0))
    source = F.when(F.col("s_null"), F.lit(None)).otherwise(F.col("s")).alias("source")
    return timed.select("doc_id", source, "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *last_keys[3:])
