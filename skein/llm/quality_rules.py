"""Quality rules as a short-circuit cascade, in DataFrame operations alone.

Each rule is a Column that is true where a text fails. On a sample of the rows that pass the base rules, which alone get
as far as the cascade, every rule's cost and selectivity are measured; rules are then ordered by rejection per cost, each
by what it rejects of the rows that those before it let pass, and chained in one CASE, which stops at the first that
fails. The verdict is a conjunction, so the order, and with it the sample, changes what is spent and never what is kept.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

SYMBOLS = "[#*$%&|<>]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is not copied into the places that use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_window_words(w: Column, n: int = 3) -> Column:
    """Words that lie in some n-word window found twice or more in the text, the first included.

    Windows are compared by a chained 64-bit hash; only texts with a repeat go on to sort them.
    """
    count = F.size(w) - (n - 1)
    starts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(n)]))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.when(j > 0, F.get(s, j - 1)["h"]) == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.array_compact(F.transform(s, lambda e, j: F.when(same(e, j), e["i"]))))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(n)), F.lit(n)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return bind(bind(by_hash, twice), union)

    some = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(count >= 2, some).otherwise(F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    full = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_features(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text that isn't null."""
    of_words = bind(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_window_words(w).alias("r")),
    )
    return {
        "_w": of_words,
        "n_symbols": count(text, SYMBOLS),
        "n_dup_lines": repeated_lines(text),
    }


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules(symbols_pct: int = 10, upper_pct: int = 30, marks_pct: int = 10, lines_pct: int = 50, least_chars: int = 2, most_chars: int = 15) -> list[Rule]:
    """Over columns text, n_words, word_chars, n_symbols, n_dup_lines; percentages of words, of characters and of lines."""
    upper, marks = count(F.col("text"), r"\p{Lu}"), count(F.col("text"), "[!?]")
    lines = F.size(F.split("text", "\n"))
    return [
        Rule("symbols", F.col("n_symbols") * 100 > F.col("n_words") * symbols_pct),
        Rule("shouting", upper * 100 > F.col("word_chars") * upper_pct),
        Rule("exclaiming", marks * 100 > F.col("n_words") * marks_pct),
        Rule("repeated_lines", F.col("n_dup_lines") * 100 > lines * lines_pct),
        Rule("word_length", (F.col("word_chars") < F.col("n_words") * least_chars) | (F.col("word_chars") > F.col("n_words") * most_chars)),
    ]


def featured(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns(base_features(F.col("text")))
    return d.select("doc_id", "text", F.col("_w.n").alias("n_words"), F.col("_w.c").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))


def measured(held: DataFrame, candidates: list[Rule], rows: int, chars: int, evaluated: int = 6_000_000) -> list[float]:
    """Seconds a row that each rule takes: of jobs that evaluate it on about `evaluated` characters, less what they take without a rule."""
    times = max(1, evaluated // max(1, chars))
    again = held.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def took(fails: Column) -> float:
        began = time.perf_counter()
        again.agg(F.count(F.when(fails, 1))).first()
        return time.perf_counter() - began

    least = lambda fails: min(took(fails) for _ in range(2))
    floor = min(least(F.col("text").isNull()), least(F.col("text").isNull()))
    return [max((least(r.fails) - floor) / (times * rows), 1e-9) for r in candidates]


def greedy(costs: list[float], verdicts: list[tuple[int, int]]) -> list[tuple[int, float]]:
    """(rule, share rejected of the rows that reach it) by falling rejection per cost; verdicts are (bits of the rules that fail, rows)."""
    order, left = [], list(range(len(costs)))
    while left:
        rows = sum(n for _, n in verdicts)
        share = {i: sum(n for bits, n in verdicts if bits >> i & 1) / rows if rows else 0.0 for i in left}
        best = max(left, key=lambda i: (share[i] / costs[i], -i))
        order.append((best, share[best]))
        left.remove(best)
        verdicts = [(bits, n) for bits, n in verdicts if not bits >> best & 1]
    return order


def order_rules(docs: DataFrame, candidates: list[Rule], base_failed: Column, sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected of the rows that reach it, seconds a row) in the order of the cascade.

    Every row has the same chance to be among the about `sample_rows` drawn. With no row that passes the base, rules keep
    the order they are given in.
    """
    total = docs.count()
    drawn = docs.select("doc_id", "text").sample(min(1.0, sample_rows / max(1, total)), seed)
    held = stage_table(featured(drawn).where(~base_failed), "sample", 2 * sample_rows)
    bits = sum((F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(candidates)), F.lit(0).cast("long"))
    # No more rows than the sample has.
    verdicts = [(x["bits"], x["n"], x["chars"]) for x in held.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()]
    rows, chars = sum(n for _, n, _ in verdicts), sum(c for _, _, c in verdicts)
    if not rows:
        return [(r, 0.0, 0.0) for r in candidates]
    costs = measured(held, candidates, rows, chars)
    found = [(candidates[i], share, costs[i]) for i, share in greedy(costs, [(b, n) for b, n, _ in verdicts])]
    logging.getLogger(__name__).info("cascade: %s", ", ".join(f"{r.name} (rejects {share:.4f} at {cost * 1e6:.2f} us a row)" for r, share, cost in found))
    return found


def cascade(docs: DataFrame, candidates: list[Rule] | None = None, sample_rows: int = 2000, least_words: int = 50, repeat_pct: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row of docs(doc_id, text).

    A null or empty text has no words and fails the base rules; a null doc_id is passed on; repeated rows stay
    repeated; an empty table gives an empty result; other columns are ignored.
    """
    candidates = rules() if candidates is None else candidates
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_pct)
    chain = F.when(F.col("base_failed"), F.lit(False))
    for r, _, _ in order_rules(docs, candidates, base, sample_rows):
        chain = chain.when(r.fails, F.lit(False))
    return featured(docs).withColumn("base_failed", base).withColumn("kept", chain.otherwise(F.lit(True))).drop("text")
