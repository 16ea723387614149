"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram's vector binds its letters': each is rotated by its
place (a permutation) and all are multiplied. A document's profile bundles, that is adds, the vectors of all its
n-grams; a language's prototype bundles the profiles of its training documents. A document gets the language whose
prototype has the largest cosine with its profile.

The training sample is bounded by a documented parameter; every whole text is scored, in Arrow batches, with memory
of one block of distinct n-grams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import id_crc, stage_table

_OTHER = re.compile(r"[\W\d_]+")
#: Letters beyond this code point share vectors by remainder, so that an n-gram's code fits 64 bits.
_LETTERS = 1 << 16


class Space:
    """Vectors of letters and n-grams, each made from its code alone, so that all tasks and runs agree."""

    def __init__(self, dims: int = 1024, n: int = 3, seed: str = "hd"):
        self.dims, self.n, self.seed = dims, n, seed
        self._letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            if len(self._letters) > 4096:
                self._letters.clear()
            bits = hashlib.shake_128(f"{self.seed}:{code}".encode()).digest(self.dims // 8)
            self._letters[code] = (np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(np.int8) * 2 - 1).astype(np.int8)
        return self._letters[code]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of n-gram codes, as a matrix of int8."""
        out = np.ones((len(codes), self.dims), dtype=np.int8)
        for place in range(self.n):
            letters, which = np.unique((codes >> (16 * place)) & (_LETTERS - 1), return_inverse=True)
            rows = np.stack([np.roll(self.letter(int(c)), place + 1) for c in letters]) if len(letters) else np.ones((0, self.dims), np.int8)
            out *= rows[which.reshape(-1)]
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes of the letters (other characters are one space) and their counts; none without letters."""
        t = _OTHER.sub(" ", text.lower()).strip()
        if not t:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = np.frombuffer(f" {t} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64) % _LETTERS
        if len(x) < self.n:
            x = np.concatenate([x, np.full(self.n - len(x), 32, np.int64)])
        g = np.zeros(len(x) - self.n + 1, dtype=np.int64)
        for place in range(self.n):
            g |= x[place : len(x) - self.n + 1 + place] << (16 * place)
        return np.unique(g, return_counts=True)

    def profile(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dims, dtype=np.float64)
        for lo in range(0, len(codes), 4096):
            out += counts[lo : lo + 4096].astype(np.float32) @ self.bound(codes[lo : lo + 4096]).astype(np.float32)
        return out


class Table:
    """n-gram vectors met so far, up to `most` rows; beyond that they start anew."""

    def __init__(self, space: Space, most: int = 16384):
        self.space, self.most = space, most
        self.rows = np.empty((most, space.dims), np.float32)
        self.clear()

    def clear(self) -> None:
        self.codes, self.where, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def profile(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(codes) > self.most // 2:
            return self.space.profile(codes, counts)
        at = np.searchsorted(self.codes, codes)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == codes if len(self.codes) else np.zeros(len(codes), bool)
        if not known.all():
            new = codes[~known]
            if self.used + len(new) > self.most:
                self.clear()
                new = codes
            self.rows[self.used : self.used + len(new)] = self.space.bound(new)
            every = np.concatenate([self.codes, new])
            order = np.argsort(every, kind="stable")
            self.codes = every[order]
            self.where = np.concatenate([self.where, np.arange(self.used, self.used + len(new))])[order]
            self.used += len(new)
            at = np.searchsorted(self.codes, codes)
        return (counts.astype(np.float32) @ self.rows[self.where[at]]).astype(np.float64)


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-12)


def fit(sample: list[tuple[str, str]], space: Space) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes: each document counts alike."""
    table, sums = Table(space), {}
    for text, lang in sample:
        codes, counts = space.grams(text)
        if len(codes):
            sums.setdefault(lang, []).append(unit(table.profile(codes, counts)))
    names = sorted(sums)
    if not names:
        return [], np.zeros((0, space.dims))
    return names, np.stack([unit(np.mean(sums[n], axis=0)) for n in names])


def noise(space: Space, languages: int, chance: float) -> float:
    """What the best cosine of a text that shares no n-gram with any of `languages` exceeds with that chance.

    Each cosine has mean 0 and a deviation of 1 over the root of the dimensions, however long the text is.
    """
    return NormalDist().inv_cdf(1 - chance / max(1, languages)) / space.dims**0.5


def training_rows(docs: DataFrame, per_language: int = 500, modulus: int = 4, held: int = 2, most: int = 1_000_000) -> list[tuple[str, str]]:
    """At most `per_language` (text, lang) of each lang, the first by a hash of the id; only non-null lang, and no row with crc32(doc_id) % modulus = held.

    Of rows with one id and lang, the one of the least text hash counts, so as many texts reach the driver as were picked.
    What was picked is broadcast, some dozens of bytes a row; more than `most` rows, which two thousand languages would
    have, are an error.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(id_crc(F.col("doc_id")) % modulus != held)
    known = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    # Spark keeps the first rows of each language in every task before it shuffles.
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "t")
    picked = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    picked = picked.groupBy("lang", "doc_id").agg(F.min("t").alias("t"))
    picked = stage_table(picked, "picked", per_language)
    if picked.count() > most:
        raise ValueError(f"more than {most} training rows: take fewer of each language")
    texts = docs.select(F.col("lang").alias("its_lang"), F.col("doc_id").alias("its_id"), "text").join(F.broadcast(picked), (F.col("its_lang") == F.col("lang")) & F.col("its_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("t")))
    rows = texts.groupBy("lang", "doc_id").agg(F.first("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["lang"], r["text"]))]


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, space: Space, no_letters: str = "und", grams: str | None = None) -> DataFrame:
    """docs plus lang_pred string, score double.

    The score is the cosine, mapped from [-1, 1] to [0, 1]. A null text, or one without a letter, is `no_letters`
    with score 0, and so is every text if nothing was learned. Ties go to the language that sorts first. Rows and
    columns of docs are kept as they are; existing columns of those names are replaced. `grams` names one more column,
    the number of distinct n-grams, if it is given.
    """
    added = ["lang_pred", "score", *([grams] if grams else [])]
    docs = docs.drop(*added)
    dims, n, seed = space.dims, space.n, space.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Space(dims, n, seed)
        table = Table(own)
        for b in batches:
            best, score, many = [], [], []
            for t in b.column(b.schema.get_field_index("text")):
                t = t.as_py()
                codes, counts = own.grams(t) if t and names else ((), ())
                many.append(len(codes))
                if not len(codes):
                    best.append(no_letters)
                    score.append(0.0)
                    continue
                cos = prototypes @ unit(table.profile(codes, counts))
                k = int(np.argmax(cos))
                best.append(names[k])
                score.append(float(min(1.0, max(0.0, (1 + cos[k]) / 2))))
            columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(many, pa.int64())][: len(added)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *added])

    schema = StructType([*docs.schema.fields, *[StructField(c, t) for c, t in zip(added, (StringType(), DoubleType(), LongType()), strict=False)]])
    return docs.mapInArrow(run, schema)
