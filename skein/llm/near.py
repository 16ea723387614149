"""Near copies by the similarity of their five-word shingles, for the pipeline.

Texts of the same words are summed up first. Candidates come from two searches: bands of MinHash sketches, and the
Gray-order index of SimHash fingerprints. Every candidate is then checked exactly: a link is a Jaccard similarity of the
shingle sets of at least 4/5, and components are those of the links.

The texts that share a band are a bucket, and so are those whose fingerprints are joined by links. Each is compared with
the bucket's least text first, pair by pair; that joins what is most alike. Buckets whose texts aren't all in one
component then go on: they are dealt by a hash into blocks of about `BLOCK` texts (most buckets are one block), and
within a block every text is compared with every other by counting shared shingles in inverted lists.

What is still open of the buckets of several blocks is compared across blocks: each is dealt into some parts, and a cell
has the rows of two parts. There every pair not joined yet is tried by the parities of its shingles: where so many bits
differ, as many shingles at least are in one set alone, so no link is left out. The pairs that would join a cell's texts
are checked exactly first, then all that are left. So no link is lost in a bucket of any size; the rows dealt grow with
the power 1.5 of an open bucket, and the tries, of a few words each, with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import drop_tables, stage_table
from .components import components
from .simhash import links

#: A pair of similarity 0.8 shares none of 24 bands of 5 minima with a chance of (1 - 0.8 ** 5) ** 24, 7 in 100,000.
N, BANDS, ROWS = 5, 24, 5
BLOCK = 256
#: Bits of the widest parities, and texts of a cell that are compared with others at a time.
WIDEST, STRIP = 1 << 15, 64
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, n: int = N, seed: int = 42) -> tuple[int, np.ndarray]:
    """A hash of the words, 0 without one, and those of the n-word shingles; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-n] + 1]).tolist() if len(words) > n else [0]
    stops = ends[n - 1 :].tolist() if len(words) > n else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return digest(joined, seed + 1) or 1, np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each band a hash of its number and minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), 512):
        np.minimum(least, (_ODD[:, None] * hashes[None, lo : lo + 512]).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def similar(both, x, y):
    """Whether sets of x and y members with so many in both have a Jaccard similarity of at least 4/5; for numbers or arrays."""
    return 5 * both >= 4 * (x + y - both)


def alike(sets: list[np.ndarray], root: list) -> list[tuple[int, int]]:
    """Links (i, j) among sets of hashes that join what all similar pairs join; sets of one root are joined already."""
    own: dict = {}
    parent = [own.setdefault(r, i) for i, r in enumerate(root)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    which = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    order = np.argsort(which, kind="stable")
    listed = owner[order]
    ends = np.cumsum(np.bincount(which))
    begins = np.concatenate([[0], ends[:-1]])
    out, at = [], 0
    for i, n in enumerate(size.tolist()):
        mine = which[at : at + n]
        at += n
        many = ends[mine] - begins[mine]
        stops = np.cumsum(many)
        # The lists of this set's members, one after another.
        places = np.arange(int(stops[-1])) + np.repeat(begins[mine] - (stops - many), many)
        both = np.bincount(listed[places], minlength=len(sets))
        for j in np.flatnonzero(similar(both, n, size)[:i]).tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of distinct hashes falls on each of some bits, two to four times as many as hashes, a power of two."""
    width = min(max(64, 1 << (2 * len(hashes)).bit_length()), WIDEST)
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Side:
    """Texts of a part, by size: their numbers of shingles and their parities, which halves fold to fewer bits."""

    def __init__(self, size: list[int], bits: list[bytes]):
        self.size, self.bits = np.array(size, np.int64), bits
        self.width = np.array([8 * len(b) for b in bits], np.int64)
        self.folded: dict = {}

    def at(self, width: int, lo: int, hi: int) -> np.ndarray:
        """Words of so many bits, a column for each of the texts lo to hi, none of which has fewer bits, or more than twice as many."""
        if width not in self.folded:
            first, last = np.searchsorted(self.width, width), np.searchsorted(self.width, 2 * width, "right")
            words = [np.frombuffer(b, "<u8") for b in self.bits[first:last]]
            self.folded[width] = first, np.array([w if len(w) * 64 == width else w[: len(w) // 2] ^ w[len(w) // 2 :] for w in words]).T.copy()
        first, words = self.folded[width]
        return words[:, lo - first : hi - first]


def close(x: Side, y: Side, root: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of x's and y's texts that may be similar and have unlike roots, numbered as root is: first x's, then y's.

    With x for y, pairs within x. If `whole`, all of them; else those of a forest that joins what all would join.
    """
    root, shift = root.copy(), 0 if x is y else len(x.size)
    s = 0
    while s < len(x.size):
        # Within a strip, and with what may be similar to it, sizes differ by less than twice, so at most two widths meet.
        e = min(s + STRIP, int(np.searchsorted(x.size, x.size[s] * 5 // 4, "right")))
        lo, hi = int(np.searchsorted(y.size, -(-4 * x.size[s] // 5))), int(np.searchsorted(y.size, x.size[e - 1] * 5 // 4, "right"))
        if x is y:
            hi = min(hi, e)
        if lo < hi:
            width = int(min(x.width[s], y.width[lo]))
            differ = np.zeros((e - s, hi - lo), np.int32)
            for p, q in zip(x.at(width, s, e), y.at(width, lo, hi), strict=True):
                differ += np.bitwise_count(p[:, None] ^ q[None, :])
            m, n = x.size[s:e, None], y.size[None, lo:hi]
            # Similar sets have (m + n) / 9 members at most that are in one of them alone.
            hit = (9 * differ <= m + n) & (5 * m >= 4 * n) & (5 * n >= 4 * m) & (root[s:e, None] != root[None, shift + lo : shift + hi])
            if x is y:
                hit &= np.arange(lo, hi)[None, :] < np.arange(s, e)[:, None]
            if whole:
                i, j = np.nonzero(hit)
                pairs = [(i + s, j + lo + shift)]
            else:
                pairs = []
                for i in np.flatnonzero(hit.any(axis=1)).tolist():
                    j = np.flatnonzero(hit[i])
                    j = j[np.argsort(differ[i, j], kind="stable")] + lo + shift
                    j = j[root[j] != root[s + i]]
                    j = j[np.unique(root[j], return_index=True)[1]]
                    root[np.isin(root, root[j])] = root[s + i]
                    pairs.append((np.full(len(j), s + i), j))
            if sum(len(i) for i, _ in pairs):
                yield np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs])
        s = e


#: Columns that marked() adds.
KEY, COUNT, FP, BAND = "__near_key", "__near_n", "__near_fp", "__near_bands"


def marked(docs: DataFrame) -> DataFrame:
    """docs plus KEY, the words' hash, COUNT, the number of distinct shingles, FP, the fingerprint, and BAND, the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, fp, bands = [], [], [], []
            for t in b.column(b.schema.get_field_index("text")):
                k, h = shingles(t.as_py() or "")
                key.append(k)
                ones = sum((np.unpackbits(h[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for lo in range(0, len(h), 8192)), np.zeros(64, np.int64))
                fp.append(int(np.packbits((ones * 2 > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]))
                n.append(len(np.unique(h)))
                bands.append(sketch(h) if len(h) else np.zeros(0, np.int64))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, n, fp)]
            yield pa.RecordBatch.from_arrays([*b.columns, *longs, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*b.schema.names, KEY, COUNT, FP, BAND])

    more = [StructField(c, LongType()) for c in (KEY, COUNT, FP)] + [StructField(BAND, ArrayType(LongType()))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def sets_of(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, members, size, bits): the sorted shingle hashes, eight bytes each, of the texts(row, text) that are in rows(row, key), their number and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t.as_py() or "")[1]) for t in b.column("text")]
            more = [pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int64()), pa.array([parities(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("key"), *more], ["key", "members", "size", "bits"])

    used = texts.join(rows.select("row", "key").distinct(), "row").select("key", "text")
    return stage_table(used.mapInArrow(run, "key long, members binary, size long, bits binary"), "sets")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("x", "y"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                keep[i] = similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    sets = sets.select("key", "members")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return stage_table(both.mapInArrow(run, "a long, b long"), "links")


def block_links(dealt: DataFrame) -> DataFrame:
    """(a, b): links within the blocks of dealt(band, block, key, root, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, roots, sets = None, [], [], []

        def flush():
            found = alike(sets, roots) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.int64()), pa.array([keys[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in batches:
            members = b.column("members")
            for i, (band, block, key, root) in enumerate(zip(*[b.column(c).to_pylist() for c in ("band", "block", "key", "root")], strict=True)):
                if (band, block) != last:
                    yield flush()
                    last, keys, roots, sets = (band, block), [], [], []
                keys.append(key)
                roots.append(root)
                sets.append(np.frombuffer(members[i].as_py(), np.uint64))
        yield flush()

    dealt = dealt.repartition("band", "block").sortWithinPartitions("band", "block", "key")
    return stage_table(dealt.mapInArrow(run, "a long, b long").distinct(), "links")


def across(placed: DataFrame, sets: DataFrame, block: int, whole: bool) -> DataFrame:
    """(a, b): pairs that may be similar, of unlike roots, of the buckets of placed(band, many, key, root); see close()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def flush():
            if len({r[1] for r in rows}) < 2:
                return
            cut = next((i for i, r in enumerate(rows) if r[0]), len(rows))
            x, y = (Side([r[3] for r in part], [r[4] for r in part]) for part in (rows[:cut], rows[cut:]))
            keys = np.array([r[2] for r in rows], np.int64)
            for i, j in close(x, x if cell[1] == cell[2] else y, np.array([r[1] for r in rows], np.int64), whole):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(keys[i], keys[j])), pa.array(np.minimum(keys[i], keys[j]))], ["a", "b"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("band", "lo", "hi", "side", "root", "key", "size", "bits")]
            for band, lo, hi, *row in zip(*columns, strict=True):
                if (band, lo, hi) != cell:
                    yield from flush()
                    cell, rows = (band, lo, hi), []
                rows.append(row)
        yield from flush()

    open_ = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    parts = F.ceil(F.sqrt(F.col("many") / block))
    dealt = placed.join(open_, "band").select("band", "key", "root", F.pmod(F.xxhash64("band", "key"), parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    dealt = dealt.select("band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).cast("int").alias("side"), "root", "key")
    dealt = dealt.join(sets.select("key", "size", "bits"), "key").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "side", "size", "key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_components(marks: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of marks(key, row, n, fp, bands), one for each key, whose texts(row, text) are; keys without a link are absent."""
    # Links of fingerprints are a forest, so all that are joined by them are a bucket.
    fps = stage_table(components(links(marks.select("fp").distinct())), "nodes")
    same = marks.join(fps, marks.fp == fps.node, "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("band"), "key")
    filed = marks.select(F.explode("bands").alias("band"), "key").unionByName(same)
    buckets = filed.groupBy("band").agg(F.count("*").alias("many"), F.min("key").alias("b")).where("many > 1")
    filed = stage_table(filed.join(buckets, "band"), "filed")

    pairs = filed.where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    # Sets that differ in size by more than a fifth can't be that similar.
    sizes = marks.select("key", "n")
    pairs = pairs.join(sizes.toDF("a", "a_n"), "a").join(sizes.toDF("b", "b_n"), "b")
    pairs = stage_table(pairs.where("5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)").select("a", "b"), "pairs")
    sets = sets_of(texts, marks.select("row", "key").join(filed.select("key").distinct(), "key"))
    found = [checked(pairs, sets)]
    nodes = [stage_table(components(found[0]), "nodes")]

    def join(more: DataFrame) -> None:
        found.append(more)
        if more.isEmpty():
            return
        nodes.append(stage_table(components(reduce(DataFrame.unionByName, found)), "nodes"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(nodes[-1], rows.key == nodes[-1].node, "left").withColumn("root", F.coalesce("root", "key"))

    dealt = placed(filed).select("band", "key", "root", F.pmod(F.xxhash64("band", "key"), F.ceil(F.col("many") / block)).alias("block"))
    # A block wholly in one component has nothing to add.
    open_ = dealt.groupBy("band", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "block")
    join(block_links(dealt.join(open_, ["band", "block"]).join(sets.select("key", "members"), "key")))
    large = filed.where(F.col("many") > block)
    if not large.isEmpty():
        for whole in (False, True):
            join(checked(across(placed(large), sets, block, whole), sets))
    drop_tables(fps, filed, pairs, sets, *found, *nodes[:-1])
    return nodes[-1]


def dedup(docs: DataFrame) -> DataFrame:
    """Of each component the row of the least id stays, or where none has an id, the one of the least key.

    Texts of the same words are copies, and so are all without a word (null, empty, blanks). Rows of one id and other
    texts are told apart; ties go by the text's hash, then by place, so one row of each component stays whatever
    repeats. An empty table gives an empty one. Other columns, of whatever name, are passed on.
    """
    row = "__near_row"
    rows = stage_table(marked(docs).withColumn(row, F.monotonically_increasing_id()), "marked")
    # Texts of the same words are one, with its sketch; empty ones have nothing to be compared by.
    one = F.min(F.struct(F.col(row).alias("row"), F.col(COUNT).alias("n"), F.col(FP).alias("fp"), F.col(BAND).alias("bands"))).alias("m")
    marks = rows.where(F.col(COUNT) > 0).groupBy(F.col(KEY).alias("key")).agg(one).select("key", "m.*")
    nodes = near_components(stage_table(marks, "marks"), rows.select(F.col(row).alias("row"), "text"))
    small = rows.select(row, F.col(KEY).alias("key"), "doc_id", F.xxhash64("text").alias("h"))
    small = small.join(nodes, small.key == nodes.node, "left").withColumn("root", F.coalesce("root", "key"))
    first = small.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "h", row)).alias("m"))
    return rows.join(first.select(F.col(f"m.{row}").alias(row)), row, "left_semi").select(*docs.columns)
