"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most r bits agree on some choice of 6 of r + 6 blocks of bits (r changed bits spoil at
most r blocks). Each distinct fingerprint is filed under every such choice, and a bucket holds those that agree on
it: the shared bits are the bucket's masked pattern, its upper node. Within a bucket fingerprints are sorted by Gray
rank, so that neighbours differ in few bits, and sixteen at a time are factored into a node that holds the mask and
pattern of the bits all of them share; nodes are factored the same way. A search adds up differences on its way down,
on each node's bits that no node above has compared, and drops a whole group once the sum is above r.

A bucket hands on no pairs but a spanning forest of the links found, so its output is no longer than its input. With
r = 2 its fingerprints differ in two blocks of eight bits alone, so no bucket, however the input is made, has more
than 65,536 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stage_table
from .components import components

FANOUT = 16


def fingerprint(text: str, n: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes of the n-word shingles, repeats included; 0 without a word."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -n] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    count, ones = len(words) - n + 1, np.zeros(64, dtype=np.int64)
    stops = ends[n - 1 :].tolist()
    for lo in range(0, count, 8192):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo : lo + 8192], stops[lo : lo + 8192], strict=True)], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > count).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


FP = "__simhash_fp"


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """docs plus the fingerprint as a signed long, in a column of the reserved name FP; a null text is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.fromiter((fingerprint(t.as_py() or "", n, seed) for t in b.column(b.schema.get_field_index("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f.view(np.int64))], [*b.schema.names, FP])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(FP, LongType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The tree over one set of distinct fingerprints; level 0 are the fingerprints themselves."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        fps = fps[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.levels = [(fps, np.full(len(fps), full))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            cuts = np.arange(0, len(pattern), FANOUT)
            head = np.repeat(pattern[cuts], np.diff(np.append(cuts, len(pattern))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ head), cuts)
            self.levels.append((pattern[cuts] & shared, shared))

    def joined(self, root: np.ndarray) -> list[np.ndarray]:
        """For each level, the component (by root of the fingerprints) that all below a node are in, or -1."""
        out = [root[self.order]]
        for level in range(1, len(self.levels)):
            cuts = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], cuts), np.maximum.reduceat(out[-1], cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def within(self, queries: np.ndarray, r: int, own: np.ndarray | None = None, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query number, number of the fingerprint) of all that differ in at most r bits.

        With `root`, the component of each fingerprint, and `own`, that of each query, groups that are wholly in the
        query's component are pruned too: they have nothing to add to it.
        """
        joined = self.joined(root) if root is not None else None
        top = len(self.levels) - 1
        q, node = np.arange(len(queries), dtype=np.int32), np.zeros(len(queries), dtype=np.int32)
        above, sum_ = np.zeros(len(queries), dtype=np.uint64), np.zeros(len(queries), dtype=np.uint8)
        for level in range(top, -1, -1):
            pattern, mask = self.levels[level]
            if level < top:
                first = node * FANOUT
                many = np.minimum(first + FANOUT, len(pattern)) - first
                q, above, sum_ = np.repeat(q, many), np.repeat(above, many), np.repeat(sum_, many)
                ends = np.cumsum(many, dtype=np.int64)
                node = (np.repeat(first - (ends - many), many) + np.arange(len(q))).astype(np.int32)
            sum_ = sum_ + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node] & ~above)
            keep = sum_ <= r
            if joined is not None:
                keep &= joined[level][node] != own[q]
            q, node, sum_ = q[keep], node[keep], sum_[keep]
            above = mask[node]
        return q, self.order[node]


def forest(fps: np.ndarray, r: int, pairs: int = 1 << 20) -> list[tuple[int, int]]:
    """Edges (indices into fps) that connect the same fingerprints as all links of at most r bits do, at most len(fps) - 1.

    Queries go in blocks of about `pairs` comparisons at worst, the first ones small: once a dense group is joined,
    its nodes are pruned for all its members.
    """
    n = len(fps)
    if n == 2:
        return [(0, 1)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= r else []
    index, root, edges = GrayIndex(fps), np.arange(n), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lo, block = 0, 16
    while lo < n:
        asked = index.order[lo : lo + block]
        q, other = index.within(fps[asked], r, root[asked], root)
        q = asked[q]
        for a, b in zip(q.tolist(), other.tolist(), strict=True):
            a_root, b_root = find(a), find(b)
            if a_root != b_root:
                root[max(a_root, b_root)] = min(a_root, b_root)
                edges.append((a, b))
        while (root != root[root]).any():
            root = root[root]
        lo, block = lo + block, min(2 * block, max(16, pairs // n))
    return edges


KEPT = 6


def keys(fps: np.ndarray, r: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The masks of all choices of KEPT of r + KEPT blocks, and the fingerprints' bits under each."""
    edges = np.linspace(0, 64, r + KEPT + 1).round().astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = np.array([sum(blocks[i] for i in choice) for choice in combinations(range(r + KEPT), KEPT)], dtype=np.uint64)
    return masks, [fps & m for m in masks]


def links(distinct: DataFrame, r: int = 2) -> DataFrame:
    """(a, b): edges between distinct fingerprints fp that connect what all links of at most r differing bits connect."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, k in enumerate(keys(fps, r)[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, np.int32)), pa.array(k.view(np.int64)), pa.array(fps.view(np.int64))], ["choice", "key", "fp"])

    filed = distinct.select("fp").mapInArrow(file, "choice int, key long, fp long").repartition("choice", "key")
    # The count shares the exchange of what it is joined to; buckets of one go no further.
    sizes = filed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = filed.join(sizes, ["choice", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def flush():
            if len(held) and len(fps := np.concatenate(held)) > 1:
                fps = fps.view(np.uint64)
                if e := forest(fps, r):
                    a, b = np.array(e).T
                    return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])
            return None

        for batch in batches:
            choice, key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp"))
            cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if hi == lo:
                    continue
                this = (int(choice[lo]), int(key[lo]))
                if this != last:
                    if (out := flush()) is not None:
                        yield out
                    held, last = [], this
                held.append(fp[lo:hi].copy())
        if (out := flush()) is not None:
            yield out

    return buckets.drop("n").sortWithinPartitions("choice", "key").mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, r: int = 2, n: int = 3, seed: int = 42) -> DataFrame:
    """docs(doc_id, ...) without text plus fingerprint string (16 hex digits) and component_id, for every row.

    component_id is the least doc_id reachable by links of at most r differing bits, the row's own included; a null
    doc_id counts for none, and a component of nothing else has null. Texts without a word (null, empty, blanks) have
    fingerprint zero and are linked like others. Equal rows, ties and empty tables need no special case; columns
    other than text are passed on, whatever their names, and columns of the two names are replaced.
    """
    docs = docs.drop("fingerprint", "component_id")
    passed = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*passed).alias("row"), "text")
    rows = stage_table(fingerprints(packed, n, seed).select("row", F.col(FP).alias("fp")), "fingerprints")
    # One row for each distinct fingerprint: exact copies are summed up before anything is compared.
    least = rows.groupBy("fp").agg(F.min("row.doc_id").alias("least"))
    nodes = components(links(least.select("fp"), r))
    ids = least.join(nodes, least.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # The least id of a component is summed by its root, then given to each fingerprint.
    of_root = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = ids.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    out = rows.join(by_fp, "fp")
    return out.select(*[F.col("row")[c].alias(c) for c in passed], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
