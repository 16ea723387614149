"""Suffix-array dedup: maximal repeats from the interval tree of common prefixes.

The corpus is cut so that no suffix array spans more than a handful of texts, and none misses a repeat. Every window
of `least` bytes belongs to its anchor, the k-byte string of least hash in it; equal windows have equal anchors. The
windows of one place of an anchor, all consecutive, are a cell: cells of the same anchor are all that can share a
window. So

1. each distinct text is cut into cells (anchor hash, content hash, start), by rolling hashes in numpy;
2. cells whose anchor stands nowhere else are dropped; equal cells are summed up before their bytes are touched;
3. for each anchor, the distinct cells' suffixes are sorted, their common prefixes computed, and one stack scan
   walks the tree of intervals of common prefixes. An interval of at least `least` bytes whose suffixes are preceded
   by different bytes is a maximal repeat; all places in it are its occurrences;
4. occurrences are carried from cells to all texts that hold the cell, and overlapping ones are merged.

Exact copies of a text are one text with a count; a text with a count over 1 is a repeat as a whole. Anchors with
more than `most` distinct cells are not put before one task: their windows are counted one by one by a 128-bit hash,
with the same result.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, stage_table

_TABLE = np.frombuffer(hashlib.shake_256(b"bytes").digest(256 * 8), dtype="<u8")
_ODD = np.frombuffer(hashlib.shake_256(b"levels").digest(8 * 8), dtype="<u8") | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Windows handled at once; their places fit the low bits beside a hash.
_BLOCK, _PLACE = 1 << 16, np.uint64((1 << 17) - 1)


def cells(data: bytes, least: int = 200, k: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, anchor hash) of each cell, in order. k is a power of two below `least`."""
    n = len(data) - least + 1
    w = least - k + 1
    starts, counts, anchors = [], [], []
    raw = np.frombuffer(data, dtype=np.uint8)
    for lo in range(0, max(n, 0), _BLOCK):
        hi = min(n, lo + _BLOCK)
        h = _TABLE[raw[lo : hi + least - 1]]
        m, level = 1, 0
        while m < k:
            h = h[:-m] * _ODD[level] + h[m:]
            m, level = 2 * m, level + 1
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        least_yet = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        m = 1
        while 2 * m <= w:
            least_yet = np.minimum(least_yet[:-m], least_yet[m:])
            m *= 2
        if m < w:
            least_yet = np.minimum(least_yet[: -(w - m)], least_yet[w - m :])
        place = (least_yet & _PLACE).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        starts.append(lo + cut)
        counts.append(np.diff(np.append(cut, len(place))))
        anchors.append(h[place[cut]].view(np.int64))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(anchors)


def window_hashes(x: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of x[i : i + length] for every i at which that many bytes follow."""
    h, m, level, out, done = _TABLE[x], 1, 0, None, 0
    n = len(x) - length + 1
    while True:
        if length & m:
            part = h[done : done + n]
            out = part.copy() if out is None else out * _ODD[7 - level % 8] + part
            done += m
        if 2 * m > length:
            return out
        h = h[:-m] * _ODD[level % 8] + h[m:]
        m, level = 2 * m, level + 1


def common_prefix(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from a and from b on, at most `most`, pair by pair."""
    out = np.zeros(len(a), dtype=np.int64)
    open_, step = np.arange(len(a)), 64
    while len(open_):
        i, j = a[open_] + out[open_], b[open_] + out[open_]
        room = most[open_] - out[open_]
        k = np.arange(step)
        inside = k[None, :] < room[:, None]
        same = (x[np.minimum(i[:, None] + k, len(x) - 1)] == x[np.minimum(j[:, None] + k, len(x) - 1)]) & inside
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        out[open_] += run
        open_ = open_[(run == step) & (room > step)]
    return out


def maximal_repeats(strings: list[bytes], weights: list[int] | None = None, least: int = 200, chunk: int = 20_000) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """Groups (group, parent or -1, length, [(string, offset)]).

    A group lists the occurrences that lie in no longer group of the same start; those of its descendants are its
    own too. A string of weight over 1 stands for so many equal ones, and is a repeat as a whole.

    The suffix array holds the suffixes of `least` bytes or more whose first `least` bytes occur twice and are not
    all preceded by the same byte: only below such a prefix can an interval be a maximal repeat. Prefixes are sorted
    out by hash, then suffixes in order of their bytes, some `chunk` at a time.
    """
    weights = weights or [1] * len(strings)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    groups: list[tuple[int, int, int, list[tuple[int, int]]]] = []
    for i, w in enumerate(weights):
        if w > 1 and lengths[i] >= least:
            groups.append((len(groups), -1, int(lengths[i]), [(i, 0)]))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = np.frombuffer(b"".join(strings), dtype=np.uint8)
    counts = np.maximum(lengths - least + 1, 0)
    if counts.sum() < 2:
        return groups
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
    h = window_hashes(x, least)[at]
    by_hash = np.argsort(h, kind="stable")
    at, h = at[by_hash], h[by_hash]
    cut = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    owner = np.searchsorted(begins, at, side="right") - 1
    # Strings without a byte share their begin with the next; those have no suffix here.
    offset = at - begins[owner]
    left = np.where(offset > 0, x[np.maximum(at - 1, 0)].astype(np.int64), -2)  # -2: nothing known before it, which differs from all
    many = np.diff(np.append(cut, len(at)))
    differ = (np.minimum.reduceat(left, cut) != np.maximum.reduceat(left, cut)) | (np.minimum.reduceat(left, cut) == -2)
    wanted = np.repeat((many > 1) & differ, many)
    at, h, owner, offset, left = at[wanted], h[wanted], owner[wanted], offset[wanted], left[wanted]
    if not len(at):
        return groups
    edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(at)]])
    rest = lengths[owner] - offset
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + chunk, side="right")) - 1)
        a, b = int(edges[lo]), int(edges[hi])
        suffixes = [strings[i][o:] for i, o in zip(owner[a:b].tolist(), offset[a:b].tolist(), strict=True)]
        order = np.array(sorted(range(b - a), key=suffixes.__getitem__), dtype=np.int64) + a
        del suffixes
        lcp = np.zeros(b - a, dtype=np.int64)
        for k in range(0, b - a - 1, 8192):
            p, q = order[k : min(k + 8192, b - a - 1)], order[k + 1 : k + 1 + min(8192, b - a - 1 - k)]
            lcp[k + 1 : k + 1 + len(p)] = common_prefix(x, at[p], at[q], np.minimum(rest[p], rest[q]))
        scan(lcp, owner[order].tolist(), offset[order].tolist(), left[order].tolist(), least, groups)
        lo = hi
    return groups


def scan(lcp: np.ndarray, who: list[int], off: list[int], before: list[int], least: int, groups: list) -> None:
    """One stack scan of an enhanced suffix array; adds its maximal repeats to groups."""
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    # Runs of neighbours with a long common prefix; each is a tree of its own.
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1):
        lo, hi = int(run[0]) - 1, int(run[-1])
        depth = lcp[lo + 1 : hi + 1].tolist() + [0]
        # Stack of open intervals: depth, preceding byte of all (-2: they differ), occurrences not yet in a group, groups below.
        stack: list[list] = []
        leaf = lo
        for d in depth:
            carry_left, carry, below = before[leaf], [(who[leaf], off[leaf])], []
            while stack and stack[-1][0] > d:
                top = stack.pop()
                same = top[1] if top[1] == carry_left else -2
                top[2].extend(carry)
                top[3].extend(below)
                carry_left, carry, below = same, top[2], top[3]
                if same == -2:
                    g = len(groups)
                    groups.append((g, -1, top[0], carry))
                    for c in below:
                        groups[c] = (c, g, groups[c][2], groups[c][3])
                    carry, below = [], [g]
            if d >= least:
                if stack and stack[-1][0] == d:
                    top = stack[-1]
                    top[1] = top[1] if top[1] == carry_left else -2
                    top[2].extend(carry)
                    top[3].extend(below)
                else:
                    stack.append([d, carry_left, carry, below])
            leaf += 1


def _binary(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return df.withColumn("_bytes", text).withColumn("tid", F.substring(F.unhex(F.sha2("_bytes", 256)), 1, 16))


def cell_table(texts: DataFrame, least: int, k: int) -> DataFrame:
    """(h, c, n, tid, start, more): cells of texts(tid, _bytes); equal cells of one text share a row.

    A text met again in the same task is passed over (the last 50,000 are remembered); across tasks it is not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, None] = OrderedDict()
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                s = b.slice(lo, 64)
                out = [[], [], [], [], [], []]
                for tid, data in zip(s.column("tid").to_pylist(), s.column("_bytes"), strict=True):
                    if tid in seen:
                        continue
                    seen[tid] = None
                    if len(seen) > 50_000:
                        seen.popitem(last=False)
                    data = data.as_py()
                    start, n, h = cells(data, least, k)
                    if not len(start):
                        continue
                    c = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(start.tolist(), (start + n + least - 1).tolist(), strict=True)), np.uint64, len(start)).view(np.int64)
                    first, where = np.unique(c, return_index=True, return_inverse=True)[1:]
                    more: list = [None] * len(first)
                    if len(first) < len(c):
                        for i, f in enumerate(where.reshape(-1).tolist()):
                            if first[f] != i:
                                more[f] = (more[f] or []) + [int(start[i])]
                    out[0].append(h[first])
                    out[1].append(c[first])
                    out[2].append(n[first])
                    out[3].extend([tid] * len(first))
                    out[4].append(start[first])
                    out[5].extend(more)
                ints = [np.concatenate(out[i]) if out[i] else np.zeros(0, np.int64) for i in (0, 1, 2, 4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ints[0], pa.int64()), pa.array(ints[1], pa.int64()), pa.array(ints[2].astype(np.int32)), pa.array(out[3], pa.binary()), pa.array(ints[3].astype(np.int32)), pa.array(out[5], pa.list_(pa.int32()))],
                    ["h", "c", "n", "tid", "start", "more"],
                )

    return texts.select("tid", "_bytes").mapInArrow(run, "h long, c long, n int, tid binary, start int, more array<int>")


def shared_cells(docs: DataFrame, least: int = 200, k: int = 32) -> DataFrame:
    """Cells of docs' texts whose anchor stands at more than one place, once per text: (h, c, n, tid, start, more)."""
    cut = cell_table(_binary(docs.select("text")), least, k)
    # Anchors are counted before they are shuffled, and the join may split a hot one's cells over tasks.
    anchors = cut.groupBy("h").agg(F.count("*").alias("rows"), F.count("more").alias("again")).where("rows > 1 or again > 0").select("h")
    found = stage_table(cut.join(anchors, "h"), "cells")
    # Copies of a text that were met in different tasks.
    once = stage_table(found.groupBy("h", "c", "n", "tid").agg(F.first("start").alias("start"), F.first("more").alias("more")), "places")
    drop_tables(found)
    return once


def texts_of(docs: DataFrame) -> DataFrame:
    """(tid, _bytes): distinct texts. Each use in a query shares one exchange of them."""
    return _binary(docs.select("text")).groupBy("tid").agg(F.first("_bytes").alias("_bytes"))


def repeats(docs: DataFrame, cut: DataFrame, least: int = 200, most: int = 20_000, batch_bytes: int = 1 << 20) -> DataFrame:
    """(h, c, n, group, parent, length, off): occurrences of maximal repeats in distinct cells; group numbers are per task batch."""
    distinct = cut.groupBy("h", "c", "n").agg(F.sum(F.lit(1) + F.coalesce(F.size("more"), F.lit(0)) * F.col("more").isNotNull().cast("int")).alias("w"), F.min(F.struct("tid", "start")).alias("at"))
    groups = distinct.groupBy("h").agg(F.count("*").alias("cells"), F.sum("w").alias("places")).where("places > 1")
    wanted = distinct.join(groups, "h").select("h", "c", "n", "w", "cells", "at.tid", "at.start")
    # A text's list of wanted cells is bounded by its length.
    lists = wanted.groupBy("tid").agg(F.collect_list(F.struct("h", "c", "n", "w", "cells", "start")).alias("wanted"))
    texts = texts_of(docs)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 32):
                s = b.slice(lo, 32)
                rows, parts = [], []
                for data, items in zip(s.column("_bytes"), s.column("wanted").to_pylist(), strict=True):
                    data = data.as_py()
                    for x in items:
                        rows.append((x["h"], x["c"], x["n"], x["w"], x["cells"]))
                        parts.append(data[x["start"] : x["start"] + x["n"] + least - 1])
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)] + [pa.array(parts, pa.binary())], ["h", "c", "n", "w", "cells", "bytes"])

    held = texts.join(lists, "tid").select("_bytes", "wanted").mapInArrow(fetch, "h long, c long, n int, w long, cells long, bytes binary")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def flush(rows: list) -> pa.RecordBatch:
            nonlocal number
            out = []
            for g, parent, length, places in maximal_repeats([r[4] for r in rows], [r[3] for r in rows], least):
                out.extend((*rows[i][:3], number + g, number + parent if parent >= 0 else None, length, off) for i, off in places)
            number += 1 << 32
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], ["h", "c", "n", "group", "parent", "length", "off"])

        rows, size = [], 0
        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in ("h", "c", "n", "w", "bytes")], strict=True):
                if size > batch_bytes and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield flush(rows)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c, n, w, data in zip(*[b.column(i).to_pylist() for i in ("h", "c", "n", "w", "bytes")], strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(data[i : i + least]) for i in range(n)], pa.binary()), pa.array([h] * n), pa.array([c] * n), pa.array([n] * n, pa.int32()), pa.array([w] * n, pa.int64()), pa.array(range(n), pa.int32())],
                    ["window", "h", "c", "n", "w", "off"],
                )

    # The cells of an anchor meet in one task; those of an anchor with more than `most` are dealt by content before their bytes move.
    held = held.withColumn("part", F.when(F.col("cells") > most, F.col("c")).otherwise(F.lit(0))).repartition("h", "part").drop("part")
    inside = held.where(F.col("cells") <= most).sortWithinPartitions("h").mapInArrow(scan, "h long, c long, n int, group long, parent long, length int, off int")
    hot = held.where(F.col("cells") > most).mapInArrow(windows, "window binary, h long, c long, n int, w long, off int")
    twice = hot.groupBy("window").agg(F.sum("w").alias("places")).where("places > 1").select("window")
    outside = hot.join(twice, "window").select("h", "c", "n", F.xxhash64("window").alias("group"), F.lit(None).cast("long").alias("parent"), F.lit(least).alias("length"), "off")
    return inside.unionByName(outside)


def repeated_spans(docs: DataFrame, least: int = 200, k: int = 32, most: int = 20_000) -> DataFrame:
    """(tid, spans): for each distinct text with a repeat, its maximal runs of repeated bytes as a flat array of starts and ends."""
    cut = shared_cells(docs, least, k)
    found = repeats(docs, cut, least, most).groupBy("h", "c", "n").agg(F.collect_list(F.struct("off", "length")).alias("places"))
    starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>")))
    by_text = cut.join(found, ["h", "c", "n"]).select("tid", starts.alias("starts"), "places").groupBy("tid").agg(F.collect_list(F.struct("starts", "places")).alias("parts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts"):
                pairs = sorted({(s + p["off"], s + p["off"] + p["length"]) for x in parts.as_py() for s in x["starts"] for p in x["places"]})
                flat: list[int] = []
                for a, e in pairs:
                    if flat and a <= flat[-1]:
                        flat[-1] = max(flat[-1], e)
                    else:
                        flat += [a, e]
                out.append(flat)
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array(out, pa.list_(pa.int32()))], ["tid", "spans"])

    return by_text.mapInArrow(merge, "tid binary, spans array<int>")


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def dedup(docs: DataFrame, least: int = 200, k: int = 32, most: int = 20_000, keep_text: bool = False) -> DataFrame:
    """Every row of docs, without its text, plus n_bytes, n_removed, n_spans, kept_sha256; with keep_text also text and kept (binary).

    A byte goes if a string of `least` bytes that covers it starts anywhere else too; strings are judged on the
    input. Null texts are empty, texts shorter than `least` keep all bytes, a repeated row is a copy like any other
    (so a text of `least` bytes or more that stands in two rows loses all). doc_id is only passed on, and so are other
    columns of whatever name: they travel as one struct. Columns of the five names are replaced. An empty table gives
    an empty result.
    """
    texts = texts_of(docs)
    passed = [c for c in docs.columns if c not in ADDED and c != "text"]
    own = [c for c in docs.columns if c not in ADDED and (keep_text or c != "text")]
    spans = repeated_spans(docs, least, k, most)

    # Texts whose bytes are neither all kept nor all dropped.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                s = b.slice(lo, 64)
                removed, runs, digests, kept = [], [], [], []
                for data, at in zip(s.column("_bytes"), s.column("spans").to_pylist(), strict=True):
                    data = data.as_py()
                    edges = [0, *at, len(data)]
                    rest = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    removed.append(len(data) - len(rest))
                    runs.append(len(at) // 2)
                    digests.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest if keep_text else None)
                yield pa.RecordBatch.from_arrays([s.column("tid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["tid", "removed", "runs", "digest", "rest"])

    changed = texts.join(spans, "tid").select("tid", "_bytes", "spans").mapInArrow(cut, "tid binary, removed long, runs long, digest string, rest binary")
    rows = _binary(docs.select((F.struct(*passed) if passed else F.struct(F.lit(0))).alias("row"), "text", F.col("text").isNull().alias("none")))
    rows = rows.select("row", "none", "tid", F.octet_length("_bytes").cast("long").alias("n_bytes"), F.sha2("_bytes", 256).alias("own"))
    copies = _binary(docs.select("text")).groupBy("tid").agg(F.count("*").alias("rows")).where("rows > 1")
    out = rows.join(changed.join(copies, "tid", "full_outer"), "tid", "left")
    if keep_text:
        # Rows find their text by the exchange that distinct texts have been dealt by already.
        out = out.join(texts, "tid")
    whole = F.coalesce((F.col("rows") > 1) & (F.col("n_bytes") >= least), F.lit(False))
    results = {
        "n_bytes": F.col("n_bytes"),
        "n_removed": F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))),
        "n_spans": F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("runs", F.lit(0).cast("long"))),
        "kept_sha256": F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("digest", "own")),
    }
    if keep_text:
        results["kept"] = F.when(whole, F.lit(bytearray())).otherwise(F.when(F.col("digest").isNotNull(), F.col("rest")).otherwise(F.col("_bytes")))
    restored = F.when(F.col("none"), F.lit(None)).otherwise(F.col("_bytes").cast("string")) if keep_text else None
    return out.select(*[restored.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in own], *[c.alias(name) for name, c in results.items()])
