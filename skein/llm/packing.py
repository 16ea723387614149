"""Packing by concatenate and cut.

Pass one tokenizes each text once and writes its ids, with the number of tokens before it in its partition, to the
shared folder. Partition totals (one small row each) are summed into each partition's place in the whole
concatenation. Pass two reads the ids and cuts them at multiples of the window; a document across a border gives a
record on either side. Nothing is shuffled but the partition totals, and no task holds more than a batch.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Letters, digits and spaces below U+0180, as the tokenizer's own splitting has them; other texts go to it whole.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = " \t-\r\x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: \x1c-\x1f are left to the tokenizer, and so is all above U+017F but the usual quotes and dashes.
_PLAIN = re.compile("[\x00-\x1b\x20-ſ‐-‧‰-⁞€]*")


class Pieces(dict):
    """From a piece of text to its ids as little-endian uint32 bytes.

    Byte-level BPE never merges across pieces, so the ids of a text are those of its pieces. Pieces met for the
    first time go to a merger of bytes by rank, made from the tokenizer's own vocabulary where its merges stand in
    the order of their ids, else to the tokenizer. The memory is bounded: beyond `most` pieces it is emptied.
    """

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            #: Texts that have one of these go to the tokenizer, which gives it the id of its own.
            self.added = [t["content"] for t in json.load(f).get("added_tokens", ())]
        self.most = most
        self.merge = self._by_rank(path)

    @staticmethod
    def _by_rank(path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"].get("".join(p), -1) for p in pairs]
        if made != sorted(made) or -1 in made or len(set(made)) < len(made) or min(made, default=0) < 256:
            return None
        import tiktoken

        top = max(made, default=255)
        # The public byte-to-letter table of byte-level BPE: printable bytes stand for themselves, others follow U+0100.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if all(c in letter for c in t) and i <= top}
        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.ids(piece) if self.merge is None else array("I", self.merge(piece.encode())).tobytes()
        self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return self.ids(text)
        return b"".join([self[p] for p in _PIECE.findall(text)])


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """One for all tasks of a worker process."""
    return Pieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs: DataFrame, path: str | None = None, end: int = 0) -> DataFrame:
    """(doc_id, part, before, n, ids): ids are uint16 bytes where all fit, `end` closes each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, before = pieces_of(path or default_path()), 0
        part, close = TaskContext.get().partitionId(), np.array([end], dtype="<u4").tobytes()
        wide = pieces.tokenizer.get_vocab_size() > 65536 or end > 65535
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                ids, n, at = [], [], []
                for t in s.column("text").to_pylist():
                    got = np.frombuffer(pieces.encode(t) + close, dtype="<u4")
                    ids.append((got if wide else got.astype("<u2")).tobytes())
                    n.append(len(got))
                    at.append(before)
                    before += len(got)
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([part] * s.num_rows, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array([4 if wide else 2] * s.num_rows, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "part", "before", "n", "width", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, part int, before long, n long, width int, ids binary")


def pack(docs: DataFrame, window: int = 1024, path: str | None = None, end: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if keep_ids.

    Every row of docs(doc_id, text) is packed, repeated ones each for itself; a null text is an empty one, which is
    its end token alone; a null doc_id is passed on; an empty table gives no piece; other columns are ignored. All
    sequences but the last are full.
    """
    stored = stage_table(tokens(docs, path, end), "tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row of two longs for each task of pass one, which is no more than the driver keeps of every task anyway.
    base = stored.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = stored.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "width", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                at, row, start, length, crc, kept = s.column("at").to_pylist(), [], [], [], [], []
                for i, (a, w, ids) in enumerate(zip(at, s.column("width").to_pylist(), s.column("ids"), strict=True)):
                    x = np.frombuffer(ids.as_buffer(), dtype=f"<u{w}").astype("<u4")
                    p = 0
                    while p < len(x):
                        q = min(len(x), p + window - (a + p) % window)
                        raw = x[p:q].tobytes()
                        row.append(i)
                        start.append(p)
                        length.append(q - p)
                        crc.append(zlib.crc32(raw))
                        if keep_ids:
                            kept.append(raw)
                        p = q
                row, start = pa.array(row, pa.int64()), np.array(start, dtype=np.int64)
                where = s.column("at").take(row).to_numpy(zero_copy_only=False) + start
                columns = [s.column("doc_id").take(row), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), s.column("n").take(row), pa.array(where // window), pa.array(where % window)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids)


assert sys.byteorder == "little"
