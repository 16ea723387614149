"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every magic number in a run of bytes at once. A format's validator then confirms, at
each place found, that headers, lengths and checks agree, and says how long the medium is. What is confirmed at the
start decides the column's type, whatever was declared; what is confirmed further on is carved out as an embedded
medium, unless it lies within one already taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = 192


def _png(b: memoryview, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or (first and n != 13):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at if n == 0 else 0
    return 0


def _riff(form: bytes, needed: bytes) -> Callable[[memoryview, int], int]:
    def check(b: memoryview, at: int) -> int:
        if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) != form:
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        p, seen = at + 12, False
        if end > len(b):
            return 0
        while p + 8 <= end:
            kind, n = struct.unpack_from("<4sI", b, p)
            seen |= kind == needed
            p += 8 + n + n % 2
        return end - at if seen and p in (end, end + 1) else 0

    return check


def _bmp(b: memoryview, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, start, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or header < 40 or start < 14 + header or depth not in (1, 4, 8, 16, 24, 32) or not 0 < width or not height:
        return 0
    body = (width * depth + 31) // 32 * 4 * abs(height)
    compressed = struct.unpack_from("<I", b, at + 30)[0]
    return size if at + size <= len(b) and (compressed or start + body <= size) and start < size else 0


def _gif(b: memoryview, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if images else 0
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 128 else 0))
            images += 1
        else:
            return 0
    return 0


def _jpeg(b: memoryview, at: int) -> int:
    p, scan = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at if scan else 0
        if kind == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            return 0
        p += 2 + n
        if kind == 0xDA:
            scan = True
            while p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] not in (0, *range(0xD0, 0xD8))):
                p += 1
    return p + 2 - at if scan and p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] == 0xD9 else 0


def _pdf(b: memoryview, at: int) -> int:
    raw = b.obj if isinstance(b.obj, bytes) and len(b.obj) == len(b) else bytes(b)
    if not raw[at + 5 : at + 8].replace(b".", b"").isdigit():
        return 0
    # A file that was updated has several ends; the last one before another file's head is its own.
    following = raw.find(b"%PDF-", at + 5)
    end = raw.rfind(b"%%EOF", at, len(raw) if following < 0 else following)
    return end + 5 - at if end > 0 and raw.find(b"startxref", at, end) >= 0 else 0


def _gzip(b: memoryview, at: int) -> int:
    z = zlib.decompressobj(31)
    p = at
    try:
        while p < len(b) and not z.eof:
            z.decompress(b[p : p + 65536], 1 << 20)
            while z.unconsumed_tail and not z.eof:
                z.decompress(z.unconsumed_tail, 1 << 20)
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(z.unused_data) - at if z.eof else 0


@dataclass(frozen=True)
class Format:
    name: str
    media_type: str
    magic: bytes
    length: Callable[[memoryview, int], int]


FORMATS = (
    Format("png", "image/png", b"\x89PNG\r\n\x1a\n", _png),
    Format("wav", "audio/wav", b"RIFF", _riff(b"WAVE", b"data")),
    Format("webp", "image/webp", b"RIFF", _riff(b"WEBP", b"VP8 ")),
    Format("bmp", "image/bmp", b"BM", _bmp),
    Format("gif", "image/gif", b"GIF87a", _gif),
    Format("gif", "image/gif", b"GIF89a", _gif),
    Format("jpeg", "image/jpeg", b"\xff\xd8\xff", _jpeg),
    Format("pdf", "application/pdf", b"%PDF-", _pdf),
    Format("gzip", "application/gzip", b"\x1f\x8b\x08", _gzip),
)


class Sniffer:
    def __init__(self, formats: tuple[Format, ...] = FORMATS):
        self.automaton = ahocorasick.Automaton()
        by_magic: dict[str, list[Format]] = {}
        for f in formats:
            by_magic.setdefault(f.magic.decode("latin-1"), []).append(f)
        for magic, fs in by_magic.items():
            self.automaton.add_word(magic, (len(magic), fs))
        self.automaton.make_automaton()

    def find(self, data: bytes) -> list[tuple[int, int, Format]]:
        """(offset, length, format) of confirmed media, in order, none within another."""
        view, out, free = memoryview(data), [], 0
        for last, (n, formats) in self.automaton.iter(data.decode("latin-1")):
            at = last - n + 1
            if at < free:
                continue
            for f in formats:
                if size := f.length(view, at):
                    out.append((at, size, f))
                    free = at + size
                    break
        return out

    def sniff(self, data: bytes, declared: str | None = None) -> dict:
        """The type confirmed at byte 0, or else none; whether that corrects the declared type; and embedded media."""
        found = self.find(data)
        first = found[0] if found and found[0][0] == 0 else None
        kind = first[2].media_type if first else "application/octet-stream"
        return {"media_type": kind, "format": first[2].name if first else None, "length": first[1] if first else 0, "corrected": declared != kind, "embedded": [(a, n, f.media_type) for a, n, f in found if a]}


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """One channel of 8-bit samples; an odd number gets the chunk's padding byte."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def wav_samples(data: bytes) -> bytes:
    p = 12
    while p + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, p)
        if kind == b"data":
            return data[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def to_png(samples: bytes, level: int = 1) -> bytes:
    """Rows of 64 RGB pixels, so whole multiples of 192 bytes, none filtered."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def png_samples(data: bytes) -> bytes:
    p, body = 8, b""
    while p + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, p)
        if kind == b"IDAT":
            body += data[p + 8 : p + 8 + n]
        p += 12 + n
    return np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(-1, ROW + 1)[:, 1:].tobytes()


WRITE = {"wav": to_wav, "png": to_png}
READ = {"wav": wav_samples, "png": png_samples}


def payload(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "replace")
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw)), len(raw)


def encode(docs: DataFrame, form: str = "wav") -> DataFrame:
    """(doc_id, n_bytes, declared, media) with the media column in format wav or png, for every row of docs(doc_id, text).

    The declared type is always application/octet-stream: readers have to sniff. A null text is the empty one, which
    is one row of blanks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                made = [payload(t.as_py() or "") for t in s.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array(["application/octet-stream"] * len(made)), pa.array([WRITE[form](p) for p, _ in made], pa.binary())],
                    ["doc_id", "n_bytes", "declared", "media"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, declared string, media binary")


def describe(media: DataFrame, carve: bool = False) -> DataFrame:
    """Reads the media column back: digests and features of its payload, its confirmed type, and embedded media.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    media_type, corrected, embedded (array of offset, length, media_type, and with `carve` the bytes). Media without
    a confirmed format, or of one that isn't read here, are their own payload. Null media count as empty.
    """
    inner = "offset: bigint, length: bigint, media_type: string" + ", bytes: binary" * carve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                rows = []
                for declared, m in zip(s.column("declared").to_pylist(), s.column("media"), strict=True):
                    m = m.as_py() or b""
                    seen = sniffer.sniff(m, declared)
                    body = READ[seen["format"]](m[: seen["length"]]) if seen["format"] in READ else m
                    x = np.frombuffer(body, dtype=np.uint8)
                    mean, sd = (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)
                    feature = f"{seen['media_type']};mean={mean:.3f};sd={sd:.3f};crossings={int(np.count_nonzero((x[1:] > mean) != (x[:-1] > mean)))}"
                    rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, seen["media_type"], seen["corrected"], [dict(offset=a, length=n, media_type=k) | ({"bytes": m[a : a + n]} if carve else {}) for a, n, k in seen["embedded"]]))
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())] + [("bytes", pa.binary())] * carve))]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected", "embedded"]
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", F.col("declared"), "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, embedded array<struct<{inner}>>")
