"""WARC archives and their merged index.

Writing: each page is one record; of pages with equal payloads the one of the largest id is a response, the others
are revisits that name it. Records go out as rows of Spark's own committing text writer, so archives are standard .warc
(or .warc.gz, a gzip member for each record) files on any file system.

Reading: archives are read whole and parsed record by record. Each file's captures, sorted by URL key and timestamp, are
one run; runs are written down. They are then dealt by ranges of (URL key, timestamp, id, run, place) of a bounded number
of captures, so one hot URL can be spread over many tasks, and in each range a loser tree merges the runs, k at once.
Runs stay in Arrow's form there, and a cursor on each decodes a block of it at a time. What a history has before its range
begins is carried over from the last capture of the range before.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_path, stage_table

END = "\r\n\r\n"
#: The last byte of a gzip member is the top byte of its data's length, 0 below this. The writer ends each row with it.
_MEMBER, _TOP = 1 << 24, "\0"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query, in lower case: pages of a site lie together."""
    try:
        u = urlsplit((url or "").strip().lower())
        host = u.hostname or ""
    except ValueError:
        return (url or "").strip().lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (u.path.rstrip("/") or "/") + (f"?{u.query}" if u.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def resolved(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload, sha and keeper, the id of the page whose record is the response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha2("html", 256))
    keepers = rows.groupBy("sha").agg(F.max("page_id").alias("keeper"))
    return rows.join(keepers, "sha")


def members(record: bytes) -> bytes:
    """A record as a gzip member; one of 16 MB or more as several, since those are read as one."""
    out = b""
    for lo in range(0, len(record), _MEMBER - 1):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.compress(record[lo : lo + _MEMBER - 1]) + z.flush()
    return out


def records(pages: DataFrame, least: int = 0, epoch: int = 1_577_836_800, compress: bool = False) -> DataFrame:
    """(record binary): each page's record without what write() ends it with: the closing blank line, or a member's last byte.

    Payloads shorter than `least` bytes are always responses. Pages have no time of their own: the capture time is
    `epoch` plus the id in seconds, modulo ten years; a null id counts as 0 there, and such pages are responses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import UTC, datetime

        for b in batches:
            for lo in range(0, b.num_rows, 128):
                out = []
                for page, url, html, keeper in zip(*[b.slice(lo, 128).column(c).to_pylist() for c in ("page_id", "url", "html", "keeper")], strict=True):
                    body = html.encode("utf-8", "replace")
                    digest, when = base32_sha1(body), datetime.fromtimestamp(epoch + (page or 0) % 315_360_000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
                    revisit = page is not None and keeper is not None and page != keeper and len(body) >= least
                    safe = "".join(c for c in url or "" if c >= " ")
                    head = [
                        "WARC/1.1",
                        f"WARC-Type: {'revisit' if revisit else 'response'}",
                        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
                        f"WARC-Date: {when}",
                        f"WARC-Payload-Digest: sha1:{digest}",
                        f"X-Payload-Length: {len(body)}",
                    ]
                    head += [f"WARC-Target-URI: {safe}"] * (url is not None)
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{keeper}>"] * revisit
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"Content-Length: {len(body)}\r\n".encode() if not revisit else b"") + b"\r\n"
                    block = http if revisit else http + body
                    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
                    raw = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block
                    out.append(members(raw + END.encode())[:-1] if compress else raw)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return resolved(pages).select("page_id", "url", "html", "keeper").mapInArrow(run, "record binary")


def archives(pages: DataFrame, size: int = 24 << 20) -> int:
    """How many files to write: of about `size` bytes of payload each, which bounds what a task reads at once."""
    total = pages.agg(F.sum(F.octet_length("html").cast("long")).alias("n")).first()["n"] or 0
    return 1 + total // size


def write(pages: DataFrame, path: str, compression: str = "gzip", per_file: int = 5000) -> None:
    """Archives under path, of at most per_file records each; compression gzip or none."""
    compress = compression == "gzip"
    # Text columns may hold any bytes; the writer puts them out as they are.
    lines = records(pages, compress=compress).coalesce(archives(pages)).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", _TOP if compress else END).option("maxRecordsPerFile", per_file).text(path)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the loser of their match, so a next item costs one path of matches."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node, winner = (w + self.k) // 2, w
            while node:
                if self._beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def _plain(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of an archive's compressed parts, or of the whole of a plain one."""
    if raw[:2] != b"\x1f\x8b":
        yield 0, len(raw), raw
        return
    p, view = 0, memoryview(raw)
    while p < len(raw):
        z, q, data = zlib.decompressobj(31), p, []
        # What follows the member is copied by the decompressor, so it gets little at a time.
        while not z.eof:
            if q >= len(raw):
                raise ValueError(f"the member at byte {p} is cut short")
            data.append(z.decompress(view[q : q + 16384]))
            q += 16384
        n = min(q, len(raw)) - p - len(z.unused_data)
        yield p, n, b"".join(data)
        p += n


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields in lower case, block, offset, length in the file) of each record of an archive.

    Archives may be plain or gzip'd; a record may be one member or several, or many may be in one, which is then the
    place of them all. Only the records of one member are held at a time.
    """
    held, at = b"", 0
    for offset, n, data in _plain(raw):
        if not held:
            at = offset
        held, p = held + data if held else data, 0
        compressed = n != len(raw) or data is not raw
        while p < len(held):
            if not held.startswith(b"WARC/", p):
                raise ValueError(f"no record at byte {at + p}")
            end = held.find(b"\r\n\r\n", p)
            if end < 0:
                break
            fields = {}
            for line in held[p:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
            start = end + 4
            stop = start + int(fields["content-length"])
            if len(held) < stop + 4:
                break
            if held[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {at + p} does not end where its length says")
            yield fields, held[start:stop], *((at, offset + n - at) if compressed else (p, stop + 4 - p))
            p = stop + 4
        held = held[p:]
    if held:
        raise ValueError(f"the record at byte {at} is cut short")


def fetch(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The first record of the bytes that an index entry's offset and length point at."""
    fields, block, *_ = next(parse(raw))
    return fields, block


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


_ENTRY = "url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


def _order(row: tuple) -> tuple:
    """(URL key, timestamp, id): null ids first."""
    return row[0], row[1], row[2] is not None, row[2] or 0


def _batch(rows: list[tuple], *more: pa.Array, names: tuple = ()) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], *more], [*_NAMES, *names])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The sorted captures of each archive, with the record's file, offset and length, and their place in the run (seq).

    A response's length and digest are computed from its payload, and must be those its header states; a revisit's
    are those of its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                out = []
                for f, block, offset, n in parse(raw.as_py()):
                    length, digest = int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response":
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        if (len(body), base32_sha1(body)) != (length, digest):
                            raise ValueError(f"{f['warc-record-id']}: the payload is not what its header says")
                    url = f.get("warc-target-uri")
                    out.append((url_key(url), f["warc-date"], _page(f["warc-record-id"]), url, length, digest, f["warc-type"], _page(f.get("warc-refers-to")), name, offset, n))
                out.sort(key=lambda x: (_order(x), x[9]))
                for lo in range(0, len(out), 4096):
                    part = out[lo : lo + 4096]
                    yield _batch(part, pa.array(range(lo, lo + len(part)), pa.int64()), names=("seq",))

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    return stage_table(files.mapInArrow(read, f"{_ENTRY}, seq long"), "runs")


def cursor(parts: list[pa.RecordBatch], block: int = 1024) -> Iterator[tuple]:
    """The rows of one run, of which a block at a time is decoded."""
    for part in parts:
        for lo in range(0, part.num_rows, block):
            s = part.slice(lo, block)
            yield from zip(*[s.column(i).to_pylist() for i in range(len(_KINDS))], strict=True)


def merged(index: DataFrame, per_range: int = 200_000) -> DataFrame:
    """One table of captures in global order of (url_key, ts, page_id); `previous` is the timestamp before in the same history."""
    total = index.count()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            files = b.column("file").to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    held.setdefault(files[lo], []).append(b.slice(lo, hi - lo))
        # Rows come sorted by (file, seq), so each list is a run as its archive had it.
        keyed = [(((_order(r), n), r) for r in cursor(parts)) for n, (_, parts) in enumerate(sorted(held.items()))]
        part, out, last, place = TaskContext.get().partitionId(), [], (None, None), 0

        def flush() -> pa.RecordBatch:
            rows = [r for r, _ in out]
            places = pa.array(range(place - len(out), place), pa.int64())
            return _batch(rows, pa.array([p for _, p in out], pa.string()), pa.array([part] * len(out), pa.int32()), places, names=("previous", "part", "place"))

        for _, row in LoserTree(keyed):
            out.append((row, last[1] if last[0] == row[0] else None))
            last, place = (row[0], row[1]), place + 1
            if len(out) == 4096:
                yield flush()
                out = []
        if out:
            yield flush()

    dealt = index.repartitionByRange(1 + total // per_range, "url_key", "ts", "page_id", "file", "seq").sortWithinPartitions("file", "seq")
    found = stage_table(dealt.mapInArrow(merge, f"{_ENTRY}, previous string, part int, place long"), "merged")
    # One row for each range: the capture that the first of the next one follows.
    ends = found.groupBy("part").agg(F.max_by(F.struct("url_key", "ts"), "place").alias("end"))
    ends = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("end"))
    carried = F.when((F.col("place") == 0) & (F.col("end.url_key") == F.col("url_key")), F.col("end.ts")).otherwise(F.col("previous"))
    return found.join(F.broadcast(ends), "part").withColumn("previous", carried).orderBy("part", "place").drop("part", "place", "end")


def archive(pages: DataFrame, path: str | None = None, compression: str = "gzip") -> DataFrame:
    """Writes pages(page_id, url, html) as archives (in the shared folder unless a path is given), reads them back, and returns their merged index.

    A null html is an empty payload, a null url an empty key; a null page_id is passed on and is never referred to;
    rows of one id and payload are all responses if theirs is the largest id, else all revisits (their records share
    their id and are told apart by file and offset). An empty table gives an empty index. Other columns are ignored.
    """
    path = path or stage_path(pages.sparkSession, "warc")
    write(pages, path, compression)
    return merged(runs(pages.sparkSession, path))
