"""A byte-level convolutional network in numpy that scores text quality.

The whole UTF-8 text is read. At every fourth byte, each filter adds what it has learned for the bytes of a window
of eight, and for the share of the sixteen before that recur 1 to 16 places earlier (so that it can tell repetition). The
rectified responses are max-pooled over overlapping chunks; the chunks' vectors are combined, by their maximum and
their mean, into one probability. Fitting is by Adam on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


@dataclass
class Net:
    filters: int = 16
    width: int = 8
    lags: int = 16
    chunk: int = 1024
    hop: int = 768
    seed: int = 7
    params: dict = field(default_factory=dict)
    shift: float = 0.0

    #: Places lie four bytes apart; chunks are made of units of 64 places, the overlap of two.
    STEP, UNIT, BLOCK = 4, 64, 64 * 3 * 64

    def __post_init__(self):
        unit = self.STEP * self.UNIT
        if self.chunk % unit or self.hop % unit or self.hop > self.chunk or (self.BLOCK // self.UNIT) % (self.hop // unit):
            raise ValueError("chunk and hop are multiples of 256 bytes, the hop no more than the chunk")
        if not self.params:
            r = np.random.default_rng(self.seed)
            f = self.filters
            self.params = {
                "table": r.normal(0, 0.2, (self.width, 256, f)),
                "lag": r.normal(0, 0.3, (self.lags, f)),
                "bias": np.zeros(f),
                "out": r.normal(0, 0.2, 2 * f),
                "out_bias": np.zeros(1),
            }
            self.params = {k: v.astype(np.float32) for k, v in self.params.items()}

    @property
    def lead(self) -> int:
        return -(-(self.lags + 16) // self.STEP) * self.STEP

    def pad(self, text: str) -> tuple[np.ndarray, int]:
        raw = text.encode("utf-8", "replace")
        units = max(1, -(-len(raw) // (self.STEP * self.UNIT)))
        x = np.zeros(self.lead + units * self.STEP * self.UNIT + self.width, dtype=np.uint8)
        # Outside the text stand bytes that do not recur nearby, so that its ends are not taken for repetition.
        x[:] = 128 + np.arange(len(x)) % 64
        x[self.lead : self.lead + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        return x, units

    def recurrence(self, x: np.ndarray, lo: int, n: int) -> np.ndarray:
        """For n places from byte lo of padded x: the share of the sixteen bytes before each that recur at each lag."""
        first = lo - 16
        now = x[first : first + 4 * (n + 3)]
        out = np.empty((self.lags, n), dtype=np.float32)
        for d in range(1, self.lags + 1):
            four = np.bitwise_count((now == x[first - d : first - d + len(now)]).view(np.uint32))
            out[d - 1] = four[:-3] + four[1:-2] + four[2:-1] + four[3:]
        return out.T * np.float32(1 / 16)

    def responses(self, x: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Recurrence and filter responses at n places from place `start` of padded x."""
        p, lo = self.params, self.lead + start * self.STEP
        rec = self.recurrence(x, lo, n)
        z = rec @ p["lag"] + p["bias"]
        for j in range(self.width):
            z += p["table"][j].take(x[lo + j : lo + j + n * self.STEP : self.STEP], axis=0)
        return rec, z

    def chunks(self, text: str, trace: bool = False):
        """The pooled vector of each chunk; with trace, also the padded bytes, and each maximum's place and recurrence."""
        x, units = self.pad(text)
        tops, places, recs = [], [], []
        cols = np.arange(self.filters)
        for start in range(0, units * self.UNIT, self.BLOCK):
            n = min(self.BLOCK, units * self.UNIT - start)
            rec, z = self.responses(x, start, n)
            if trace:
                k = z.reshape(-1, self.UNIT, self.filters).argmax(axis=1) + np.arange(0, n, self.UNIT)[:, None]
                tops.append(z[k, cols])
                places.append(start + k)
                recs.append(rec[k])
            else:
                tops.append(z.reshape(-1, self.UNIT, self.filters).max(axis=1))
        tops = np.concatenate(tops)
        wide, hop = self.chunk // (self.STEP * self.UNIT), self.hop // (self.STEP * self.UNIT)
        starts = np.arange(0, max(1, units - (wide - hop)), hop)
        member = np.minimum(starts[:, None] + np.arange(wide), units - 1)
        pooled = np.maximum(tops[member].max(axis=1), 0)
        if not trace:
            return pooled
        best = np.take_along_axis(member, tops[member].argmax(axis=1), axis=1)
        return pooled, x, np.concatenate(places)[best, cols], np.concatenate(recs)[best, cols]

    def logit(self, pooled: np.ndarray) -> float:
        v = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)])
        return float(v @ self.params["out"] + self.params["out_bias"][0])

    def score(self, text: str) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.logit(self.chunks(text)) + self.shift, -30, 30))))

    def gradient(self, text: str, y: int) -> dict:
        pooled, x, places, recs = self.chunks(text, trace=True)
        p, f, c = self.params, self.filters, len(pooled)
        top = pooled.argmax(axis=0)
        v = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)])
        err = 1 / (1 + np.exp(-np.clip(v @ p["out"] + p["out_bias"][0], -30, 30))) - y
        g = {k: np.zeros_like(a) for k, a in p.items() if k != "table"} | {"table": None}
        g["out"], g["out_bias"] = err * v, np.array([err], dtype=np.float32)
        d = np.tile(err * p["out"][f:] / c, (c, 1))
        d[top, np.arange(f)] += err * p["out"][:f]
        d *= pooled > 0
        g["bias"] = d.sum(axis=0)
        g["lag"] = np.einsum("cf,cfl->lf", d, recs)
        rows = [(x[self.lead + places * self.STEP + j], d) for j in range(self.width)]
        g["table"] = rows
        return g

    def fit(self, sample: list[tuple[str, int]], epochs: int = 8, batch: int = 16, rate: float = 0.01, prior: float | None = None) -> Net:
        """Adam on the sample; prior, if given, is the share of label 1 outside it, to which scores are shifted."""
        if not sample or len({y for _, y in sample}) < 2:
            self.params["out"][:] = 0
            share = prior if prior is not None else (sample[0][1] if sample else 0.5)
            self.shift = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
            return self
        r = np.random.default_rng(self.seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.params.items()}, {k: np.zeros_like(a) for k, a in self.params.items()}, 0
        cols = np.arange(self.filters)
        for _ in range(epochs):
            order = r.permutation(len(sample))
            for lo in range(0, len(order), batch):
                total = {k: np.zeros_like(a) for k, a in self.params.items()}
                part = order[lo : lo + batch]
                for i in part:
                    g = self.gradient(*sample[i])
                    for k in total:
                        if k == "table":
                            for j, (b, d) in enumerate(g[k]):
                                np.add.at(total[k][j], (b, cols[None, :]), d)
                        else:
                            total[k] += g[k]
                step += 1
                for k, a in self.params.items():
                    grad = total[k] / len(part) + 1e-4 * a
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.99 * v[k] + 0.01 * grad * grad
                    a -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if prior is not None:
            mean = np.mean([y for _, y in sample])
            self.shift = float(np.log((prior + 1e-3) / (1 - prior + 1e-3)) - np.log(mean / (1 - mean)))
        return self


def score(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """docs plus score double and predicted int, for every row; a null text is scored as the empty one.

    Repeated rows stay repeated, an empty table gives an empty result, and columns of those two names are replaced.
    """
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [net.score(t.as_py() or "") for t in b.column(b.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())])).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def label_share(labels: DataFrame, label: str) -> float | None:
    """The share of label 1 among rows with that label: one number."""
    return labels.agg(F.avg(F.col(label).cast("double")).alias("m")).first()["m"]
