"""A byte-level convolutional network in numpy for the quality of texts.

A filter of width k is a table of weights by place and byte, so its response at a byte is a sum
of k table entries. A text is cut into chunks of `chunk` bytes that overlap, all of it; each
filter's largest response in a chunk goes through a rectifier and a hidden layer to the chunk's
logit, and the mean logit of the chunks gives the one probability of the text. Largest responses
are taken over blocks first, which the chunks that overlap share.

The network is fitted on the driver on a bounded, seeded sample of labelled rows: at most
`sample` texts and `pieces` chunks of each (both documented parameters); it scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import texts

BLOCK, CHUNK, STEP = 64, 512, 448  # bytes; a chunk overlaps the next by 64
SLICE = 1 << 19


def pad(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with each text from a block's start on, zeros after it; places outside the texts;
    first block of each text). An empty text has one place."""
    size = np.diff(offs)
    blocks = -(-(size + width - 1) // BLOCK)  # zeros at the end, so that no filter sees the next text
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(first[-1] * BLOCK + width, np.uint8)
    at = np.repeat(first[:-1] * BLOCK - offs[:-1], size) + np.arange(offs[0], offs[-1])
    out[at] = data[offs[0] : offs[-1]]
    outside = np.ones(len(out), bool)
    outside[at] = False
    outside[first[:-1] * BLOCK] = False
    return out, outside, first


class Network:
    def __init__(self, filters: int = 16, width: int = 6, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.width, self.filters = width, filters
        self.p = {
            "table": r.normal(0, 0.3, (width, 256, filters)), "bias": np.zeros(filters),
            "w1": r.normal(0, filters**-0.5, (filters, hidden)), "b1": np.zeros(hidden), "w2": r.normal(0, hidden**-0.5, hidden), "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def responses(self, data: np.ndarray, n: int) -> np.ndarray:
        t = self.p["table"]
        z = t[0][data[:n]]
        for k in range(1, self.width):
            z += t[k][data[k : n + k]]
        return z

    def pooled(self, data: np.ndarray, outside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest responses of each chunk, first chunk of each text)."""
        n = int(first[-1])
        tops = np.full((n + 1, self.filters), -np.inf, np.float32)
        for a in range(0, n, SLICE // BLOCK):
            b = min(n, a + SLICE // BLOCK)
            z = self.responses(data[a * BLOCK : b * BLOCK + self.width], (b - a) * BLOCK)
            z[outside[a * BLOCK : b * BLOCK]] = -np.inf
            tops[a:b] = z.reshape(b - a, BLOCK, self.filters).max(1)
        blocks = np.diff(first)
        per, step = CHUNK // BLOCK, STEP // BLOCK
        chunks = 1 + np.maximum(0, -(-(blocks - per) // step))
        at = np.concatenate(([0], np.cumsum(chunks)))
        nth = np.arange(at[-1]) - np.repeat(at[:-1], chunks)
        lo = np.repeat(first[:-1], chunks) + nth * step
        hi = np.minimum(lo + per, np.repeat(first[1:], chunks))
        ends = np.stack([lo, hi], 1).reshape(-1)
        return np.maximum.reduceat(tops, ends, axis=0)[::2], at

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        a = np.maximum(pooled + self.p["bias"], 0)
        return np.maximum(a @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"] + self.p["b2"]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if len(offs) == 1:
            return np.empty(0)
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        data, outside, first = pad(data, offs, self.width)
        pooled, at = self.pooled(data, outside, first)
        mean = np.add.reduceat(self.logits(pooled).astype(float), at[:-1]) / np.diff(at)
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))

    def fit(self, pieces: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
        """Adam on the cross entropy of chunks; the same pieces give the same network."""
        y = np.asarray(labels, np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            return self
        n = CHUNK
        data = np.zeros((len(pieces), n + self.width), np.uint8)
        real = np.zeros(len(pieces), np.int64)
        for i, x in enumerate(pieces):
            data[i, : min(len(x), n)] = np.frombuffer(x[:n], np.uint8)
            real[i] = max(1, min(len(x), n))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                j = order[i : i + batch]
                x = data[j]
                z = self.p["table"][0][x[:, :n]]
                for k in range(1, self.width):
                    z += self.p["table"][k][x[:, k : n + k]]
                z[np.arange(n)[None, :] >= real[j][:, None]] = -np.inf
                top = z.argmax(1)
                best = np.take_along_axis(z, top[:, None, :], 1)[:, 0]
                a0 = best + self.p["bias"]
                a = np.maximum(a0, 0)
                h0 = a @ self.p["w1"] + self.p["b1"]
                h = np.maximum(h0, 0)
                out = h @ self.p["w2"] + self.p["b2"]
                d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[j]) / len(j)
                dh = np.outer(d, self.p["w2"]) * (h0 > 0)
                da = (dh @ self.p["w1"].T) * (a0 > 0)
                g = {"w2": h.T @ d, "b2": d.sum(keepdims=True), "w1": a.T @ dh, "b1": dh.sum(0), "bias": da.sum(0), "table": np.zeros_like(self.p["table"])}
                f = np.broadcast_to(np.arange(self.filters), top.shape)
                rows = np.arange(len(j))[:, None]
                for k in range(self.width):
                    np.add.at(g["table"][k], (x[rows, top + k], f), da)
                t += 1
                pace = rate * (1 - epoch / epochs)
                for k, v in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    v -= pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _pieces(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = texts(b.column("text"))
            outs: list[list[bytes]] = []
            for i in range(b.num_rows):
                size = int(offs[i + 1] - offs[i])
                n = len(range(0, max(1, size - CHUNK + STEP), STEP))
                own = sorted({(2 * c + 1) * n // (2 * count) for c in range(count)})
                outs.append([data[offs[i] + k * STEP : min(offs[i] + k * STEP + CHUNK, offs[i + 1])].tobytes() for k in own])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(outs, pa.list_(pa.binary()))], ["id", "label", "pieces"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample: int = 6000, pieces: int = 3, **shape) -> Network:
    """Fit on at most `sample` labelled texts of docs (those of the smallest hash of their ids).

    Ids may be of any type that both tables share. Rows with a null id, label or unlabelled ids
    are left out; a null text is an empty one; of several rows with one id the one with the least
    text counts, and an id labelled more than once counts with its mean label, rounded. So at most
    sample * pieces pieces of 512 bytes reach the driver, however long texts are and however often
    an id stands. One label only, or none (an empty table), gives a constant.
    """
    own = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    own = own.groupBy(F.col(f"`{id_col}`").cast("string").alias("id")).agg(F.round(F.avg(f"`{label}`")).alias("label"))
    named = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    ids = named.select("id").distinct().join(own, "id").orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows: a bound that the data can't change
    rows = named.join(F.broadcast(ids), "id")
    got = rows.select("id", F.col("label").cast("double").alias("label"), "text").mapInArrow(_pieces(pieces), "id string, label double, pieces array<binary>")
    # one text for each id, chosen before anything is collected
    got = got.groupBy("id").agg(F.min(F.struct("pieces", "label")).alias("x")).select("id", "x.*").collect()
    got = [(bytes(x), r.label) for r in sorted(got, key=lambda r: r.id) for x in r.pieces]
    return Network(**shape).fit([x for x, _ in got], np.array([y for _, y in got]))


def _score(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for b in batches:
            data, offs = texts(b.column("text"))
            outs, i, n = [], 0, len(offs) - 1
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE * 4, "right")) - 1))
                outs.append(net.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                i = j
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.concatenate(outs) if outs else np.empty(0), pa.float64())], ["row", "score"])

    return run


def score_quality(df: DataFrame, network: Network, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, score) for each row of df, from its text alone (null: empty); equal texts score equally.

    Ids are not read, so they may be null, repeated or of any type; row holds the carried columns,
    whatever their names; a very long text is scored whole, half a megabyte at a time; an empty
    table gives an empty one.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kinds = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(df.sparkSession.sparkContext.broadcast(network)), kinds)
