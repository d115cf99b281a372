"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting tasks turn their texts into sorted, compressed arrays of (key, count), one for each of
`parts` ranges of the key's hash, so that what is shuffled is summed before and no word or
context, however common, meets in one task as rows. The model is a set of .npy files in the
shared folder, by part: hashes of words in order with their counts, continuation counts and
numbers of followers seen once, twice and more often (the place of a word is its number), and
hashes of bigrams in order with their counts. Workers map these files and search them.

The order is 2: what trigrams need on disk is over four times the input.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import local_path, new_dir, open_input, write_bytes
from .words import U, Words, chunks, pair, each_group

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END, BEGIN = U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B)
FLUSH = 4_000_000
PART_BYTES = 32 << 20


def pack(a: np.ndarray) -> bytes:
    """An array as its byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return a.dtype.str.encode() + b":" + len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    kind, rest = b.split(b":", 1)
    kind, n = np.dtype(kind.decode()), int.from_bytes(rest[:8], "little")
    planes = np.frombuffer(pa.decompress(rest[8:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ascending ranges of hashes."""
    return (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def slim(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def save(uri: str, a: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, a)
    write_bytes(uri, [out.getvalue()])


_OPEN: OrderedDict[str, np.ndarray] = OrderedDict()
#: Files that a worker holds at once; beyond them the one not used for longest is let go.
MOST_OPEN = 1024


def load(uri: str) -> np.ndarray:
    """The array of a file of the model, mapped into memory where the shared folder is mounted."""
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
    else:
        while len(_OPEN) >= MOST_OPEN:
            _OPEN.popitem(last=False)
        path = local_path(uri)
        if path is None:
            with open_input(uri) as f:
                _OPEN[uri] = np.load(io.BytesIO(f.read()))
        else:
            try:
                _OPEN[uri] = np.load(path, mmap_mode="r")
            except ValueError:  # an empty array can't be mapped
                _OPEN[uri] = np.load(path)
    return _OPEN[uri]


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all tokens with an end after each text, hashes of those before, first token of each text)."""
    h = np.insert(w.hashes, w.at[1:], END)
    first = w.at + np.arange(len(w.at))
    before = np.concatenate((np.array([BEGIN], U), h[:-1]))
    before[first[:-1]] = BEGIN
    return h, before, first


def lowered(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for i, j, w in chunks(column):
        yield i, j, Words(LOWER[w.data], w.offs)


def _runs(order_key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each run, sum of n over it) of sorted keys."""
    first = np.flatnonzero(np.concatenate(([True], order_key[1:] != order_key[:-1])))
    return first, np.add.reduceat(n, first)


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            p = part_of(h, parts)
            at = np.searchsorted(p, np.arange(parts + 1))
            for i in np.unique(p):
                x = slice(at[i], at[i + 1])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(h[x])]), pa.array([pack(slim(n[x]))])], ["part", "h", "n"])

        for b in batches:
            for _, _, w in lowered(b.column("text")):
                h, _, _ = tokens(w)
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _store_words(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_group(batches, "part"):
            part = t.column("part")[0].as_py()
            h = np.concatenate([unpack(x) for x in t.column("h").to_pylist()])
            n = np.concatenate([unpack(x).astype(np.int64) for x in t.column("n").to_pylist()])
            order = np.argsort(h)
            first, n = _runs(h[order], n[order])
            save(f"{base}/word-{part}.npy", h[order][first])
            save(f"{base}/count-{part}.npy", slim(n))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["part", "distinct", "total"])

    return run


class Model:
    """Places and figures of a model; what it has in memory is a few numbers for each part."""

    def __init__(self, base: str, parts: int, distinct: list[int], total: int):
        self.base, self.parts, self.total = base, parts, total
        self.start = np.concatenate(([0], np.cumsum(distinct))).astype(np.int64)
        self.size = int(self.start[-1])
        self.filled: set[int] = set()
        self.discount = self.lower = (0.0, 0.0, 0.0)
        self.bigrams = 0
        self.lower_sums = (0, 0, 0)

    def spans(self, h: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Parts of sorted hashes."""
        if not len(h):
            return
        p = part_of(h, self.parts)
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        for a, b in zip(first, np.append(first[1:], len(p)), strict=True):
            yield int(p[a]), slice(a, b)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted word hashes, -1 where unknown; that of a text's begin is self.size."""
        out = np.full(len(h), -1, np.int64)
        for part, x in self.spans(h):
            n = int(self.start[part + 1] - self.start[part])
            if n:
                known = load(f"{self.base}/word-{part}.npy")
                at = np.minimum(np.searchsorted(known, h[x]), n - 1)
                out[x] = np.where(known[at] == h[x], at + self.start[part], -1)
        return np.where(h == BEGIN, self.size, out)

    def values(self, kind: str, i: np.ndarray) -> np.ndarray:
        """Figures of word numbers, 0 for -1."""
        order = np.argsort(i, kind="stable")
        s, out = i[order], np.zeros(len(i), np.int64)
        for part in np.unique(np.searchsorted(self.start, s[s >= 0], "right") - 1):
            if part >= self.parts:
                part = self.parts  # the begin of a text
                lo, hi = self.size, self.size + 1
            else:
                lo, hi = int(self.start[part]), int(self.start[part + 1])
            a, b = np.searchsorted(s, [lo, hi])
            if a < b:
                out[order[a:b]] = load(f"{self.base}/{kind}-{part}.npy")[s[a:b] - lo]
        return out

    def bigram_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        h = pair(v.astype(U), w.astype(U))
        order = np.argsort(h)
        s, found = h[order], np.zeros(len(h), np.int64)
        for part, x in self.spans(s):
            if part in self.filled:
                known = load(f"{self.base}/pair-{part}.npy")
                at = np.minimum(np.searchsorted(known, s[x]), len(known) - 1)
                found[x] = np.where(known[at] == s[x], load(f"{self.base}/pairs-{part}.npy")[at], 0)
        out = np.empty(len(h), np.int64)
        out[order] = found
        return out

    def lowest(self, w: np.ndarray) -> np.ndarray:
        """Probability by continuation counts, mixed with the uniform one over words and unknown."""
        c = self.values("seen", w)
        if not self.bigrams:
            return np.full(len(w), 1.0 / (self.size + 1))
        d = np.select([c == 0, c == 1, c == 2], [0.0, self.lower[0], self.lower[1]], self.lower[2])
        spare = sum(d * n for d, n in zip(self.lower, self.lower_sums, strict=True)) / self.bigrams
        return (c - d) / self.bigrams + spare / (self.size + 1)

    def probabilities(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of words w after words v (numbers, -1 unknown)."""
        p = self.lowest(w)
        c = self.values("count", v)
        known = c > 0
        k = np.where(known & (w >= 0), 1, 0)
        n = np.zeros(len(w), np.int64)
        both = np.flatnonzero(k)
        n[both] = self.bigram_counts(v[both], w[both])
        d = np.select([n == 0, n == 1, n == 2], [0.0, self.discount[0], self.discount[1]], self.discount[2])
        spare = sum(x * self.values(f"after{i}", v) for i, x in zip((1, 2, 3), self.discount, strict=True))
        total = np.maximum(c, 1)
        return np.where(known, (n - d) / total + spare / total * p, p)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from the numbers of n-grams seen 1, 2, 3 and 4 times;
    0.5, 1 and 1.5 where too few are seen to tell."""
    if min(n) <= 0:
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k)) for k in (1, 2, 3))  # type: ignore[return-value]


def _count_pairs(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        held, size = [], 0
        narrow = m.size + 1 < 1 << 32

        def flush():
            v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if narrow:
                k, n = np.unique((v.astype(U) << U(32)) | w.astype(U), return_counts=True)
                v, w = k >> U(32), k & U(0xFFFFFFFF)
            else:
                order = np.lexsort((w, v))
                v, w = v[order].astype(U), w[order].astype(U)
                first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
                v, w, n = v[first], w[first], np.diff(np.append(first, len(v)))
            p = part_of(pair(v, w), m.parts)
            order = np.argsort(p.astype(np.min_scalar_type(m.parts)), kind="stable")
            v, w, n, p = v[order], w[order], n[order], p[order]
            at = np.searchsorted(p, np.arange(m.parts + 1))
            kind = np.uint32 if narrow else U
            for i in np.unique(p):
                x = slice(at[i], at[i + 1])
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([pack(y)]) for y in (np.diff(v[x].astype(kind), prepend=kind(0)), w[x].astype(kind), slim(n[x])))], ["part", "v", "w", "n"])

        for b in batches:
            for _, _, x in lowered(b.column("text")):
                h, before, _ = tokens(x)
                u, back = np.unique(h, return_inverse=True)
                i = m.numbers(u)[back]
                v = np.where(before == BEGIN, m.size, np.concatenate(([m.size], i[:-1])))
                held.append((v, i))
                size += len(i)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _store_pairs(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for t in each_group(batches, "part"):
            part = t.column("part")[0].as_py()
            v = np.concatenate([np.cumsum(unpack(x), dtype=U) for x in t.column("v").to_pylist()])
            w = np.concatenate([unpack(x).astype(U) for x in t.column("w").to_pylist()])
            n = np.concatenate([unpack(x).astype(np.int64) for x in t.column("n").to_pylist()])
            h = pair(v, w)
            order = np.argsort(h)
            first, n = _runs(h[order], n[order])
            at = order[first]
            save(f"{m.base}/pair-{part}.npy", h[at])
            save(f"{m.base}/pairs-{part}.npy", slim(n))
            told = np.array([len(n), *((n == k).sum() for k in (1, 2, 3, 4))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([told.tolist()], pa.list_(pa.int64())), *(pa.nulls(1, x) for x in (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "told", "of", "kind", "i", "n"])
            # followers of v seen once (1), twice (2), more often (3), and texts before w (0)
            for kind, ids in ((0, w[at]), (1, v[at[n == 1]]), (2, v[at[n == 2]]), (3, v[at[n > 2]])):
                i, c = np.unique(ids, return_counts=True)
                of = np.searchsorted(m.start, i.astype(np.int64), "right") - 1
                for x in np.unique(of):
                    a, b = np.searchsorted(of, [x, x + 1])
                    lo = m.start[min(x, m.parts)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.nulls(1, pa.list_(pa.int64())), pa.array([x], pa.int32()), pa.array([kind], pa.int32()), pa.array([pack(slim(np.diff(i[a:b].astype(np.int64) - lo, prepend=0)))]), pa.array([pack(slim(c[a:b]))])],
                        ["part", "told", "of", "kind", "i", "n"],
                    )

    return run


def _store_figures(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for t in each_group(batches, "of"):
            of = t.column("of")[0].as_py()
            size = int(m.start[of + 1] - m.start[of]) if of < m.parts else 1
            sums = np.zeros((4, size), np.int64)
            for kind, i, n in zip(*(t.column(c).to_pylist() for c in ("kind", "i", "n")), strict=True):
                np.add.at(sums[kind], np.cumsum(unpack(i), dtype=np.int64), unpack(n).astype(np.int64))
            for kind, name in enumerate(("seen", "after1", "after2", "after3")):
                save(f"{m.base}/{name}-{of}.npy", slim(sums[kind]))
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([[int((sums[0] == k).sum()) for k in (1, 2, 3, 4)] + [int((sums[0] > 2).sum())]], pa.list_(pa.int64()))], ["of", "told"])

    return run


def train(df: DataFrame, text: str = "text") -> Model:
    """Count the texts of df (null: empty) and store the model in the shared folder.

    The model has a part for each PART_BYTES of text, which are measured first, and at least one
    for each shuffle partition. A text is worked on as a whole; only the text column is read,
    whatever the names of others; an empty table gives a model that knows no word.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{text}`").alias("text"))
    read = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read // PART_BYTES))
    base = new_dir(spark, "ngrams")
    words = docs.mapInArrow(_count_words(parts), "part int, h binary, n binary").repartition(parts, "part").sortWithinPartitions("part")
    found = {r.part: r for r in words.mapInArrow(_store_words(base), "part int, distinct long, total long").collect()}
    model = Model(base, parts, [found[p].distinct if p in found else 0 for p in range(parts)], sum(r.total for r in found.values()))
    for p in set(range(parts)) - set(found):
        save(f"{base}/count-{p}.npy", np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast(model)
    pairs = docs.mapInArrow(_count_pairs(shared), "part int, v binary, w binary, n binary").repartition(parts, "part").sortWithinPartitions("part")
    from .shared import cut

    stored = cut(pairs.mapInArrow(_store_pairs(shared), "part int, told array<long>, of int, kind int, i binary, n binary"), "figures")
    told = stored.filter("told is not null").select("part", "told").collect()
    model.filled = {r.part for r in told}
    sums = [sum(r.told[k] for r in told) for k in range(5)]
    model.bigrams, model.discount = sums[0], discounts(sums[1:])
    figures = stored.filter("of is not null").select("of", "kind", "i", "n").repartition(parts, "of").sortWithinPartitions("of")
    told = figures.mapInArrow(_store_figures(shared), "of int, told array<long>").collect()
    seen = [sum(r.told[k] for r in told) for k in range(5)]
    model.lower, model.lower_sums = discounts(seen[:4]), (seen[0], seen[1], seen[4])
    # a text's begin counts once for each text, as its end does
    ends = model.numbers(np.array([END], U))
    save(f"{base}/count-{parts}.npy", model.values("count", ends))
    made = {r.of for r in told}
    for p in range(parts + 1):
        if p not in made:
            size = int(model.start[p + 1] - model.start[p]) if p < parts else 1
            for name in ("seen", "after1", "after2", "after3"):
                save(f"{base}/{name}-{p}.npy", np.zeros(size, np.int64))
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        low, size = np.log10(m.total + 0.5 * (m.size + 1)), m.size
        for b in batches:
            outs = []
            for _, _, x in lowered(b.column("text")):
                h, before, first = tokens(x)
                u, back = np.unique(h, return_inverse=True)
                i = m.numbers(u)
                c = m.values("count", i)
                base = (np.log10(c + 0.5) - low)[back]
                known = (c > 0)[back]
                w = i[back]
                v = np.where(before == BEGIN, size, np.concatenate(([size], w[:-1])))
                both, at = np.unique(((v + 1).astype(U) << U(32)) | (w + 1).astype(U), return_inverse=True) if size + 2 < 1 << 32 else (None, None)
                if both is None:
                    p = m.probabilities(v, w)
                else:
                    p = m.probabilities((both >> U(32)).astype(np.int64) - 1, (both & U(0xFFFFFFFF)).astype(np.int64) - 1)[at]
                score = np.log10(p)
                outs.append((np.diff(first), *(np.add.reduceat(y, first[:-1]) for y in (known.astype(np.int64), base, score))))
            cols = [np.concatenate(x) for x in zip(*outs, strict=True)] if outs else [np.empty(0)] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["row", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, n_tokens, n_known, base_score, score) for each row of df.

    Tokens are the words in lower case (A to Z only) and one end. A null text is an empty one,
    which has its end only; equal rows count each; an empty table gives an empty one. The
    perplexity of a text is 10 ** (-score / n_tokens).
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kinds = T.StructType([rows.schema["row"], *T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double").fields])
    return rows.mapInArrow(_score(df.sparkSession.sparkContext.broadcast(model)), kinds)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))
