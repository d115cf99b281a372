"""Removal of word windows that occur more than once, by level-wise doubling.

Levels have windows of b, 2b, 4b, ... words up to the largest within the window of w words; b is
a power of two, half of w at most. On the first level those windows of b words are taken up
that are the leftmost minimum (by hash), the anchor, of some window of w words, so that equal
windows of w words take up equal ones. On each level the windows that occur once end, and with
them all windows of w words they were taken up for; the others are extended to twice the length,
at a place that follows from the anchor alone, until no candidate survives or the next doubling
would pass w. What is left is extended to w words, and of these windows the ones that occur more
than once cover the words to remove. Every level is judged on the input.

Each task drops what it has seen twice itself before the shuffle (one row per key and task goes
on), so a passage that a third of all texts share does not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, chunks, pair, whole_groups, window_hashes

FLUSH = 4_000_000


def doublings(window: int, base: int | None = None) -> list[int]:
    """Lengths of the levels: base, twice that, and so on within the window."""
    n = base or max(1, 1 << max(0, (window // 2).bit_length() - 1))
    out = [n]
    while 2 * out[-1] <= window:
        out.append(2 * out[-1])
    return out


def _leftmost_min(x: np.ndarray, n: int) -> np.ndarray:
    """Position of the leftmost minimum of each n consecutive items, by doubling."""
    at, size = np.arange(len(x)), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while 2 * size <= n:
        at = lower(at[: len(at) - size], at[size:])
        size *= 2
    return at if size == n else lower(at[: len(at) - (n - size)], at[n - size :])


def _anchors(w: Words, window: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows within one text, their anchors)."""
    if len(w.hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = _leftmost_min(window_hashes(w.hashes, base), window - base + 1)
    p = np.flatnonzero(np.arange(len(a)) + window <= w.end_of_doc[: len(a)])
    return p, a[p]


def _inside(p: np.ndarray, a: np.ndarray, window: int, length: int) -> np.ndarray:
    """Start of the part of `length` words that stands for the window at p with anchor a."""
    step = window - length + 1
    return a - step * ((a - p) // step)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each group of equal keys, group of each row, whether a group has several)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    return first, of, np.bincount(of, minlength=len(first)) > 1


def _stay(b: pa.RecordBatch, i: int, j: int, w: Words) -> np.ndarray:
    """Marks of the words where a part of the level before survives."""
    lists = b.column("alive").slice(i, j - i)
    n = np.diff(lists.offsets.to_numpy())
    good = np.zeros(len(w.starts), bool)
    good[lists.flatten().to_numpy() + np.repeat(w.at[:-1], n)] = True
    return good


def _texts(b: pa.RecordBatch) -> pa.Array:
    return b.column("row").field(b.column("row").type.get_field_index("text"))


def _level(window: int, base: int, before: int | None, length: int):
    """Parts of `length` words of the windows whose part of `before` words survives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            if not held:
                return
            k, r, p = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            first, of, again = _groups(k)
            seen = again[of].astype(np.int8)  # 1: known to be repeated, key not needed
            seen[first[again]] = 2  # stands for its key, and is known to be repeated
            # known rows are dealt out by their text and place, the others meet by their key
            s = np.where(seen == 1, pair(r.view(np.uint64), p.astype(np.uint64)), k)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(r), pa.array(p.astype(np.int32)), pa.array(seen)], ["s", "rk", "p", "f"])

        for b in batches:
            rk = b.column("rk").to_numpy()
            for i, j, w in chunks(_texts(b) if before else b.column("text")):
                p, a = _anchors(w, window, base)
                if before and len(p):
                    on = _stay(b, i, j, w)[_inside(p, a, window, before)]
                    p, a = p[on], a[on]
                if not len(p):
                    continue
                s = _inside(p, a, window, length)
                s = np.unique(s) if before else s[np.concatenate(([True], s[1:] != s[:-1]))]
                d = w.doc[s]
                held.append((window_hashes(w.hashes, length)[s], rk[i:j][d], s - w.at[:-1][d]))
                size += len(s)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _known(flag: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of rows sorted by keys: do the keys stand more than once, or are they flagged."""
    new = np.zeros(len(flag), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(flag)))
    return np.repeat((n > 1) | np.logical_or.reduceat(flag, first), n)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "s"):
        k, f = t.column("s").to_numpy(), t.column("f").to_numpy()
        keep = (f > 0).copy()
        rest = np.flatnonzero(f != 1)  # in order by key; rows known before need none
        if len(rest):
            keep[rest] |= _known(f[rest] == 2, k[rest])
        t = t.select(["rk", "p"]).filter(pa.array(keep))
        yield from t.to_batches()


def _last(window: int, base: int, length: int):
    """Windows whose part of `length` words, the last level, survives: by that part, with the
    hashes of the up to `step` windows that it stands for."""
    step = window - length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            if not held:
                return
            k, h, r, s, o = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            first, of, again = _groups(k, h)
            lead = np.zeros(len(h), np.int8)
            lead[first] = 1 + again  # 1: alone so far; 2: repeated, stands for the others
            known = again[of]
            # rows of one part each, of up to `step` full windows
            new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] != s[:-1]))))
            row = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(h))))
            full = np.zeros((len(new), step), np.uint64)
            flags = np.zeros((len(new), step), np.uint8)
            sent = lead > 0
            full[row[sent], o[sent]] = h[sent]
            flags[row[sent], o[sent]] = lead[sent]
            need = flags.any(1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k[new][need].view(np.int64)), pa.array(r[new][need]), pa.array(s[new][need].astype(np.int32)),
                    pa.array([x.tobytes() for x in full[need]], pa.binary()), pa.array([x.tobytes() for x in flags[need]], pa.binary()), pa.nulls(int(need.sum()), pa.int64()),
                ],
                ["k", "rk", "p", "h", "f", "m"],
            )
            # what is known is sent as bits over 32 window starts, once for all equal rows
            r, p = r[known], s[known] - o[known]
            order = np.lexsort((p, r))
            yield _bits(r[order], p[order])

        for b in batches:
            rk = b.column("rk").to_numpy()
            for i, j, w in chunks(_texts(b)):
                p, a = _anchors(w, window, base)
                if not len(p):
                    continue
                s = _inside(p, a, window, length)
                on = _stay(b, i, j, w)[s]
                p, s = p[on], s[on]
                if not len(p):
                    continue
                d = w.doc[p]
                held.append((window_hashes(w.hashes, length)[s], window_hashes(w.hashes, window)[p], rk[i:j][d], s - w.at[:-1][d], s - p))
                size += len(p)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _bits(r: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """Window starts of texts as rows of 32 bits."""
    if len(p):
        word = p >> 5
        new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (word[1:] != word[:-1]))))
        m = np.bitwise_or.reduceat(np.int64(1) << (p & 31).astype(np.int64), new)
        r, p = r[new], word[new] << 5
    else:
        m = np.empty(0, np.int64)
    n = len(m)
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(r, pa.int64()), pa.array(p.astype(np.int32)), none, none, pa.array(m)], ["k", "rk", "p", "h", "f", "m"])


def _repeated(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "s"):
            m = t.column("m").combine_chunks()
            done = np.asarray(m.is_valid())
            if done.any():
                x = t.filter(pa.array(done))
                yield from x.select(["rk", "p", "m"]).to_batches()
            t = t.filter(pa.array(~done))
            if not len(t):
                continue
            h = np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint64)
            f = np.frombuffer(b"".join(t.column("f").to_pylist()), np.uint8)
            o = np.tile(np.arange(step), len(t))
            k, rk = (np.repeat(t.column(c).to_numpy(), step) for c in ("k", "rk"))
            p = np.repeat(t.column("p").to_numpy(), step) - o
            keep = f > 0
            h, f, k, rk, p = h[keep], f[keep], k[keep], rk[keep], p[keep]
            order = np.lexsort((h, k))
            again = np.zeros(len(h), bool)
            again[order] = _known(f[order] == 2, k[order], h[order])
            rk, p = rk[again], p[again]
            order = np.lexsort((p, rk))
            x = pa.Table.from_batches([_bits(rk[order], p[order].astype(np.int64))])
            yield from x.select(["rk", "p", "m"]).to_batches()

    return run


OUT = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string(), "removed": pa.list_(pa.list_(pa.int32()))}
OUT_DDL = "n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<array<int>>"


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, hits = b.column("row"), b.column("hits")
            outs = [[] for _ in range(5)]
            for i, j, w in chunks(rows.field(rows.type.get_field_index("text"))):
                gone = np.zeros(len(w.starts) + 1, np.int64)
                lists = hits.slice(i, j - i)
                x = lists.flatten().to_numpy()
                if len(x):
                    n = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(v) if v is not None else 0 for v in lists.to_pylist()])
                    at = np.repeat(w.at[:-1], n) + (x >> 32)
                    bits = ((x & 0xFFFFFFFF)[:, None] >> np.arange(32)) & 1
                    r, c = np.nonzero(bits)
                    p = np.unique(at[r] + c)
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + window, -1)
                out = np.cumsum(gone)[:-1] > 0
                for d in range(j - i):
                    lo, hi = w.at[d], w.at[d + 1]
                    s, e, g = w.starts[lo:hi], w.ends[lo:hi], out[lo:hi]
                    kept = np.flatnonzero(~g)
                    text = b" ".join(w.data[s[k] : e[k]].tobytes() for k in kept) if g.any() else b" ".join(w.data[w.offs[d] : w.offs[d + 1]].tobytes().translate(_BLANKS).split())
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                    outs[0].append(hi - lo)
                    outs[1].append(int(g.sum()))
                    outs[2].append(hashlib.sha256(text).hexdigest())
                    outs[3].append(text.decode("utf-8", "replace") if g.any() else None)
                    outs[4].append(edge.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(x, t) for x, t in zip(outs, OUT.values(), strict=True))], ["row", *OUT])

    return run


_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def remove_repeated_windows(df: DataFrame, window: int = 35, text: str = "text", base: int | None = None) -> DataFrame:
    """All columns of df (in a struct `row`) with n_words, n_removed, kept_sha256, kept_text (null
    where nothing is removed: the text stays as it is) and removed (pairs of word numbers, end
    excluded).

    A null or empty text has no words and stays; texts shorter than the window lose nothing;
    equal rows are repeats of each other and cost as much as different ones; an empty table gives
    an empty one; other columns are only carried, whatever their names. A very long text is
    worked on as a whole, by one worker. Windows are compared by two 64-bit hashes, of the window
    and of its last level; rows are named by one.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    row = F.struct(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(None).cast("int").alias("none")]).alias("rest"))
    src = df.select(row.alias("row")).withColumn("rk", F.xxhash64("row.text", F.to_json("row.rest")))
    dealt = src.select("rk", "row").repartition("rk")
    sizes = doublings(window, base)

    def level(rows: DataFrame, before: int | None, length: int) -> DataFrame:
        found = rows.mapInArrow(_level(window, sizes[0], before, length), "s long, rk long, p int, f byte")
        found = found.repartition("s").sortWithinPartitions("s").mapInArrow(_survivors, "rk long, p int")
        return found.groupBy("rk").agg(F.collect_set("p").alias("alive"))

    alive = level(src.select("rk", F.col("row.text").alias("text")), None, sizes[0])
    for before, length in zip(sizes, sizes[1:]):
        alive = level(dealt.join(alive, "rk"), before, length)
    step = window - sizes[-1] + 1
    last = dealt.join(alive, "rk").mapInArrow(_last(window, sizes[0], sizes[-1]), "k long, rk long, p int, h binary, f binary, m long")
    last = last.withColumn("s", F.coalesce("k", F.xxhash64("rk", "p")))
    hits = last.repartition("s").sortWithinPartitions("s").mapInArrow(_repeated(step), "rk long, p int, m long")
    # equal rows stand in one task and find the same, which a set has once
    hits = hits.groupBy("rk").agg(F.collect_set((F.col("p").cast("long") * F.lit(1 << 32)) + F.col("m")).alias("hits"))
    out = dealt.join(hits, "rk", "left").select("row", F.coalesce("hits", F.array().cast("array<bigint>")).alias("hits"))
    schema = T.StructType([T.StructField("row", src.schema["row"].dataType), *T.StructType.fromDDL(OUT_DDL).fields])
    out = out.mapInArrow(_remove(window), schema)
    cols = [(F.col("row.text") if c == text else F.col(f"row.rest.`{c}`")).alias(c) for c in df.columns]
    return out.select(F.struct(*cols).alias("row"), "n_words", "n_removed", "kept_sha256", "kept_text", "removed")
