"""Benchmark decontamination by canonical templates.

Texts become tokens (runs of letters or of digits; 1.5 and 1,000 are one number each), in lower
case. A token is a literal or fills a slot: numbers and number words a number slot, units a unit
slot, capitalised words a name slot. Windows of `window` tokens are hashed twice: as templates,
where slots are placeholders of their kind, and as they are. Template windows of texts meet those
of benchmark items by hash. Hits of an item on one alignment (text place minus item place) form
runs; a run is a leak if it covers enough of the item, and its slots are consistent: the same
filling of the item always became the same filling in the text, and differing ones differing.
A run of which over a fifth is filled anew must be literals by half, and a template window holds
a literal: mere lists of numbers or names fit each other anyhow, so they meet as they are only.

If no alignment is enough by itself, runs of all of them are joined in order: what counts is the
longest chain of places that rise in both the item and the text. For this, windows are also hashed
with neighbouring slots of one kind folded into one, so a filling may have another number of tokens.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .words import U, chunks, mix, pair, span_hashes, window_hashes

WINDOW = 8
#: Number words and units of the languages served.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg t ton tons tonne tonnes ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms us ns hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa n c f k "
    "dollar dollars cent cents euro euros usd eur gbp percent km2 m2 m3 mph kmh bit bits byte bytes kb mb gb tb meter meters metre metres kilometer kilometers kilogram kilograms gram grams degree degrees"
).split()
NUMBER, UNIT, NAME = 1, 2, 3

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 digit
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Tokens of consecutive texts, with hashes, kinds and template hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        c = _CLASS[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        dot = np.zeros(n, bool)
        if n > 2:  # a point or comma between digits belongs to the number
            dot[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & (c[:-2] == 2) & (c[2:] == 2) & ~edge[1:-2] & ~edge[2:-1]
        c = np.where(dot, 2, c)
        low = _LOWER[data]
        if n > 1:  # capitals of the Latin-1 range
            cap = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            low[1:][cap] += 32
        start, last = c > 0, c > 0
        if n:
            start[1:] &= (c[1:] != c[:-1]) | edge[1:-1]
            last[:-1] &= (c[1:] != c[:-1]) | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.counts)
        self.h = span_hashes(low, self.starts, self.ends)
        s = self.starts
        self.kind = np.zeros(len(s), np.uint8)
        first = data[s]
        upper = (first >= 65) & (first <= 90)
        two = s + 1 < n
        nxt = data[np.minimum(s + 1, max(n - 1, 0))]
        upper |= two & (first == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E)
        # words in capitals throughout are not names
        after = np.where(first == 0xC3, s + 2, s + 1)
        nxt = data[np.minimum(after, max(n - 1, 0))]
        shout = (after < self.ends) & (nxt >= 65) & (nxt <= 90)
        self.kind[upper & ~shout] = NAME
        self.kind[np.isin(self.h, _FIXED["units"])] = UNIT
        self.kind[(c[s] == 2) | np.isin(self.h, _FIXED["numbers"])] = NUMBER
        self.template = np.where(self.kind > 0, mix(self.kind.astype(U) + U(977)), self.h)
        # groups: a literal, or all neighbouring slots of one kind
        new = np.ones(len(s), bool)
        new[1:] = (self.kind[1:] == 0) | (self.kind[1:] != self.kind[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.groups = np.append(np.flatnonzero(new), len(s))
        self.group_at = np.searchsorted(self.groups[:-1], self.at)
        self.group = np.cumsum(new) - 1


def _hash_words(words: list[str]) -> np.ndarray:
    x = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in x])
    return np.unique(span_hashes(np.frombuffer(b"".join(x), np.uint8), ends - [len(w) for w in x], ends))


_FIXED = {"units": _hash_words(UNITS), "numbers": _hash_words(NUMBER_WORDS)}


def _with_literal(kind: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Those of the windows of n places from p that are not slots only."""
    literals = np.concatenate(([0], np.cumsum(kind == 0)))
    return p[literals[p + n] > literals[p]]


def _windows(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of windows within one text, as templates and as they are."""
    if len(t.h) < n:
        return np.empty(0, np.int64), np.empty(0, U)
    end = np.repeat(t.at[1:], t.counts)
    p = np.flatnonzero(np.arange(len(t.h) - n + 1) + n <= end[: len(t.h) - n + 1])
    q = _with_literal(t.kind, p, n)
    return np.concatenate([q, p]), np.concatenate([window_hashes(t.template, n)[q], mix(window_hashes(t.h, n)[p])])


def _folded(t: Tokens, n: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first group, hash) of windows of n groups within one text, and of each shorter length."""
    h, ends = t.template[t.groups[:-1]], np.repeat(t.group_at[1:], np.diff(t.group_at))
    parts = [(np.empty(0, np.int64), np.empty(0, U))]
    for m in (*short, n):
        if len(h) >= m:
            p = _with_literal(t.kind[t.groups[:-1]], np.flatnonzero(np.arange(len(h) - m + 1) + m <= ends[: len(h) - m + 1]), m)
            parts.append((p, pair(window_hashes(h, m)[p], np.full(len(p), m, U))))
    return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


class Items:
    """Windows of benchmark items, sorted by hash, and the tokens of the items."""

    def __init__(self, ids: list, texts: list[str], window: int):
        raw = [(x or "").encode() for x in texts]
        offs = np.cumsum([0, *map(len, raw)])
        t = Tokens(np.frombuffer(b"".join(raw), np.uint8), offs)
        self.ids, self.window = list(ids), window
        self.h, self.kind, self.at, self.counts = t.h, t.kind, t.at, t.counts
        p, h = _windows(t, window)
        # items shorter than a window are one window of their length
        self.short = sorted({int(n) for n in self.counts if 0 < n < window})
        more = [_short_windows(t, self.at[:-1][self.counts == n], n) for n in self.short]
        p, h = np.concatenate([p, *(x for x, _ in more)]), np.concatenate([h, *(x for _, x in more)])
        keep = np.unique(np.stack([h, p.astype(U)], 1), axis=0) if len(h) else np.empty((0, 2), U)
        self.keys, self.places = keep[:, 0].copy(), keep[:, 1].astype(np.int64)
        self.item = np.searchsorted(self.at, self.places, "right") - 1
        # the same of groups; items with fewer than a window are whole, and need literals by half to pass
        self.groups, self.group, self.group_at = t.groups, t.group, t.group_at
        self.group_counts = np.diff(t.group_at)
        literals = np.bincount(t.doc[t.kind == 0], minlength=len(raw))
        few = (self.group_counts > 0) & (self.group_counts < window) & (2 * literals >= self.counts)
        self.group_short = sorted({int(n) for n in self.group_counts[few]})
        p, h = _folded(t, window, [])
        for n in self.group_short:
            q, x = _folded(t, n, [])
            own = np.isin(q, t.group_at[:-1][few & (self.group_counts == n)])
            p, h = np.concatenate([p, q[own]]), np.concatenate([h, x[own]])
        order = np.lexsort((p, h))
        self.group_keys, self.group_places = h[order], p[order]
        self.group_item = np.searchsorted(self.group_at, self.group_places, "right") - 1


def _short(h: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    x = h[p]
    for i in range(1, n):
        x = pair(x, h[p + i])
    return x


def _short_windows(t: Tokens, p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As _windows, of fewer places from p; their number is part of the hash."""
    q = _with_literal(t.kind, p, n)
    named = lambda h, at: pair(_short(h, at, n), np.full(len(at), n, U))
    return np.concatenate([q, p]), np.concatenate([named(t.template, q), mix(named(t.h, p))])


def _hits(t: Tokens, window: int, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    p, h = _windows(t, window)
    parts = [(p, h)]
    for n in short:
        end = np.repeat(t.at[1:], t.counts)
        if len(t.h) >= n:
            q = np.flatnonzero(np.arange(len(t.h) - n + 1) + n <= end[: len(t.h) - n + 1])
            parts.append(_short_windows(t, q, n))
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def _matches(keys: np.ndarray, p: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, number of the key) of each pair of a window and an equal key."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(keys, h)
    hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h)
    p, h, at = p[hit], h[hit], at[hit]
    n = np.searchsorted(keys, h, "right") - at
    return np.repeat(p, n), np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def enough(covered: np.ndarray, size: int, least_share: float, least_run: int, long_run: int) -> bool:
    """Whether these places of an item are enough of it, or hold a run of long_run."""
    if len(covered) >= min(size, max(least_run, least_share * size)):
        return True
    return len(covered) >= long_run and bool((covered[long_run - 1 :] - covered[: len(covered) - long_run + 1] == long_run - 1).any())


def judge(t: Tokens, d: int, places: np.ndarray, items: Items, i: int, at: np.ndarray, least_share: float, least_run: int, long_run: int) -> tuple[int, int, int, int] | None:
    """The best run of text d on item i: (covered tokens, slots, slots refilled, first token), or
    None. places are starts of hit windows in the text, at those in the item."""
    best = None
    shift = places - at
    n = min(items.window, int(items.counts[i]))
    lo, size = int(items.at[i]), int(items.counts[i])
    for s in np.unique(shift):
        on = np.zeros(size + 1, np.int64)
        w = np.unique(at[shift == s]) - lo
        np.add.at(on, w, 1)
        np.add.at(on, np.minimum(w + n, size), -1)
        covered = np.flatnonzero(np.cumsum(on)[:size] > 0)
        if not enough(covered, size, least_share, least_run, long_run):
            continue
        a, b = items.h[lo + covered], t.h[lo + covered + s]
        kind, other = items.kind[lo + covered], t.kind[lo + covered + s]
        # a place counts as refilled if the token differs; literals do not differ in hit windows
        slot = (kind > 0) & (kind == other)
        x, y = a[slot], b[slot]
        pairs = len(np.unique(np.stack([x, y], 1), axis=0)) if len(x) else 0
        refilled = int((x != y).sum())
        loose = pairs != len(np.unique(x)) or pairs != len(np.unique(y)) or 2 * int((kind == 0).sum()) < len(covered)
        # what is the same stands by itself; what is filled anew needs consistent slots between literals
        if loose and refilled > 0.2 * len(covered):
            continue
        found = (len(covered), int(slot.sum()), refilled, int(lo + s + covered[0] - t.at[d]))
        best = max(best, found) if best else found
    return best


def _chain(j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the longest chain of pairs that rises in j and in at."""
    order = np.lexsort((-j, at))
    tails: list[int] = []
    last: list[int] = []
    before = np.full(len(j), -1, np.int64)
    for k, v in zip(order.tolist(), j[order].tolist(), strict=True):
        m = bisect_left(tails, v)
        before[k] = last[m - 1] if m else -1
        if m == len(tails):
            tails.append(v)
            last.append(k)
        else:
            tails[m], last[m] = v, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(k)
        k = int(before[k])
    return np.array(out[::-1], np.int64)


def join_runs(t: Tokens, d: int, places: np.ndarray, items: Items, i: int, at: np.ndarray, group_places: np.ndarray, group_at: np.ndarray, least_share: float, least_run: int, long_run: int) -> tuple[int, int, int, int] | None:
    """As judge, of the runs of all alignments in order. group_places and group_at are the hits of
    folded windows, as groups."""
    lo, size = int(items.at[i]), int(items.counts[i])
    step = np.arange(min(items.window, size))
    j, p = (at[:, None] + step).ravel(), (places[:, None] + step).ravel()
    step = np.arange(min(items.window, int(items.group_counts[i])))
    g = np.unique(np.stack([(group_at[:, None] + step).ravel(), (group_places[:, None] + step).ravel()], 1), axis=0)
    # tokens of a group lie evenly on those of its match
    a, b = items.groups[g[:, 0] + 1] - items.groups[g[:, 0]], t.groups[g[:, 1] + 1] - t.groups[g[:, 1]]
    k = np.arange(a.sum()) - np.repeat(np.cumsum(a) - a, a)
    j = np.concatenate([j, np.repeat(items.groups[g[:, 0]], a) + k])
    if not enough(np.unique(j), size, least_share, least_run, long_run):
        return None
    line = np.concatenate([p, np.repeat(t.groups[g[:, 1]], a) + k * np.repeat(b / np.maximum(a, 1), a)])
    pairs = np.unique(np.stack([j, line], 1), axis=0)
    pairs = pairs[_chain(pairs[:, 0].astype(np.int64), pairs[:, 1])]
    j, p = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
    if not enough(j - lo, size, least_share, least_run, long_run):
        return None
    slot = (items.kind[j] > 0) & (items.kind[j] == t.kind[p])
    fills, refilled = set(), 0
    for x, y in zip(j[slot].tolist(), p[slot].tolist(), strict=True):
        gx, gy = int(items.group[x]), int(t.group[y])
        ax, ay = int(items.groups[gx]), int(t.groups[gy])
        bx, by = int(items.groups[gx + 1]), int(t.groups[gy + 1])
        if bx - ax == by - ay and x - ax == y - ay:
            ax, bx, ay, by = x, x + 1, y, y + 1
        fill = items.h[ax:bx].tobytes(), t.h[ay:by].tobytes()
        fills.add(fill)
        refilled += fill[0] != fill[1]
    loose = len(fills) != len({x for x, _ in fills}) or len(fills) != len({y for _, y in fills}) or 2 * int((items.kind[j] == 0).sum()) < len(j)
    if loose and refilled > 0.2 * len(j):
        return None
    return len(j), int(slot.sum()), refilled, int(p[0] - t.at[d])


def _scan(shared, kind: pa.DataType, least_share: float, least_run: int, long_run: int):
    leak = pa.list_(pa.struct([("item_id", kind), ("share", pa.float64()), ("tokens", pa.int64()), ("slots", pa.int64()), ("refilled", pa.int64()), ("start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for b in batches:
            leaks: list[list] = []
            for _, _, w in chunks(b.column("text")):
                t = Tokens(w.data, w.offs)
                found: dict[int, list] = {}
                sets = []
                for keys, own, hits in ((items.keys, items.item, _hits(t, items.window, items.short)), (items.group_keys, items.group_item, _folded(t, items.window, items.group_short))):
                    p, k = _matches(keys, *hits)
                    doc = t.doc[t.groups[p]] if sets else t.doc[p]
                    key = doc * len(items.ids) + own[k]
                    order = np.argsort(key, kind="stable")
                    sets.append((p[order], k[order], key[order]))
                (p, k, key), (gp, gk, gkey) = sets
                for x in np.unique(np.concatenate([key, gkey])):
                    d, i = divmod(int(x), len(items.ids))
                    a, z = np.searchsorted(key, x), np.searchsorted(key, x, "right")
                    at = items.places[k[a:z]]
                    got = judge(t, d, p[a:z], items, i, at, least_share, least_run, long_run)
                    if not got:
                        ga, gz = np.searchsorted(gkey, x), np.searchsorted(gkey, x, "right")
                        got = join_runs(t, d, p[a:z], items, i, at, gp[ga:gz], items.group_places[gk[ga:gz]], least_share, least_run, long_run)
                    if got:
                        covered, slots, refilled, start = got
                        found.setdefault(d, []).append({"item_id": items.ids[i], "share": covered / int(items.counts[i]), "tokens": covered, "slots": slots, "refilled": refilled, "start": start})
                leaks += [found.get(d, []) for d in range(len(w.offs) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(leaks, leak)], ["row", "leaks"])

    return run


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, least_share: float = 0.5, least_run: int = 5, part_bytes: int = 8 << 20, carry: list[str] | None = None, long_run: int = 50) -> DataFrame:
    """(row, leaks) for each row of df: leaks lists the benchmark items that it holds, with the
    share of the item covered, tokens covered, its slots and those filled anew, and the first token.

    Items are sent to the workers in parts of at most part_bytes of text, whose sizes are measured
    first; a text meets each part in a pass of its own, so no size of the benchmark goes beyond
    memory. Null or empty texts and items leak nothing; item ids may be of any type, repeated or
    null, and are listed as they are; items of equal text are all listed; equal rows get equal
    results; an empty table gives an empty one; the columns of df stand in the struct row,
    whatever their names; a text is read whole, by one worker. Items of fewer tokens than
    least_run leak if all of them are there; a run of long_run tokens leaks whatever its share.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text")).filter("text is not null").distinct()
    kind = to_arrow_type(items.schema["id"].dataType)
    leaks = T.StructType([T.StructField(k, t) for k, t in [("item_id", items.schema["id"].dataType), ("share", T.DoubleType()), *((x, T.LongType()) for x in ("tokens", "slots", "refilled", "start"))]])
    leaks = T.StructField("leaks", T.ArrayType(leaks))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // part_bytes))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    kinds = T.StructType([rows.schema["row"], leaks])
    out = None
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("id", "text"), parts) == k).orderBy("id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([r.id for r in own], [r.text for r in own], window))
        if out is not None:
            rows = out.select(F.struct("row", "leaks").alias("row"), "text")
            kinds = T.StructType([rows.schema["row"], leaks])
        found = rows.select(F.struct("row", "text").alias("row"), "text") if parts > 1 else rows
        kinds = T.StructType([found.schema["row"], leaks])
        found = found.mapInArrow(_scan(shared, kind, least_share, least_run, long_run), kinds)
        if parts == 1:
            return found
        if out is None:
            out = found.select("row.row", "row.text", "leaks")
        else:
            out = found.select(F.col("row.row.row").alias("row"), F.col("row.text").alias("text"), F.concat("row.row.leaks", "leaks").alias("leaks"))
    return out.select("row", "leaks")
