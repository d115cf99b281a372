"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

Equal texts are one node. Each shingle with count c is a union of Poisson processes over the
weight axis cut into the levels [0,1), [1,2), [2,4), [4,8) ...: a level has a process of the rate
of its length, each point of which is placed on a unit of the level; points beyond c do not count.
The earliest point of each of `slots` slots is the signature, so two signatures agree in a slot
with the weighted Jaccard similarity. Points are drawn in time order up to a horizon that fills
all slots nearly always; a text with an empty slot is drawn again with twice the horizon.

Texts that agree in a band are members of a bucket. Each member is compared with the smallest
member, which makes no pairs within a bucket, and the links found join members to components.
For buckets in which several components are left, an exact prefix join finds the links that are
missing: two multisets can only overlap by o if their elements up to rank size - o + 1, rarest
first, have one in common. Of these pairs only those meet whose parity words allow the link: each
element that is in one of the two texts alone flips one bit, so the bits that differ are never more
than such elements. So the classes miss no link between texts that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .shared import cut
from .words import U, Words, chunks, mix, pair, window_hashes

BANDS, ROWS, SHINGLE, THRESHOLD = 32, 5, 5, 0.8
#: 64-bit words of the parities of a text's elements.
PARITY = 16


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles; a text of fewer than n words is one."""
    h, size = w.hashes, w.counts
    d = np.empty(0, np.int64)
    s = np.empty(0, U)
    if len(h) >= n:
        p = np.flatnonzero(np.arange(len(h) - n + 1) + n <= w.end_of_doc[: len(h) - n + 1])
        d, s = w.doc[p], window_hashes(h, n)[p]
    for k in range(1, n):
        short = np.flatnonzero(size == k)
        if len(short):
            x = h[w.at[short]]
            for i in range(1, k):
                x = pair(x, h[w.at[short] + i])
            d, s = np.concatenate([d, short]), np.concatenate([s, mix(x + U(k))])
    order = np.argsort(s + mix(d.astype(U)), kind="stable")
    d, s = d[order], s[order]
    new = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])))) if len(s) else np.empty(0, np.int64)
    return d[new], s[new], np.diff(np.append(new, len(s)))


def signatures(d: np.ndarray, s: np.ndarray, c: np.ndarray, n: int, slots: int) -> np.ndarray:
    """BagMinHash signatures (n x slots) of texts 0..n-1; rows of texts without shingles are 0."""
    total = np.bincount(d, c, n)
    horizon = slots * (np.log(slots) + 3) / np.maximum(total, 1)
    sig = np.zeros((n, slots), U)
    # one row for each element and level
    levels = np.ones(len(c), np.int64)
    many = c > 1
    levels[many] = np.ceil(np.log2(c[many])).astype(np.int64) + 1
    e = np.repeat(np.arange(len(c)), levels)
    level = np.arange(len(e)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.maximum(low, 1)
    d, c = d[e], c[e]
    seed = pair(s[e], level.astype(U))
    todo = total > 0
    while todo.any():
        best = np.full(n * slots, np.inf)
        ids = np.zeros(n * slots, U)
        on = np.flatnonzero(todo[d])
        t, i, step = np.zeros(len(on)), 0, 1
        while len(on):
            x = mix(seed[on][:, None] + (np.arange(i, i + step, dtype=U) * U(0xD1342543DE82EF95)))
            gap = -np.log(((x >> U(11)) + U(1)).astype(float) * 2.0**-53) / rate[on][:, None]
            at = t[:, None] + np.cumsum(gap, 1)
            y = mix(x)
            leaf = low[on][:, None] + ((y >> U(40)).astype(float) * 2.0**-24 * rate[on][:, None]).astype(np.int64)
            use = (at <= horizon[d[on]][:, None]) & (leaf < c[on][:, None])
            r, _ = np.nonzero(use)
            cell = d[on][r] * slots + (y[use] & U(0xFFFFFFFF)).astype(np.int64) % slots
            when, who = at[use], x[use]
            np.minimum.at(best, cell, when)
            won = best[cell] == when
            ids[cell[won]] = who[won]
            t = at[:, -1]
            more = t <= horizon[d[on]]
            on, t, i = on[more], t[more], i + step
            step = 1 if len(on) > 200_000 else 4 if len(on) > 20_000 else 16 if len(on) > 500 else 64
        full = np.isfinite(best.reshape(n, slots)).all(1) & todo
        sig[full] = ids.reshape(n, slots)[full]
        todo &= ~full
        horizon = np.where(todo, horizon * 2, horizon)
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, slots = sig.shape
    x = sig.reshape(n, slots // rows, rows)
    k = np.broadcast_to(np.arange(slots // rows, dtype=U), (n, slots // rows)).copy()
    for i in range(rows):
        k = pair(k, x[:, :, i])
    return k


def _profile(bands: int, rows: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            for i, j, w in chunks(b.column("text")):
                n = j - i
                d, s, c = shingles(w, shingle)
                k = band_keys(signatures(d, s, c, n, bands * rows), rows)
                lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), k.reshape(-1).view(np.int64))
                own = [b.column(x).slice(i, n) for x in ("row", "id", "rk")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node[i:j], pa.int64(), mask=w.counts == 0), pa.array(w.counts.astype(np.int64)), lists], ["row", "id", "rk", "node", "n_words", "bands"])

    return run


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets sorted by hash."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _compare(shingle: int):
    """Rows sorted by group: first the leader's text (role 0), then the members (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, bag = None, None
        for b in batches:
            role, node, of = (b.column(x).to_numpy() for x in ("role", "node", "leader"))
            outs: list[tuple[int, int, float]] = []
            for i, j, w in chunks(b.column("text")):
                d, s, c = shingles(w, shingle)
                order = np.lexsort((s, d))
                d, s, c = d[order], s[order], c[order]
                at = np.searchsorted(d, np.arange(j - i + 1))
                for x in range(j - i):
                    own = (s[at[x] : at[x + 1]], c[at[x] : at[x + 1]])
                    if role[i + x] == 0:
                        leader, bag = of[i + x], own
                    elif leader == of[i + x]:
                        outs.append((int(node[i + x]), int(leader), _overlap(bag, own)))
            n, m, v = zip(*outs, strict=True) if outs else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(v, pa.float64())], ["node", "leader", "sim"])

    return run


def similarities(pairs: DataFrame, text_of: DataFrame, shingle: int = SHINGLE, share: int = 256) -> DataFrame:
    """Exact multiset similarity of (node, leader) pairs. A leader's text goes once to each
    `share` of its members, not once to each member."""
    n = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    dealt = pairs.join(n, "leader").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / share)).cast("int"))
    heads = dealt.select("leader", "part").distinct().join(text_of.withColumnRenamed("node", "leader"), "leader").select("leader", "part", F.lit(0).alias("role"), F.col("leader").alias("node"), "text")
    rows = heads.unionByName(dealt.join(text_of, "node").select("leader", "part", F.lit(1).alias("role"), "node", "text"))
    rows = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "role")
    return rows.mapInArrow(_compare(shingle), "node long, leader long, sim double")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of df: its id, n_words, class_id (the smallest id of its class), class
    (a number of the class, null for a text without words) and row (the columns to carry, none by
    default).

    Texts are linked if the weighted Jaccard similarity of their shingles is at least the
    threshold; a class is all that links join. Equal texts are one class; texts without words
    (null, empty, blank) are each their own. Ids may be of any type that has an order, repeated or
    null: classes are of texts. Rows with a null id are grouped with their texts and never name a
    class that has another id; a class of null ids only has a null class_id. Equal rows stay. An
    empty table gives an empty one. A text is worked on as a whole, by one worker. Texts are told
    apart by 64-bit hashes: among 10^10 different ones about 3 pairs are expected to be taken for
    equal.
    """
    node, key = F.xxhash64("text"), F.xxhash64("id", "text")
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in carry or []] or [F.lit(None).cast("int").alias("none")]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    docs = docs.select("row", "id", key.alias("rk"), node.alias("node"), "text")
    kinds = T.StructType([docs.schema["row"], docs.schema["id"], *T.StructType.fromDDL("rk long, node long, n_words long, bands array<long>").fields])
    profile = cut(docs.mapInArrow(_profile(bands, rows, shingle), kinds), "profile")
    nodes = profile.filter("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    keys = nodes.select("node", F.explode("bands").alias("k"))
    heads = keys.groupBy("k").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = cut(keys.join(heads, "k").select("k", "node", "leader"), "buckets")
    # the texts of members, each from one of the rows that have it
    named = profile.select("rk", "node").join(buckets.select("node").distinct(), "node").groupBy("node").agg(F.min("rk").alias("rk"))
    found = docs.select("rk", F.col("node").alias("of"), "text").join(named, "rk").filter("of = node")
    text_of = cut(found.select("node", "text").dropDuplicates(["node"]), "texts")
    pairs = buckets.filter("node != leader").select("node", "leader").distinct()
    tested = cut(similarities(pairs, text_of, shingle), "tested")
    links = tested.filter(F.col("sim") >= threshold).select("node", "leader")
    label = components(links.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    missed = similarities(_unlinked(buckets, label, tested, text_of, threshold, shingle), text_of, shingle).filter(F.col("sim") >= threshold).select("node", "leader")
    missed = cut(missed, "links")
    if not missed.isEmpty():
        label = components(links.unionByName(missed).select(F.col("node").alias("a"), F.col("leader").alias("b")))
    label = label.withColumnRenamed("label", "class")
    rows_ = profile.select("row", "id", "node", "n_words")
    first = rows_.filter("node is not null").groupBy("node").agg(F.min("id").alias("lowest"))
    first = first.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    lowest = first.groupBy("class").agg(F.min("lowest").alias("class_id"))
    named = cut(first.join(lowest, "class").select("node", "class", "class_id"), "classes")
    out = rows_.join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "class", "row")


def _unlinked(buckets: DataFrame, label: DataFrame, tested: DataFrame, text_of: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Pairs (node, leader) of different components that may be similar enough, of the texts of
    buckets with more than one component; one of them is outside the largest component of one.

    Texts compared with the same leader at distances that differ by more than 1 - threshold cannot
    be linked, as 1 - similarity is a metric."""
    rows = buckets.select("k", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = rows.groupBy("k", "label").agg(F.count("*").alias("n")).groupBy("k").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts"))
    rows = rows.join(parts.filter("parts > 1"), "k")
    nodes = rows.groupBy("node").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("minor"))
    base = tested.groupBy("node").agg(F.min(F.struct("leader", "sim")).alias("base"))
    nodes = nodes.join(base, "node", "left").select("node", "label", "minor", F.coalesce("base.leader", "node").alias("base"), F.coalesce("base.sim", F.lit(1.0)).alias("sim"))
    nodes = cut(nodes, "contested")
    elements = cut(text_of.join(nodes, "node").select("node", "label", "minor", "text").mapInArrow(_elements(shingle), "node long, label long, minor boolean, n int, e long, parity array<long>"), "elements")
    nodes = nodes.join(elements.filter(F.size("parity") > 0).select("node", "parity"), "node")
    df = elements.groupBy("e").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("node")).alias("at")).filter("df > 1")
    # of elements that stand in the same texts the first is enough: the first that two texts share is such
    df = df.withColumn("first", F.col("e") == F.min("e").over(Window.partitionBy("df", "at"))).drop("at")
    elements = elements.drop("parity")
    # an element of one text only comes first in it, and matches nothing
    ranked = elements.join(df, "e", "left").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "e")))
    prefix = ranked.filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("first"))
    prefix = cut(prefix.join(nodes.select("node", "base", "sim", "parity"), "node").select("e", "node", "label", "minor", "n", "r", "base", "sim", "parity"), "prefix")
    x = prefix.filter("minor").select("e", "node", "label", "n", "r", "base", "sim", "parity")
    y = prefix.select("e", *[F.col(c).alias(c + "2") for c in ("node", "label", "minor", "n", "r", "base", "sim", "parity")])
    least = F.ceil((F.col("n") + F.col("n2")) * (threshold / (1 + threshold)) - 1e-9)
    # two minor texts meet once, not once from either side
    once = ~F.col("minor2") | (F.col("node") < F.col("node2"))
    apart = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity2")[i])) for i in range(PARITY)), F.lit(0))
    near = once & (F.col("label") != F.col("label2")) & (F.col("r") <= F.col("n") - least + 1) & (F.col("r2") <= F.col("n2") - least + 1) & ((F.col("base") != F.col("base2")) | (F.abs(F.col("sim") - F.col("sim2")) <= 1 - threshold + 1e-9)) & (apart <= F.col("n") + F.col("n2") - 2 * least)
    found = x.join(y, (x.e == y.e) & near)
    return found.select(F.greatest("node", "node2").alias("node"), F.least("node", "node2").alias("leader")).distinct()


def _elements(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label, minor = (b.column(x) for x in ("node", "label", "minor"))
            for i, j, w in chunks(b.column("text")):
                d, s, c = shingles(w, shingle)
                n = np.bincount(d, c, j - i).astype(np.int32)
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                e = pair(np.repeat(s, c), nth.astype(U))
                d = np.repeat(d, c)
                at = pa.array(d + i)
                # the parities of a text stand in the row of its first element
                bits = np.zeros((j - i) * PARITY, U)
                np.bitwise_xor.at(bits, d * PARITY + (e >> U(6)).astype(np.int64) % PARITY, U(1) << (e & U(63)))
                text, first = np.unique(d, return_index=True)
                offs = np.zeros(len(d) + 1, np.int32)
                offs[first + 1] = PARITY
                values = bits.reshape(-1, PARITY)[text[np.argsort(first)]].reshape(-1).view(np.int64)
                parity = pa.ListArray.from_arrays(np.cumsum(offs, dtype=np.int32), values)
                yield pa.RecordBatch.from_arrays([node.take(at), label.take(at), minor.take(at), pa.array(n[d]), pa.array(e.view(np.int64)), parity], ["node", "label", "minor", "n", "e", "parity"])

    return run
