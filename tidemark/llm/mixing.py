"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to. The flow sends words of each pattern
to the quotas of its sources; the n-th copy of a pattern costs n - 1, so repeats are used only
where first copies do not suffice (augmenting epoch by epoch is the successive shortest path
method here, as costs lie on the pattern's own edges). The documents of a pattern then stand on
a line in seeded order, once per epoch, and each source takes the stretch that was routed to it.
Only patterns and sources reach the driver, never documents.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

WORD = r"[^\x20\x09-\x0D]+"


def capped_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of total by weight, none above most times its size; the excess goes on by weight."""
    out, open_ = {}, {s for s in sizes}
    left = float(total)
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s]}
        if not over:
            out |= {s: left * weights[s] / w for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def flow(patterns: dict[tuple, int], quotas: dict, epochs: int) -> dict[tuple[tuple, object], int]:
    """Words from each pattern to each source of it: most words, at least repetition.

    Each epoch is a flow by phases: shortest ways are numbered by one search, and all of them are
    filled before the next one. A pattern of one source needs a single step, whatever their number.
    """
    sent: dict = defaultdict(int)
    need, members = dict(quotas), defaultdict(list)
    for p in patterns:
        for s in p:
            members[s].append(p)
    for _ in range(epochs):
        room = {p: n for p, n in patterns.items() if n > 0}
        while _phase(room, need, members, sent):
            pass
    return {k: n for k, n in sent.items() if n}


def _phase(room: dict, need: dict, members: dict, sent: dict) -> bool:
    """Fill the shortest ways from patterns with room to sources in need; False if there is none.
    A way may go back over routes in use."""
    level: dict = {("p", p): 0 for p, n in room.items() if n > 0}
    todo, end = deque(level), None
    while todo:
        node = todo.popleft()
        if end is not None and level[node] >= end:
            break
        kind, x = node
        if kind == "s":
            new = [("p", p) for p in members[x] if sent[p, x] > 0]
        else:
            new = [("s", s) for s in x if s in need]
        for y in new:
            if y not in level:
                level[y] = level[node] + 1
                if y[0] == "s" and need[y[1]] > 0:
                    end = level[y]
                todo.append(y)
    if end is None:
        return False
    place: dict = defaultdict(int)  # edges before it lead nowhere
    for start in [y for y, n in level.items() if n == 0]:
        while room[start[1]] > 0:
            way = [start]
            while way:
                kind, x = way[-1]
                if kind == "s" and need[x] > 0:
                    break
                ways, i = (x if kind == "p" else members[x]), place[way[-1]]
                while i < len(ways):
                    y = ("s" if kind == "p" else "p", ways[i])
                    if level.get(y) == level[way[-1]] + 1 and (kind == "p" or sent[ways[i], x] > 0):
                        break
                    i += 1
                place[way[-1]] = i
                if i < len(ways):
                    way.append(y)
                else:
                    level[way.pop()] = -1
            if not way:
                break
            steps = list(zip(way, way[1:], strict=False))
            n = min([room[start[1]], need[way[-1][1]], *(sent[b[1], a[1]] for a, b in steps if a[0] == "s")])
            room[start[1]] -= n
            need[way[-1][1]] -= n
            for a, b in steps:
                if a[0] == "p":
                    sent[a[1], b[1]] += n
                else:
                    sent[b[1], a[1]] -= n
    return True


def with_sizes(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, size, digest): size is the number of words, 0 for a null text; digest names the text;
    row has the columns to carry."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("row"), size.alias("size"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"))


def mix(rows: DataFrame, members: str, quotas, epochs: int = 2, seed: int = 17, id_col: str = "doc_id", most_patterns: int = 1_000_000, bucket: int = 2000) -> DataFrame:
    """rows (row, size, digest, members: array of sources, null allowed in it) with taken (long)
    and routes (array of struct<source, taken>).

    quotas is a function of {source: size} to {source: words}; it and the flow run on the driver
    over sums by pattern, whose number is checked: more than most_patterns are an error. Rows
    without members are not taken. The seed and the id, or the text where the id is null, place a
    row on the line; rows of one id go by size and text, and equal rows are exchangeable, so reruns
    agree. A row is taken at most `epochs` times; the row at the end of a stretch is taken in part.
    An empty table gives an empty one.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("pattern", F.array_sort(F.array_distinct(F.transform(members, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~"))))))
    sums = marked.filter(F.size("pattern") > 0).groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError("too many membership patterns for the driver; merge sources first")
    real = {s: None if s == "~" else s[1:] for r in sums for s in r["pattern"]}
    sizes: dict = defaultdict(int)
    for r in sums:
        for s in r["pattern"]:
            sizes[real[s]] += r["size"]
    wanted = {s: int(round(q)) for s, q in quotas(dict(sizes)).items()}
    sent = flow({tuple(r["pattern"]): r["size"] for r in sums}, {s: wanted.get(v, 0) for s, v in real.items()}, epochs)
    plan = []
    for r in sums:
        p, at, stretches = tuple(r["pattern"]), 0, []
        for s in p:
            n = sent.get((p, s), 0)
            if n:
                stretches.append((real[s], at, at + n))
                at += n
        plan.append((list(p), r["size"], max(1, -(-r["n"] // bucket)), stretches))
    schema = "pattern array<string>, line long, buckets long, stretches array<struct<source string, lo long, hi long>>"
    plan = spark.createDataFrame(plan, schema)
    # the plan has a row for each pattern; documents of a hot one are dealt over its buckets
    dealt = marked.join(F.broadcast(plan) if len(sums) <= 10_000 else plan, "pattern", "left")
    dealt = dealt.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.col("digest")))))
    dealt = dealt.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.coalesce("buckets", F.lit(1)), 28))
    parts = cut(dealt.groupBy("pattern", "bucket").agg(F.sum("size").alias("part")), "lines")
    before = parts.withColumn("before", F.sum("part").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("part")).drop("part")
    inner = Window.partitionBy("pattern", "bucket").orderBy("key", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("upto", F.sum("size").over(inner)).join(before, ["pattern", "bucket"], "left")
    out = out.withColumn("c", F.col("before") + F.col("upto") - F.col("size"))

    def share(x):
        got = [F.greatest(F.lit(0), F.least(x["hi"], F.col("c") + F.col("size") + F.col("line") * e) - F.greatest(x["lo"], F.col("c") + F.col("line") * e)) for e in range(epochs)]
        return F.struct(x["source"].alias("source"), sum(got[1:], got[0]).alias("taken"))

    stretches = F.coalesce("stretches", F.array().cast("array<struct<source: string, lo: bigint, hi: bigint>>"))
    out = out.withColumn("routes", F.filter(F.transform(stretches, share), lambda x: x["taken"] > 0))
    taken = F.coalesce(F.aggregate("routes", F.lit(0).cast("long"), lambda a, x: a + x["taken"]), F.lit(0).cast("long"))
    return out.select("row", "size", taken.alias("taken"), "routes")


def mix_by_weight(df: DataFrame, text: str = "text", source: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """(row, size, source_size, target, taken, routes): sources in code point order, null last,
    weigh `weights` in turn and share `share` of all words, none above `most` times its size.

    A null text has no words; a null source is one of its own; a null or repeated id, ties and
    equal rows are as in mix; an empty table gives an empty one. The columns of df stand in the
    struct row, whatever their names. Words of a very long text are counted in its row.
    """
    rows = with_sizes(df, text, carry)
    if carry is not None:
        rows = cut(rows, "sizes")  # narrow; whole rows are not written but counted again
    rows = rows.withColumn("members", F.array(F.col(f"row.`{source}`")))
    made: dict = {}

    def quotas(sizes: dict) -> dict:
        names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
        made["sizes"], made["targets"] = sizes, capped_targets(sizes, w, share * sum(sizes.values()), most)
        return made["targets"]

    out = mix(rows, "members", quotas, most, seed, id_col)
    told = df.sparkSession.createDataFrame([(s, int(n), float(made["targets"][s])) for s, n in made["sizes"].items()], "of string, source_size long, target double")
    told = F.broadcast(told) if len(made["sizes"]) <= 100_000 else told
    return out.join(told, F.col(f"row.`{source}`").eqNullSafe(F.col("of")), "left").drop("of")
