"""Telemetry of servers and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import bucket_upper, change, latency_bucket


def histogram(df: DataFrame, ns: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by, latency_bucket(ns).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_percentiles(hist: DataFrame, by: list[str], permille: list[int]) -> DataFrame:
    """(by, permille, upper_ns): upper bound of the bucket that holds the rank. At most 160 rows a group."""
    w = Window.partitionBy(*by).orderBy("bucket")
    rows = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    rows = rows.withColumn("permille", F.explode(F.array(*map(F.lit, permille))))
    rows = rows.withColumn("rank", F.greatest(F.lit(1), F.floor((F.col("total") * F.col("permille") + 999) / 1000)))
    return rows.filter("upto >= rank").groupBy(*by, "permille").agg(F.min("bucket").alias("bucket")).select(*by, "permille", bucket_upper(F.col("bucket")).alias("upper_ns"))


def ranked_values(df: DataFrame, by: list[str], value: str, rank: Column, steps: int = 200) -> DataFrame:
    """(by, value) at a rank (an expression of n, 1 is the least) of each group, exactly.

    Approximate percentiles, good to a ten-thousandth of the rows, bracket the rank by half a
    percent to either side; values below are counted, and only the distinct values of the bracket
    are put in order. So neither a hot group, nor an outlier, nor ties are sorted in one task.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    cuts = F.percentile_approx("v", [i / steps for i in range(steps + 1)], 10_000)
    near = rows.groupBy(*by).agg(F.count("*").alias("n"), cuts.alias("cuts")).withColumn("rank", rank)
    at = F.col("rank") / F.col("n") * steps
    near = near.select(*by, "rank", F.element_at("cuts", F.greatest(F.lit(1), F.floor(at).cast("int"))).alias("lo"), F.element_at("cuts", F.least(F.lit(steps + 1), F.ceil(at).cast("int") + 2)).alias("hi"))
    near = rows.join(near, by) if by else rows.crossJoin(F.broadcast(near))
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    counts = near.filter(F.col("v") <= F.col("hi")).groupBy(*by, "rank", F.when(inside, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first())))
    return upto.filter("v is not null and upto >= rank and upto - c < rank").select(*by, F.col("v").alias(value))


def nearest_rank(df: DataFrame, by: list[str], value: str, bps: int) -> DataFrame:
    return ranked_values(df, by, value, F.greatest(F.lit(1), F.floor((F.col("n") * bps + 9999) / 10000)).cast("long"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return ranked_values(df, by, value, (F.floor(F.col("n") / 2) + 1).cast("long"))


def median_range(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, least, median, most): the upper median between the extremes."""
    ends = df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return ends.join(upper_median(df, by, value).withColumnRenamed(value, "median"), by).select(*by, "least", "median", "most")


def _carried(rows: DataFrame, node: str, order: str, step: int, inner: Column, edge: Column, over: Column) -> DataFrame:
    """rows with `before`: what `inner` finds among earlier rows of the same node and bucket of
    `step` units, else what `over` finds among the edges (one per bucket, made by `edge`) of the
    buckets before. So no task holds all rows of a node. inner and over get their windows here."""
    rows = rows.withColumn("bucket", F.floor(F.col(order) / step))
    edges = rows.groupBy(node, "bucket").agg(edge.alias("edge"))
    edges = edges.select(node, "bucket", over.over(Window.partitionBy(node).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    rows = rows.withColumn("near", inner.over(Window.partitionBy(node, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(edges, [node, "bucket"]).drop("bucket")


def counter_rates(samples: DataFrame, node: str = "node", t: str = "t_ms", value: str = "value", step: int = 3_600_000) -> DataFrame:
    """(node, t, rate) between neighbours in time; none beside a missing sample, after a reset or without time passing."""
    last = F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    rows = _carried(samples, node, t, step, F.last(last), F.max_by(last, t), F.last("edge", True)).withColumn("p", F.coalesce("near", "far"))
    t0, v0 = F.col("p.t"), F.col("p.v")
    return rows.filter(v0.isNotNull() & F.col(value).isNotNull() & (F.col(value) >= v0) & (F.col(t) > t0)).select(node, t, ((F.col(value) - v0) * 1000.0 / (F.col(t) - t0)).alias("rate"))


def last_samples(samples: DataFrame, n: int = 300, node: str = "node", t: str = "t_ms") -> DataFrame:
    return samples.withColumn("r", F.row_number().over(Window.partitionBy(node).orderBy(F.desc(t)))).filter(F.col("r") <= n).drop("r")


def advancing(samples: DataFrame, node: str = "node", order: str = "seq", t: str = "t_ms", step: int = 1_000_000) -> DataFrame:
    """Samples later than all that came before them."""
    rows = _carried(samples, node, order, step, F.max(t), F.max(t), F.max("edge")).withColumn("seen", F.greatest("near", "far"))
    return rows.filter(F.col("seen").isNull() | (F.col(t) > F.col("seen"))).drop("seen", "near", "far")


def as_of(asked: DataFrame, samples: DataFrame, node: str = "node", t: str = "t_ms", value: str = "value", step: int = 3_600_000) -> DataFrame:
    """(node, t, value): the last sample at or before each time asked for; a null sample is null."""
    s = samples.select(node, (F.col(t) * 2).alias("o"), F.struct(F.col(value).alias("v")).alias("s"))
    # an odd place stands behind a sample of the same time
    q = asked.select(node, (F.col(t) * 2 + 1).alias("o"), F.lit(None).cast(s.schema["s"].dataType).alias("s"))
    rows = _carried(s.unionByName(q), node, "o", 2 * step, F.last("s", True), F.max_by("s", F.when(F.col("s").isNotNull(), F.col("o"))), F.last("edge", True))
    return rows.filter("o % 2 = 1").select(node, F.floor(F.col("o") / 2).cast("long").alias(t), F.coalesce("near", "far")["v"].alias(value))


def mix_medians(bench: DataFrame, by: list[str], figure: str) -> DataFrame:
    return bench.groupBy(*by).agg(F.median(figure).alias("median"))


def base_head(base: DataFrame, head: DataFrame, by: list[str], figure: str) -> DataFrame:
    """(by, before, after, change): base drives; change is null where before is 0 or missing."""
    out = base.select(*by, F.col(figure).alias("before")).join(head.select(*by, F.col(figure).alias("after")), by, "left")
    return out.withColumn("change", change(F.col("before"), F.col("after")))


def sync_stats(df: DataFrame, ns: str, failed: Column) -> DataFrame:
    """Count, errors, longest and mean (whole ns, then up to µs) of syncs; null before the first."""
    ok = F.when(~failed, F.col(ns))
    out = df.agg(F.count(ok).alias("syncs"), F.count_if(failed).alias("errors"), F.sum(ok).alias("total"), F.max(ok).alias("longest"))
    mean = F.floor(F.col("total") / F.col("syncs"))
    return out.select("syncs", "errors", F.when(F.col("syncs") > 0, F.floor((mean + 999) / 1000)).cast("long").alias("avg_us"), F.floor((F.col("longest") + 999) / 1000).cast("long").alias("max_us"))


def parse_stats(lines: DataFrame, text: str = "text") -> DataFrame:
    """name=value lines to rows; malformed lines are left out, `unknown` is null."""
    x = lines.select(*[c for c in lines.columns if c != text], F.explode(F.split(text, "\n")).alias("line")).filter(F.instr("line", "=") > 1)
    value = F.regexp_replace("line", "^[^=]*=", "")
    return x.select(*[c for c in lines.columns if c != text], F.substring_index("line", "=", 1).alias("name"), F.when(value != "unknown", value).alias("value"))
