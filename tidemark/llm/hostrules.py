"""Quality rules of texts and of their hosts, with DataFrame functions only.

Rules are computed once per text inside its row (no shuffle of words). Failures are then summed
by host (combined before the shuffle, so a hot host is a few rows), the rate of each host is
shrunk by a beta prior fitted to all hosts by moments, and the verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def with_rules(df: DataFrame, text: str = "text", n: int = 5) -> DataFrame:
    """df with the struct `rule`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    t = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    worded = F.filter(F.split(t, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    rows = rows.withColumn("h", F.transform(word_array(t), lambda x: F.xxhash64(x))).withColumn("lines", worded)
    gram = lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(n)])
    rows = rows.withColumn("g", F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), gram)).otherwise(F.array().cast("array<bigint>")))
    # windows that stand more than once: sorted with their places, equal neighbours
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, j: (F.get("s", j - 1)["x"] == e["x"]) | (F.get("s", j + 1)["x"] == e["x"])
    rows = rows.withColumn("p", F.array_sort(F.transform(F.filter("s", lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"])))
    step = lambda x, j: F.least(F.lit(n), F.coalesce(F.get("p", j + 1) - x, F.lit(n)))
    covered = F.aggregate(F.transform("p", step), F.lit(0).cast("long"), lambda a, x: a + x)
    rule = F.struct(
        F.size("h").cast("long").alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return rows.select("row", rule.alias("rule"))


def host_rates(hosts: DataFrame, ratio: float, sigmas: float, most: float) -> DataFrame:
    """(of, host_rate, host_failed) of hosts (host, n, f).

    The beta prior has the mean of all rows and a weight by the moments of the hosts' rates. A
    host fails if its posterior rate, less `sigmas` posterior deviations, is over `ratio` times
    the rate of all rows, or over `most`: a host with few rows needs more than a bad rate, a large
    one is not failed for a difference that is sure but small.
    """
    # one row for all hosts
    x = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.var_pop(F.col("f") / F.col("n")).alias("v"), F.avg(1 / F.col("n")).alias("w")).first()
    m = (x.f + 0.5) / (x.n + 1) if x.n else 0.5
    between = max((x.v or 0.0) - m * (1 - m) * (x.w or 0.0), 1e-6)
    size = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
    rate = (F.col("f") + m * size) / (F.col("n") + size)
    out = hosts.select(F.col("host").alias("of"), rate.alias("host_rate"), (F.col("n") + size + 1).alias("weight"))
    low = F.col("host_rate") - sigmas * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / F.col("weight"))
    return out.select("of", "host_rate", (low > min(ratio * m, most)).alias("host_failed"))


def host_rules(df: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None, ratio: float = 1.5, sigmas: float = 2.0, most: float = 0.5, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """(row, rule, base_failed, host_rate, host_failed, kept): `row` holds the columns to carry,
    all by default, whatever their names.

    Rules are computed once: rows are written with them, hosts are summed from that table and
    their verdicts (see host_rates) are joined back. A null text has no words and fails; a null
    host is a host of its own; equal rows count each; an empty table gives an empty one. A text
    is judged as a whole in its row, whatever its length. The table of hosts is joined by size:
    broadcast if small, else a join that Spark may split.
    """
    rows = with_rules(df, text)
    failed = (F.col("rule.n_words") < min_words) | (F.col("rule.n_repeat_words") * 100 > F.col("rule.n_words") * repeat_percent)
    kept = F.struct(*[F.col(f"row.`{c}`").alias(c) for c in carry or df.columns]).alias("row")
    rows = cut(rows.select(kept, F.col(f"row.`{host}`").alias("host"), "rule", failed.alias("base_failed")), "rules")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("f"))
    verdict = cut(host_rates(cut(hosts, "hosts"), ratio, sigmas, most), "verdicts")
    out = rows.join(verdict, rows.host.eqNullSafe(verdict.of), "left")
    return out.select("row", "rule", "base_failed", "host_rate", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
