"""Reads of the key-value relation that a change log or sorted runs define.

Every read is one partial aggregate by key and filters; nothing is ordered but the pages asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checksums import little
from ..functions.scalars import MAX_LIMIT, PAGE_BYTES, pair_length


def in_range(key: Column, start=None, end=None) -> Column:
    """start <= key < end; a missing bound is open."""
    found = F.lit(True)
    if start is not None:
        found = key >= F.lit(start)
    if end is not None:
        found = found & (key < F.lit(end))
    return found


def newest(changes: DataFrame, order: str = "lsn") -> DataFrame:
    """(key, op, value): the newest change of each key, deletes too. Map-side combined."""
    return changes.groupBy("key").agg(F.max_by(F.struct("op", "value"), order).alias("v")).select("key", "v.op", "v.value")


def live(changes: DataFrame, order: str = "lsn") -> DataFrame:
    return newest(changes, order).filter("op = 1").select("key", "value")


def state_at(changes: DataFrame, lsn: int) -> DataFrame:
    return live(changes.filter(F.col("lsn") <= lsn))


def replay(snapshot: DataFrame, snapshot_lsn: int, changes: DataFrame) -> DataFrame:
    """State from a snapshot and the changes after it; only those are read."""
    base = snapshot.select(F.lit(snapshot_lsn).cast("long").alias("lsn"), F.lit(1).alias("op"), "key", "value")
    return live(base.unionByName(changes.filter(F.col("lsn") > snapshot_lsn).select("lsn", F.col("op").cast("int").alias("op"), "key", "value")))


def get(changes: DataFrame, key) -> DataFrame:
    """The filter on the key is below the aggregate and reaches the scan."""
    return live(changes.filter(F.col("key") == F.lit(key)))


def exists(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found) of asked keys; values are not read."""
    there = newest(changes.select("key", "lsn", "op", F.lit(None).cast("string").alias("value"))).filter("op = 1").select("key", F.lit(True).alias("found"))
    return keys.select("key").distinct().join(there, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def scan_page(state: DataFrame, start=None, end=None, limit: int = MAX_LIMIT, after=None) -> DataFrame:
    """(key, value, more): the first rows of a range in key order; more tells of a further one.

    after continues behind a key. One top-k of limit + 1 rows.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    rows = state.filter(in_range(F.col("key"), start, end))
    if after is not None:
        rows = rows.filter(F.col("key") > F.lit(after))
    top = rows.orderBy("key").limit(limit + 1)
    w = Window.orderBy("key")
    top = top.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    return top.filter(F.col("r") <= limit).select("key", "value", (F.col("n") > limit).alias("more"))


def cut_page(page: DataFrame, budget: int = PAGE_BYTES) -> DataFrame:
    """A page cut at the first pair that no longer fits the budget; then there is more."""
    w = Window.orderBy("key")
    rows = page.withColumn("sum", F.lit(5) + F.sum(pair_length(F.col("key"), F.col("value"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("over", F.max(F.col("sum") > budget).over(Window.partitionBy()))
    return rows.filter(F.col("sum") <= budget).select("key", "value", (F.col("more") | F.col("over")).alias("more"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """(key, op, value) of runs with source_rank, 0 the newest."""
    return newest(runs.withColumn("age", -F.col("source_rank")), "age")


def compact(runs: DataFrame) -> DataFrame:
    return merge_runs(runs).filter("op = 1").select("key", "value")


def overlay(state: DataFrame, pending: DataFrame) -> DataFrame:
    """State as a transaction sees it: its own newest change of a key, deletes too, comes first."""
    own = newest(pending).select("key", F.struct("op", "value").alias("own"))
    both = state.join(own, "key", "full_outer")
    return both.filter("own is null or own.op = 1").select("key", F.when(F.col("own").isNotNull(), F.col("own.value")).otherwise(F.col("value")).alias("value"))


def duplicate_keys(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def same_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only one side has, and whether none."""
    tagged = a.select("key", "value", F.lit(1).alias("side")).unionByName(b.select("key", "value", F.lit(-1).alias("side")))
    left = tagged.groupBy("key", "value").agg(F.sum("side").alias("d"))
    return left.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).cast("long").alias("differing")).select("differing", (F.col("differing") == 0).alias("equal"))


def not_ascending(rows: DataFrame, place: str = "place") -> DataFrame:
    """Places whose key is not above that of the place before: rows of a run or block are numbered,
    so neighbours meet by number and no window spans the run."""
    before = rows.select((F.col(place) + 1).alias(place), F.col("key").alias("before"))
    return rows.join(before, place).filter("key <= before").select(place, "key", "before")


def state_errors(pairs: DataFrame, entry_count: int) -> DataFrame:
    """One row: entries, keys that stand more than once, and what is wrong with a whole state."""
    n = pairs.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count_if(F.col("n") > 1).alias("repeated"))
    error = F.when(F.col("repeated") > 0, "duplicate key").when(F.col("entries") != entry_count, "entry count differs")
    return n.select("entries", "repeated", error.alias("error"))


def page_bytes(page: DataFrame) -> DataFrame:
    """One row: a page (key, value, more) as bytes: count, more, and for each pair in key order the
    lengths and the bytes. A page has at most 10,000 pairs and 1 MB."""
    k, v = (F.col(c).cast("binary") for c in ("key", "value"))
    pair = F.concat(little(F.octet_length(k), 4), little(F.octet_length(v), 4), k, v)
    got = page.agg(F.count("*").alias("n"), F.max(F.col("more").cast("int")).alias("more"), F.array_sort(F.collect_list(F.struct(k.alias("key"), F.hex(pair).alias("pair")))).alias("pairs"))
    body = F.unhex(F.array_join(F.transform("pairs", lambda x: x["pair"]), ""))
    return got.select(F.concat(little(F.col("n"), 4), little(F.coalesce("more", F.lit(0)), 1), body).alias("page"))
