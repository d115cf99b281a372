"""Tables of sorted runs, replicas and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY = 1_000_000


def run_tables(runs: DataFrame) -> DataFrame:
    """Manifest rows of runs (id, level, key): entries and key bounds."""
    return runs.groupBy("id", "level").agg(F.count("*").alias("entry_count"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def level_inputs(tables: DataFrame) -> DataFrame:
    """Level 1 tables whose keys overlap those of level 0 (one row of bounds is broadcast)."""
    span = tables.filter("level = 0").agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
    return tables.filter("level = 1").join(F.broadcast(span), (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi")), "left_semi")


def misplaced(tables: DataFrame) -> DataFrame:
    """Level 1 tables that do not come after the table before them. A manifest is small."""
    w = Window.orderBy("min_key", "id")
    return tables.filter("level = 1").withColumn("before", F.lag("max_key").over(w)).filter("min_key <= before").select("id", "before")


def table_order(tables: DataFrame) -> DataFrame:
    """Level 0 newest first, then level 1 by key."""
    return tables.withColumn("place", F.row_number().over(Window.orderBy("level", F.when(F.col("level") == 0, -F.col("id")), "min_key", "id")))


def unlisted(files: DataFrame, tables: DataFrame) -> DataFrame:
    return files.join(tables.select("id"), "id", "left_anti")


def missing(files: DataFrame, tables: DataFrame) -> DataFrame:
    return tables.join(files.select("id"), "id", "left_anti")


def approximate_keys(tables: DataFrame) -> DataFrame:
    """An upper bound: versions and deletes count."""
    return tables.agg(F.coalesce(F.sum("entry_count"), F.lit(0)).cast("long").alias("upper_bound"))


def replica_lag(progress: DataFrame, durable: Column) -> DataFrame:
    lag = F.when(F.col("connected") & (F.col("applied_lsn") <= durable), durable - F.col("applied_lsn"))
    return progress.withColumn("lag", lag)


def retention_base(base: Column, floor: Column, snapshot: Column, most: int = HISTORY) -> Column:
    """Where history starts: kept for the slowest connected replica within `most` records."""
    return F.when((floor < base) & (base - floor <= most), F.greatest(floor, snapshot)).otherwise(base)


def acknowledged(acks: DataFrame, lsn: int, needed: int) -> DataFrame:
    """Disconnected replicas count for what they have applied."""
    return acks.agg(F.count_if(F.col("applied_lsn") >= lsn).alias("acks")).select("acks", (F.col("acks") >= needed).alias("enough"))


def node_view(nodes: DataFrame, primary: DataFrame) -> DataFrame:
    """(name, node_id, applied_lsn, lag, state) of nodes (name, node_id, up) as the primary's
    progress table (node_id, applied_lsn, connected, lag) tells of them, by node id."""
    p = primary.select("node_id", "applied_lsn", "lag", F.coalesce("connected", F.lit(False)).alias("connected"), F.lit(True).alias("known"))
    out = nodes.join(p, "node_id", "left")
    streaming = F.col("up") & F.col("known") & F.col("connected") & F.col("lag").isNotNull()
    state = F.when(streaming & (F.col("lag") == 0), "synced").when(streaming, "lagging").otherwise("disconnected")
    return out.select("name", "node_id", "applied_lsn", F.when(streaming, F.col("lag")).alias("lag"), state.alias("state"))


def caught_up(told: DataFrame, own: DataFrame, expected: Column) -> DataFrame:
    """node_id of replicas with lag 0 at the primary (node_id, lag) that have themselves applied
    what is expected (node_id, applied_lsn)."""
    return told.filter("lag = 0").join(own.filter(F.col("applied_lsn") == expected), "node_id", "left_semi").select("node_id")


def history_check(replicas: DataFrame, log: DataFrame, base: Column, durable: Column) -> DataFrame:
    """(replica, decision) of replicas (replica, lsn, record_hash) by the log's hash at their
    number: an equi-join; the log holds (base, durable]."""
    out = replicas.join(log.select("lsn", F.col("record_hash").alias("known")), "lsn", "left")
    known = F.when((F.col("lsn") == 0) & (base == 0), 0).otherwise(F.col("known"))
    decision = F.when(F.col("lsn") > durable, "replica ahead").when(known.isNull(), "snapshot").when(known != F.col("record_hash"), "history differs").otherwise("stream")
    return out.select("replica", decision.alias("decision"))


def write_outcomes(writes: DataFrame, acks: DataFrame, needed: int, timeout_ms: int) -> DataFrame:
    """(lsn, acks, outcome) of writes (lsn, t_ms): OK if `needed` replicas acknowledged (replica,
    lsn, t_ms) it within the timeout. UNAVAILABLE leaves the outcome open: the write is durable here."""
    timed = acks.select("replica", "lsn", F.col("t_ms").alias("at"))
    got = writes.join(timed, "lsn", "left").groupBy("lsn").agg(F.count_distinct(F.when(F.col("at") - F.col("t_ms") <= timeout_ms, F.col("replica"))).alias("acks"))
    return got.select("lsn", "acks", F.when(F.col("acks") >= needed, "OK").otherwise("UNAVAILABLE").alias("outcome"))


def catch_up(acks: DataFrame, restarts: DataFrame) -> DataFrame:
    """(replica, catch_up_ms) from restarts (replica, t_ms, durable) to the first acknowledgement
    (replica, t_ms, applied_lsn) of what was durable then; null if there is none."""
    a = acks.select("replica", F.col("t_ms").alias("at"), "applied_lsn")
    near = (a.replica == restarts.replica) & (F.col("at") >= F.col("t_ms")) & (F.col("applied_lsn") >= F.col("durable"))
    out = restarts.join(a, near, "left").groupBy(restarts.replica, "t_ms").agg(F.min("at").alias("at"))
    return out.select("replica", (F.col("at") - F.col("t_ms")).alias("catch_up_ms"))


def stale(generations: DataFrame, current: DataFrame) -> DataFrame:
    """Generations (generation) other than the current one."""
    return generations.join(current, "generation", "left_anti")


def table_totals(tables: DataFrame) -> DataFrame:
    """One row: tables, those of level 0, entries and bytes (file_len)."""
    return tables.agg(F.count("*").alias("tables"), F.count_if(F.col("level") == 0).alias("level0"), F.sum("entry_count").alias("entries"), F.sum("file_len").alias("bytes"))


def table_errors(tables: DataFrame, next_id: int) -> DataFrame:
    """(id, error) of manifest rows (id, level, entry_count, min_key, max_key) that can't be; a
    manifest is small, ids are counted."""
    n = tables.groupBy("id").agg(F.count("*").alias("n"))
    error = (
        F.when((F.col("id") <= 0) | (F.col("id") >= next_id), "id out of range")
        .when(F.col("n") > 1, "duplicate id")
        .when(F.col("min_key") > F.col("max_key"), "min above max")
        .when(F.col("entry_count") < 1, "no entries")
    )
    return tables.join(n, "id").select("id", error.alias("error")).filter("error is not null")


def reclaim_plan(segments: DataFrame, boundary: Column, floor: Column) -> DataFrame:
    """Segments (first_lsn, last_lsn, bytes) with whether they may go: all of them at or before
    the boundary and before what the slowest replica needs."""
    return segments.withColumn("reclaim", F.col("last_lsn") <= F.least(boundary, F.coalesce(floor, boundary)))
