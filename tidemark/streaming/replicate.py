"""Replication as a stream over the committed entries of a Parquet change log."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import record_hash
from ..operators.changelog import broken_links, gaps
from ..sources.store import LOG, Store

MARKER = "path string, first long, last long, hash long, segments array<array<long>>"


class Diverged(Exception):
    """What a primary sent does not continue what the replica has."""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where the session runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stream_commits(spark: SparkSession, store_path: str, files: int = 64) -> DataFrame:
    """Markers of log entries as they are committed, a bounded number at a time. Data of a torn
    commit has no marker, so it is never seen."""
    os.makedirs(f"{store_path}/commits", exist_ok=True)
    return spark.readStream.schema(MARKER).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.json").option("ignoreMissingFiles", True).json(f"{store_path}/commits")


def apply_batch(replica: Store, batch: DataFrame, mark: int | None = None, segments: list | None = None) -> int:
    """Apply changes behind what the replica has; known ones must have the same hash, and none may
    be missing or unlinked.

    Applying a batch again changes nothing, so a restarted stream delivers each change once. Only
    that part of the replica's log is read that the batch covers. mark and segments are those of
    a log entry that was appended in parts.
    """
    batch = batch.dropDuplicates(["lsn", "record_hash"])
    x = batch.agg(F.min("lsn").alias("lo"), F.max("lsn").alias("hi"), F.max_by("record_hash", "lsn").alias("mark")).first()
    if x.lo is None:
        return replica.m["lsn"]
    own = record_hash(F.col("lsn"), F.col("op"), F.col("key"), F.col("value"), F.col("prev_hash"))
    if not batch.filter(~F.col("record_hash").eqNullSafe(own)).isEmpty():
        raise Diverged("a record does not match its hash")
    have = replica.log(x.lo - 1).filter(F.col("lsn") <= x.hi).select("lsn", F.col("record_hash").alias("h"))
    if not batch.join(have, "lsn").filter(~F.col("record_hash").eqNullSafe(F.col("h"))).isEmpty():
        raise Diverged("a change differs from the one applied")
    if x.hi <= replica.m["lsn"]:
        return replica.m["lsn"]
    fresh = batch.filter(F.col("lsn") > replica.m["lsn"])
    if not gaps(fresh, replica.m["lsn"]).isEmpty():
        raise Diverged("changes are missing")
    starts = [tuple(s) for s in segments or [] if s[0] > replica.m["lsn"]]
    if not starts or starts[0][0] != replica.m["lsn"] + 1:
        starts = [(replica.m["lsn"] + 1, replica.m["hash"]), *starts]
    elif starts[0][1] != replica.m["hash"]:
        raise Diverged("the history before the changes differs")
    if not broken_links(fresh, starts=fresh.sparkSession.createDataFrame(starts, "lsn long, base long")).isEmpty():
        raise Diverged("changes do not link to each other")
    rows = fresh.select("lsn", "op", "key", "value", "prev_hash", "record_hash")
    return replica._append(rows, replica.m["lsn"] + 1, x.hi, x.mark if mark is None else mark, [list(s) for s in starts])


def bootstrap(replica: Store, primary: Store) -> int:
    """Put a replica on the primary's state at its flush boundary, in one commit."""
    m = primary.m
    if m["cluster"] and replica.m["cluster"] not in (None, m["cluster"]):
        raise Diverged("cluster mismatch")
    replica.install(primary.flushed_state(), m["flushed"], m["flushed_hash"], m["cluster"])
    return m["flushed"]


def apply_entries(replica: Store, primary: Store, entries: list[dict]) -> int:
    """Apply log entries in order, each as the commit it was. One that is reclaimed, or starts
    behind a gap, makes the replica start over from the primary's state."""
    replica.m["cluster"] = replica.m["cluster"] or primary.m["cluster"]
    listed = {x["path"] for x in primary.m["log"]}
    for x in sorted(entries, key=lambda x: x["first"]):
        if x["last"] <= replica.m["lsn"] and x["path"] not in listed:
            continue
        if x["path"] not in listed or x["first"] > replica.m["lsn"] + 1:
            if primary.m["flushed"] <= replica.m["lsn"]:
                raise Diverged("changes are missing")
            bootstrap(replica, primary)
            if x["path"] not in listed:
                continue
        apply_batch(replica, primary._read([x], LOG), x["hash"], x["segments"])
    return replica.m["lsn"]


def replicate(primary_path: str, replica: Store, checkpoint: str, files: int = 64):
    """Apply all that is there and stop; call again, or use another trigger, to follow on.

    The replica is greeted first: one of another cluster, ahead or with another history stops
    here, one whose next records are reclaimed gets the primary's state.
    """
    primary = Store(replica.spark, primary_path)
    decision = primary.greet(replica.m["cluster"], replica.m["lsn"], replica.m["hash"])
    if decision == "snapshot" or (replica.m["lsn"] < primary.m["lsn"] and primary.records_after(replica.m["lsn"]) is None):
        bootstrap(replica, primary)
    elif decision != "stream":
        raise Diverged(decision)

    def on(batch: DataFrame, _: int) -> None:
        # at most `files` markers; the changes themselves are read from the entries they name
        entries = [r.asDict(True) for r in batch.collect()]
        apply_entries(replica.refresh(), Store(replica.spark, primary_path), entries)

    q = stream_commits(replica.spark, primary_path, files).writeStream.foreachBatch(on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return replica.refresh()


def live_view(changes: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The newest change of each key as it streams in, deletes as op 2.

    State is kept in RocksDB; each batch writes the keys it changed as Parquet below `out` (in
    update mode, so the whole state is never sent), and the view is the newest row of each key.
    out and checkpoint are folders that all executors share.
    """
    spark = changes.sparkSession
    found = changes.groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "lsn").alias("v")).select("key", "v.lsn", "v.op", "v.value")

    def on(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = found.writeStream.outputMode("update").foreachBatch(on).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)
    q.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(out)
    return rows.groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "lsn").alias("v")).select("key", "v.lsn", "v.op", "v.value")
