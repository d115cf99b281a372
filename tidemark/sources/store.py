"""A key-value store of Parquet files below one directory, committed by a manifest.

log/ holds committed groups, runs/ key-sorted tables, snapshots/ whole states. A version of the
manifest lists what counts; it is written beside the others and made current by one rename, under
a lock, and only if nobody else has committed since it was read. Files that no manifest lists are
invisible (a torn commit), and are dropped by collect_garbage. commits/ holds a marker for each
log entry, written after its commit: what a replication stream follows. Readers keep the manifest
they opened. The manifest is a local or mounted path: rename and lock must work there.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checksums import crc64_one
from ..functions.scalars import MAX_GROUP, MAX_LIMIT
from ..operators import kv
from ..operators.changelog import broken_links, chain_step, chained, gaps
from ..plans.decisions import greet

LOG = "lsn long, op int, key binary, value binary, prev_hash long, record_hash long"
RUN = "lsn long, op int, key binary, value binary"
EMPTY = {"version": 0, "cluster": None, "lsn": 0, "hash": 0, "log": [], "runs": [], "snapshots": [], "flushed": 0, "flushed_hash": 0, "next": 1}


class Corrupt(Exception):
    """The store is not whole; nothing is read as missing instead."""


class Conflict(Exception):
    """Another writer has committed since this one read the manifest; nothing was committed."""


class Exhausted(Exception):
    """A budget does not allow the step; nothing was changed."""


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _links(base: int):
    """Adds prev_hash and record_hash to partitions in order; the first record of each links to base."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = base
        for x in parts:
            before, own = [], []
            for n, op, k, v in zip(x["lsn"], x["op"], x["key"], x["value"], strict=True):
                before.append(h)
                h = chain_step(int(n), int(op), bytes(k), None if v is None else bytes(v), h)
                own.append(h)
            yield x.assign(prev_hash=before, record_hash=own)[["lsn", "op", "key", "value", "prev_hash", "record_hash", "p"]]

    return run


class Store:
    def __init__(self, spark: SparkSession, path: str, level0: int = 4, table_bytes: int = 8 << 20):
        self.spark, self.path, self.level0, self.table_bytes = spark, path, level0, table_bytes
        os.makedirs(path, exist_ok=True)
        self.seen: set[str] = set()
        self.m = self._load()

    # manifest
    def _load(self) -> dict:
        current = f"{self.path}/CURRENT"
        if not os.path.exists(current):
            return json.loads(json.dumps(EMPTY))
        with open(current) as f:
            name = f.read().strip()
        try:
            with open(f"{self.path}/{name}") as f:
                m = json.load(f)
        except (OSError, ValueError) as e:
            raise Corrupt(f"manifest {name}: {e}") from e
        error = manifest_error(m)
        if error:
            raise Corrupt(f"manifest {name}: {error}")
        listed = {x["path"] for x in [*m["log"], *m["runs"], *m["snapshots"]]}
        for x in listed - self.seen:
            if not os.path.exists(f"{self.path}/{x}" if x.endswith(".parquet") else f"{self.path}/{x}/_SUCCESS"):
                raise Corrupt(f"{x} is listed and not there")
        self.seen = listed
        return m

    def _write(self, file: str, text: str) -> None:
        attempt = f"{self.path}/{file}.{uuid.uuid4().hex}.tmp"
        with open(attempt, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(attempt, f"{self.path}/{file}")

    def _publish(self, m: dict) -> None:
        with open(f"{self.path}/LOCK", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            found = self._load()["version"]
            if found != m["version"]:
                raise Conflict(f"version {found} is current, not {m['version']}")
            m["version"] += 1
            m["cluster"] = m["cluster"] or uuid.uuid4().hex
            name = f"MANIFEST-{m['version']:012d}"
            self._write(name, json.dumps(m))
            self._write("CURRENT", name)
            self.m = m
            # markers tell a stream of what is committed; one that a crash left out is made up for here
            os.makedirs(f"{self.path}/commits", exist_ok=True)
            for x in m["log"]:
                if not os.path.exists(f"{self.path}/commits/{x['first']:016d}.json"):
                    self._write(f"commits/{x['first']:016d}.json", json.dumps(x))

    def _copy(self) -> dict:
        return json.loads(json.dumps(self.m))

    def refresh(self) -> Store:
        self.m = self._load()
        return self

    def _read(self, entries: list[dict], schema: str) -> DataFrame:
        paths = [f"{self.path}/{x['path']}" for x in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writes
    def commit(self, changes: list[tuple[int, bytes, bytes | None]]) -> int:
        """One atomic group of at most 64 changes (op, key, value); returns its last number."""
        if not 1 <= len(changes) <= MAX_GROUP:
            raise ValueError("a group has 1 to 64 changes")
        rows = [(n, op, bytearray(k), None if v is None else bytearray(v), p, h) for n, op, k, v, p, h in chained(changes, self.m["lsn"], self.m["hash"])]
        return self._append(self.spark.createDataFrame(rows, LOG).coalesce(1), rows[0][0], rows[-1][0], rows[-1][5])

    def append(self, changes: DataFrame) -> int:
        """A batch (order, op, key, value) of any size; numbers follow `order`. The batch is
        range-partitioned, counted, then numbered by partition, so no task sees all of it.

        Records are chained within each partition; its first record links to the hash before the
        batch, and the batch's own hash covers the last hashes of all partitions in order. These
        places are in the manifest (segments), where broken_links looks them up.
        """
        base = f"{self.path}/tmp-{uuid.uuid4().hex}"
        changes.repartitionByRange("order").sortWithinPartitions("order").select(F.spark_partition_id().alias("p"), "*").write.parquet(base)
        rows = self.spark.read.parquet(base)
        counts = sorted((r.p, r.n) for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect())
        starts, at = [], self.m["lsn"]
        for p, n in counts:
            starts.append((p, at))
            at += n
        if at == self.m["lsn"]:
            shutil.rmtree(base)
            return at
        first = self.spark.createDataFrame(starts, "p int, start long")
        numbered = rows.join(F.broadcast(first), "p").withColumn("lsn", F.col("start") + F.row_number().over(Window.partitionBy("p").orderBy("order")))
        numbered = numbered.select("lsn", F.col("op").cast("int").alias("op"), F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "p")
        numbered = numbered.repartitionByRange(len(starts), "p").sortWithinPartitions("lsn").mapInPandas(_links(self.m["hash"]), LOG + ", p int")
        last = self._append(numbered, self.m["lsn"] + 1, at, None)
        shutil.rmtree(base)
        return last

    def _append(self, rows: DataFrame, first: int, last: int, mark: int | None, segments: list | None = None) -> int:
        m = self._copy()
        where = f"log/{first:016d}-{uuid.uuid4().hex[:8]}"
        rows.drop("p").write.parquet(f"{self.path}/{where}")
        if mark is None:
            # a file is a partition: its first record and its last hash
            ends = self._read([{"path": where}], LOG).groupBy(F.input_file_name().alias("f")).agg(F.min("lsn").alias("lo"), F.max_by("record_hash", "lsn").alias("h"))
            ends = sorted((r.lo, r.h) for r in ends.collect())
            segments = [[lo, m["hash"]] for lo, _ in ends]
            mark = signed(crc64_one(b"".join((h % 2**64).to_bytes(8, "little") for _, h in ends)))
        m["log"].append({"path": where, "first": first, "last": last, "hash": mark, "segments": segments or [[first, m["hash"]]]})
        m["lsn"], m["hash"] = last, mark
        self._publish(m)
        return last

    # reads
    def log(self, after: int = 0) -> DataFrame:
        """Retained changes after a number; only log entries that have any are opened."""
        return self._read([x for x in self.m["log"] if x["last"] > after], LOG).filter(F.col("lsn") > after)

    def broken_links(self) -> DataFrame:
        """Records of the retained log that do not link to the one before, or to their segment."""
        starts = [tuple(x) for e in self.m["log"] for x in e["segments"]]
        return broken_links(self.log(), starts=self.spark.createDataFrame(starts, "lsn long, base long"))

    def hash_at(self, lsn: int) -> int | None:
        """The record hash at a number that is retained, or at a boundary; None where it is gone."""
        if lsn in (0, self.m["lsn"], self.m["flushed"]):
            return 0 if lsn == 0 else self.m["hash"] if lsn == self.m["lsn"] else self.m["flushed_hash"]
        for x in self.m["log"]:
            if x["last"] == lsn:
                return x["hash"]
            if x["first"] <= lsn < x["last"]:
                return self._read([x], LOG).filter(F.col("lsn") == lsn).first().record_hash
        return None

    def records_after(self, lsn: int, limit: int = MAX_GROUP) -> DataFrame | None:
        """The next records; None if they are reclaimed, or lsn is ahead of what is committed."""
        oldest = self.m["log"][0]["first"] - 1 if self.m["log"] else self.m["lsn"]
        if not oldest <= lsn <= self.m["lsn"]:
            return None
        return self.log(lsn).orderBy("lsn").limit(limit)

    def greet(self, cluster: str | None, lsn: int, mark: int) -> str:
        """What this primary does with a replica that has applied up to lsn with the hash mark."""
        known = self.hash_at(lsn) if lsn <= self.m["lsn"] else None
        return greet(cluster in (None, self.m["cluster"]), lsn, self.m["lsn"], known, mark)

    def changes(self) -> DataFrame:
        """Runs and the log behind them: what the newest version of each key is taken from."""
        tail = self.log(self.m["flushed"]).select("lsn", "op", "key", "value")
        return self._read(self.m["runs"], RUN).unionByName(tail)

    def state(self) -> DataFrame:
        return kv.live(self.changes())

    def _pruned(self, start: bytes | None, end: bytes | None) -> DataFrame:
        keep = [x for x in self.m["runs"] if (start is None or bytes.fromhex(x["max"]) >= start) and (end is None or bytes.fromhex(x["min"]) < end)]
        tail = self.log(self.m["flushed"]).select("lsn", "op", "key", "value")
        return self._read(keep, RUN).unionByName(tail)

    def get(self, key: bytes) -> DataFrame:
        return kv.get(self._pruned(key, key + b"\0"), bytearray(key))

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = MAX_LIMIT, after: bytes | None = None) -> DataFrame:
        rows = self._pruned(after or start, end).filter(kv.in_range(F.col("key"), start and bytearray(start), end and bytearray(end)))
        return kv.scan_page(kv.live(rows), None, None, limit, after and bytearray(after))

    # maintenance
    def flush(self, parts: int | None = None) -> None:
        """The log behind the runs becomes key-sorted level 0 runs, deletes kept."""
        if self.m["flushed"] == self.m["lsn"]:
            return
        rows = self.log(self.m["flushed"]).groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "lsn").alias("v")).select("v.lsn", "v.op", "key", "v.value")
        m = self._copy()
        m["runs"] += self._write_run(rows, 0, m, parts, True)
        m["flushed"], m["flushed_hash"] = m["lsn"], m["hash"]
        self._publish(m)

    def _write_run(self, rows: DataFrame, level: int, m: dict, parts: int | None, whole: bool = False) -> list[dict]:
        """Sorted tables of disjoint key ranges: a table for each file, or one for all of them."""
        where = f"runs/{m['next']:08d}-{uuid.uuid4().hex[:8]}"
        rows = rows.repartitionByRange(parts, "key") if parts else rows.repartitionByRange("key")
        rows.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{where}")
        file = F.lit(where) if whole else F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
        found = self._read([{"path": where}], RUN).groupBy(file.alias("f")).agg(F.count("*").alias("n"), F.lower(F.hex(F.min("key"))).alias("lo"), F.lower(F.hex(F.max("key"))).alias("hi")).collect()
        out = []
        for x in sorted(found, key=lambda x: x.lo):
            path = where if whole else f"{where}/{x.f}"
            files = [f"{self.path}/{path}"] if not whole else [f"{self.path}/{where}/{n}" for n in os.listdir(f"{self.path}/{where}") if n.endswith(".parquet")]
            out.append({"path": path, "id": m["next"], "level": level, "entries": x.n, "min": x.lo, "max": x.hi, "bytes": sum(map(os.path.getsize, files))})
            m["next"] += 1
        return out

    def compact(self, force: bool = False, parts: int | None = None) -> bool:
        """Level 0 with the level 1 tables that overlap it becomes tables of level 1 without deletes,
        of about table_bytes each."""
        level0 = [x for x in self.m["runs"] if x["level"] == 0]
        if not level0 or (len(level0) < self.level0 and not force):
            return False
        lo, hi = min(x["min"] for x in level0), max(x["max"] for x in level0)
        inputs = level0 + [x for x in self.m["runs"] if x["level"] == 1 and x["max"] >= lo and x["min"] <= hi]
        rows = self._read(inputs, RUN).groupBy("key").agg(F.max_by(F.struct("lsn", "op", "value"), "lsn").alias("v")).filter("v.op = 1").select("v.lsn", "v.op", "key", "v.value")
        m = self._copy()
        gone = {x["path"] for x in inputs}
        m["runs"] = [x for x in m["runs"] if x["path"] not in gone]
        m["runs"] += self._write_run(rows, 1, m, parts or max(1, -(-sum(x["bytes"] for x in inputs) // self.table_bytes)))
        self._publish(m)
        return True

    def bytes(self, kinds: tuple[str, ...] = ("log", "runs", "snapshots")) -> int:
        """Size of what the manifest lists."""
        total = 0
        for x in (x for k in kinds for x in self.m[k]):
            p = f"{self.path}/{x['path']}"
            total += os.path.getsize(p) if os.path.isfile(p) else sum(os.path.getsize(f"{p}/{n}") for n in os.listdir(p))
        return total

    def snapshot(self, budget: int | None = None) -> int:
        """A whole state, written, read back and compared before it counts. With a budget, nothing
        is written unless log and runs, which the state is not larger than, fit in it once more."""
        if budget is not None and self.bytes() + self.bytes(("log", "runs")) > budget:
            raise Exhausted("a snapshot may not fit the disk budget")
        m = self._copy()
        where = f"snapshots/{m['lsn']:016d}-{uuid.uuid4().hex[:8]}"
        state = self.state()
        state.write.parquet(f"{self.path}/{where}")
        if not kv.same_relation(self._read([{"path": where}], "key binary, value binary"), state).first().equal:
            raise Corrupt("a snapshot does not read back as written")
        m["snapshots"].append({"path": where, "lsn": m["lsn"], "hash": m["hash"]})
        self._publish(m)
        return m["lsn"]

    def reclaim(self, keep_after: int | None = None) -> None:
        """Drop log entries that the runs or the newest snapshot hold, but for those behind
        keep_after (what a slow replica still needs); then files not listed."""
        m = self._copy()
        kept = max([m["flushed"], *(x["lsn"] for x in m["snapshots"])])
        if kept > m["flushed"]:
            raise ValueError("flush before reclaiming behind a snapshot")
        upto = m["flushed"] if keep_after is None else min(m["flushed"], keep_after)
        m["log"] = [x for x in m["log"] if x["last"] > upto]
        m["snapshots"] = m["snapshots"][-1:]
        self._publish(m)
        self.collect_garbage()

    def maintain(self, flush_bytes: int = 4 << 20) -> list[str]:
        """What is due, in order: a flush of a log of flush_bytes, a compaction."""
        done = []
        tail = [x for x in self.m["log"] if x["last"] > self.m["flushed"]]
        if tail and sum(os.path.getsize(f"{self.path}/{x['path']}/{n}") for x in tail for n in os.listdir(f"{self.path}/{x['path']}")) >= flush_bytes:
            self.flush()
            done.append("flush")
        if self.compact():
            done.append("compact")
        return done

    def collect_garbage(self) -> list[str]:
        """Drop what the manifest does not list: data of torn commits and of the past, attempts,
        markers of reclaimed log entries, and manifests but for the current one."""
        listed = {"/".join(x["path"].split("/")[:2]) for x in [*self.m["log"], *self.m["runs"], *self.m["snapshots"]]}
        gone = []
        for kind in ("log", "runs", "snapshots"):
            for name in os.listdir(f"{self.path}/{kind}") if os.path.isdir(f"{self.path}/{kind}") else []:
                if f"{kind}/{name}" not in listed:
                    gone.append(f"{kind}/{name}")
        markers = {f"{x['first']:016d}.json" for x in self.m["log"]}
        if os.path.isdir(f"{self.path}/commits"):
            gone += [f"commits/{n}" for n in os.listdir(f"{self.path}/commits") if not n.startswith(".") and n not in markers]
        current = f"MANIFEST-{self.m['version']:012d}"
        gone += [n for n in os.listdir(self.path) if n.startswith("tmp-") or n.endswith(".tmp") or (n.startswith("MANIFEST-") and n < current)]
        for x in gone:
            p = f"{self.path}/{x}"
            shutil.rmtree(p) if os.path.isdir(p) else os.remove(p)
        return gone

    # whole states from elsewhere
    def ingest(self, pairs: DataFrame, lsn: int, mark: int, cluster: str | None = None) -> None:
        """Load a state (key, value) at a number into an empty store."""
        if self.m["lsn"] or self.m["runs"]:
            raise ValueError("the store is not empty")
        self.install(pairs, lsn, mark, cluster)

    def install(self, pairs: DataFrame, lsn: int, mark: int, cluster: str | None = None) -> None:
        """Replace all that the store holds by a state, in one commit; what it held is garbage then."""
        m = self._copy()
        rows = pairs.select(F.lit(lsn).cast("long").alias("lsn"), F.lit(1).alias("op"), "key", "value")
        m |= {"cluster": cluster or m["cluster"], "lsn": lsn, "hash": mark, "flushed": lsn, "flushed_hash": mark, "log": [], "snapshots": []}
        m["runs"] = self._write_run(rows, 1, m, None)
        self._publish(m)

    def recover(self) -> DataFrame:
        """State from the newest snapshot that has a whole tail, else from runs and log."""
        for x in sorted(self.m["snapshots"], key=lambda x: -x["lsn"]):
            tail = self.log(x["lsn"])
            if tail.isEmpty() and self.m["lsn"] > x["lsn"]:
                continue
            if gaps(tail, x["lsn"]).isEmpty():
                return kv.replay(self._read([x], "key binary, value binary"), x["lsn"], tail)
        if not gaps(self.log(self.m["flushed"]), self.m["flushed"]).isEmpty():
            raise Corrupt("the log has a gap")
        return self.state()

    def flushed_state(self) -> DataFrame:
        """State at the flush boundary: runs only."""
        return kv.live(self._read(self.m["runs"], RUN))

    def stats(self) -> DataFrame:
        runs, m = self.m["runs"], self.m
        at = max([0, *(x["lsn"] for x in m["snapshots"])])
        row = (m["lsn"], m["flushed"], at, len(runs), sum(x["level"] == 0 for x in runs), sum(x["entries"] for x in runs), sum(x["bytes"] for x in runs), m["lsn"] - max(at, m["flushed"]))
        return self.spark.createDataFrame([row], "current_lsn long, flushed_lsn long, snapshot_lsn long, tables int, level0_tables int, approximate_keys long, table_bytes long, wal_entries long")


def manifest_error(m: dict) -> str | None:
    """Why a manifest can't be, or None."""
    ids = [x["id"] for x in m["runs"]]
    if any(not 0 < i < m["next"] for i in ids) or len(set(ids)) < len(ids):
        return "invalid or duplicate table id"
    if any(x["min"] > x["max"] or x["entries"] < 1 for x in m["runs"]):
        return "invalid key range or count"
    if not 0 <= m["flushed"] <= m["lsn"] or any(x["first"] > x["last"] for x in m["log"]):
        return "invalid numbers"
    level1 = sorted((x["min"], x["max"]) for x in m["runs"] if x["level"] == 1)
    if any(b[0] <= a[1] for a, b in zip(level1, level1[1:])):
        return "tables of level 1 overlap"
    return None
