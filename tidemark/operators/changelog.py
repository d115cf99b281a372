"""The change log: slices, gaps, hash chain, groups and packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checksums import crc64_one, encode_record
from ..functions.scalars import MAX_GROUP

MAX_GROUP_BYTES = 8 << 20


def from_events(events: DataFrame) -> DataFrame:
    """Changes from an event table: one key for each user, errors delete."""
    gone = F.col("event_type") == "error"
    return events.select((F.col("event_id") + 1).alias("lsn"), F.when(gone, 2).otherwise(1).alias("op"), F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), F.when(~gone, F.col("props")).alias("value"))


def slice_after(changes: DataFrame, lsn: int, limit: int = MAX_GROUP) -> DataFrame:
    return changes.filter(F.col("lsn") > lsn).orderBy("lsn").limit(limit)


def gaps(changes: DataFrame, base: int = 0, step: int = 1_000_000) -> DataFrame:
    """(after_lsn, next_lsn): places where numbers are missing.

    Buckets of `step` numbers are checked inside, and their few edges against each other, so no
    window spans the log.
    """
    rows = changes.select("lsn", F.floor((F.col("lsn") - 1) / step).alias("b"))
    near = Window.partitionBy("b").orderBy("lsn")
    inside = rows.withColumn("before", F.lag("lsn").over(near)).filter("before is not null and lsn > before + 1").select(F.col("before").alias("after_lsn"), F.col("lsn").alias("next_lsn"))
    edges = rows.groupBy("b").agg(F.min("lsn").alias("lo"), F.max("lsn").alias("hi"))
    edges = edges.withColumn("before", F.coalesce(F.lag("hi").over(Window.orderBy("b")), F.lit(base)))
    return inside.unionByName(edges.filter("lo > before + 1").select(F.col("before").alias("after_lsn"), F.col("lo").alias("next_lsn")))


def broken_links(log: DataFrame, base_hash: int = 0, starts: DataFrame | None = None) -> DataFrame:
    """Records whose prev_hash is not the hash of the record before (an equi-join by number).

    starts (lsn, base) tells where chains begin and what the first record links to; without it
    one chain begins at number 1.
    """
    before = log.select((F.col("lsn") + 1).alias("lsn"), F.col("record_hash").alias("expected"))
    rows = log.join(before, "lsn", "left")
    if starts is None:
        first = F.when(F.col("lsn") == 1, F.lit(base_hash).cast("long"))
        rows = rows.withColumn("expected", F.coalesce("expected", first))
    else:
        rows = rows.join(starts, "lsn", "left").withColumn("expected", F.coalesce("base", "expected"))
    return rows.filter(~F.col("prev_hash").eqNullSafe(F.col("expected"))).select("lsn", "prev_hash", "expected")


def footers(changes: DataFrame, size: int = MAX_GROUP) -> DataFrame:
    """(group_id, first_lsn, last_lsn, count, whole) of groups of consecutive numbers."""
    g = changes.groupBy(F.floor((F.col("lsn") - 1) / size).cast("long").alias("group_id"))
    out = g.agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count("*").alias("count"))
    return out.withColumn("whole", (F.col("last_lsn") - F.col("first_lsn") + 1 == F.col("count")) & F.col("count").between(1, size))


def footer_checks(records: DataFrame, ends: DataFrame, size: int = MAX_GROUP) -> DataFrame:
    """(first_lsn, last_lsn, error) of footers (first_lsn, last_lsn, count, last_record_hash): why
    one does not close its records (lsn, record_hash), or null.

    Records meet their footer by number: each footer names its numbers, at most `size` of them, so
    no window runs over the log. Records that no footer names are an open tail.
    """
    f, l, c = F.col("first_lsn"), F.col("last_lsn"), F.col("count")
    sane = c.between(1, size) & (l - f + 1 == c)
    named = ends.withColumn("sane", sane).withColumn("lsn", F.explode_outer(F.when(sane, F.sequence(f, l))))
    got = named.join(records.select("lsn", "record_hash"), "lsn", "left").groupBy("first_lsn", "last_lsn", "count", "last_record_hash", "sane").agg(
        F.count("record_hash").alias("there"), F.max_by("record_hash", "lsn").alias("mark"))
    error = F.when(~F.col("sane"), "bad count or range").when(F.col("there") != c, "records are missing").when(F.col("mark") != F.col("last_record_hash"), "hash differs")
    return got.select("first_lsn", "last_lsn", error.alias("error"))


def slice_answer(cursor, base, durable):
    """What a reader at a cursor gets of a log that holds (base, durable]: 'reclaimed', 'ahead' or 'records'."""
    return F.when(cursor < base, "reclaimed").when(cursor > durable, "ahead").otherwise("records")


def hash_at(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(lsn, record_hash) of asked numbers; null where the log does not hold them, 0 for 0."""
    out = asked.select("lsn").distinct().join(log.select("lsn", "record_hash"), "lsn", "left")
    return out.select("lsn", F.when(F.col("lsn") == 0, 0).otherwise(F.col("record_hash")).alias("record_hash"))


def ack_errors(acks: DataFrame, sent: DataFrame) -> DataFrame:
    """(replica, lsn, error) of acknowledgements (replica, lsn, applied_lsn, record_hash) that do
    not match a record sent (lsn, record_hash): null if one does."""
    out = acks.join(sent.select("lsn", F.col("record_hash").alias("sent_hash")), "lsn", "left")
    error = F.when(F.col("sent_hash").isNull(), "not sent").when(F.col("applied_lsn") != F.col("lsn"), "not applied").when(F.col("sent_hash") != F.col("record_hash"), "hash differs")
    return out.select("replica", "lsn", error.alias("error"))


def committed_prefix(records: DataFrame) -> DataFrame:
    """Records that a footer closes; records has lsn and closed (a footer stands behind it)."""
    last = records.filter("closed").agg(F.max("lsn").alias("upto"))
    return records.join(F.broadcast(last), F.col("lsn") <= F.col("upto"), "left_semi")  # one row


def pack(jobs: DataFrame, most: int = MAX_GROUP, most_bytes: int = MAX_GROUP_BYTES, writer: str = "writer") -> DataFrame:
    """Greedy groups of whole jobs (writer, job, records, bytes) in job order, per writer: a job
    starts a new group if it doesn't fit. Streams over sorted partitions; one sum is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, group, n, size = object(), 0, 0, 0
        for x in parts:
            out = []
            for w, records, b in zip(x[writer], x["records"], x["bytes"], strict=True):
                if w != last:
                    last, group, n, size = w, 0, 0, 0
                elif n + records > most or size + b > most_bytes:
                    group, n, size = group + 1, 0, 0
                n, size = n + records, size + b
                out.append(group)
            yield x.assign(group_id=out)

    rows = jobs.select(writer, "job", "records", "bytes").repartition(writer).sortWithinPartitions(writer, "job")
    return rows.mapInPandas(run, f"{writer} {dict(jobs.dtypes)[writer]}, job long, records long, bytes long, group_id long")


def chain_step(lsn: int, op: int, key: bytes, value: bytes | None, before: int) -> int:
    """The hash of a record behind one with the hash `before` (signed, as stored)."""
    x = crc64_one(encode_record(lsn, op, key, value or b"", before % 2**64))
    return x - 2**64 if x >= 2**63 else x


def chained(changes: list[tuple], base_lsn: int = 0, base_hash: int = 0) -> list[tuple]:
    """(lsn, op, key, value, prev_hash, record_hash) of one commit's changes (op, key, value).

    A chain is made one record after the other, so it is made for the batch that is committed;
    checking it (broken_links) is distributed.
    """
    out, h = [], base_hash
    for i, (op, key, value) in enumerate(changes, base_lsn + 1):
        before, h = h, chain_step(i, op, key, value, h)
        out.append((i, op, key, value, before, h))
    return out
