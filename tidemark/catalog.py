"""Registered queries over the driver tables and their SQL.

The change log comes from `events` (one key for each user, errors delete, props is the value);
telemetry takes events.value as a latency and user_id mod 3 as the node.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import scalars as S
from .functions.checksums import crc32c, crc64, record_hash, splitmix64
from .operators import changelog, kv, maintenance, telemetry
from .plans.decisions import handshake
from .sources.files import parse_commands

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = """WITH m AS (SELECT event_id + 1 AS lsn, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, 'user:' || lpad(user_id::VARCHAR, 8, '0') AS key,
 CASE WHEN event_type <> 'error' THEN props END AS value FROM events),
n AS (SELECT key, lsn, op, value FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1),
live AS (SELECT key, value FROM n WHERE op = 1),
ns AS (SELECT event_id, event_type, user_id, 'n' || (user_id % 3) AS node, floor(value * 1000)::BIGINT AS ns, value, epoch_ms(ts)::BIGINT AS t_ms FROM events),
runs AS (SELECT source_rank, key, op, value, lsn, 4 - source_rank AS id, CASE WHEN source_rank < 3 THEN 0 ELSE 1 END AS level FROM (SELECT m.*, 3 - least(3, (lsn - 1) * 4 // (SELECT max(lsn) FROM m)) AS source_rank FROM m)
 QUALIFY row_number() OVER (PARTITION BY source_rank, key ORDER BY lsn DESC) = 1),
part AS (SELECT id, level, count(*) AS entry_count, min(key) AS min_key, max(key) AS max_key FROM
 (SELECT 10 + (lsn - 1) // 500 AS id, CASE WHEN (lsn - 1) // 500 % 3 = 0 THEN 0 ELSE 1 END AS level, 'k' || lpad((lsn * 7 % 1000)::VARCHAR, 8, '0') AS key FROM m) GROUP BY ALL),
cutoff AS (SELECT (max(lsn) * 95 // 100)::BIGINT AS mark FROM m),
hs AS (SELECT lsn, ('0x' || substr(md5(key || lsn), 1, 15))::BIGINT AS record_hash FROM m),
prog AS (SELECT 'r' || (user_id % 5) AS node_id, max(event_id + 1) - 3 * (user_id % 5) AS applied_lsn, user_id % 5 <> 4 AS connected FROM events GROUP BY user_id % 5),
bench AS (SELECT l_returnflag AS mix, l_linestatus AS build, l_quantity AS q FROM lineitem)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = BASE + sql
        return f

    return add


def log(spark, d) -> DataFrame:
    return changelog.from_events(table(spark, d, "events"))


def samples(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", "user_id", F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node"), F.floor(F.col("value") * 1000).cast("long").alias("ns"), "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"))


def runs(spark, d) -> DataFrame:
    """Four sorted runs of quarters of the log, the newest of rank 0."""
    m = log(spark, d)
    last = m.agg(F.max("lsn").alias("last"))
    rank = (3 - F.least(F.lit(3), F.floor((F.col("lsn") - 1) * 4 / F.col("last")))).cast("long")
    m = m.join(F.broadcast(last)).withColumn("source_rank", rank)
    m = m.groupBy("source_rank", "key").agg(F.max_by(F.struct("lsn", "op", "value"), "lsn").alias("v")).select("source_rank", "key", "v.*")
    return m.withColumn("id", 4 - F.col("source_rank")).withColumn("level", F.when(F.col("source_rank") < 3, 0).otherwise(1))


def run_tables(spark, d) -> DataFrame:
    m = log(spark, d)
    id_ = F.floor((F.col("lsn") - 1) / 500)
    return maintenance.run_tables(m.select((id_ + 10).alias("id"), F.when(id_ % 3 == 0, 0).otherwise(1).alias("level"), S.key_text("k", F.col("lsn") * 7 % 1000).alias("key")))


def progress(spark, d) -> DataFrame:
    r = (F.col("user_id") % 5).alias("r")
    e = table(spark, d, "events").groupBy(r).agg((F.max("event_id") + 1).alias("top"))
    return e.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("node_id"), (F.col("top") - 3 * F.col("r")).alias("applied_lsn"), (F.col("r") != 4).alias("connected"))


# reads


@query("SELECT key, value FROM live")
def latest_state(spark, d):
    return kv.live(log(spark, d))


@query("SELECT key, op, value FROM n")
def newest_versions(spark, d):
    return kv.newest(log(spark, d))


@query("SELECT key, value FROM live WHERE key = 'user:00000007'")
def get_point(spark, d):
    return kv.get(log(spark, d), "user:00000007")


@query("SELECT a.key, live.key IS NOT NULL AS found FROM (SELECT DISTINCT 'user:' || lpad(c_custkey::VARCHAR, 8, '0') AS key FROM customer) a LEFT JOIN live ON a.key = live.key")
def exists_batch(spark, d):
    asked = table(spark, d, "customer").select(S.key_text("user:", F.col("c_custkey")).alias("key"))
    return kv.exists(log(spark, d), asked)


@query("SELECT key, value FROM live WHERE key >= 'user:00000010' AND key < 'user:00000050'")
def scan_range(spark, d):
    return kv.live(log(spark, d)).filter(kv.in_range(F.col("key"), "user:00000010", "user:00000050"))


@query("SELECT key, value, (SELECT count(*) FROM live WHERE key >= 'user:00000010') > 13 AS more FROM live WHERE key >= 'user:00000010' ORDER BY key LIMIT 13")
def scan_page_more(spark, d):
    return kv.scan_page(kv.live(log(spark, d)), start="user:00000010", limit=13)


@query("SELECT key, value, s.n > 13 AS more FROM live, (SELECT count(*) AS n FROM live WHERE key > 'user:00000030') s WHERE key > 'user:00000030' ORDER BY key LIMIT 13")
def keyset_page_2(spark, d):
    return kv.scan_page(kv.live(log(spark, d)), limit=13, after="user:00000030")


@query(""", c AS (SELECT key, value, 5 + sum(8 + strlen(key) + strlen(value)) OVER (ORDER BY key) AS s FROM (SELECT * FROM live ORDER BY key LIMIT 100))
SELECT key, value, (SELECT count(*) FROM live) > 100 OR (SELECT max(s) FROM c) > 2000 AS more FROM c WHERE s <= 2000""")
def scan_page_bytes_cut(spark, d):
    return kv.cut_page(kv.scan_page(kv.live(log(spark, d)), limit=100), 2000)


@query("SELECT count(*) AS keys FROM live")
def key_count(spark, d):
    return kv.live(log(spark, d)).agg(F.count("*").alias("keys"))


@query("SELECT sum(c)::BIGINT AS upper_bound FROM (SELECT count(*) AS c FROM runs GROUP BY id)")
def key_count_upper_bound(spark, d):
    return maintenance.approximate_keys(maintenance.run_tables(runs(spark, d)))


@query("SELECT key, arg_min(op, source_rank) AS op, first(value ORDER BY source_rank) AS value FROM runs GROUP BY key")
def merge_runs(spark, d):
    return kv.merge_runs(runs(spark, d))


@query("SELECT key, value FROM live")
def compaction_output(spark, d):
    return kv.compact(runs(spark, d))


@query(""", p AS (SELECT key, op, value FROM (SELECT lsn, 'user:' || lpad((c_custkey % 60)::VARCHAR, 8, '0') AS key, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS op, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS value
 FROM (SELECT c_custkey, c_name, c_custkey AS lsn FROM customer WHERE c_custkey <= 64)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1)
SELECT coalesce(p.key, live.key) AS key, CASE WHEN p.key IS NOT NULL THEN p.value ELSE live.value END AS value FROM live FULL JOIN p ON live.key = p.key WHERE p.op IS NULL OR p.op = 1""")
def overlay_read(spark, d):
    c = table(spark, d, "customer").filter("c_custkey <= 64")
    gone = F.col("c_custkey") % 4 == 0
    pending = c.select(F.col("c_custkey").alias("lsn"), F.when(gone, 2).otherwise(1).alias("op"), S.key_text("user:", F.col("c_custkey") % 60).alias("key"), F.when(~gone, F.col("c_name")).alias("value"))
    return kv.overlay(kv.live(log(spark, d)), pending)


def snapshot_at(spark, d) -> int:
    """The number that 95 % of the log stand at or before (one row)."""
    return log(spark, d).agg(F.floor(F.max("lsn") * 95 / 100)).first()[0]


SNAPSHOT = ", s AS (SELECT * FROM m WHERE lsn <= (SELECT mark FROM cutoff) QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1)"


@query(SNAPSHOT + " SELECT key, value FROM s WHERE op = 1")
def snapshot_state(spark, d):
    return kv.state_at(log(spark, d), snapshot_at(spark, d))


@query(", s AS (SELECT * FROM m WHERE lsn <= (SELECT max(lsn) * 9 // 10 FROM m) QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1) SELECT key, value FROM s WHERE op = 1")
def flush_boundary_state(spark, d):
    """What sorted runs hold if the log is flushed up to nine tenths."""
    m = log(spark, d)
    flushed = m.agg(F.floor(F.max("lsn") * 9 / 10)).first()[0]
    return kv.live(m.filter(F.col("lsn") <= flushed))


@query("SELECT key, value FROM live")
def snapshot_plus_tail(spark, d):
    m, at = log(spark, d), snapshot_at(spark, d)
    return kv.replay(kv.state_at(m, at), at, m)


@query("SELECT key, count(*) AS n FROM m GROUP BY key HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return kv.duplicate_keys(log(spark, d))


@query(SNAPSHOT + """, b AS (SELECT key, value FROM s WHERE op = 1)
SELECT count(*) AS differing, count(*) = 0 AS equal FROM ((FROM live EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM live))""")
def relation_equal(spark, d):
    """The live state against that of the snapshot, which lacks the last changes."""
    return kv.same_relation(latest_state(spark, d), snapshot_state(spark, d))


@query(""", c AS (SELECT key, value FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_rank) = 1 AND op = 1)
SELECT count(*) AS differing, count(*) = 0 AS equal FROM ((FROM live EXCEPT ALL FROM c) UNION ALL (FROM c EXCEPT ALL FROM live))""")
def relation_equal_after_compaction(spark, d):
    return kv.same_relation(latest_state(spark, d), compaction_output(spark, d))


LE = "printf('%02x%02x%02x%02x', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"


@query(f""", p AS (SELECT key, value FROM live WHERE key >= 'user:00000010' ORDER BY key LIMIT 13)
SELECT {LE.format("count(*)")} || (SELECT CASE WHEN count(*) > 13 THEN '01' ELSE '00' END FROM live WHERE key >= 'user:00000010')
 || string_agg({LE.format("strlen(key)")} || {LE.format("strlen(value)")} || lower(hex(encode(key))) || lower(hex(encode(value))), '' ORDER BY key) AS page FROM p""")
def page_codec(spark, d):
    """A page as the bytes that a client is sent."""
    return kv.page_bytes(scan_page_more(spark, d)).select(F.lower(F.hex("page")).alias("page"))


@query(", r AS (SELECT lsn AS place, 'k' || lpad((CASE WHEN lsn % 100 = 0 THEN lsn - 2 ELSE lsn END)::VARCHAR, 9, '0') AS key FROM m) SELECT place, key, before FROM (SELECT *, lag(key) OVER (ORDER BY place) AS before FROM r) WHERE key <= before")
def ascending_check(spark, d):
    """Every hundredth key of a run is out of order on purpose."""
    lsn = F.col("lsn")
    return kv.not_ascending(log(spark, d).select(lsn.alias("place"), S.key_text("k", F.when(lsn % 100 == 0, lsn - 2).otherwise(lsn), 9).alias("key")))


@query("SELECT count(*) AS entries, (SELECT count(*) FROM (SELECT key FROM m GROUP BY key HAVING count(*) > 1)) AS repeated, 'duplicate key' AS error FROM m")
def snapshot_check_repeated(spark, d):
    """The log's pairs are no state: keys repeat."""
    return kv.state_errors(log(spark, d).select("key", "value"), 1)


@query("SELECT count(*) AS entries, 0::BIGINT AS repeated, CASE WHEN count(*) <> 1 THEN 'entry count differs' END AS error FROM live")
def snapshot_check_count(spark, d):
    return kv.state_errors(latest_state(spark, d), 1)


# change log


@query("SELECT lsn, op, key, value FROM m WHERE lsn > 500 ORDER BY lsn LIMIT 64")
def changelog_slice(spark, d):
    return changelog.slice_after(log(spark, d), 500)


@query("SELECT before AS after_lsn, lsn AS next_lsn FROM (SELECT lsn, coalesce(lag(lsn) OVER (ORDER BY lsn), 0) AS before FROM m WHERE lsn % 97 <> 0) WHERE lsn > before + 1")
def lsn_gap_check(spark, d):
    return changelog.gaps(log(spark, d).filter("lsn % 97 <> 0"), step=1000)


@query("SELECT (lsn - 1) // 64 AS group_id, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS count, max(lsn) - min(lsn) + 1 = count(*) AND count(*) BETWEEN 1 AND 64 AS whole FROM m WHERE lsn % 1001 <> 7 GROUP BY 1")
def group_footers(spark, d):
    return changelog.footers(log(spark, d).filter("lsn % 1001 <> 7"))


@query("SELECT lsn, op, key FROM m WHERE lsn <= (SELECT max(lsn) FROM m WHERE lsn % 64 = 0)")
def committed_prefix(spark, d):
    return changelog.committed_prefix(log(spark, d).withColumn("closed", F.col("lsn") % 64 == 0)).select("lsn", "op", "key")


def hashes(spark, d) -> DataFrame:
    """(lsn, record_hash): a hash of each change that both engines have."""
    return log(spark, d).select("lsn", F.conv(F.substring(F.md5(F.concat("key", F.col("lsn").cast("string"))), 1, 15), 16, 10).cast("long").alias("record_hash"))


@query("SELECT a.lsn FROM hs a JOIN hs b ON b.lsn = a.lsn - 1 WHERE a.lsn % 250 = 0")
def chain_breaks(spark, d):
    """Every 250th link is broken on purpose."""
    h = hashes(spark, d)
    before = h.select((F.col("lsn") + 1).alias("lsn"), F.col("record_hash").alias("prev_hash"))
    chain = h.join(before, "lsn", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit(0)) + F.when(F.col("lsn") % 250 == 0, 1).otherwise(0))
    return changelog.broken_links(chain).select("lsn")


@query("SELECT c_custkey * 10 AS cursor, CASE WHEN c_custkey * 10 < 500 THEN 'reclaimed' WHEN c_custkey * 10 > (SELECT max(lsn) FROM m) THEN 'ahead' ELSE 'records' END AS answer FROM customer")
def slice_answers(spark, d):
    """What readers at many places get of a log reclaimed up to 500."""
    last = log(spark, d).agg(F.max("lsn").alias("last"))
    cursor = F.col("c_custkey") * 10
    return table(spark, d, "customer").join(F.broadcast(last)).select(cursor.alias("cursor"), changelog.slice_answer(cursor, F.lit(500), F.col("last")).alias("answer"))


@query("SELECT a.lsn, CASE WHEN a.lsn = 0 THEN 0 ELSE hs.record_hash END AS record_hash FROM (SELECT DISTINCT (c_custkey - 1) * 7 AS lsn FROM customer) a LEFT JOIN hs ON hs.lsn = a.lsn")
def record_hash_at(spark, d):
    return changelog.hash_at(hashes(spark, d), table(spark, d, "customer").select(((F.col("c_custkey") - 1) * 7).alias("lsn")))


FOOTERS = """, g AS (SELECT (lsn - 1) // 64 AS g, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS n, arg_max(record_hash, lsn) AS mark FROM hs GROUP BY 1),
f AS (SELECT g, first_lsn, last_lsn, CASE WHEN g % 10 = 3 THEN n + 1 ELSE n END AS c, CASE WHEN g % 10 = 5 THEN mark + 1 ELSE mark END AS mark2, mark, n FROM g),
lost AS (SELECT DISTINCT (lsn - 1) // 64 AS g FROM hs WHERE lsn % 1009 = 0)"""


@query(FOOTERS + """ SELECT first_lsn, last_lsn, CASE WHEN c NOT BETWEEN 1 AND 64 OR c <> n THEN 'bad count or range' WHEN g IN (FROM lost) THEN 'records are missing' WHEN mark2 <> mark THEN 'hash differs' END AS error FROM f""")
def footer_checks(spark, d):
    """Footers of groups of 64; some count wrongly, some name another hash, some records are lost."""
    h = hashes(spark, d)
    g = F.floor((F.col("lsn") - 1) / 64)
    ends = h.groupBy(g.alias("g")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count("*").alias("n"), F.max_by("record_hash", "lsn").alias("mark"))
    ends = ends.select("first_lsn", "last_lsn", (F.col("n") + F.when(F.col("g") % 10 == 3, 1).otherwise(0)).alias("count"), (F.col("mark") + F.when(F.col("g") % 10 == 5, 1).otherwise(0)).alias("last_record_hash"))
    return changelog.footer_checks(h.filter("lsn % 1009 <> 0"), ends)


@query("""SELECT replica, lsn, CASE WHEN sent IS NULL THEN 'not sent' WHEN applied_lsn <> lsn THEN 'not applied' WHEN sent <> ack THEN 'hash differs' END AS error FROM
 (SELECT 'r' || (m.lsn % 5) AS replica, m.lsn, m.lsn - CASE WHEN m.lsn % 17 = 0 THEN 1 ELSE 0 END AS applied_lsn, record_hash + CASE WHEN m.lsn % 19 = 0 THEN 1 ELSE 0 END AS ack,
  CASE WHEN m.lsn % 13 <> 0 THEN record_hash END AS sent FROM m JOIN hs USING (lsn) WHERE m.lsn % 3 = 0)""")
def ack_match(spark, d):
    """Acknowledgements of every third record; some name other hashes or numbers, some were never sent."""
    h, lsn = hashes(spark, d), F.col("lsn")
    acks = h.filter("lsn % 3 = 0").select(F.concat(F.lit("r"), (lsn % 5).cast("string")).alias("replica"), "lsn", (lsn - F.when(lsn % 17 == 0, 1).otherwise(0)).alias("applied_lsn"), (F.col("record_hash") + F.when(lsn % 19 == 0, 1).otherwise(0)).alias("record_hash"))
    return changelog.ack_errors(acks, h.filter("lsn % 13 <> 0"))


@query("""SELECT c_custkey AS replica, CASE WHEN a > (SELECT max(lsn) FROM m) THEN 'replica ahead' WHEN a <= 300 THEN 'snapshot' WHEN c_custkey % 6 = 0 THEN 'history differs' ELSE 'stream' END AS decision
FROM (SELECT c_custkey, (c_custkey - 1) * 9 AS a FROM customer)""")
def history_check(spark, d):
    """Replicas at many places; every sixth has another hash there. The log begins behind 300."""
    h, a = hashes(spark, d), (F.col("c_custkey") - 1) * 9
    mine = table(spark, d, "customer").select(F.col("c_custkey").alias("replica"), a.alias("lsn")).join(h, "lsn", "left")
    mine = mine.withColumn("record_hash", F.coalesce("record_hash", F.lit(0)) + F.when(F.col("replica") % 6 == 0, 1).otherwise(0))
    last = h.agg(F.max("lsn").alias("last"))
    return maintenance.history_check(mine.join(F.broadcast(last)), h.filter("lsn > 300"), F.lit(300), F.col("last"))


@query(""", w AS (SELECT lsn FROM m WHERE lsn % 50 = 0), r AS (SELECT unnest(range(5)) AS r)
SELECT lsn, count(*) FILTER ((lsn * 7 + r * 31) % 100 <= 50) AS acks, CASE WHEN count(*) FILTER ((lsn * 7 + r * 31) % 100 <= 50) >= 3 THEN 'OK' ELSE 'UNAVAILABLE' END AS outcome FROM w, r GROUP BY lsn""")
def ack_wait(spark, d):
    """Writes that three of five replicas have to acknowledge within 50 ms."""
    w = log(spark, d).filter("lsn % 50 = 0").select("lsn", (F.col("lsn") * 1000).alias("t_ms"))
    acks = w.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("replica", "lsn", (F.col("t_ms") + (F.col("lsn") * 7 + F.col("replica") * 31) % 100).alias("t_ms"))
    return maintenance.write_outcomes(w, acks.unionByName(acks), 3, 50)


@query(""", j AS (SELECT lsn, lsn % 4 AS writer, lsn % 30 + 1 AS records, (33 + strlen(key) + coalesce(strlen(value), 0)) * 40000::BIGINT AS bytes, row_number() OVER (PARTITION BY lsn % 4 ORDER BY lsn) AS i FROM m),
p AS (WITH RECURSIVE p AS (SELECT writer, i, lsn, records, bytes, 0::BIGINT AS g, records AS n, bytes AS size FROM j WHERE i = 1
 UNION ALL SELECT j.writer, j.i, j.lsn, j.records, j.bytes, p.g + CASE WHEN p.n + j.records > 64 OR p.size + j.bytes > 8388608 THEN 1 ELSE 0 END,
 CASE WHEN p.n + j.records > 64 OR p.size + j.bytes > 8388608 THEN j.records ELSE p.n + j.records END, CASE WHEN p.n + j.records > 64 OR p.size + j.bytes > 8388608 THEN j.bytes ELSE p.size + j.bytes END
 FROM p JOIN j ON j.writer = p.writer AND j.i = p.i + 1) FROM p)
SELECT writer, lsn AS job, records, bytes, g AS group_id FROM p""")
def greedy_packing(spark, d):
    m = log(spark, d)
    jobs = m.select((F.col("lsn") % 4).alias("writer"), F.col("lsn").alias("job"), (F.col("lsn") % 30 + 1).alias("records"), (S.encoded_length(F.col("key"), F.col("value")) * 40_000).cast("long").alias("bytes"))
    return changelog.pack(jobs)


@query()
def record_hashes(spark, d):
    m = log(spark, d)
    key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
    return m.select("lsn", crc32c(key).alias("key_crc32c"), F.hex(crc64(key)).alias("key_crc64"), F.hex(record_hash(F.col("lsn"), F.col("op"), key, value, F.lit(0))).alias("record_hash"))


TWO64 = "18446744073709551616::UHUGEINT"


@query(f""", a AS (SELECT lsn, ((42::UHUGEINT + (lsn::UHUGEINT * 11400714819323198485) % {TWO64}) % {TWO64})::UBIGINT AS x FROM m),
b AS (SELECT lsn, ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929) % {TWO64})::UBIGINT AS x FROM a),
c AS (SELECT lsn, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931) % {TWO64})::UBIGINT AS x FROM b), e AS (SELECT lsn, xor(x, x >> 31)::HUGEINT AS x FROM c)
SELECT lsn, (CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616::HUGEINT ELSE x END)::BIGINT AS x FROM e""")
def splitmix_keys(spark, d):
    return log(spark, d).select("lsn", splitmix64(F.lit(42).cast("long"), F.col("lsn")).alias("x"))


# tables, replicas, retention


@query("SELECT id, level, entry_count, min_key, max_key FROM part")
def manifest_tables(spark, d):
    return run_tables(spark, d)


@query("SELECT p.id FROM part p, (SELECT min(min_key) AS lo, max(max_key) AS hi FROM part WHERE level = 0) s WHERE level = 1 AND max_key >= lo AND min_key <= hi")
def level_overlap(spark, d):
    return maintenance.level_inputs(run_tables(spark, d)).select("id")


@query("SELECT id, before FROM (SELECT id, min_key, lag(max_key) OVER (ORDER BY min_key, id) AS before FROM part WHERE level = 1) WHERE min_key <= before")
def level_order_check(spark, d):
    return maintenance.misplaced(run_tables(spark, d))


@query("SELECT id, row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -id END, min_key, id)::INT AS place FROM part")
def table_order(spark, d):
    return maintenance.table_order(run_tables(spark, d)).select("id", "place")


@query("SELECT count(*) AS tables, count(*) FILTER (level = 0) AS level0, sum(entry_count)::BIGINT AS entries, sum(entry_count * 100 + id)::BIGINT AS bytes FROM part")
def manifest_totals(spark, d):
    return maintenance.table_totals(run_tables(spark, d).withColumn("file_len", F.col("entry_count") * 100 + F.col("id")))


@query(""", t AS (SELECT id % 15 AS id, CASE WHEN id % 4 = 0 THEN 'z' ELSE min_key END AS min_key, max_key, CASE WHEN id % 7 = 0 THEN 0 ELSE entry_count END AS entry_count FROM part)
SELECT id, error FROM (SELECT id, CASE WHEN id <= 0 OR id >= 14 THEN 'id out of range' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' WHEN min_key > max_key THEN 'min above max' WHEN entry_count < 1 THEN 'no entries' END AS error FROM t) WHERE error IS NOT NULL""")
def manifest_checks(spark, d):
    """Manifest rows with ids, bounds and counts spoiled on purpose."""
    id_ = F.col("id")
    t = run_tables(spark, d).select((id_ % 15).alias("id"), "level", F.when(id_ % 4 == 0, "z").otherwise(F.col("min_key")).alias("min_key"), "max_key", F.when(id_ % 7 == 0, 0).otherwise(F.col("entry_count")).alias("entry_count"))
    return maintenance.table_errors(t, 14)


@query("SELECT id AS generation FROM part WHERE id <> 12")
def stale_generations(spark, d):
    return maintenance.stale(run_tables(spark, d).select(F.col("id").alias("generation")), spark.range(12, 13).withColumnRenamed("id", "generation"))


@query(", s AS (SELECT (lsn - 1) // 500 AS g, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) * 100 AS bytes FROM m GROUP BY 1) SELECT first_lsn, last_lsn, bytes, last_lsn <= least((SELECT mark FROM cutoff), (SELECT max(lsn) // 2 FROM m)) AS reclaim FROM s")
def reclaim_plan(spark, d):
    """Segments of 500 that a snapshot at 95 % lets go, with a replica that is halfway."""
    m = log(spark, d)
    s = m.groupBy(F.floor((F.col("lsn") - 1) / 500).alias("g")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), (F.count("*") * 100).alias("bytes")).drop("g")
    ends = m.agg(F.floor(F.max("lsn") * 95 / 100).alias("at"), F.floor(F.max("lsn") / 2).alias("slow"))
    return maintenance.reclaim_plan(s.join(F.broadcast(ends)), F.col("at"), F.col("slow")).drop("at", "slow")


@query("SELECT max(lsn) - (SELECT mark FROM cutoff) AS wal_entries, (SELECT mark FROM cutoff) AS snapshot_lsn, max(lsn) AS current_lsn FROM m")
def log_gauges(spark, d):
    x = log(spark, d).agg(F.max("lsn").alias("current_lsn")).withColumn("snapshot_lsn", F.floor(F.col("current_lsn") * 95 / 100))
    return x.select((F.col("current_lsn") - F.col("snapshot_lsn")).alias("wal_entries"), "snapshot_lsn", "current_lsn")


LAGS = ", lags AS (SELECT node_id, applied_lsn, connected, CASE WHEN connected AND applied_lsn <= (SELECT max(lsn) FROM m) THEN (SELECT max(lsn) FROM m) - applied_lsn END AS lag FROM prog)"


def nodes(spark, d) -> DataFrame:
    """Eight nodes, three of them unknown to the primary, one of them down."""
    id_ = F.concat(F.lit("r"), F.col("id").cast("string"))
    return spark.range(8).select(F.concat(F.lit("node "), id_).alias("name"), id_.alias("node_id"), (F.col("id") != 2).alias("up"))


@query(LAGS + """ SELECT 'node r' || i AS name, 'r' || i AS node_id, applied_lsn, CASE WHEN i <> 2 AND connected THEN lag END AS lag,
 CASE WHEN i <> 2 AND connected AND lag = 0 THEN 'synced' WHEN i <> 2 AND connected AND lag > 0 THEN 'lagging' ELSE 'disconnected' END AS state FROM (SELECT unnest(range(8)) AS i) LEFT JOIN lags ON node_id = 'r' || i""")
def node_view(spark, d):
    return maintenance.node_view(nodes(spark, d), replica_lag(spark, d))


@query(", top AS (SELECT max(lsn) AS x FROM m) SELECT 'n' || c_custkey AS node_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def caught_up_replicas(spark, d):
    """Every third node has lag 0 at the primary; every fifth has not applied that itself."""
    c, id_ = table(spark, d, "customer"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("node_id")
    top = log(spark, d).agg(F.max("lsn").alias("top"))
    told = c.select(id_, F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(F.col("c_custkey")).alias("lag"))
    own = c.join(F.broadcast(top)).select(id_, (F.col("top") - F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).alias("applied_lsn"), "top")
    return maintenance.caught_up(told, own, F.col("top"))


@query(""", a AS (SELECT user_id % 5 AS replica, event_id * 10 AS t_ms, event_id - event_id % 7 * 3 AS applied FROM events), s AS (SELECT replica, r * 100 AS t_ms, r * 10 + 20 AS durable FROM (SELECT unnest(range(5)) AS replica), (SELECT unnest(range(0, 100, 9)) AS r))
SELECT s.replica, (SELECT min(a.t_ms) FROM a WHERE a.replica = s.replica AND a.t_ms >= s.t_ms AND applied >= durable) - s.t_ms AS catch_up_ms FROM s""")
def catch_up(spark, d):
    """How long replicas take after a restart until they have applied what was durable then."""
    acks = table(spark, d, "events").select((F.col("user_id") % 5).alias("replica"), (F.col("event_id") * 10).alias("t_ms"), (F.col("event_id") - F.col("event_id") % 7 * 3).alias("applied_lsn"))
    starts = spark.range(5).select(F.col("id").alias("replica"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"), F.lit(9).cast("long"))).alias("r"))
    return maintenance.catch_up(acks, starts.select("replica", (F.col("r") * 100).alias("t_ms"), (F.col("r") * 10 + 20).alias("durable")))


@query("SELECT f.id FROM (SELECT unnest(range(8, 18)) AS id) f ANTI JOIN part ON f.id = part.id")
def unlisted_tables(spark, d):
    return maintenance.unlisted(spark.range(8, 18), run_tables(spark, d))


@query("SELECT id, level FROM part WHERE id NOT IN (SELECT unnest(range(8, 11)))")
def missing_tables(spark, d):
    return maintenance.missing(spark.range(8, 11), run_tables(spark, d)).select("id", "level")


@query("SELECT node_id, applied_lsn, connected, CASE WHEN connected AND applied_lsn <= (SELECT max(lsn) FROM m) THEN (SELECT max(lsn) FROM m) - applied_lsn END AS lag FROM prog")
def replica_lag(spark, d):
    durable = log(spark, d).agg(F.max("lsn").alias("durable"))
    return maintenance.replica_lag(progress(spark, d).join(F.broadcast(durable)), F.col("durable")).drop("durable")


@query("SELECT node_id, CASE WHEN NOT connected THEN 'disconnected' WHEN applied_lsn > (SELECT max(lsn) FROM m) THEN 'online' WHEN applied_lsn = (SELECT max(lsn) FROM m) THEN 'synced' ELSE 'lagging' END AS state FROM prog")
def replica_state(spark, d):
    return replica_lag(spark, d).select("node_id", S.replica_state(F.col("connected"), F.col("lag"), F.lit(True)).alias("state"))


@query("SELECT min(applied_lsn) FILTER (connected) AS floor, CASE WHEN min(applied_lsn) FILTER (connected) < 100000 AND 100000 - min(applied_lsn) FILTER (connected) <= 1000000 THEN greatest(min(applied_lsn) FILTER (connected), 900) ELSE 100000 END AS base FROM prog")
def retention_floor(spark, d):
    f = progress(spark, d).agg(F.min(F.when(F.col("connected"), F.col("applied_lsn"))).alias("floor"))
    return f.select("floor", maintenance.retention_base(F.lit(100_000), F.col("floor"), F.lit(900)).cast("long").alias("base"))


@query("SELECT count(*) FILTER (applied_lsn >= 990) AS acks, count(*) FILTER (applied_lsn >= 990) >= 3 AS enough FROM prog")
def acks_at_lsn(spark, d):
    return maintenance.acknowledged(progress(spark, d), 990, 3)


@query("""SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'cluster mismatch' WHEN a > 500000 THEN 'replica ahead' WHEN a < 20 THEN 'snapshot' WHEN user_id % 5 = 0 THEN 'history differs' ELSE 'stream' END AS decision
FROM (SELECT user_id, max(event_id) % 1000 * 600 % 600100 AS a FROM events GROUP BY user_id)""")
def handshake_decision(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg((F.max("event_id") % 1000 * 600 % 600_100).alias("a"))
    return r.select("user_id", handshake(F.col("user_id") % 7 != 0, F.col("a"), F.lit(500_000), F.lit(20), F.col("user_id") % 5 != 0).alias("decision"))


# telemetry


@query("SELECT node, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS errors FROM ns GROUP BY node")
def request_counts(spark, d):
    return samples(spark, d).groupBy("node").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("errors"))


HIST = "h AS (SELECT node, CASE WHEN ns <= 1 THEN 0 ELSE least(floor(log2(ns) * 4)::INT, 159) END AS bucket, count(*) AS n FROM ns GROUP BY ALL)"


@query(f", {HIST} SELECT node, bucket, n FROM h")
def latency_histogram(spark, d):
    return telemetry.histogram(samples(spark, d), F.col("ns"), ["node"])


@query(f""", {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY node ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY node) AS total FROM h)
SELECT node, permille, ceil(pow(2.0, (min(bucket) + 1) / 4.0))::DOUBLE AS upper_ns FROM c, (SELECT unnest([500, 950, 990]) AS permille) WHERE upto >= greatest(1, (total * permille + 999) // 1000) GROUP BY ALL""")
def histogram_percentiles(spark, d):
    return telemetry.histogram_percentiles(latency_histogram(spark, d), ["node"], [500, 950, 990])


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = greatest(1, (n * 9500 + 9999) // 10000)")
def nearest_rank_percentiles(spark, d):
    return telemetry.nearest_rank(table(spark, d, "events"), ["event_type"], "value", 9500)


@query("SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = n // 2 + 1")
def upper_median(spark, d):
    return telemetry.upper_median(table(spark, d, "events"), ["event_type"], "value")


@query("SELECT event_type, least, value AS median, most FROM (SELECT event_type, value, row_number() OVER w AS r, count(*) OVER p AS n, min(value) OVER p AS least, max(value) OVER p AS most FROM events WHERE value IS NOT NULL WINDOW p AS (PARTITION BY event_type), w AS (PARTITION BY event_type ORDER BY value)) WHERE r = n // 2 + 1")
def median_range(spark, d):
    return telemetry.median_range(table(spark, d, "events"), ["event_type"], "value")


@query("SELECT mix, median(q)::DOUBLE AS median FROM bench GROUP BY mix")
def mix_median(spark, d):
    return telemetry.mix_medians(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mix"), F.col("l_quantity").alias("q")), ["mix"], "q")


@query(""", a AS (SELECT mix, median(q) AS before FROM bench WHERE build = 'O' GROUP BY mix), b AS (SELECT mix, median(q) AS after FROM bench WHERE build = 'F' AND mix <> 'R' GROUP BY mix)
SELECT mix, before, after, CASE WHEN before <> 0 THEN (after - before) / before END AS change FROM a LEFT JOIN b USING (mix)""")
def base_head_change(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mix"), F.col("l_linestatus").alias("build"), F.col("l_quantity").alias("q"))
    side = lambda f: telemetry.mix_medians(l.filter(f), ["mix"], "q")
    return telemetry.base_head(side("build = 'O'"), side("build = 'F' and mix <> 'R'"), ["mix"], "median")


SERIES = "s AS (SELECT node, event_id AS t_ms, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 50 = 0 THEN 0 ELSE event_id * 3 END AS value FROM ns)"


def series(spark, d) -> DataFrame:
    v = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 50 == 0, 0).otherwise(F.col("event_id") * 3)
    return samples(spark, d).select("node", F.col("event_id").alias("t_ms"), v.alias("value"))


@query(f""", {SERIES}, l AS (SELECT *, lag(t_ms) OVER w AS t0, lag(value) OVER w AS v0 FROM s WINDOW w AS (PARTITION BY node ORDER BY t_ms))
SELECT node, t_ms, (value - v0) * 1000.0::DOUBLE / (t_ms - t0) AS rate FROM l WHERE v0 IS NOT NULL AND value IS NOT NULL AND value >= v0 AND t_ms > t0""")
def counter_rates(spark, d):
    return telemetry.counter_rates(series(spark, d), step=5000)


@query(f", {SERIES} SELECT q.node, q.t_ms, (SELECT value FROM s WHERE s.node = q.node AND s.t_ms = (SELECT max(t_ms) FROM s s2 WHERE s2.node = q.node AND s2.t_ms <= q.t_ms)) AS value FROM (SELECT 'n' || (c_custkey % 3) AS node, c_custkey * 5 AS t_ms FROM customer) q")
def asof_value(spark, d):
    asked = table(spark, d, "customer").select(F.concat(F.lit("n"), (F.col("c_custkey") % 3).cast("string")).alias("node"), (F.col("c_custkey") * 5).alias("t_ms"))
    return telemetry.as_of(asked, series(spark, d), step=5000)


@query(f", {SERIES} SELECT node, t_ms, value FROM s QUALIFY row_number() OVER (PARTITION BY node ORDER BY t_ms DESC) <= 300")
def last_n_samples(spark, d):
    return telemetry.last_samples(series(spark, d))


@query(", s AS (SELECT node, event_id AS seq, event_id * 37 % 1009 AS t_ms FROM ns), x AS (SELECT *, max(t_ms) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s) SELECT node, seq, t_ms FROM x WHERE seen IS NULL OR t_ms > seen")
def advancing_samples(spark, d):
    s = samples(spark, d).select("node", F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 1009).alias("t_ms"))
    return telemetry.advancing(s, step=5000)


@query("SELECT count(*) FILTER (event_type <> 'error') AS syncs, count(*) FILTER (event_type = 'error') AS errors, ((sum(ns) FILTER (event_type <> 'error') // count(*) FILTER (event_type <> 'error') + 999) // 1000)::BIGINT AS avg_us, ((max(ns) FILTER (event_type <> 'error') + 999) // 1000)::BIGINT AS max_us FROM ns")
def sync_stats(spark, d):
    return telemetry.sync_stats(samples(spark, d), "ns", F.col("event_type") == "error")


@query("SELECT node, count(*) FILTER (event_type <> 'error') / 10.0::DOUBLE AS per_second, (sum(ns) FILTER (event_type <> 'error'))::DOUBLE / count(*) FILTER (event_type <> 'error') AS mean_ns FROM ns GROUP BY node")
def throughput(spark, d):
    ok = F.col("event_type") != "error"
    return samples(spark, d).groupBy("node").agg((F.count_if(ok) / 10.0).alias("per_second"), (F.sum(F.when(ok, F.col("ns"))).cast("double") / F.count_if(ok)).alias("mean_ns"))


@query("SELECT node, greatest(max(event_id) - min(event_id), 0) / 100.0::DOUBLE / 7.0::DOUBLE * 100 AS percent FROM ns GROUP BY node")
def cpu_percent(spark, d):
    r = samples(spark, d).groupBy("node").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return r.select("node", S.cpu_percent(F.col("a"), F.col("b"), 100.0, F.lit(7.0)).alias("percent"))


@query("SELECT event_id, k AS name, v AS value FROM (SELECT event_id, unnest(['lsn', 'user', 'lag']) AS k, unnest([event_id::VARCHAR, user_id::VARCHAR, NULL]) AS v FROM events)")
def stats_lines(spark, d):
    text = F.concat(F.lit("lsn="), F.col("event_id").cast("string"), F.lit("\nbroken\nuser="), F.col("user_id").cast("string"), F.lit("\nlag=unknown\n=x"))
    return telemetry.parse_stats(table(spark, d, "events").select("event_id", text.alias("text")))


# scalar functions


@query("SELECT key, lower(hex(encode(key))) AS hex, key AS again, NULL::VARCHAR AS odd FROM live")
def hex_roundtrip(spark, d):
    x = kv.live(log(spark, d)).select("key", S.hex_encode(F.col("key")).alias("hex"))
    return x.select("key", "hex", S.hex_decode(F.col("hex")).cast("string").alias("again"), S.hex_decode(F.concat("hex", F.lit("a"))).cast("string").alias("odd"))


@query("SELECT lsn, (33 + strlen(key) + coalesce(strlen(value), 0))::INT AS length FROM m")
def encoded_length(spark, d):
    return log(spark, d).select("lsn", S.encoded_length(F.col("key"), F.col("value")).cast("int").alias("length"))


@query("SELECT lsn, CASE WHEN lsn % 5 = 0 THEN 'empty key' WHEN lsn % 7 = 0 THEN 'key too long' WHEN lsn % 11 = 0 THEN 'unknown operation' WHEN lsn % 13 = 0 AND op = 2 THEN 'delete with value' END AS error FROM m")
def record_checks(spark, d):
    m = log(spark, d)
    key = F.when(F.col("lsn") % 5 == 0, "").when(F.col("lsn") % 7 == 0, F.repeat(F.lit("k"), 4097)).otherwise(F.col("key"))
    op = F.when(F.col("lsn") % 11 == 0, 3).otherwise(F.col("op"))
    value = F.when((F.col("lsn") % 13 == 0) & (F.col("op") == 2), "x").otherwise(F.col("value"))
    return m.select("lsn", S.mutation_error(op, key, value).alias("error"))


@query("""SELECT lsn, CASE WHEN lsn % 4 < 3 THEN ['SET', 'GET', 'SCAN'][lsn % 4 + 1] END AS verb, CASE WHEN lsn % 4 < 3 THEN key END AS key,
 CASE WHEN lsn % 4 = 0 THEN 'a b ' || lsn WHEN lsn % 4 = 2 THEN key || '~ 10' END AS value, CASE WHEN lsn % 4 = 3 THEN 'unknown command' END AS error FROM m""")
def command_parse(spark, d):
    n, lsn = F.col("lsn") % 4, F.col("lsn").cast("string")
    line = F.when(n == 0, F.concat(F.lit("  set "), "key", F.lit("  a b "), lsn, F.lit(" "))).when(n == 1, F.concat(F.lit("Get "), "key")).when(n == 2, F.concat(F.lit("SCAN "), "key", F.lit(" "), "key", F.lit("~ 10"))).otherwise(F.lit("jump x"))
    return parse_commands(log(spark, d).select("lsn", "key", line.alias("line")).drop("key")).drop("line")


@query("SELECT lsn, [lpad(hex(i * 16), 8, '0') || '  ' || rtrim(regexp_replace(lower(hex(encode(substr(key, i * 16 + 1, 16)))), '(..)', '\\1 ', 'g')) FOR i IN range(0, (strlen(key) + 15) // 16)]::VARCHAR AS dump FROM m".replace("\\\\", "\\"))
def hexdump(spark, d):
    x = log(spark, d).select("lsn", S.hexdump(F.col("key").cast("binary")).alias("dump"))
    return x.select("lsn", F.concat(F.lit("["), F.array_join("dump", ", "), F.lit("]")).alias("dump"))


@query("SELECT lsn, 'k:' || lpad(lsn::VARCHAR, 8, '0') AS k, 'key-' || lpad((lsn % 600)::VARCHAR, 5, '0') AS dashed, (lsn // 8 + CASE WHEN 3 < lsn % 8 THEN 1 ELSE 0 END)::BIGINT AS share, ((lsn * 701 + 999) // 1000)::BIGINT AS us FROM m")
def formats(spark, d):
    lsn = F.col("lsn")
    return log(spark, d).select("lsn", S.key_text("k:", lsn).alias("k"), S.key_text("key-", lsn % 600, 5).alias("dashed"), S.work_share(lsn, 8, F.lit(3)).alias("share"), S.ceil_micros(lsn * 701).alias("us"))


@query("SELECT lsn, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%.1f MiB', b / 1048576.0) END AS size FROM (SELECT lsn, lsn * 1000 + 3 AS b FROM m)")
def human_sizes(spark, d):
    return log(spark, d).select("lsn", S.human_bytes(F.col("lsn") * 1000 + 3).alias("size"))


@query("SELECT lsn, ['OK', 'NOT_FOUND', 'BAD_REQUEST', 'NOT_PRIMARY', 'UNAVAILABLE', 'INTERNAL_ERROR', 'UNSUPPORTED_VERSION', 'RESOURCE_EXHAUSTED', 'OK_VOLATILE', 'QUEUED'][lsn % 12 + 1] AS status, ['UNAVAILABLE', 'NOT_PRIMARY', 'RESOURCE_EXHAUSTED', 'INTERNAL_ERROR', NULL][lsn % 5 + 1] AS failure FROM m")
def status_names(spark, d):
    error = F.get(F.array(*map(F.lit, ["io", "read-only replica", "resource exhausted", "format", None])), (F.col("lsn") % 5).cast("int"))
    return log(spark, d).select("lsn", S.status_name(F.col("lsn") % 12).alias("status"), S.failure_status(error).alias("failure"))


@query("SELECT json_object('key', key, 'value', value || chr(10) || chr(34) || chr(92))::VARCHAR AS row FROM live")
def json_rows(spark, d):
    """Pairs as JSON objects, with a line end, a quote and a backslash in the value."""
    return latest_state(spark, d).select(F.to_json(F.struct("key", F.concat("value", F.lit("\n\"\\")).alias("value"))).alias("row"))


@query("""SELECT lsn, n AS name, v AS value FROM (SELECT lsn, unnest(['key', 'a b', 'flag', 'odd', 'eq']) AS n, unnest([key, '+' || lsn, '', '%zz%', 'x=y']) AS v FROM m)""")
def query_params(spark, d):
    text = F.concat(F.lit("key="), F.replace(F.col("key"), F.lit(":"), F.lit("%3a")), F.lit("&&a+b=%2B"), F.col("lsn").cast("string"), F.lit("&flag&odd=%zz%&eq=x=y"))
    return log(spark, d).select("lsn", F.explode(S.query_pairs(text)).alias("p")).select("lsn", "p.name", "p.value")


@query("SELECT lsn, CASE WHEN coalesce(value, '') = '' THEN '-' ELSE lower(hex(encode(value))) END AS shown FROM m")
def rendered_values(spark, d):
    return log(spark, d).select("lsn", S.shown(F.coalesce("value", F.lit("")).cast("binary")).alias("shown"))


@query("SELECT lsn, lsn % 4 IN (0, 2) AS printable, CASE lsn % 4 WHEN 0 THEN key WHEN 1 THEN key || chr(7) WHEN 2 THEN key || 'é' || chr(10) ELSE key || chr(65533) END AS text FROM m")
def printable_values(spark, d):
    """Plain text, text with a control character, with letters beyond ASCII, and bytes that are no text."""
    k, n = F.col("key").cast("binary"), F.col("lsn") % 4
    x = F.when(n == 0, k).when(n == 1, F.concat(k, F.lit(b"\x07"))).when(n == 2, F.concat(k, F.lit("é\n".encode()))).otherwise(F.concat(k, F.lit(b"\xff")))
    return log(spark, d).select("lsn", x.alias("x")).select("lsn", F.coalesce(S.printable(F.col("x")), F.lit(False)).alias("printable"), S.lossy_text(F.col("x")).alias("text"))


@query(f"SELECT lsn, left(repeat({LE.format('lsn')} || '00000000', 3), 40) AS hex FROM m")
def generated_values(spark, d):
    return log(spark, d).select("lsn", F.lower(F.hex(S.value_bytes(F.col("lsn"), 20))).alias("hex"))


@query("""SELECT lsn, CASE WHEN us >= 100000 THEN printf('%.0f ms', us / 1000.0) WHEN us >= 10000 THEN printf('%.1f ms', us / 1000.0) ELSE printf('%.2f ms', us / 1000.0) END AS ms,
 CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS uptime,
 CASE WHEN r < 10 THEN printf('%.1f', r) ELSE format('{:,}', floor(r + 0.5)::BIGINT) END AS rate FROM (SELECT lsn, lsn * 37 AS us, lsn * 11 AS s, lsn * 0.75::DOUBLE AS r FROM m)""")
def human_times(spark, d):
    lsn = F.col("lsn")
    return log(spark, d).select("lsn", S.human_ms(lsn * 37).alias("ms"), S.human_uptime(lsn * 11).alias("uptime"), S.human_rate(lsn * F.lit(0.75)).alias("rate"))


@query("SELECT lsn, CASE WHEN lsn % 3 > 0 THEN md5(lsn::VARCHAR) END AS id FROM m")
def node_ids(spark, d):
    """Ids of 32 hex digits, through their bytes; those with a digit missing are none."""
    text = F.upper(F.md5(F.col("lsn").cast("string")))
    text = F.when(F.col("lsn") % 3 == 0, F.substring(text, 2, 31)).otherwise(text)
    return log(spark, d).select("lsn", S.id_text(S.id_bytes(text)).alias("id"))


@query("""SELECT lsn, CASE WHEN k < 9 THEN ['SET', 'GET', 'SCAN', 'SET', 'GET', 'SCAN', 'EXISTS', 'PING', 'SET'][k + 1] END AS verb,
 CASE k WHEN 0 THEN x WHEN 1 THEN x WHEN 2 THEN '' END AS key, CASE k WHEN 0 THEN '' END AS value, CASE k WHEN 2 THEN x END AS end, CASE k WHEN 2 THEN 25 END AS limit,
 [NULL, NULL, NULL, 'value is not hex', 'key is not hex', 'bad limit', 'wrong number of arguments', NULL, 'bad key length', 'unknown command'][k + 1] AS error FROM (SELECT lsn, (lsn % 10)::INT AS k, lower(hex(encode(key))) AS x FROM m)""")
def hex_commands(spark, d):
    from .sources.files import parse_hex_commands

    x, k = F.upper(S.hex_encode(F.col("key").cast("binary"))), F.col("lsn") % 10
    lines = [F.concat(F.lit(" set "), x, F.lit(" - ")), F.concat(F.lit("Get  "), x), F.concat(F.lit("scan * "), x, F.lit(" 25")), F.concat(F.lit("set "), x, F.lit(" 0x")), F.concat(F.lit("get a"), x)]
    lines += [F.concat(F.lit("scan * * 0"), F.lit("")), F.lit("exists"), F.lit("PING"), F.concat(F.lit("set "), F.repeat(F.lit("6b"), 4097), F.lit(" 00")), F.concat(F.lit("jump "), x)]
    line = F.get(F.array(*lines), k.cast("int"))
    return parse_hex_commands(log(spark, d).select("lsn", line.alias("line"))).drop("line")


# streaming


@query("SELECT key, op, lsn FROM n")
def stream_latest_state(spark, d):
    """The newest change of each key by a stream over the change log's files. Its state and its
    output go to the folder that all executors share (spark.checkpoint.dir)."""
    from .streaming.replicate import live_view, shared_folder

    e = table(spark, d, "events")
    # a folder of part files is streamed as it is, a single file by its name
    whole = e.inputFiles()
    single = len(whole) == 1 and whole[0].endswith("/events.parquet")
    found = spark.readStream.schema(e.schema).option("recursiveFileLookup", True)
    found = found.option("pathGlobFilter", "events.parquet").parquet(d) if single else found.parquet(f"{d}/events.parquet")
    base = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    return live_view(changelog.from_events(found), f"{base}/out", f"{base}/check").select("key", "op", "lsn")
