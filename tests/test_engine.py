import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions.checksums import crc32c, crc32c_of, crc64, crc64_of, record_hash, splitmix64
from tidemark.operators import changelog, kv, telemetry
from tidemark.plans.decisions import recovery_base
from tidemark.sources.files import directory_bytes, read_bench

SF = "/root/testdata/sf0.001"


def test_checksums(spark):
    assert int(crc32c_of([b"123456789"])[0]) == 0xE3069283
    assert int(crc64_of([b"123456789", b""])[0]) == 0x6C40DF5F0B497347
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),), (None,)], "b binary")
    assert [(r.a, r.b) for r in df.select(crc32c("b").alias("a"), F.hex(crc64("b")).alias("b")).collect()] == [(0xE3069283, "6C40DF5F0B497347"), (0, "0"), (None, None)]
    x = spark.range(1, 3).select(F.hex(splitmix64(F.lit(0).cast("long"), F.col("id"))).alias("x")).collect()
    assert [r.x for r in x] == ["E220A8397B1DCDAF", "6E789E6AA1B965F4"]


def test_record_hash_of_columns_and_of_a_commit_agree(spark):
    rows = changelog.chained([(1, b"k", b"v"), (2, b"k", None), (1, b"\x00\xff", b"")], 4, 77)
    df = spark.createDataFrame([(a, b, bytearray(c), d and bytearray(d), e, f) for a, b, c, d, e, f in rows], "lsn long, op int, key binary, value binary, prev_hash long, record_hash long")
    got = df.select("record_hash", record_hash(F.col("lsn"), F.col("op"), F.col("key"), F.col("value"), F.col("prev_hash")).alias("h")).collect()
    assert all(r.h == r.record_hash for r in got)
    assert changelog.broken_links(df.filter("lsn > 5")).select("lsn").collect()[0].lsn == 6


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.binary(min_size=1, max_size=2), st.binary(max_size=3)), max_size=40))
def test_live_state_is_that_of_a_dict(spark, ops):
    model = {}
    for op, k, v in ops:
        model.pop(k, None) if op == 2 else model.update({k: v})
    df = spark.createDataFrame([(i, op, bytearray(k), bytearray(v) if op == 1 else None) for i, (op, k, v) in enumerate(ops)], "lsn long, op int, key binary, value binary")
    assert {bytes(r.key): bytes(r.value) for r in kv.live(df).collect()} == model
    page = kv.scan_page(kv.live(df), limit=3).collect()
    assert [bytes(r.key) for r in page] == sorted(model)[:3] and all(r.more == (len(model) > 3) for r in page)


def test_packing(spark):
    jobs = spark.createDataFrame([("a", i, 30, 10) for i in range(5)] + [("b", 0, 1, 90), ("b", 1, 1, 20), ("b", 2, 64, 500), ("b", 3, 1, 1)], "writer string, job long, records long, bytes long")
    got = {(r.writer, r.job): r.group_id for r in changelog.pack(jobs, 64, 100).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 1, 2] and [got["b", i] for i in range(4)] == [0, 1, 2, 3]


def test_percentiles(spark):
    h = spark.createDataFrame([(10_000,)] * 90 + [(10_000_000,)] * 10, "ns long")
    p = {r.permille: r.upper_ns for r in telemetry.histogram_percentiles(telemetry.histogram(h, F.col("ns"), []), [], [500, 950]).collect()}
    assert 10_000 <= p[500] < 12_000 and 10_000_000 <= p[950] < 12_000_000
    v = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "v double")
    assert telemetry.nearest_rank(v, [], "v", 5000).first().v == 20 and telemetry.nearest_rank(v, [], "v", 9500).first().v == 40
    assert telemetry.upper_median(v, [], "v").first().v == 30
    assert telemetry.nearest_rank(v.limit(0), [], "v", 5000).collect() == []


def test_files_and_recovery(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("timestamp_ms,revision\n5,abc\n")
    r = read_bench(spark, str(p)).first()
    assert (r.timestamp_ms, r.revision, r.replica_catch_up_ms) == (5, "abc", None)
    assert directory_bytes(spark, str(tmp_path)).first().bytes == os.path.getsize(p)
    assert recovery_base([(10, True), (20, False)], 1, lambda n: True) == 10
    assert recovery_base([(10, True)], 1, lambda n: n == 0) == 0 and recovery_base([], 5, lambda n: True) is None


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("events", "customer", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    plain = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    df, sql = catalog.QUERIES[name](spark, SF), c.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    got = sorted([plain(x) for x in r] for r in df.select(*cols).collect())
    assert got == sorted([plain(x) for x in r] for r in sql.select(*[f'"{x}"' for x in cols]).fetchall())
