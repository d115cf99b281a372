import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog, kv
from tidemark.plans.transactions import Session
from tidemark.sources.store import Conflict, Corrupt, Exhausted, Store, manifest_error
from tidemark.streaming.replicate import Diverged, apply_batch, bootstrap, live_view, replicate


def rows(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_store_against_a_dict(spark, tmp_path):
    r, store, model = random.Random(7), Store(spark, str(tmp_path / "s"), level0=2), {}
    for step in range(8):
        changes = []
        for _ in range(r.randint(1, 12)):
            k = b"k%02d" % r.randrange(12)
            if r.random() < 0.3:
                changes.append((2, k, None))
                model.pop(k, None)
            else:
                v = b"v%d" % r.randrange(99) if r.random() < 0.9 else b""
                changes.append((1, k, v))
                model[k] = v
        store.commit(changes)
        if step in (2, 4, 6):
            store.flush(parts=2)
            store.compact(parts=2)
        if step == 5:
            store.snapshot()
    assert rows(store.state()) == model
    assert rows(store.recover()) == model
    again = Store(spark, store.path)
    assert rows(again.state()) == model and again.m["lsn"] == store.m["lsn"]
    page, seen, last = 4, {}, None
    while True:
        got = again.scan(start=b"k03", end=b"k11", limit=page, after=last).collect()
        seen |= {bytes(x.key): bytes(x.value) for x in got}
        if not got or not got[0].more:
            break
        last = bytes(got[-1].key)
    assert seen == {k: v for k, v in model.items() if b"k03" <= k < b"k11"}
    k = min(model)
    assert bytes(again.get(k).first().value) == model[k] and again.get(b"none").isEmpty()
    assert changelog.gaps(again.log()).isEmpty() and changelog.broken_links(again.log()).isEmpty()


def test_torn_commit_is_invisible_and_missing_file_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit([(1, b"a", b"1")])
    store.log().write.parquet(f"{store.path}/log/torn")
    assert rows(Store(spark, store.path).state()) == {b"a": b"1"}
    assert store.collect_garbage() == ["log/torn"]
    os.remove(f"{store.path}/{store.m['log'][0]['path']}/_SUCCESS")
    with pytest.raises(Corrupt):
        Store(spark, store.path)


def test_append_numbers_follow_the_order(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit([(1, b"a", b"0")])
    df = spark.range(500).select((500 - F.col("id")).alias("order"), F.lit(1).alias("op"), F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    assert store.append(df.repartition(6)) == 501
    assert changelog.gaps(store.log()).isEmpty()
    assert rows(store.state())[b"k0"] == b"0" and rows(store.state())[b"k6"] == b"6"
    store.flush()
    store.reclaim()
    assert rows(Store(spark, store.path).state())[b"k3"] == b"3"


def test_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    s, other = Session(store), Session(store)
    assert s.commit() == s.rollback() == "BAD_REQUEST" and Session(store, primary=False).begin() == "NOT_PRIMARY"
    assert s.set(b"A", b"100") == s.set(b"gone", b"x") == "OK"
    assert s.begin() == "OK" and s.begin() == "BAD_REQUEST"
    assert s.set(b"A", b"90") == s.set(b"B", b"110") == s.delete(b"gone") == "QUEUED"
    assert (s.get(b"A"), s.get(b"gone"), other.get(b"A"), other.get(b"gone")) == (b"90", None, b"100", b"x")
    assert rows(s.view()) == {b"A": b"90", b"B": b"110"} and s.scan() == "BAD_REQUEST"
    assert s.commit() == "OK" and rows(store.state()) == {b"A": b"90", b"B": b"110"}
    lsn = store.m["lsn"]
    assert s.begin() == s.commit() == "OK" and store.m["lsn"] == lsn
    s.begin()
    assert {s.set(b"k%d" % i, b"") for i in range(64)} == {"QUEUED"}
    assert (s.set(b"x", b""), s.set(b"y", b""), s.commit(), s.commit()) == ("RESOURCE_EXHAUSTED", "BAD_REQUEST", "BAD_REQUEST", "BAD_REQUEST")
    assert store.m["lsn"] == lsn
    assert s.delete(b"absent") == "OK" and store.m["lsn"] == lsn + 1


def test_replication(spark, tmp_path):
    primary, replica = Store(spark, str(tmp_path / "p")), Store(spark, str(tmp_path / "r"))
    for i in range(3):
        primary.commit([(1, b"k%d" % i, b"v"), (2, b"k0", None)])
    assert rows(replicate(primary.path, replica, str(tmp_path / "c"), files=2).state()) == rows(primary.state())
    primary.commit([(1, b"k9", b"new")])
    assert rows(replicate(primary.path, replica, str(tmp_path / "c")).state()) == rows(primary.state())
    before = replica.m["lsn"]
    assert apply_batch(replica, primary.log()) == before
    with pytest.raises(Diverged):
        apply_batch(replica, primary.log().withColumn("value", F.lit(b"other")))
    with pytest.raises(Diverged):
        apply_batch(replica, primary.log().limit(1).withColumn("lsn", F.lit(before + 2)))
    assert kv.same_relation(primary.state(), replica.state()).first().equal


def test_streamed_view(spark, tmp_path):
    rows_ = [(1, 1, "a", "x"), (2, 1, "b", "y"), (3, 2, "a", None)]
    for i, r in enumerate(rows_):
        spark.createDataFrame([r], "lsn long, op int, key string, value string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    found = spark.readStream.schema("lsn long, op int, key string, value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    view = live_view(found, f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted((x.key, x.lsn, x.op, x.value) for x in view.collect()) == [("a", 3, 2, None), ("b", 2, 1, "y")]


def test_torn_commit_does_not_reach_a_replica(spark, tmp_path):
    primary, replica = Store(spark, str(tmp_path / "p")), Store(spark, str(tmp_path / "r"))
    primary.commit([(1, b"a", b"1")])
    torn = Store(spark, primary.path)
    torn._publish = lambda m: None  # the data is written, and then the writer is lost
    torn.commit([(1, b"b", b"TORN")])
    replica = replicate(primary.path, replica, str(tmp_path / "c"))
    assert rows(replica.state()) == {b"a": b"1"}
    primary.commit([(1, b"b", b"2")])  # the retry has the same number
    replica = replicate(primary.path, replica, str(tmp_path / "c"))
    assert rows(replica.state()) == {b"a": b"1", b"b": b"2"} and replica.m["hash"] == primary.m["hash"]
    assert len(primary.collect_garbage()) == 2  # the torn entry and the manifest before
    # a marker that a crash left out is made up for by the next commit
    os.remove(f"{primary.path}/commits/{2:016d}.json")
    primary.commit([(2, b"a", None)])
    assert os.path.exists(f"{primary.path}/commits/{2:016d}.json")


def test_append_keeps_the_chain(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit([(1, b"a", b"0"), (1, b"b", b"0")])
    df = spark.range(300).select(F.col("id").alias("order"), F.lit(1).alias("op"), F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    store.append(df.repartition(4))
    store.commit([(1, b"c", b"0")])
    assert store.m["lsn"] == 303 and store.broken_links().isEmpty()
    assert store.log().filter("prev_hash is null or record_hash is null").isEmpty()
    replica = replicate(store.path, Store(spark, str(tmp_path / "r")), str(tmp_path / "c"))
    assert (replica.m["lsn"], replica.m["hash"], replica.m["cluster"]) == (303, store.m["hash"], store.m["cluster"])
    assert replica.broken_links().isEmpty() and rows(replica.state()) == rows(store.state())
    assert store.hash_at(302) == replica.hash_at(302) and store.hash_at(1) == store.log().filter("lsn = 1").first().record_hash
    assert [r.lsn for r in store.records_after(300).collect()] == [301, 302, 303] and store.records_after(304) is None


def test_bootstrap_after_reclaim_and_histories(spark, tmp_path):
    primary = Store(spark, str(tmp_path / "p"))
    for i in range(3):
        primary.commit([(1, b"k%d" % i, b"v%d" % i), (2, b"k0", None)])
    early = replicate(primary.path, Store(spark, str(tmp_path / "e")), str(tmp_path / "ce"))
    primary.flush()
    primary.commit([(1, b"late", b"x")])
    primary.reclaim()
    primary.commit([(1, b"later", b"y")])
    assert primary.records_after(2) is None and primary.hash_at(2) is None
    new = replicate(primary.path, Store(spark, str(tmp_path / "n")), str(tmp_path / "cn"))
    assert rows(new.state()) == rows(primary.state()) and (new.m["lsn"], new.m["hash"]) == (8, primary.m["hash"])
    assert rows(replicate(primary.path, early, str(tmp_path / "ce")).state()) == rows(primary.state())
    # what a greeted replica is told
    assert primary.greet(None, 6, primary.m["flushed_hash"]) == "stream" and primary.greet("other", 6, 0) == "cluster mismatch"
    assert primary.greet(None, 9, 0) == "replica ahead" and primary.greet(None, 2, 0) == "snapshot" and primary.greet(None, 6, 5) == "history differs"
    other = Store(spark, str(tmp_path / "o"))
    other.commit([(1, b"z", b"z")])
    with pytest.raises(Diverged):
        replicate(primary.path, other, str(tmp_path / "co"))
    with pytest.raises(Diverged):
        bootstrap(other, primary)
    with pytest.raises(ValueError):
        other.ingest(primary.state(), 8, 1)
    twin = Store(spark, str(tmp_path / "t"))
    twin.ingest(primary.state(), 8, primary.m["hash"], primary.m["cluster"])
    assert rows(Store(spark, twin.path).state()) == rows(primary.state()) and twin.m["lsn"] == 8


def test_two_writers_conflict(spark, tmp_path):
    one = Store(spark, str(tmp_path / "s"))
    one.commit([(1, b"a", b"1")])
    two = Store(spark, one.path)
    two.commit([(1, b"b", b"2")])
    with pytest.raises(Conflict):
        one.commit([(1, b"c", b"3")])
    assert rows(one.refresh().state()) == {b"a": b"1", b"b": b"2"}


def test_maintenance(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), level0=2, table_bytes=2000)
    for i in range(2):
        store.commit([(1, b"%03d" % k, bytes([k]) * 40) for k in range(i * 40, i * 40 + 60)])
        assert "flush" in store.maintain(flush_bytes=1)
    assert [x["level"] for x in store.m["runs"]] == [1] * len(store.m["runs"]) and len(store.m["runs"]) > 1
    tables = sorted((x["min"], x["max"]) for x in store.m["runs"])
    assert all(a[1] < b[0] for a, b in zip(tables, tables[1:], strict=False)) and len(rows(store.state())) == 100
    assert bytes(store.get(b"007").first().value) == b"\x07" * 40 and len(store._pruned(b"007", b"008").inputFiles()) == 1
    with pytest.raises(Exhausted):
        store.snapshot(budget=100)
    assert not store.m["snapshots"] and store.snapshot(budget=10**9) == 120
    told = store.stats().first()
    assert told.table_bytes == store.bytes(("runs",)) > 0 and told.wal_entries == 0 and told.level0_tables == 0
    store.reclaim(keep_after=60)
    assert len(store.m["log"]) == 1 and store.maintain() == []
    good = store.m
    for bad in ({"next": 1}, {"flushed": 999}, {"runs": good["runs"] + good["runs"][:1]}, {"runs": [{**good["runs"][0], "min": "ff", "max": "00"}]}, {"runs": [{**good["runs"][0], "entries": 0}]}):
        assert manifest_error({**good, **bad})
    assert manifest_error(good) is None
