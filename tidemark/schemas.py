"""Schemas of the tables of the engine, as DDL."""

MUTATIONS = "lsn BIGINT, op TINYINT, key BINARY, value BINARY, prev_hash BIGINT"
GROUPS = "first_lsn BIGINT, last_lsn BIGINT, count INT, last_record_hash BIGINT"
KV = "key BINARY, value BINARY"
MANIFEST_TABLES = "id BIGINT, level TINYINT, file_len BIGINT, entry_count BIGINT, min_key BINARY, max_key BINARY"
REPLICA_PROGRESS = "node_id STRING, applied_lsn BIGINT, connected BOOLEAN"
STATS_SAMPLES = "t_ms BIGINT, node STRING, stats MAP<STRING,STRING>"
BENCH = (
    "timestamp_ms BIGINT, revision STRING, build_mode STRING, os STRING, arch STRING, kernel STRING, filesystem STRING, storage_medium STRING, topology STRING, durability STRING, "
    "replicas_configured INT, replicas_caught_up BOOLEAN, clients INT, operations_requested BIGINT, warmup_requested BIGINT, read_ratio DOUBLE, keys BIGINT, value_bytes INT, seed BIGINT, "
    "elapsed_seconds DOUBLE, successful_ops BIGINT, failed_ops BIGINT, skipped_ops BIGINT, read_ops BIGINT, write_ops BIGINT, read_misses BIGINT, ops_per_second DOUBLE, avg_latency_ns BIGINT, "
    "p50_latency_ns BIGINT, p95_latency_ns BIGINT, p99_latency_ns BIGINT, server_cpu_percent DOUBLE, server_peak_rss_kib BIGINT, data_bytes BIGINT, wal_bytes BIGINT, server_read_p99_us BIGINT, "
    "server_read_lock_wait_p99_us BIGINT, server_write_lock_hold_p99_us BIGINT, server_wal_sync_avg_us BIGINT, replica_catch_up_ms DOUBLE"
)
RECOVERY = "scenario STRING, trial INT, initial_records BIGINT, tail_records BIGINT, keys BIGINT, value_bytes INT, last_lsn BIGINT, snapshot_lsn BIGINT, replayed_records BIGINT, recovery_us BIGINT, open_us BIGINT, data_bytes BIGINT"
