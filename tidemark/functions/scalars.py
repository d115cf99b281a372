"""Scalar functions and row checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEY, MAX_RECORD, RECORD_HEAD, PAGE_BYTES = 4096, 1_000_000, 33, 1_048_568
MAX_GROUP, MAX_LIMIT = 64, 10_000
LAST_BUCKET = 159


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(c))


def hex_decode(c: Column) -> Column:
    """Null unless the text is whole pairs of hex digits."""
    return F.when(c.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(c))


def encoded_length(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + RECORD_HEAD


def pair_length(key: Column, value: Column) -> Column:
    return F.octet_length(key) + F.octet_length(value) + 8


def mutation_error(op: Column, key: Column, value: Column) -> Column:
    """Why a change is refused, or null."""
    return (
        F.when(key.isNull() | (F.octet_length(key) == 0), "empty key")
        .when(F.octet_length(key) > MAX_KEY, "key too long")
        .when(~op.isin(1, 2), "unknown operation")
        .when((op == 2) & value.isNotNull(), "delete with value")
        .when((op == 1) & value.isNull(), "set without value")
        .when(encoded_length(key, value) > MAX_RECORD, "record too large")
    )


def shown(c: Column) -> Column:
    """Bytes as text: hex, '-' for none."""
    return F.when(F.octet_length(c) == 0, "-").otherwise(hex_encode(c))


def printable(c: Column) -> Column:
    return F.is_valid_utf8(c.cast("string")) & ~F.make_valid_utf8(c.cast("string")).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def hexdump(c: Column) -> Column:
    """Lines of 16 bytes: offset and hex."""
    n = F.octet_length(c)
    line = lambda i: F.concat(F.lpad(F.lower(F.hex(i * 16)), 8, "0"), F.lit("  "), F.rtrim(F.regexp_replace(hex_encode(F.substring(c, i * 16 + 1, F.lit(16))), "(..)", "$1 ")))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")), line))


def key_text(prefix: str, n: Column, width: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def work_share(total: Column, workers: int, i: Column) -> Column:
    return F.floor(total / workers).cast("long") + F.when(i < total % workers, 1).otherwise(0)


def ceil_micros(ns: Column) -> Column:
    return F.floor((ns + 999) / 1000).cast("long")


def latency_bucket(ns: Column) -> Column:
    """Quarter octaves: floor(4 log2 ns), 0 up to 1 ns, the last bucket for the rest."""
    return F.when(ns <= 1, 0).otherwise(F.least(F.floor(F.log2(ns) * 4).cast("int"), F.lit(LAST_BUCKET))).cast("int")


def bucket_upper(i: Column) -> Column:
    return F.ceil(F.pow(F.lit(2.0), (i + 1) / 4)).cast("double")


def human_bytes(n: Column) -> Column:
    at = lambda k: F.regexp_replace(F.format_number(n / float(1 << (10 * k)), 1), ",", "")
    return F.when(n.isNull(), "-").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(at(1), F.lit(" KiB"))).when(n < 1 << 30, F.concat(at(2), F.lit(" MiB"))).otherwise(F.concat(at(3), F.lit(" GiB")))


def replica_state(connected: Column, lag: Column, caught_up: Column) -> Column:
    return F.when(~F.coalesce(connected, F.lit(False)), "disconnected").when(lag.isNull(), "online").when(caught_up & (lag == 0), "synced").when(lag == 0, "synced").otherwise("lagging")


def cpu_percent(before: Column, after: Column, hz: float, seconds: Column) -> Column:
    return F.when(seconds > 0, F.greatest(after - before, F.lit(0)) / hz / seconds * 100)


def change(before: Column, after: Column) -> Column:
    return F.when(before != 0, (after - before) / before)


#: Names of request outcomes by their number.
STATUSES = ["OK", "NOT_FOUND", "BAD_REQUEST", "NOT_PRIMARY", "UNAVAILABLE", "INTERNAL_ERROR", "UNSUPPORTED_VERSION", "RESOURCE_EXHAUSTED", "OK_VOLATILE", "QUEUED"]


def status_name(code: Column) -> Column:
    """Null for numbers that name none."""
    return F.get(F.array(*map(F.lit, STATUSES)), code.cast("int"))


def failure_status(error: Column) -> Column:
    """The outcome that a failed write is told as."""
    return (
        F.when(error.isin("io", "fail closed", "corruption"), "UNAVAILABLE")
        .when(error == "read-only replica", "NOT_PRIMARY")
        .when(error == "mutation too large", "BAD_REQUEST")
        .when(error == "resource exhausted", "RESOURCE_EXHAUSTED")
        .when(error.isNotNull(), "INTERNAL_ERROR")
    )


def lossy_text(c: Column) -> Column:
    """Bytes as UTF-8 text; what is none is replaced."""
    return F.make_valid_utf8(c.cast("string"))


def percent_decoded(text: Column) -> Column:
    """+ is a space and %XX a byte; a broken escape stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_pairs(query: Column) -> Column:
    """Pairs (name, value) of a URL query; a name without = has an empty value."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    value = lambda x: F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    return F.transform(parts, lambda x: F.struct(percent_decoded(F.substring_index(x, "=", 1)).alias("name"), percent_decoded(value(x)).alias("value")))


def value_bytes(operation: Column, length: int) -> Column:
    """The number's 8 little-endian bytes, over and over."""
    from .checksums import little

    return F.substring(F.unhex(F.repeat(F.hex(little(operation, 8)), -(-length // 8))), 1, length)


def id_text(c: Column) -> Column:
    return F.when(F.octet_length(c) == 16, hex_encode(c))


def id_bytes(text: Column) -> Column:
    """16 bytes of 32 hex digits, else null."""
    return F.when(text.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(text))


def _fixed(x: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def human_ms(us: Column) -> Column:
    ms = us / 1000
    text = F.when(ms >= 100, _fixed(ms, 0)).when(ms >= 10, _fixed(ms, 1)).otherwise(_fixed(ms, 2))
    return F.when(us.isNull(), "-").otherwise(F.concat(text, F.lit(" ms")))


def human_uptime(seconds: Column) -> Column:
    h, m, s = (F.floor(x).cast("long") for x in (seconds / 3600, seconds % 3600 / 60, seconds % 60))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(seconds.isNull(), "-")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def human_rate(r: Column) -> Column:
    return F.when(r.isNull(), "-").when(r < 10, _fixed(r, 1)).otherwise(F.format_number(F.floor(r + 0.5).cast("long"), 0))
