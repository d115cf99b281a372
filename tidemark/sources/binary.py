"""Readers and encoders of the binary log, snapshot and page formats, fail-closed.

Files are read whole by Spark's binaryFile source and decoded in Arrow batches, a file to a task.
What does not check out is an error and never a missing record; only the open end of the newest
log segment may be torn, and what no footer closes there is dropped. The 8 bytes that mark a kind
of file are parameters.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.checksums import crc32c_one, crc64_one, encode_record

HEAD, FOOT, TAIL_BYTES = 64, 40, 8 << 20
LENGTHS = range(29, 999_997)


class Broken(ValueError):
    """The bytes are not what the format says."""


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise Broken(why)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def sealed(body: bytes) -> bytes:
    return body + struct.pack("<I", crc32c_one(body))


def _open_seal(b: bytes, what: str) -> None:
    _need(struct.unpack("<I", b[-4:])[0] == crc32c_one(b[:-4]), f"{what} checksum differs")


def segment_head(magic: bytes, cluster: bytes, node: bytes, first: int) -> bytes:
    return sealed(struct.pack("<8sHH16s16sQ8x", magic, 1, HEAD, cluster, node, first))


def read_segment_head(b: bytes, magic: bytes) -> tuple[bytes, bytes, int]:
    """(cluster, node, first number)."""
    _need(len(b) >= HEAD, "segment header is cut")
    mark, version, size, cluster, node, first, spare = struct.unpack("<8sHH16s16sQ8s", b[:60])
    _need(mark == magic, "bad segment magic")
    _need(version == 1 and size == HEAD, "unsupported segment version or header length")
    _need(spare == bytes(8), "reserved bytes are not zero")
    _open_seal(b[:HEAD], "segment header")
    return cluster, node, first


def group_footer(magic: bytes, first: int, last: int, mark: int) -> bytes:
    return sealed(struct.pack("<8sQQIQ", magic, first, last, last - first + 1, mark))


def read_footer(b: bytes, magic: bytes) -> tuple[int, int, int, int]:
    """(first, last, count, hash of the last record)."""
    _need(len(b) >= FOOT, "footer is cut")
    mark, first, last, count, h = struct.unpack("<8sQQIQ", b[:36])
    _need(mark == magic, "bad footer magic")
    _open_seal(b[:FOOT], "footer")
    _need(1 <= count <= 64, "bad footer count")
    _need(last >= first and last - first + 1 == count, "footer numbers do not fit its count")
    return first, last, count, h


def read_record(b: bytes) -> tuple[int, int, int, bytes, bytes, int, int]:
    """(bytes used, lsn, op, key, value, previous hash, own hash) of the record at the front."""
    _need(len(b) >= 4, "record is cut")
    size = struct.unpack("<I", b[:4])[0]
    _need(size in LENGTHS, "bad record length")
    _need(len(b) >= size + 4, "record is cut")
    lsn, op, k, v, before = struct.unpack("<QBIIQ", b[4:29])
    _need(op in (1, 2), "unknown operation")
    _need(29 + k + v == size, "record lengths differ")
    _need(op == 1 or v == 0, "delete with value")
    _open_seal(b[: size + 4], "record")
    return size + 4, lsn, op, b[29 : 29 + k], b[29 + k : 29 + k + v], before, crc64_one(b[: size + 4])


def read_segment(b: bytes, magic: bytes, footer: bytes, newest: bool, before: int | None = None) -> list[tuple]:
    """Records (lsn, op, key, value, previous hash, own hash) that a footer closes. `before` is the
    hash ahead of the segment, where it is known. A sealed segment has to be whole; the newest one
    may end in an open tail of up to 8 MiB."""
    _, _, first = read_segment_head(b, magic)
    out: list[tuple] = []
    group: list[tuple] = []
    at = closed = HEAD
    try:
        while at < len(b):
            if b[at : at + 8] == footer:
                lo, hi, count, mark = read_footer(b[at:], footer)
                _need(bool(group) and (lo, hi, count, mark) == (group[0][0], group[-1][0], len(group), group[-1][5]), "footer does not match its records")
                out, group, at = out + group, [], at + FOOT
                closed = at
                continue
            used, lsn, op, key, value, prev, own = read_record(b[at : at + 1_000_000])
            last = (group or out or [(first - 1, 0, b"", b"", 0, before)])[-1]
            _need(lsn == last[0] + 1, "numbers are not contiguous")
            _need(last[5] is None or prev == last[5], "hash chain is broken")
            group.append((lsn, op, key, value, prev, own))
            _need(len(group) <= 64, "group without footer")
            at += used
        _need(not group, "records without footer")
    except Broken:
        if not newest or len(b) - closed > TAIL_BYTES:
            raise
    return out


def write_segment(magic: bytes, footer: bytes, cluster: bytes, node: bytes, groups: list[list[tuple]], first: int = 1, before: int = 0) -> bytes:
    """Bytes of a segment of groups of (op, key, value)."""
    out, lsn, h = [segment_head(magic, cluster, node, first)], first, before
    for group in groups:
        start = lsn
        for op, key, value in group:
            x = encode_record(lsn, op, key, value or b"", h)
            out.append(x)
            h, lsn = crc64_one(x), lsn + 1
        out.append(group_footer(footer, start, lsn - 1, h))
    return b"".join(out)


def write_snapshot(magic: bytes, cluster: bytes, lsn: int, mark: int, pairs: list[tuple[bytes, bytes]]) -> bytes:
    body = b"".join(struct.pack("<II", len(k), len(v)) + k + v for k, v in pairs)
    x = sealed(struct.pack("<8sHH16sQQQQ", magic, 1, HEAD, cluster, lsn, mark, len(pairs), len(body))) + body
    return x + struct.pack("<Q", crc64_one(x))


def read_snapshot(b: bytes, magic: bytes, cluster: bytes | None = None) -> tuple[int, int, list[tuple[bytes, bytes]]]:
    """(lsn, hash at it, pairs) of a whole snapshot file."""
    _need(len(b) >= HEAD + 8, "snapshot is cut")
    mark, version, size, of, lsn, h, count, length = struct.unpack("<8sHH16sQQQQ", b[:60])
    _need(mark == magic, "bad snapshot magic")
    _need(version == 1 and size == HEAD, "unsupported snapshot version or header length")
    _need(cluster is None or of == cluster, "snapshot of another cluster")
    _open_seal(b[:HEAD], "snapshot header")
    _need(struct.unpack("<Q", b[-8:])[0] == crc64_one(b[:-8]), "snapshot checksum differs")
    body, at, pairs = b[HEAD:-8], 0, {}
    _need(length == len(body), "payload length differs")
    while at < len(body):
        _need(at + 8 <= len(body), "entry overruns the payload")
        k, v = struct.unpack("<II", body[at : at + 8])
        _need(at + 8 + k + v <= len(body), "entry overruns the payload")
        key = body[at + 8 : at + 8 + k]
        _need(key not in pairs, "duplicate key")
        pairs[key] = body[at + 8 + k : at + 8 + k + v]
        at += 8 + k + v
    _need(count == len(pairs), "entry count differs")
    return lsn, h, list(pairs.items())


def read_page(b: bytes) -> tuple[list[tuple[bytes, bytes]], bool]:
    """(pairs, more) of a page of a scan."""
    _need(len(b) >= 5, "page is shorter than its header")
    count, more = struct.unpack("<IB", b[:5])
    _need(more < 2, "bad more flag")
    at, pairs = 5, []
    for _ in range(count):
        _need(at + 8 <= len(b), "pair overruns the page")
        k, v = struct.unpack("<II", b[at : at + 8])
        _need(at + 8 + k + v <= len(b), "pair overruns the page")
        pairs.append((b[at + 8 : at + 8 + k], b[at + 8 + k : at + 8 + k + v]))
        at += 8 + k + v
    _need(at == len(b), "bytes behind the page")
    return pairs, bool(more)


def read_segments(spark: SparkSession, path: str, magic: bytes, footer: bytes, pattern: str = "*") -> DataFrame:
    """Records of all segment files below a path; the one with the highest first number is the
    newest. Segments are decoded apart, so links between them are left to broken_links."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)

    def heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield pd.DataFrame({"first": [read_segment_head(bytes(c), magic)[2] for c in x["content"]]})

    top = files.select("content").mapInPandas(heads, "first long").agg({"first": "max"}).first()[0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            for c in x["content"]:
                b = bytes(c)
                rows = read_segment(b, magic, footer, read_segment_head(b, magic)[2] == top)
                yield pd.DataFrame([(n, op, k, v if op == 1 else None, signed(p), signed(h)) for n, op, k, v, p, h in rows], columns=["lsn", "op", "key", "value", "prev_hash", "record_hash"])

    return files.select("content").mapInPandas(run, "lsn long, op int, key binary, value binary, prev_hash long, record_hash long")


def read_snapshots(spark: SparkSession, path: str, magic: bytes, cluster: bytes | None = None) -> DataFrame:
    """(snapshot_lsn, record_hash, key, value) of snapshot files."""
    files = spark.read.format("binaryFile").load(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            for c in x["content"]:
                lsn, h, pairs = read_snapshot(bytes(c), magic, cluster)
                yield pd.DataFrame([(lsn, signed(h), k, v) for k, v in pairs], columns=["snapshot_lsn", "record_hash", "key", "value"])

    return files.select("content").mapInPandas(run, "snapshot_lsn long, record_hash long, key binary, value binary")
