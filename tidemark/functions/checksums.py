"""CRC32C and CRC64-ECMA-182 of binary columns, record bytes and hashes, and SplitMix64 streams.

Spark has neither checksum; both run as Arrow-batched functions in which all rows of a batch
advance one byte at a time.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

U = np.uint64
#: Polynomials of CRC32C (reflected) and CRC64-ECMA-182, and SplitMix64's constants.
CASTAGNOLI, ECMA = 0x82F63B78, 0x42F0E1EBA9EA3693
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _tables() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> 1) ^ np.uint32(CASTAGNOLI), low >> 1).astype(np.uint32)
    high = np.arange(256, dtype=U) << U(56)
    for _ in range(8):
        high = np.where(high >> U(63), (high << U(1)) ^ U(ECMA), high << U(1))
    return low, high


LOW, HIGH = _tables()


def _columns(values: list[bytes]):
    """Bytes of the k-th place of all rows that have one, longest rows first."""
    size = np.array([len(v) for v in values])
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(values), np.uint8)
    start = np.concatenate(([0], np.cumsum(size)))[:-1][order]
    left = len(values) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), "right")
    for k, n in enumerate(left):
        yield order[:n], data[start[:n] + k]


def crc32c_of(values: list[bytes]) -> np.ndarray:
    c = np.full(len(values), 0xFFFFFFFF, np.uint32)
    for rows, b in _columns(values):
        c[rows] = LOW[(c[rows] ^ b) & 0xFF] ^ (c[rows] >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def crc64_of(values: list[bytes]) -> np.ndarray:
    c = np.zeros(len(values), U)
    for rows, b in _columns(values):
        c[rows] = HIGH[((c[rows] >> U(56)) ^ b).astype(np.int64)] ^ (c[rows] << U(8))
    return c


def _over(values: pd.Series, f) -> pd.Series:
    out = pd.Series([None] * len(values), dtype="Int64")
    on = values.notna().to_numpy()
    if on.any():
        out[on] = f([bytes(v) for v in values[on]]).astype(np.int64)
    return out


@F.pandas_udf(LongType())
def crc32c(values: pd.Series) -> pd.Series:
    return _over(values, crc32c_of)


@F.pandas_udf(LongType())
def crc64(values: pd.Series) -> pd.Series:
    """Signed bit pattern; F.hex shows the usual form."""
    return _over(values, crc64_of)


@F.pandas_udf(LongType())
def splitmix64(seed: pd.Series, step: pd.Series) -> pd.Series:
    """Output number `step` (from 1) of the stream of a seed."""
    x = seed.to_numpy().astype(np.int64).view(U) + step.to_numpy().astype(np.int64).view(U) * U(GOLDEN)
    x = (x ^ (x >> U(30))) * U(MIX1)
    x = (x ^ (x >> U(27))) * U(MIX2)
    return pd.Series((x ^ (x >> U(31))).view(np.int64))


def little(c, n: int):
    """An integer column as n little-endian bytes."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.slice(F.reverse(pairs), 1, n), ""))


def record_body(lsn, op, key, value, prev_hash):
    """Bytes of a record that its checksum covers: the length behind that field (checksum
    included), number, operation, lengths of key and value, previous hash, key, value."""
    v = F.coalesce(value, F.lit(b""))
    length = F.octet_length(key) + F.octet_length(v) + 29
    return F.concat(little(length, 4), little(lsn, 8), little(op, 1), little(F.octet_length(key), 4), little(F.octet_length(v), 4), little(prev_hash, 8), key, v)


def record_hash(lsn, op, key, value, prev_hash):
    """CRC64 of the record with its CRC32C behind it."""
    body = record_body(lsn, op, key, value, prev_hash)
    return crc64(F.concat(body, little(crc32c(body), 4)))


_LOW, _HIGH = LOW.tolist(), HIGH.tolist()


def crc32c_one(data: bytes) -> int:
    """Of one value; many at once go through crc32c_of."""
    c = 0xFFFFFFFF
    for b in data:
        c = _LOW[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc64_one(data: bytes) -> int:
    c = 0
    for b in data:
        c = _HIGH[(c >> 56) ^ b] ^ (c << 8 & 0xFFFFFFFFFFFFFFFF)
    return c


def encode_record(lsn: int, op: int, key: bytes, value: bytes, prev_hash: int) -> bytes:
    """A whole record, as record_body with its checksum."""
    head = struct.pack("<IQBIIQ", 29 + len(key) + len(value), lsn, op, len(key), len(value), prev_hash)
    body = head + key + value
    return body + struct.pack("<I", crc32c_one(body))
