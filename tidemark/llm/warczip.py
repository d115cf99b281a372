"""WARC records in ZIP-packaged archives: writer, and a reader that never extracts.

An archive holds the stored member archive/data.warc.gz (one gzip member for each record), the
stored index indexes/index.cdxj (a line of JSON for each record: offset and length in the data
member) and datapackage.json. The reader takes the end-of-central-directory record or its ZIP64
form, the central directory with its ZIP64 fields, and the local headers; it then reads the
ranges of single records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, local_path, new_dir, open_input
from .words import texts

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
EPOCH = "2020-01-01T00:00:00Z"


def page_urn(page: str | None) -> str:
    return "urn:none" if page is None else "urn:page:" + quote(page, safe="")


def urn_page(urn: str | None) -> str | None:
    urn = (urn or "urn:none").strip("<>")
    return unquote(urn.removeprefix("urn:page:")) if urn.startswith("urn:page:") else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str, payload: bytes, refers: str | None) -> bytes:
    """One gzip member; ids of pages are escaped as in URLs. A revisit has the HTTP head of the full payload, and not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers is not None else head + payload
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{page_urn(page)}>", f"WARC-Date: {EPOCH}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{page_urn(refers)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers in lower case, HTTP head, payload) of one gzip member."""
    data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


@contextmanager
def new_file(uri: str):
    """A binary file that is there only when whole."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as out:
            yield out
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(attempt, "wb") as out:
        yield out
    os.replace(attempt, path)


def write_archive(uri: str, records: Iterator[tuple[str | None, str, bytes, str | None]], limit: int = 1 << 30) -> int:
    """Number of records written; a file that has reached `limit` bytes takes no more of them."""
    n, at, index = 0, 0, io.BytesIO()
    with new_file(uri) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        info = zipfile.ZipInfo(DATA)
        with z.open(info, "w", force_zip64=True) as data:
            for page, url, payload, refers in records:
                x = record(page, url, payload, refers)
                data.write(x)
                index.write(json.dumps({"id": page, "offset": at, "length": len(x)}).encode() + b"\n")
                at, n = at + len(x), n + 1
                if at >= limit:
                    break
        z.writestr(zipfile.ZipInfo(INDEX), index.getvalue())
        z.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [DATA, INDEX], "records": n}))
    return n


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """{name: (offset of its bytes, length)} of the stored members of a ZIP file."""
    f.seek(max(0, size - 65_557))
    tail = f.read(65_557)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HLL", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        where = end - 20
        if where < 0 or tail[where : where + 4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        f.seek(struct.unpack("<Q", tail[where + 8 : where + 16])[0])
        big = f.read(56)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", big[32:56])
    f.seek(start)
    table, at, found = f.read(length), 0, {}
    for _ in range(count):
        if table[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", table[at + 8 : at + 12])
        packed, full, n_name, n_extra, n_note = struct.unpack("<LLHHH", table[at + 20 : at + 34])
        offset = struct.unpack("<L", table[at + 42 : at + 46])[0]
        name = table[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = table[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:
                big = list(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                full = big.pop(0) if full == 0xFFFFFFFF else full
                packed = big.pop(0) if packed == 0xFFFFFFFF else packed
                offset = big.pop(0) if offset == 0xFFFFFFFF else offset
            e += 4 + n
        at += 46 + n_name + n_extra + n_note
        f.seek(offset)
        local = f.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        if method == 0:
            a, b = struct.unpack("<HH", local[26:30])
            found[name] = (offset + 30 + a + b, packed)
    return found


def _sizes(f) -> int:
    f.seek(0, 2)
    return f.tell()


def _write(base: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def rows():
            for b in batches:
                data, offs = texts(b.column("payload"))
                for i, (page, url, refers) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page", "url", "refers")), strict=True)):
                    yield page, url or "", data[offs[i] : offs[i + 1]].tobytes(), refers

        records, n = rows(), 0
        for first in records:
            uri = f"{base}/part-{TaskContext.get().partitionId():05d}-{n:05d}.wacz"
            count = write_archive(uri, chain([first], records), limit)
            n += 1
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count], pa.int64())], ["archive", "records"])

    return run


def write_archives(df: DataFrame, base: str, page: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, limit: int = 1 << 30) -> DataFrame:
    """Write each row of df to an archive below base; returns (archive, records). An archive that
    has reached `limit` bytes is closed and a new one begun, so its index stays small.

    Of rows whose payloads are equal and have at least `least` bytes, those with the smallest
    page id are responses, the others revisit it. A null payload is empty. A null page id is
    never referred to: it revisits a page that has an id, and is a response if there is none.
    Ids may be of any type that has an order; rows of one id and payload are responses all, if it
    is the smallest. Equal rows are written each; other columns are not read. A payload is one
    record, however long. An empty table gives no archives.
    """
    rows = df.select(F.col(f"`{page}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    large = keyed.filter(F.octet_length("payload") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    # only narrow rows of repeated payloads meet by digest; the payloads move once, by page
    again = large.select("page_id", "digest").join(first, "digest").filter("not (page_id <=> first)").select(F.col("page_id").alias("of"), F.col("digest").alias("d"), "first").distinct()
    joined = keyed.join(again, keyed.page_id.eqNullSafe(again.of) & (keyed.digest == again.d), "left")
    return joined.select(F.col("page_id").cast("string").alias("page"), "url", "payload", F.col("first").cast("string").alias("refers")).mapInArrow(_write(base, limit), "archive string, records long")


def _index(per_row: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("archive").to_pylist():
                with open_input(uri) as f:
                    found = members(f, _sizes(f))
                    if DATA not in found or INDEX not in found:
                        raise ValueError(f"{uri} has no stored {DATA} and {INDEX}; compressed members can't be read in ranges")
                    (data, _), (at, n) = found[DATA], found[INDEX]
                    f.seek(at)
                    lines = [json.loads(x) for x in f.read(n).splitlines()]
                for i in range(0, len(lines), per_row):
                    part = lines[i : i + per_row]
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([[data + x["offset"] for x in part]], pa.list_(pa.int64())), pa.array([[x["length"] for x in part]], pa.list_(pa.int64()))], ["archive", "offset", "length"])

    return run


RECORD = "archive string, offset long, page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                out = []
                with open_input(uri) as f:
                    for at, n in zip(offset, length, strict=True):
                        f.seek(at)
                        h, http, payload = parse_record(f.read(n))
                        told = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and digest(payload) != told:
                            raise ValueError(f"{uri}: payload at {at} does not match its digest")
                        size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
                        out.append((uri, at, urn_page(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], urn_page(h.get("warc-refers-to")), size, told, payload if payloads else None))
                names = [x.split()[0] for x in RECORD.split(", ")]
                kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*out, strict=True), RECORD.split(", "), strict=True)], names)

    return run


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True, per_row: int = 500, page_type="long") -> DataFrame:
    """Records of the archives (column archive): directories and indexes are read first, then the
    ranges of `per_row` records at a time, dealt evenly however large an archive is. Page ids are
    cast to page_type. An archive whose members are compressed, or whose payloads do not match
    their digests, is an error."""
    ranges = archives.select("archive").mapInArrow(_index(per_row), "archive string, offset array<long>, length array<long>")
    out = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_read(payloads), RECORD)
    return out.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def through_archives(df: DataFrame, payloads: bool = False, **names) -> DataFrame:
    """Write df to archives in the shared folder and read the records back."""
    spark = df.sparkSession
    written = cut(write_archives(df, new_dir(spark, "archives"), **names), "written")
    return read_archives(spark, written, payloads, page_type=df.schema[names.get("page", "page_id")].dataType)
