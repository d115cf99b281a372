import hashlib
import io
import zipfile

import pytest

from tidemark.llm.warczip import DATA, INDEX, digest, members, parse_record, through_archives, write_archive


def test_zip64_and_offsets(tmp_path):
    path = str(tmp_path / "a.wacz")
    rows = [(str(i), f"http://x/{i}\r\n", b"p" * i, None if i % 3 else "0") for i in range(50)]
    assert write_archive(path, iter(rows)) == 50
    assert zipfile.ZipFile(path).testzip() is None
    with open(path, "rb") as f:
        found = members(f, f.seek(0, 2))
        assert set(found) == {DATA, INDEX, "datapackage.json"}
        f.seek(found[DATA][0])
        assert f.read(found[DATA][1]) == zipfile.ZipFile(path).read(DATA)


def test_zip64_directory_of_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(70_000):
            z.writestr(f"m{i}", str(i))
    found = members(out, len(out.getvalue()))
    assert len(found) == 70_000
    at, n = found["m69999"]
    assert out.getvalue()[at : at + n] == b"69999"
    with pytest.raises(ValueError):
        members(io.BytesIO(b"nothing"), 7)


def test_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "v", None), (4, "v", ""), (5, "w", "é\r\n\r\nx" * 3), (6, None, "same"), (7, "z", "b" * 300_000), (None, "n", "same"), (None, "n", "only"), (8, "q", "tie"), (8, "q", "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = through_archives(df, payloads=True).collect()
    assert len(got) == len(rows)
    texts = {}
    for p, _, t in rows:
        texts.setdefault((t or ""), []).append(p)
    for r in got:
        key = next(t for t, ids in texts.items() if r.page_id in ids and digest(t.encode()) == r.payload_digest)
        ids = [i for i in texts[key] if i is not None]
        first = min(ids, default=None)
        assert r.payload_bytes == len(key.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        if r.record_type == "response":
            assert bytes(r.payload) == key.encode() and hashlib.sha1(r.payload).digest()
    assert through_archives(df.limit(0)).collect() == []


def test_a_changed_record_is_noticed():
    import gzip

    from tidemark.llm.warczip import record

    h, http, payload = parse_record(record("5", "u", b"abc", None))
    assert h["warc-payload-digest"] == "sha1:" + digest(b"abc") and payload == b"abc" and b"Content-Length: 3" in http
    with pytest.raises(ValueError):
        parse_record(gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"))
