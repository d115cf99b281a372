import random

import pytest

from tidemark.operators.changelog import broken_links, gaps
from tidemark.sources.binary import Broken, read_page, read_record, read_segment, read_segments, read_snapshot, read_snapshots, write_segment, write_snapshot

SEG, GRP, SNAP, ME = b"SEGMENT1", b"GROUPEND", b"SNAPSHOT", bytes(range(16))


def groups(n, seed=1):
    r = random.Random(seed)
    return [[(r.choice([1, 1, 2]), b"k%d" % r.randrange(9), b"") for _ in range(r.randint(1, 5))] for _ in range(n)]


def test_every_cut_and_every_flipped_byte():
    data = write_segment(SEG, GRP, ME, ME, groups(3))
    whole = read_segment(data, SEG, GRP, False, 0)
    ends = [len(read_segment(data[:i], SEG, GRP, True, 0)) for i in range(64, len(data) + 1)]
    assert ends == sorted(ends) and ends[-1] == len(whole) and set(ends) == {0, *(sum(map(len, groups(3)[: i + 1])) for i in range(3))}
    for i in range(0, len(data), 3):
        bad = data[:i] + bytes([data[i] ^ 64]) + data[i + 1 :]
        with pytest.raises(Broken):
            read_segment(bad, SEG, GRP, False, 0)
    for i in set(range(64, len(data))) - _ends(data):  # a sealed segment can't end in a tail
        with pytest.raises(Broken):
            read_segment(data[:i], SEG, GRP, False, 0)


def _ends(data):
    """Places behind footers, where a cut leaves a whole segment."""
    out, at = {64}, data.find(GRP)
    while at >= 0:
        out.add(at + 40)
        at = data.find(GRP, at + 1)
    return out


def test_segments_as_a_table(spark, tmp_path):
    first, more = write_segment(SEG, GRP, ME, ME, groups(4)), groups(2, 2)
    rows = read_segment(first, SEG, GRP, False, 0)
    second = write_segment(SEG, GRP, ME, ME, more, rows[-1][0] + 1, rows[-1][5])
    (tmp_path / "a.log").write_bytes(first)
    (tmp_path / "b.log").write_bytes(second + second[70:90])  # a torn tail
    log = read_segments(spark, str(tmp_path), SEG, GRP)
    assert log.count() == len(rows) + sum(map(len, more)) and gaps(log).isEmpty() and broken_links(log).isEmpty()
    (tmp_path / "a.log").write_bytes(first[:-10])  # a sealed segment has to be whole
    with pytest.raises(Exception, match="Broken"):
        read_segments(spark, str(tmp_path), SEG, GRP).collect()


def test_snapshots_and_pages(spark, tmp_path):
    pairs = [(b"a", b"1"), (b"", b""), (b"b", bytes(300))]
    data = write_snapshot(SNAP, ME, 7, 2**63 + 5, pairs)
    assert read_snapshot(data, SNAP, ME) == (7, 2**63 + 5, pairs)
    (tmp_path / "s").write_bytes(data)
    assert sorted(bytes(r.key) for r in read_snapshots(spark, str(tmp_path / "s"), SNAP).collect()) == [b"", b"a", b"b"]
    for i in range(0, len(data), 5):
        for bad in (data[:i], data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]):
            with pytest.raises(Broken):
                read_snapshot(bad, SNAP, ME)
    with pytest.raises(Broken, match="duplicate"):
        read_snapshot(write_snapshot(SNAP, ME, 1, 0, [(b"a", b""), (b"a", b"")]), SNAP)
    with pytest.raises(Broken, match="cluster"):
        read_snapshot(data, SNAP, bytes(16))
    page = (2).to_bytes(4, "little") + b"\x01" + b"\x01\0\0\0\x02\0\0\0kvv" + b"\0\0\0\0\0\0\0\0"
    assert read_page(page) == ([(b"k", b"vv"), (b"", b"")], True)
    for bad in (page[:-1], page + b"x", page[:4] + b"\x02" + page[5:], b"abc"):
        with pytest.raises(Broken):
            read_page(bad)


def test_record_checks():
    from tidemark.functions.checksums import encode_record

    x = encode_record(5, 1, b"key", b"value", 9)
    assert read_record(x + b"more")[:6] == (len(x), 5, 1, b"key", b"value", 9)
    for bad in (encode_record(5, 3, b"k", b"", 0), encode_record(5, 2, b"k", b"v", 0), x[:-1], b"\0\0\0\0" + x[4:], x[:-1] + b"\0"):
        with pytest.raises(Broken):
            read_record(bad)
