import gzip
import os
import zlib

import pyarrow as pa
import pytest

from folio.llm import warc


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory, words):
    rows = [(i, f"http://x/{i}", words(i, 50 + i)) for i in range(60)] + [(None, None, None), (99, "", ""), (100, "http://ü b\n", "é" * 70000), (100, "http://ü b\n", "é" * 70000), (101, "u", "\r\n\r\n WARC/1.0 \x1f\x8b\x08")]
    folder = "file://" + str(tmp_path_factory.mktemp("warc"))
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, file int").repartition(3)
    made = warc.write(df, folder).collect()
    assert sum(r.records for r in made) == len(rows)
    return folder, rows


def key(rows):
    return sorted((str(a), str(b), str(c)) for a, b, c in rows)


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 30])
def test_any_split_reads_each_record_once(spark, written, split):
    folder, rows = written
    if split == 1:  # a task for each byte of one small file
        folder += "/one"
        os.makedirs(folder[7:], exist_ok=True)
        rows = [(1, "u", "x"), (2, "v", "y")]
        open(folder[7:] + "/a.warc.gz", "wb").write(b"".join(warc.record(a, b, c.encode()) for a, b, c in rows))
    else:
        folder, rows = written
    got = warc.read(spark, folder, split).where("true" if split == 1 else "file <> 'a.warc.gz'").collect()
    assert key((r.page_id, r.target_uri, None if r.payload is None else bytes(r.payload).decode()) for r in got) == key(rows)


def test_false_magic_foreign_members_and_a_cut_file(spark, tmp_path):
    good = warc.record(1, "u", b"text")
    stored = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n" + warc.MAGIC + b"inner" + warc.record(9, "no", b"within"), 0)
    plain = gzip.compress(b"not a record")
    data = b"junk" + warc.MAGIC + b"junk" + good + plain + stored + good[:-9]
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(good)
    want = [(4 + 3 + 4, 1), (4 + 3 + 4 + len(good) + len(plain), None)]
    for split in (20, 1 << 20):
        got = warc.read(spark, f"file://{tmp_path}", split).collect()
        assert sorted(((r.start, r.page_id) for r in got)) == want


def nested():
    """Records stored within records: one, a chain of many, one in the header of another, and one that goes on beyond the record it begins in."""
    one = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n" + warc.record(9, "no", b"within"), 0)
    chain = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n" + b"".join(warc.record(i, "no", b"x" * i) for i in range(10, 30)), 0)
    deep = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n" + chain, 0)
    # A stored member begins in one record's payload; its block holds that record's end and the next one's beginning.
    begin = warc.MAGIC + b"\0\0\0\0\0\0\xff"
    size = 600
    left = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n" + begin + b"\1" + size.to_bytes(2, "little") + (size ^ 0xFFFF).to_bytes(2, "little") + b"WARC/1.0\r\nWARC-Type: no\r\n\r\n", 0)
    at = left.index(begin, 20) + len(begin) + 5
    top = gzip.compress(b"", 0)[:10]
    head = b"WARC/1.0\r\nWARC-Type: resource\r\n\r\n" + b"y" * 900
    inner = left[at:] + top + b"\1" + (1000).to_bytes(2, "little") + (1000 ^ 0xFFFF).to_bytes(2, "little") + head
    inner = inner[:size]
    tail = zlib.crc32(inner).to_bytes(4, "little") + size.to_bytes(4, "little")
    taken = size - (len(left) - at) - len(top) - 5
    body = (head[:taken] + tail + b"z" * 1000)[:1000]
    right = top + b"\1" + (1000).to_bytes(2, "little") + (1000 ^ 0xFFFF).to_bytes(2, "little") + body + zlib.crc32(body).to_bytes(4, "little") + (1000).to_bytes(4, "little")
    assert zlib.decompressobj(31).decompress((left + right)[left.index(begin, 20) :]).startswith(b"WARC/1.0\r\nWARC-Type: no")
    parts = [warc.record(1, "u", b"text"), one, chain, warc.record(2, "v", b""), deep, left, right, warc.record(3, "w", b"end")]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    return b"".join(parts), list(zip(starts, [1, None, None, 2, None, None, None, 3], strict=True))


def test_what_is_read_does_not_depend_on_the_split():
    data, want = nested()
    for split in [*range(1, 60), *range(60, len(data), 37), len(data)]:
        ranges = [(i, min(i + split, len(data))) for i in range(0, len(data), split)]
        found = [warc.ways(pa.BufferReader(data), *r) for r in ranges]
        table = pa.table({"path": ["x"] * len(ranges), "start": [r[0] for r in ranges], "end": [r[1] for r in ranges], "upto": pa.array([f[0] for f in found], pa.list_(pa.int64())), "out": pa.array([f[1] for f in found], pa.list_(pa.int64()))})
        got = [(r[1], r[7]) for e in warc.entries(table).to_pylist() for r in warc.records(pa.BufferReader(data), "x", e["start"], e["end"])]
        assert got == want, split


def test_nested_records_and_long_headers(spark, tmp_path):
    data, want = nested()
    (tmp_path / "x.warc.gz").write_bytes(data)
    long = gzip.compress(b"WARC/1.0\r\nX-Pad: " + b"p" * 200_000 + b"\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nok\r\n\r\n")
    (tmp_path / "y.warc.gz").write_bytes(long)
    for split in (50, 700, 1 << 20):
        got = warc.read(spark, f"file://{tmp_path}", split).collect()
        assert sorted((r.file, r.start, r.page_id) for r in got) == [("x.warc.gz", *w) for w in want] + [("y.warc.gz", 0, None)]
        assert next(bytes(r.payload) for r in got if r.file == "y.warc.gz") == b"ok"


def test_clashing_names(spark):
    rows = [(1, "u", "x", "a", 5), (None, None, None, None, None), (1, "u", "x", "a", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string, start long")
    assert key(warc.round_trip(df).collect()) == key(r[:3] for r in rows)


def test_round_trip_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
