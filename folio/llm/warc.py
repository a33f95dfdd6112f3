"""A splittable reader of compressed WARC files, and a writer.

A .warc.gz file is a chain of gzip members, one for each record: the first member that can be
decoded, then the first at or after its end, and so on. What a record's stored bytes may hold,
such as a whole WARC file of its own, is no part of that chain.

A task gets a byte range of a file, scans it for the gzip magic, and accepts a candidate only
if it decodes to its end. From all candidates that start in its range it tells where the chain
leaves the range, for each place at which it may enter; that is mostly one number. Put
together from the start of the file, a row a range, these say where the chain enters each
range. A second pass then reads the records that start inside its range from there on, past
the end of the range for the last. So every record is read exactly once, whatever the split
size and wherever the cuts fall, and one large file is read by many tasks.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
BLOCK = 1 << 18
ROWS_OUT, BYTES_OUT = 2000, 4 << 20
PLAIN = re.compile(r"[!-~]+(?: [!-~]+)*")
SCHEMA = "file string, start long, warc_type string, record_id string, target_uri string, warc_date string, content_type string, page_id long, payload binary"
ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary())])


def record(page_id: int | None, url: str | None, payload: bytes | None) -> bytes:
    """One gzip member. A null payload or id is marked as such; a URL that a header line can't hold is stored as JSON."""
    body = payload or b""
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url}" if PLAIN.fullmatch(url) else f"X-Target-URI-JSON: {json.dumps(url)}")
    if payload is None:
        lines.append("X-Payload-Null: 1")
    lines.append(f"Content-Length: {len(body)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) below folder, one file for each partition, and returns (file, records, bytes) of each.

    A task writes under a name of its own attempt and renames at the end, so a task that is
    run again replaces its file whole. An empty table gives no file, or files of no records.
    Other columns are not written.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get()
        name, draft = f"{root}/part-{part.partitionId():06d}.warc.gz", f"{root}/_{part.partitionId()}-{part.taskAttemptId()}-{uuid.uuid4().hex}"
        n = size = 0
        with system.open_output_stream(draft, compression=None) as out:
            for b in batches:
                for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    member = record(page_id, url, html)
                    out.write(member)
                    n += 1
                    size += len(member)
        if system.get_file_info(name).type != fs.FileType.NotFound:  # of an attempt that ended but whose executor was lost
            system.delete_file(name)
        system.move(draft, name)
        yield pa.RecordBatch.from_pydict({"file": [name.rsplit("/", 1)[1]], "records": [n], "bytes": [size]})

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    return kernel.cut(chosen.mapInArrow(store, "file string, records long, bytes long"))


class Ranges:
    """Bytes of a file from a position on, in blocks as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.data = file, at, bytearray()
        file.seek(at)

    def need(self, position: int) -> bool:
        """Holds the byte before position, if the file has it."""
        while self.at + len(self.data) < position:
            block = self.file.read(BLOCK)
            if not block:
                return False
            self.data += block
        return True

    def forget(self, position: int) -> None:
        if position - self.at > 4 * BLOCK:
            del self.data[: position - self.at]
            self.at = position

    def find(self, needle: bytes, position: int, end: int) -> int:
        """Where needle first starts at or after position and before end, or -1."""
        while position < end:
            self.need(min(position + BLOCK, end) + len(needle) - 1)
            self.forget(position)
            stop = min(end + len(needle) - 1, self.at + len(self.data))
            i = self.data.find(needle, position - self.at, stop - self.at)
            if i >= 0:
                return self.at + i
            if stop >= end + len(needle) - 1 or not self.need(stop + 1):
                return -1
            position = max(position, stop - len(needle) + 1)
        return -1


def member(source: Ranges, start: int, keep: bool) -> tuple[bytes, int] | None:
    """What the gzip member at start inflates to, if it is to be kept, and its end; None if it is none or cut off."""
    inflate, out, at = zlib.decompressobj(31), [], start
    while not inflate.eof:
        if not source.need(at + 1):
            return None
        block = bytes(source.data[at - source.at : at - source.at + BLOCK])
        try:
            got = inflate.decompress(block, 0 if keep else BLOCK)
            while not keep and inflate.unconsumed_tail:
                inflate.decompress(inflate.unconsumed_tail, BLOCK)
        except zlib.error:
            return None
        if keep:
            out.append(got)
        at += len(block) - len(inflate.unused_data)
    return b"".join(out), at


def ways(file: pa.NativeFile, start: int, end: int) -> tuple[list[int], list[int]]:
    """Where the chain leaves the range [start, end), as (upto, out): if it enters at upto[i] or before, and after upto[i - 1], it goes on at out[i]. Beyond the last, nothing starts in the range."""
    source, at = Ranges(file, start), start
    starts, ends = [], []
    while (at := source.find(MAGIC, at, end)) >= 0:
        if found := member(source, at, False):
            starts.append(at)
            ends.append(found[1])
        at += 1
    out = [end] * (len(starts) + 1)  # nothing more starts in the range
    for i in range(len(starts) - 1, -1, -1):
        out[i] = ends[i] if ends[i] >= end else out[bisect_left(starts, ends[i])]
    last = [i for i in range(len(starts)) if i + 1 == len(starts) or out[i] != out[i + 1]]
    return [starts[i] for i in last], [out[i] for i in last]


def entries(rows: pa.Table) -> pa.Table:
    """Of one file's ranges with their ways: those in which a member of the chain may start, and the place from which on."""
    rows = rows.sort_by("start")
    kept, place = [], 0
    for i, (start, end, upto, out) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("start", "end", "upto", "out")), strict=True)):
        place = max(place, start)
        if place < end and (k := bisect_left(upto, place)) < len(upto):
            kept.append((i, place))
            place = out[k]
    some = rows.take(pa.array([i for i, _ in kept], pa.int64()))
    return pa.table({"path": some.column("path"), "start": pa.array([x for _, x in kept], pa.int64()), "end": some.column("end")})


def headed(head: bytes) -> bool:
    return head.startswith(b"WARC/") and b"\nwarc-type:" in head.lower()


def fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def records(file: pa.NativeFile, name: str, start: int, end: int) -> Iterator[tuple]:
    """The records of a file's chain that start in [start, end); the chain has no member under way at start."""
    source, at = Ranges(file, start), start
    while (at := source.find(MAGIC, at, end)) >= 0:
        whole = member(source, at, True)
        if whole is None:
            at += 1  # these three bytes happen to be in other data, or the file ends within this member
            continue
        here, at = at, whole[1]
        head, _, rest = whole[0].partition(b"\r\n\r\n")
        if not headed(head):
            continue
        f = fields(head)
        length = int(f["content-length"]) if f.get("content-length", "").isdigit() else max(0, len(rest) - 4)
        uri = json.loads(f["x-target-uri-json"]) if "x-target-uri-json" in f else f.get("warc-target-uri")
        page = re.fullmatch(r"<urn:page:(-?\d+)>", f.get("warc-record-id", ""))
        yield name, here, f.get("warc-type"), f.get("warc-record-id"), uri, f.get("warc-date"), f.get("content-type"), int(page[1]) if page else None, None if "x-payload-null" in f else rest[:length]


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all .warc.gz files below folder: where each starts, its main header fields and its payload.

    Defined cases: a folder without such files, or with empty ones, gives no rows; bytes that
    are no record are passed over, as are members that hold none, and a record that the end of
    a file cuts off; records stored within a record are its payload; missing header fields are
    null; without a Content-Length the payload is all up to the closing blank lines. Records
    with equal contents stay apart. A header block may have any length.
    """
    system, root = fs.FileSystem.from_uri(folder)
    found = [(i.path, i.size) for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.path.endswith(".warc.gz") and i.size]
    splits = max(1, sum(-(-size // split_bytes) for _, size in found))
    ranges = (
        spark.createDataFrame(found, "path string, size long")
        .select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
        .select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("end"))
        .repartition(splits)  # a range, not its bytes: one a task
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            found = []
            for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with system.open_input_file(path) as file:
                    found.append(ways(file, start, end))
            lists = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=["path", "start", "end", "upto", "out"])

    # A row a range; the ranges that the chain enters are then dealt out anew.
    looked = ranges.mapInArrow(look, "path string, start long, end long, upto array<long>, out array<long>")
    ranges = looked.groupBy("path").applyInArrow(entries, "path string, start long, end long").repartition(splits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with system.open_input_file(path) as file:
                    for r in records(file, path.rsplit("/", 1)[-1], start, end):
                        rows.append(r)
                        size += len(r[-1] or b"")
                        if len(rows) >= ROWS_OUT or size >= BYTES_OUT:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    return ranges.mapInArrow(scan, SCHEMA)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages written as WARC files into the shared folder and read back: (page_id, url, html).

    Null ids, URLs and pages come back null and empty pages empty; repeated rows stay; other
    columns are left out, whatever their names; an empty table gives no rows. The files stay
    until the driver ends, as the result is read from them.
    """
    spark = pages.sparkSession
    folder = kernel.own_folder(spark, "warc")
    write(pages, folder).count()
    return read(spark, folder, split_bytes).select("page_id", F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("html"))
