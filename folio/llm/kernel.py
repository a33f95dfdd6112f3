"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Everything here works on one Arrow string array at a time, as flat NumPy buffers, and
holds about a megabyte of text at once however large the batch is. A null text is an empty
one. Words are runs of bytes other than blank, tab, newline, vertical tab, form feed and
carriage return.
"""

from __future__ import annotations

import atexit
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.shared import cut, shared_folder

CHUNK_BYTES = 1_000_000
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
WORD_BASE = 0xD1342543DE82EF95
GROUP_ROWS = 1 << 16  # of a stored table's row groups
SHORT_WORD = 32  # bytes; the hash of a longer word is no polynomial, as these have known collisions for every base
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the published SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = known = (out[0], out[1])
    return known


class Prefix:
    """Prefix polynomial hashes of a sequence: the hash of any slice in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.power, self.inverse = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def digests(data: bytes | memoryview, starts: np.ndarray, ends: np.ndarray, size: int = 16) -> np.ndarray:
    """Cryptographic digests (BLAKE2b) of slices, as rows of 64-bit numbers."""
    view = memoryview(data)
    return np.frombuffer(b"".join([blake2b(view[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, size // 8)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = mix(Prefix(data, BASE).slices(starts, ends))
    long = np.flatnonzero(ends - starts > SHORT_WORD)
    if len(long):
        out[long] = digests(np.ascontiguousarray(data), starts[long], ends[long], 8)[:, 0]
    return out


def gather(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices end to end."""
    return data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each slice of data is byte for byte that of the other array."""
    size = ends - starts
    same = size == other_ends - other_starts
    some = np.flatnonzero(same)
    alike = gather(data, starts[some], size[some]) == gather(other, other_starts[some], size[some])
    if not alike.all():
        same[np.repeat(some, size[some])[~alike]] = False
    return same


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more offset than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if "binary" in str(texts.type) else "")
    buffers = texts.buffers()
    n = len(texts)
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `limit` bytes; a longer text is one slice."""
    n, i = batch.num_rows, 0
    if not n:
        return
    _, offsets = flat(batch.column(column))
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are inside, cut at text boundaries; and the number of the first run of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Words:
    """The words of some texts, and their hashes."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = flat(texts)
        self.starts, self.ends, self.first = spans(self.data, self.offsets, ~SPACE[self.data])
        self.counts = np.diff(self.first)
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one blank between them, and where each starts and ends there: the same bytes for the same words, whatever lay between them."""
        size = self.ends - self.starts
        ends = np.cumsum(size + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        out[np.repeat(ends - np.cumsum(size), size) + np.arange(int(size.sum()))] = gather(self.data, self.starts, size)
        return out.tobytes(), ends - size, ends

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start word, text and hash of each run of k words within one text."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        rows = self.rows
        at = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
        return at, rows[at], mix(Prefix(self.hashes, WORD_BASE).slices(at, at + k))


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values and the length of each list. More values than Arrow's lists can number are an error."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))  # raises if an offset is too large


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new place in the shared folder. What is still there when the driver ends is deleted then."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _owned.append(path)
    return path


_owned: list[str] = []


@atexit.register
def _clear() -> None:
    for path in _owned:
        try:
            files, name = fs.FileSystem.from_uri(path)
            if files.get_file_info(name).type != fs.FileType.NotFound:
                files.delete_dir(name)
        except (OSError, pa.ArrowException):  # the folder went with its file system
            pass


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, a third of a checkpoint's size; and its path, for remove()."""
    path = own_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> tuple[DataFrame, str]:
    """df, or df.mapInArrow(work, schema), as written() has it, but with files that Python tasks write; for columns that aren't nested.

    On a local file system Spark's own writers start a process (chmod) for each file, in a
    checkpoint too, and until that runs a program of its own it has the executor's memory once
    more. A task writes under a name of its own attempt and renames at the end, so a task that is
    run again replaces its file whole.
    """
    spark = df.sparkSession
    path = own_folder(spark, "table")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        part = TaskContext.get()
        name, draft = f"{root}/part-{part.partitionId():06d}.parquet", f"{root}/_{part.partitionId()}-{part.taskAttemptId()}-{uuid.uuid4().hex}"
        writer, held, n = None, [], 0
        for batch in work(batches) if work else batches:
            if writer is None:
                writer = pq.ParquetWriter(draft, batch.schema, filesystem=files)
            held.append(batch)
            n += batch.num_rows
            if n >= GROUP_ROWS:
                writer.write_table(pa.Table.from_batches(held), GROUP_ROWS)
                held, n = [], 0
        if writer is not None:
            if held:
                writer.write_table(pa.Table.from_batches(held), GROUP_ROWS)
            writer.close()
            if files.get_file_info(name).type != fs.FileType.NotFound:  # of an attempt that ended but whose executor was lost
                files.delete_file(name)
            files.move(draft, name)
        yield pa.RecordBatch.from_pydict({"done": [True]})

    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root, recursive=True)
    df.mapInArrow(store, "done boolean").collect()
    return spark.read.schema(df.mapInArrow(work, schema).schema if work else df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Has Spark's cleaner remove shuffle files and checkpoints that nothing refers to any more, which else waits for the driver to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, computed once, and marked for broadcast if it has at most so many rows; beyond that the join shuffles."""
    done = cut(df)
    return F.broadcast(done) if done.limit(rows + 1).count() <= rows else done


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that clash with none of df, in any letter case."""
    taken = {c.lower() for c in df.columns}
    return [n if n.lower() not in taken else f"{n}_{uuid.uuid5(uuid.NAMESPACE_OID, n).hex[:12]}" for n in names]


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(work, schema) for column names of any kind, dots included, which mapInArrow itself can't take."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(b.rename_columns(names) for b in batches):
            yield out.rename_columns([f"d{i}" for i in range(out.num_columns)])

    numbered = StructType([StructField(f"d{i}", f.dataType) for i, f in enumerate(schema)])
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, numbered).toDF(*(f.name for f in schema))


def tokenizer_file(name: str) -> str:
    return os.path.join(os.environ.get("FOLIO_TOKENIZERS", "/opt/tokenizers"), name)
