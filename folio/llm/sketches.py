"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the SIZE least distinct hashes of a text's word shingles, in order. The sketch of
a union is the least of both sketches, so sketches of parts merge into that of the whole, in
any order. They estimate how many distinct shingles there are (exactly, below SIZE), the
resemblance of two sets and how much of one is contained in the other. Hashes are stored as
signed numbers in the order of the unsigned ones.

Two different sketches are linked if the estimate of their resemblance is ALIKE or more. None
of these links is missed: two such sketches share at least ALIKE of the longer one's hashes, so
with all hashes in one order, one of the first 1 - ALIKE of each is the same. In that order rare
hashes come first, by counters that many hashes share, and those that very many sketches have
last, so that few meet that are not alike. Sketches that share one of their first hashes are compared by signatures in bit planes (simhash.py),
which leave out none that can be linked; what these connect is compared in full, each sketch
once with each other of its component, and only counts leave the task. Sketches stay in the
files where they were written: what is found is brought to them, by file and row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, graph, kernel, simhash

SIZE, SHINGLE = 128, 5
ALIKE = 0.8
SIGNATURE = 512  # bits
OFTEN = 500  # a hash that one in so many sketches has comes late in the order
COUNTERS, COUNTING, SLICES = 1 << 20, 16, 16  # counters of hashes, tasks that count, and parts in which the counters are added up
SALTS = 64  # parts of the rows of a hash that very many sketches have
CHUNK, READ = 1 << 14, 1 << 12
TILE = 2048  # sketches of a component that are counted in one task with as many others
FLIP = np.uint64(1 << 63)


def bottom(rows: np.ndarray, hashes: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The `size` least distinct hashes of each row, in order, end to end; and how many each of n rows has."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    counts = np.bincount(rows, minlength=n)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes[place < size], np.minimum(counts, size)


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; a shorter text has its whole as its only one, and a text without words none."""
    words = kernel.Words(texts)
    _, rows, hashes = words.grams(k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = kernel.mix(kernel.Prefix(words.hashes, kernel.WORD_BASE).slices(words.first[short], words.first[short + 1]))
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, whole])
    return rows, hashes


def sketch(docs: DataFrame, size: int = SIZE, k: int = SHINGLE) -> DataFrame:
    """(doc_id, source, sketch_id, sketch) of every row, in one pass. sketch_id is a 64-bit digest of the sketch, equal where sketches are."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                values, counts = bottom(*shingles(part.column("text"), k), part.num_rows, size)
                ends = np.cumsum(counts) * 8
                name = kernel.digests(values.tobytes(), ends - counts * 8, ends, 8)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(kernel.signed(name)), kernel.ragged(kernel.signed(values ^ FLIP), counts, pa.int64())], names=["doc_id", "source", "sketch_id", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, source string, sketch_id long, sketch array<long>")


def union(a: Column, b: Column, size: int = SIZE) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def distinct(s: Column, size: int = SIZE) -> Column:
    """How many distinct shingles a sketch stands for."""
    last = (F.element_at(s, size).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(s) < size, F.size(s).cast("double")).otherwise(F.lit(float(size - 1)) / last)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A or B|; null where both are empty."""
    u = union(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(u, a), b))
    return F.try_divide(both, F.size(u))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A|; null where A is empty."""
    shared = resemblance(a, b, size) * distinct(union(a, b, size), size)
    return F.least(F.lit(1.0), F.try_divide(shared, distinct(a, size)))


def merge(sketches: DataFrame, by: str, size: int = SIZE) -> DataFrame:
    """(by, sketch) of the union of all sketches with each value of `by`, a null one included.

    Each task merges its own first, so what moves is one sketch for each value and task.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, int] = {}
        rows, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            code = batch.column(0).dictionary_encode(null_encoding="encode")
            of = np.array([known.setdefault(v, len(known)) for v in code.dictionary.to_pylist()], np.int64)
            lists = batch.column(1)
            row = np.repeat(of[code.indices.to_numpy()] if len(of) else np.zeros(0, np.int64), np.asarray(lists.value_lengths()))
            values, counts = bottom(np.concatenate([rows, row]), np.concatenate([values, lists.flatten().to_numpy()]), len(known), size)
            rows = np.repeat(np.arange(len(known)), counts)
        counts = np.bincount(rows, minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), kernel.ragged(values, counts, pa.int64())], names=[by, "sketch"])

    parts = sketches.select(F.col(by).cast("string").alias(by), "sketch").mapInArrow(partial, f"`{by}` string, sketch array<long>")
    # A second level keeps what one task puts together small when there are very many tasks.
    some = parts.groupBy(by, (F.spark_partition_id() % 64).alias("branch")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, size).alias("sketch"))
    return some.groupBy(by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, size).alias("sketch"))


def estimate(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """resemblance(), and containment() both ways, of the sketches in equal rows of x and y; a row is filled up at its end to `size` values with the largest."""
    n = nx + ny
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    inside = np.arange(2 * size) < n[:, None]
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & inside[:, 1:]
    place = np.cumsum(~same & inside, axis=1, dtype=np.int32)  # in the union, from 1
    of_union = np.minimum(place[:, -1], size)
    last = both[np.arange(len(both)), np.minimum((place < size).sum(1), 2 * size - 1)]
    alike = (same & (place <= size)).sum(1) / of_union
    shared = alike * estimated(of_union, last, size)
    return alike, np.minimum(1, shared / estimated(nx, x[:, size - 1], size)), np.minimum(1, shared / estimated(ny, y[:, size - 1], size))


def alikeness(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, size: int) -> np.ndarray:
    """The first that estimate() gives, in a third of the time."""
    n = nx + ny
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    same = both[:, 1:] == both[:, :-1]
    if (n < 2 * size).any():
        same &= np.arange(1, 2 * size) < n[:, None]
    shared = np.cumsum(same, axis=1, dtype=np.int32)
    # The k-th number is in the union at place k less those before it that are in both; places never fall.
    upto = np.count_nonzero(shared >= np.arange(2, 2 * size + 1, dtype=np.int32) - size, axis=1)
    return shared[np.arange(len(n)), upto - 1] / np.minimum(n - shared[:, -1], size)


def estimated(n: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """distinct() of sketches of n values, by the last value of those that are full."""
    return np.where(n < size, n, (size - 1) / ((last.astype(np.float64) + 2.0**63 + 1) / 2.0**64))


def grid(lists: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows, filled up at their ends with the largest number; and how many hashes each has."""
    counts = np.asarray(lists.value_lengths()).astype(np.int64)
    full = np.full((len(counts), size), np.iinfo(np.int64).max)
    full[np.arange(size) < counts[:, None]] = lists.flatten().to_numpy()
    return full, counts


def signatures(full: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit for each hash, of SIGNATURE: those of two sketches differ in no more bits than the sketches have hashes that the other lacks."""
    bits = np.zeros((len(full), SIGNATURE), bool)
    row = np.repeat(np.arange(len(full)), counts)
    inside = np.arange(full.shape[1]) < counts[:, None]
    bits[row, (full[inside] & (SIGNATURE - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def radius(size: int, alike: float) -> int:
    """How many hashes two linked sketches have that the other lacks, at most."""
    return math.floor(2 * (1 - alike) * size + 1e-9)


def frequent(sketches: DataFrame, size: int) -> np.ndarray:
    """Hashes that many sketches have, sorted; at most 2 * OFTEN * size. The result of no query depends on which they are."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                values, n = np.unique(part.column(0).flatten().to_numpy(), return_counts=True)
                some = n >= max(8, part.num_rows / OFTEN)
                yield pa.RecordBatch.from_pydict({"value": pa.array(values[some]), "n": pa.array(n[some])})

    seen = sketches.select("sketch").mapInArrow(look, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    return np.sort(seen.where(F.col("n") * (2 * OFTEN) >= sketches.count()).select("value").toArrow().column("value").to_numpy())


def levels(sketches: DataFrame) -> np.ndarray:
    """For each of COUNTERS, how many hashes fall to it: four times the logarithm. The result of no query depends on them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        parts = np.minimum(total, 0xFFFF).astype(np.uint16).reshape(SLICES, -1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "part": pa.array([x.tobytes() for x in parts], pa.binary())})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_py(), np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(sums, pa.int32()), "part": pa.array([np.ceil(4 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())})

    kind = "slice int, part binary"
    parts = sketches.select("sketch").coalesce(COUNTING).mapInArrow(look, kind).repartition("slice").mapInArrow(together, kind).toArrow().sort_by("slice")
    return np.frombuffer(b"".join(parts.column("part").to_pylist()), np.uint8) if len(parts) else np.zeros(COUNTERS, np.uint8)


def first_hashes(sketches: DataFrame, often: np.ndarray, level: np.ndarray, size: int, alike: float) -> DataFrame:
    """(key, salt, node) of the hashes that a linked sketch must share one of, for each sketch; the salt is 0 but for keys among `often`. Copies of a sketch may be left out."""
    model = sketches.sparkSession.sparkContext.broadcast((often, level))  # bounded, see frequent() and levels()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, level = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                part = part.take(pa.array(np.unique(part.column("sketch_id").to_numpy(), return_index=True)[1]))
                full, counts = grid(part.column("sketch"), size)
                late = np.isin(full, often)
                order = np.argsort(level[full & (COUNTERS - 1)] + late.astype(np.uint16) * np.uint16(256), axis=1, kind="stable")
                n = counts - np.ceil(alike * counts - 1e-9).astype(np.int64) + 1
                # Places that are filled up count for nothing, wherever the order has them.
                inside = np.take_along_axis(np.arange(size) < counts[:, None], order, 1)
                place = np.cumsum(inside, axis=1)
                chosen = inside & (place <= n[:, None])
                node = part.column("sketch_id").to_numpy()[np.nonzero(chosen)[0]]
                salt = np.where(np.take_along_axis(late, order, 1)[chosen], 1 + (node & (SALTS - 1)), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(full, order, 1)[chosen]), pa.array(salt), pa.array(node)], names=["key", "salt", "node"])

    return sketches.select("sketch_id", "sketch").mapInArrow(take, "key long, salt int, node long")


def meeting(first: DataFrame) -> DataFrame:
    """(key, node), each once, of the keys that several nodes have; and of all with a salt, whose rows go to no one task."""

    def shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, salt, node = (table.column(c).to_numpy() for c in ("key", "salt", "node"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (salt[1:] != salt[:-1])
        key, salt, node = key[new], salt[new], node[new]
        like = np.zeros(len(key) + 1, bool)
        like[1:-1] = key[1:] == key[:-1]
        some = like[1:] | like[:-1] | (salt > 0)
        yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(node[some])], names=["key", "node"])

    return blocks.each(first, ["key", "salt"], shared, "key long, node long", order=("node",))


def places(table: DataFrame) -> DataFrame:
    """(sketch_id, file, row) of a written table: a hash of the file's name, and the number of the row in it."""
    return table.select("sketch_id", F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def at_files(path: str, rows: DataFrame, columns: list[str], work: Callable[[pa.RecordBatch, np.ndarray, pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Brings rows (file, row, ...) of places() to the files of the table at path. work gets each stretch of a file, and the rows that are for it, in order: where in the stretch, and the rows."""
    files, folder = fs.FileSystem.from_uri(path)
    names = [f.base_name for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "name string").select(F.xxhash64("name").alias("file"), "name")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path)
        begin = blocks.begins(table, ["file"])
        for lo, hi in zip(begin, np.append(begin[1:], table.num_rows), strict=True):
            name, mine = table.column("name")[lo].as_py(), table.slice(lo + 1, hi - lo - 1)  # a null row is the first
            at, done = mine.column("row").to_numpy(), 0
            with files.open_input_file(f"{folder}/{name}") as opened:
                for batch in pq.ParquetFile(opened).iter_batches(READ, columns=columns):
                    a, b = np.searchsorted(at, [done, done + batch.num_rows])
                    if (out := work(batch, at[a:b] - done, mine.slice(a, b - a))) is not None:
                        yield out
                    done += batch.num_rows

    return blocks.each(rows.unionByName(every, allowMissingColumns=True), ["file"], run, schema, order=("row",), tasks=2 * len(names) or 1)


def counted(table: pa.Table, size: int, alike: float) -> pa.RecordBatch:
    """(node, links, resemblance, containment, other_id) of the sketches with a link in their block, a row for each: as links() has them. However many links there are, what leaves the task is a row a sketch."""
    ids, tile = table.column("sketch_id").to_numpy(), table.column("tile").to_numpy()
    same = table.column("lo").to_numpy() == table.column("hi").to_numpy()
    full, counts = grid(table.column("sketch").combine_chunks(), size)
    n, best, other = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for p, q in simhash.near_pairs(blocks.begins(table, COMPONENT), signatures(full, counts), radius(size, alike)):
        once = (tile[p] != tile[q]) | same[p]
        p, q = p[once], q[once]
        for lo in range(0, len(p), CHUNK):
            i, j = p[lo : lo + CHUNK], q[lo : lo + CHUNK]
            r = alikeness(full[i], counts[i], full[j], counts[j], size)
            ok = r >= alike - 1e-12
            me, it, r = np.concatenate([i[ok], j[ok]]), np.concatenate([j[ok], i[ok]]), np.concatenate([r[ok], r[ok]])
            n += np.bincount(me, minlength=len(ids))
            order = np.lexsort((ids[it], -r, me))
            first = order[np.flatnonzero(np.diff(me[order], prepend=-1))]
            me, it, r = me[first], it[first], r[first]
            better = (r > best[me]) | ((r == best[me]) & (ids[it] < ids[other[me]]))
            best[me[better]], other[me[better]] = r[better], it[better]
    some = np.flatnonzero(n)
    part = np.zeros(len(some))
    for lo in range(0, len(some), CHUNK):
        i = some[lo : lo + CHUNK]
        j = other[i]
        part[lo : lo + CHUNK] = estimate(full[i], counts[i], full[j], counts[j], size)[1]
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(best[some]), pa.array(part), pa.array(ids[other[some]])], names=["node", "links", "resemblance", "containment", "other_id"])


def links(sketches: DataFrame, path: str, size: int = SIZE, alike: float = ALIKE) -> DataFrame:
    """(node, links, nearest) of every sketch with a link: how many other sketches it has one to, and the one of greatest resemblance: (resemblance, containment of this in that, other_id), of equal ones the least other_id.

    sketches has (sketch_id, sketch), in any number of equal rows, and is the table written at path.
    """
    spark, words = sketches.sparkSession, SIGNATURE // 64
    some = sketches.where(F.size("sketch") > 0)
    meet = kernel.cut(meeting(first_hashes(some, frequent(some, size), levels(some), size, alike)))
    kernel.release(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                bits = kernel.signed(signatures(*grid(part.column("sketch"), size)))
                yield pa.RecordBatch.from_arrays([part.column("sketch_id"), *(pa.array(np.ascontiguousarray(bits[:, w])) for w in range(words))], names=["sketch_id", *(f"f{w}" for w in range(words))])

    signed = some.select("sketch_id", "sketch").mapInArrow(sign, "sketch_id long, " + ", ".join(f"f{w} long" for w in range(words))).dropDuplicates(["sketch_id"])
    near = simhash.near_edges(meet.join(signed, F.col("node") == F.col("sketch_id")).drop("sketch_id"), radius(size, alike), words)
    parts = kernel.cut(graph.components(near))
    kernel.release(spark)

    def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield counted(table, size, alike)

    def bring(batch: pa.RecordBatch, at: np.ndarray, rows: pa.Table) -> pa.RecordBatch | None:
        if not len(at):
            return None
        took = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([rows.column("component").combine_chunks(), took.column("sketch_id"), took.column("sketch").cast(pa.list_(pa.int64()))], names=["component", "sketch_id", "sketch"])

    where = places(sketches).join(parts, F.col("sketch_id") == F.col("node")).groupBy("sketch_id", "component").agg(F.min(F.struct("file", "row")).alias("at"))
    placed = at_files(path, where.select("component", "at.file", "at.row"), ["sketch_id", "sketch"], bring, "component long, sketch_id long, sketch array<long>")
    cut = blocks.tiled(placed, "component", "sketch_id", min(TILE, blocks.ROWS), keys=parts)
    tallies = blocks.each(cut, COMPONENT, count, "node long, links long, resemblance double, containment double, other_id long")
    best = F.max(F.struct("resemblance", F.bitwise_not("other_id").alias("flipped"), "containment"))
    found = tallies.groupBy("node").agg(F.sum("links").alias("links"), best.alias("best"))
    return found.select("node", "links", F.struct("best.resemblance", "best.containment", F.bitwise_not("best.flipped").alias("other_id")).alias("nearest"))


COMPONENT = ["component", *blocks.BLOCK]


def fingerprints(docs: DataFrame, size: int = SIZE, k: int = SHINGLE, alike: float = ALIKE) -> DataFrame:
    """(doc_id, sketch_id, sketch, distinct_shingles, source_shingles, links, nearest_id, resemblance, containment) of every row.

    source_shingles is the number of distinct shingles in the document's source, from merged
    sketches. links is the number of other sketches with an estimated resemblance of `alike` or
    more; documents with one sketch_id have the same links, and each other's estimates are 1.
    The last three are of the link with the greatest resemblance: its sketch_id, and how much of
    this document it contains.

    Defined cases: a null, empty or word-free text has an empty sketch, no shingles and no links;
    where there is no link the last three are null; a null source is a source of its own; rows
    with a null or a repeated id are each on their own, and repeated rows stay; texts are taken
    whole; of links with equal resemblance the least sketch_id is named; an empty table gives no
    rows; other columns are not looked at.
    """
    each, path = kernel.written(sketch(docs, size, k))
    whole = kernel.small(merge(each, "source", size).select(F.col("source").alias("of_source"), distinct(F.col("sketch"), size).alias("source_shingles")))
    linked = kernel.cut(links(each, path, size, alike))
    kernel.release(docs.sparkSession)

    def beside(batch: pa.RecordBatch, at: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        n = np.zeros(batch.num_rows, np.int64)
        n[at] = rows.column("links").to_numpy()
        to = np.full(batch.num_rows, -1)
        to[at] = np.arange(len(at))
        best = rows.select(["nearest_id", "resemblance", "containment"]).take(pa.array(to, mask=to < 0)).combine_chunks()
        lists = batch.column("sketch").cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("sketch_id"), lists, pa.array(n), *(pc.cast(c.combine_chunks(), t) for c, t in zip(best.columns, (pa.int64(), pa.float64(), pa.float64()), strict=True))], names=names)

    names = ["doc_id", "source", "sketch_id", "sketch", "links", "nearest_id", "resemblance", "containment"]
    rows = places(each).join(linked, F.col("sketch_id") == F.col("node")).select("file", "row", "links", F.col("nearest.other_id").alias("nearest_id"), "nearest.resemblance", "nearest.containment")
    found = at_files(path, rows, names[:4], beside, "doc_id long, source string, sketch_id long, sketch array<long>, links long, nearest_id long, resemblance double, containment double")
    joined = found.join(whole, F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "sketch_id", "sketch", distinct(F.col("sketch"), size).alias("distinct_shingles"), "source_shingles", "links", "nearest_id", "resemblance", "containment")
