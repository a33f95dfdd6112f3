"""Near-duplicate vectors by PCA-ordered tiled comparison of all pairs.

Vectors are scaled to length 1 and turned onto the principal axes of all of them, largest
first, which changes no cosine. Two tiles of vectors are compared over the leading axes first;
what the others can still add is at most the product of the two vectors' norms over them. A
tile stops when no pair can reach the threshold any more, and from the point where few pairs
can, only those go on.

No pair at the threshold is left out, at any number of vectors: different vectors lie in the
shared folder as tiles, and every two tiles meet once in a task that reads both there, so that
the pairs grow with the square of the vectors and what is written doesn't. From a task come
how many near ones each vector has there, and edges that connect what is connected.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, graph, kernel

THRESHOLD, RECALL = 0.9, 0.99
BUCKET_ROWS, LEAST_BITS = 2048, 2
BRANCHES = 64
LEAST_TILES = 8  # so that a table of few vectors is not one task's
TILE, STEP = 512, 8
FEW = 0.02  # of a tile's pairs: from here on they go on one by one
SLACK = 1e-6  # what single precision may be off, besides its rounding of each of the terms
TINY = 1e-11  # what double precision may be off


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes a table, and tables, of a search in buckets that finds a pair with probability RECALL. No query uses it: compared() takes all pairs. It stays as long as its test does."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, n) / BUCKET_ROWS)))
    share = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - share))) if share < 1 else 1


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square is beyond the numbers
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of equal rows, with sums in the order of the elements, as SQL has them."""
    both, one, two = np.zeros((3, len(x)))
    for k in range(x.shape[1]):
        both += x[:, k] * y[:, k]
        one += x[:, k] * x[:, k]
        two += y[:, k] * y[:, k]
    return both / np.sqrt(one * two)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: elements, all of them finite, and not all zero."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vkey, vector) of every row; vkey is null where the vector has no direction. Elements are double or, where they came so, single."""
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    return every.select("vec_id", F.when(usable(F.col("vector")), F.xxhash64("vector")).alias("vkey"), "vector")


def axes(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Principal axes of all vectors, largest first, and how many vectors there are. One dim x dim sum comes from each task, and the driver gets BRANCHES sums of these."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            x = scaled(matrix(batch.column("vector"), dim))
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim * dim), 0
        for batch in batches:
            for part, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += np.frombuffer(part.as_py())
                n += k
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary()), "n": pa.array([n], pa.int64())})

    kind = "part binary, n long"
    sums = rows.mapInArrow(add, kind).repartition(BRANCHES).mapInArrow(together, kind).toArrow()
    second = np.sum([np.frombuffer(p) for p in sums.column("part").to_pylist()], axis=0).reshape(dim, dim)
    _, found = np.linalg.eigh((second + second.T) / 2)
    return found[:, ::-1].copy(), sum(sums.column("n").to_pylist())


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose dot product reaches the threshold, by TINY less at most; rows have length 1."""
    dim = x.shape[1]
    rest = [np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])) for m in (x, y)]
    least, end = threshold - SLACK - 1.2e-7 * (dim + 1), 0
    while end < dim:
        end = min(dim, max(STEP, 2 * end))
        # The norms of what is left are one more axis, and its product is the bound.
        left, right = ((np.concatenate([m[:, :end], r[:, end : end + 1]], 1)).astype(np.float32) for m, r in zip((x, y), rest, strict=True))
        alive = left @ right.T >= np.float32(least)
        count = np.count_nonzero(alive)
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if count <= FEW * alive.size:
            break
    i, j = np.nonzero(alive)
    sums = np.zeros(len(i))
    for k in range(0, dim, STEP):
        sums = sums + np.einsum("ij,ij->i", x[i, k : k + STEP], y[j, k : k + STEP])
        more = rest[0][i, k + STEP] * rest[1][j, k + STEP] if k + STEP < dim else 0.0
        keep = sums + more >= threshold - TINY
        i, j, sums = i[keep], j[keep], sums[keep]
    return i, j


def tile_pair(number: int, tiles: int) -> tuple[int, int] | None:
    """The two tiles that meet under a number below tiles * (tiles // 2 + 1): each two once, and each with itself."""
    a, step = divmod(number, tiles // 2 + 1)
    return None if 2 * step == tiles and 2 * a >= tiles else (a, (a + step) % tiles)


def compared(rows: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, other, links) of vectors, by vkey, from all pairs of different ones: edges (node, other) that connect near ones; and, where other is null, parts of the number of others near a node."""
    spark = rows.sparkSession
    turn, n = axes(rows, dim)
    model = spark.sparkContext.broadcast(turn)  # bounded by the dimension
    deal = max(LEAST_TILES, math.ceil(n / blocks.ROWS))
    _, path = kernel.written(rows.dropDuplicates(["vkey"]).select("vkey", "vector").repartition(deal, "vkey"))  # copies of one vector are compared once
    files, folder = fs.FileSystem.from_uri(path)
    names = sorted(f.base_name for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".parquet"))
    tiles = len(names)

    def load(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        files, folder = fs.FileSystem.from_uri(path)
        table = pq.read_table(f"{folder}/{names[k]}", columns=["vkey", "vector"], filesystem=files)
        raw = matrix(table.column("vector").combine_chunks(), dim).astype(np.float64)
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])  # by a power of two: no square is beyond the numbers, and no cosine is rounded in another way
        return table.column("vkey").to_numpy(), raw, scaled(raw) @ model.value

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for number in (k for batch in batches for k in batch.column(0).to_pylist()):
            if (pair := tile_pair(number, tiles)) is None:
                continue
            held = {k: held[k] if k in held else load(k) for k in pair}
            (keys, raw, x), (other_keys, other_raw, y) = held[pair[0]], held[pair[1]]
            same, n = pair[0] == pair[1], len(x)
            label, links, other_links, a, b = np.arange(n + len(y)), np.zeros(n, np.int64), np.zeros(len(y), np.int64), [], []
            for i in range(0, n, TILE):
                for j in range(i if same else 0, len(y), TILE):
                    p, q = near(x[i : i + TILE], y[j : j + TILE], threshold)
                    p, q = p + i, q + j
                    once = np.flatnonzero((p < q) | (not same))
                    for lo in range(0, len(once), 1 << 14):
                        u, v = p[once[lo : lo + (1 << 14)]], q[once[lo : lo + (1 << 14)]]
                        ok = cosines(raw[u], other_raw[v]) >= threshold
                        u, v = u[ok], v[ok]
                        links += np.bincount(u, minlength=n)
                        other_links += np.bincount(v, minlength=len(y))
                        u, v, label = blocks.spanning(label, u, v + (0 if same else n))
                        a.append(u)
                        b.append(v)
            every = keys if same else np.concatenate([keys, other_keys])
            links = links + other_links if same else np.concatenate([links, other_links])
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_pydict({"node": pa.array(every[some]), "other": pa.nulls(len(some), pa.int64()), "links": pa.array(links[some])})
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_pydict({"node": pa.array(every[a]), "other": pa.array(every[b]), "links": pa.nulls(len(a), pa.int64())})

    numbers = tiles * (tiles // 2 + 1)
    found = kernel.cut(spark.range(0, numbers, 1, min(numbers, max(64, numbers // 16))).mapInArrow(meet, "node long, other long, links long"))
    kernel.remove(spark, path)
    return found


def placed(rows: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, vkey, kept, links) of every row, those equal in id and vector once; kept is the id and vkey of the least of its group."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    every = kernel.cut(vectors(rows))
    kept = every.where("vkey is not null")
    # Each length has its own axes and tiles.
    dims = [r.dim for r in kept.groupBy(F.size("vector").alias("dim")).count().where("count > 1").orderBy("dim").collect()]
    members = every.select("vec_id", "vkey").distinct()
    if not dims:
        return members.select("vec_id", "vkey", F.struct(F.col("vec_id").alias("id"), F.col("vkey").alias("key")).alias("kept"), F.lit(0).cast("long").alias("links"))
    found = functools.reduce(DataFrame.unionByName, (compared(kept.where(F.size("vector") == dim), dim, threshold) for dim in dims))
    parts = kernel.cut(graph.components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    counted = found.where("other is null").groupBy(F.col("node").alias("near_key")).agg(F.sum("links").alias("links"))
    members = members.join(parts, F.col("vkey") == F.col("node"), "left").join(counted, F.col("vkey") == F.col("near_key"), "left")
    members = members.select("vec_id", "vkey", F.coalesce("component", "vkey").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    order = F.struct(F.col("vec_id").isNull().alias("no_id"), F.col("vec_id").alias("id"), F.col("vkey").alias("key"))
    least = kernel.cut(members.where("vkey is not null").groupBy(F.col("component").alias("of")).agg(F.min(order).alias("kept")))
    own = F.struct(F.col("vec_id").alias("id"), F.col("vkey").alias("key"))
    return members.join(least, F.col("component") == F.col("of"), "left").select("vec_id", "vkey", F.when(F.col("of").isNull(), own).otherwise(F.struct("kept.id", "kept.key")).alias("kept"), "links")


def classes(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, class_id, links) of every vector: the least id of its group, and how many other vectors are near it; copies of one vector count once.

    Groups are the connected components of cosine >= threshold, and links are counted, over all
    pairs of different vectors: none is left out, at any number of vectors.

    Defined cases: null and empty vectors, zero vectors, and those with null, infinite or NaN
    elements are near nothing, and vectors of different lengths not near each other; a null id
    orders after all others; rows equal in id and vector are one; other rows that share an id
    are vectors of their own; equal vectors are near; an empty table gives no rows; other
    columns are not looked at. Vectors are told apart by a 64-bit hash of their elements.
    """
    return placed(rows, threshold).select("vec_id", F.col("kept.id").alias("class_id"), "links")


def groups(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, kept_id) of every vector that goes because another of its group stays, that with the least id. The groups and the defined cases are those of classes()."""
    stays = F.col("vec_id").eqNullSafe(F.col("kept.id")) & F.col("vkey").eqNullSafe(F.col("kept.key"))
    return placed(rows, threshold).where(~stays).select("vec_id", F.col("kept.id").alias("kept_id"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    e AS (SELECT p.vec_id AS a, q.vec_id AS b, q.x AS x, p.x <> q.x AS other FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= {threshold}),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    g AS (SELECT a, min(b) AS least FROM r GROUP BY a),
    n AS (SELECT a, count(DISTINCT x) FILTER (WHERE other) AS links FROM e GROUP BY a)
    SELECT v.vec_id, least(v.vec_id, coalesce(g.least, v.vec_id)) AS class_id, coalesce(n.links, 0)::BIGINT AS links
    FROM v LEFT JOIN g ON g.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
