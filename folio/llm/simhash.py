"""Near-duplicate documents by SimHash, with bit-sliced comparison.

A fingerprint has 256 bits: for each, the majority of that bit over the hashes of a
document's distinct words. Two documents are near copies if their fingerprints differ in at
most RADIUS bits, and groups are the connected components of that relation.

Which fingerprints are compared is found by min-hashing: documents share a block if for one
of TABLES pairs of hash functions both minima over their three-word shingles agree. Two
documents with resemblance r do so with probability 1 - (1 - r**2)**TABLES: 0.99 at 0.5.

Fingerprints are stored as bit planes, one machine word for each 64 of them, block after block,
so small blocks share words. One fingerprint's distances to all of a word are added up plane by
plane with carry-save adders, so each bitwise operation serves 64 distances, and a word is
abandoned when the distances to all that belong to the block are beyond the radius. Every pair
of a block is compared, in blocks of any size. A block of very many is split into tiles, every
two of which meet (blocks.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, graph, kernel

BITS, RADIUS = 256, 44
SHINGLE, TABLES = 3, 16
PLANES_A_STEP = 16
TOGETHER = 1 << 16  # fingerprints against words of planes
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(1, 1 << 63, 2 * TABLES, np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _rng.integers(1, 1 << 63, BITS // 64, np.uint64)
WORDY = np.zeros(256, bool)
WORDY[48:58] = WORDY[65:91] = WORDY[97:123] = WORDY[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FIRST = np.packbits(np.arange(64) < np.arange(65)[:, None], axis=1).view(np.uint64).ravel()  # the bits of the first k fingerprints of a word
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()  # a byte's bits, each as a byte


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, fingerprints (uint64, BITS / 64 columns) and block keys (TABLES columns) of some texts.

    Words are lower-case runs of ASCII letters, digits and non-ASCII bytes.
    """
    data, offsets = kernel.flat(texts)
    n = len(offsets) - 1
    starts, ends, first = kernel.spans(data, offsets, WORDY[data])
    counts = np.diff(first)
    hashes = kernel.word_hashes(LOWER[data], starts, ends)
    rows = np.repeat(np.arange(n), counts)

    # Distinct words: the row in the high bits, 48 bits of the hash below.
    prints = np.zeros((n, BITS // 64), np.uint64)
    keys = np.zeros((n, TABLES), np.uint64)
    have = np.flatnonzero(counts)
    if not len(have):
        return counts, prints, keys
    parts = []
    for lo in range(0, n, 1 << 16):
        a, b = first[lo], first[min(n, lo + (1 << 16))]
        u = np.unique(((rows[a:b] - lo).astype(np.uint64) << np.uint64(48)) | (hashes[a:b] >> np.uint64(16)))
        parts.append(((u >> np.uint64(48)).astype(np.int64) + lo, kernel.mix(u & np.uint64((1 << 48) - 1))))
    urows, uhash = (np.concatenate(x) for x in zip(*parts, strict=True))
    begins = np.searchsorted(urows, have)
    sizes = np.diff(np.append(begins, len(urows)))
    # Eight counters of one byte in each machine word, so at most 255 words at once.
    per = -(-sizes // 255)
    sub_doc = np.repeat(np.arange(len(have)), per)
    sub = begins[sub_doc] + 255 * (np.arange(len(sub_doc)) - np.repeat(np.cumsum(per) - per, per))
    doc_at = np.cumsum(per) - per
    for w, salt in enumerate(SALTS):
        octets = kernel.mix(uhash ^ salt).view(np.uint8).reshape(-1, 8)
        votes = np.empty((len(have), 8, 8), np.int32)
        for c in range(8):
            sums = np.add.reduceat(SPREAD[octets[:, c]], sub).view(np.uint8).reshape(-1, 8)
            votes[:, c] = np.add.reduceat(sums, doc_at, axis=0, dtype=np.int32)
        bits = 2 * votes.reshape(len(have), 64) > sizes[:, None]
        prints[have, w] = np.packbits(bits, axis=1).view(np.uint64).ravel()

    # Shingles; a document shorter than one has its whole as its only shingle.
    prefix = kernel.Prefix(hashes, kernel.WORD_BASE)
    grams = np.maximum(counts[have] - SHINGLE + 1, 1)
    gram_at = np.cumsum(grams) - grams
    at = np.repeat(first[have], grams) + np.arange(grams.sum()) - np.repeat(gram_at, grams)
    end = np.minimum(at + SHINGLE, np.repeat(first[have + 1], grams))
    shingles = kernel.mix(prefix.slices(at, end))
    for t in range(TABLES):
        low = [np.minimum.reduceat(shingles * MULTIPLIERS[2 * t + i], gram_at) for i in (0, 1)]
        keys[have, t] = kernel.mix(kernel.mix(low[0] + np.uint64(t)) + low[1])
    return counts, prints, keys


def transpose(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b has bit b of every fingerprint, 64 to a word."""
    n = len(prints)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, -1), axis=1)
    wide = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1).view(np.uint64)


def within(planes: np.ndarray, queries: np.ndarray, q: np.ndarray, w: np.ndarray, outside: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For query fingerprint q[i] and word w[i] of the planes, a bit for each fingerprint there: whether they are within the radius and not outside. Only what has such a bit comes back, as (i, bits)."""
    n_bits = len(planes)
    flip = np.where(np.unpackbits(queries.view(np.uint8).reshape(len(queries), -1), axis=1).T, ALL, np.uint64(0))
    digits = (n_bits + 1).bit_length()
    live = np.arange(len(q))
    counters = [np.zeros(len(q), np.uint64) for _ in range(digits)]  # one array for each binary digit
    beyond = outside
    for b in range(0, n_bits, PLANES_A_STEP):
        for i in range(b, min(n_bits, b + PLANES_A_STEP), 2):
            x, y = planes[i, w] ^ flip[i, q], planes[i + 1, w] ^ flip[i + 1, q]
            c = counters[0]
            half = x ^ y
            counters[0], carry = half ^ c, (x & y) | (half & c)  # full adder: two planes and the units
            for d in range(1, digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
                if not carry.any():
                    break
        beyond = at_least(counters, radius + 1) | outside
        go = beyond != ALL
        if not go.all():
            live, q, w, outside, beyond = live[go], q[go], w[go], outside[go], beyond[go]
            counters = [c[go] for c in counters]
            if not len(q):
                break
    return live, ~beyond


def at_least(counters: list[np.ndarray], least: int) -> np.ndarray:
    """A bit for each counter: whether it is `least` or more."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], 0xFFFFFFFFFFFFFFFF)
    for d in range(len(counters) - 1, -1, -1):
        if least >> d & 1:
            equal = equal & counters[d]
        else:
            above = above | (equal & counters[d])
            equal = equal & ~counters[d]
    return above | equal


def near_pairs(begin: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of one block within the radius, in parts; blocks begin at `begin` and fill the rows."""
    n = len(prints)
    planes = transpose(prints)
    end = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n)))
    i = np.flatnonzero(np.arange(1, n + 1) < end)  # each meets those after it
    first, count = (i + 1) // 64, (end[i] - 1) // 64 - (i + 1) // 64 + 1
    upto = np.cumsum(count)
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - count[lo] + TOGETHER, "right")))
        q = np.repeat(np.arange(hi - lo), count[lo:hi])
        w = np.arange(len(q)) - np.repeat(upto[lo:hi] - count[lo:hi] - (upto[lo] - count[lo]), count[lo:hi]) + first[lo:hi][q]
        row = i[lo:hi][q]
        outside = FIRST[np.clip(row + 1 - 64 * w, 0, 64)] | ~FIRST[np.clip(end[row] - 64 * w, 0, 64)]
        some, bits = within(planes, prints[i[lo:hi]], q, w, outside, radius)
        if len(some):
            at, place = np.nonzero(np.unpackbits(bits.view(np.uint8)).reshape(-1, 64))
            yield row[some[at]], w[some[at]] * 64 + place
        lo = hi


def compare(begin: np.ndarray, nodes: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a < b) that connect what is connected within the radius in each block. Of a group's pairs, all of which are compared, those that join it are kept."""
    label, a, b = np.arange(len(nodes)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in near_pairs(begin, prints, radius):
        p, q, label = blocks.spanning(label, i, j)
        a.append(nodes[p])
        b.append(nodes[q])
    x, y = np.concatenate(a), np.concatenate(b)
    return np.minimum(x, y), np.maximum(x, y)


def near_edges(rows: DataFrame, radius: int, words: int = BITS // 64) -> DataFrame:
    """(a, b) of nodes that connects near ones, from rows (key, node, f0, f1, ...)."""
    names = [f"f{w}" for w in range(words)]

    def edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: table.column(c).to_numpy() for c in ("node", *names)}
        a, b = compare(blocks.begins(table, KEYS), col["node"], np.stack([col[c].view(np.uint64) for c in names], 1), radius)
        if len(a):
            a, b = np.unique(np.stack([a, b], 1), axis=0).T
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.each(blocks.tiled(rows, "key", "node").drop("tile"), KEYS, edges, "a long, b long")


KEYS = ["key", *blocks.BLOCK]


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, f0..f3, keys) of every document with words: the node stands for its fingerprint."""
    n_words = BITS // 64

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                counts, prints, keys = fingerprints(part.column("text"))
                some = np.flatnonzero(counts)
                node = prints[some, 0].copy()
                for w in range(1, n_words):
                    node = kernel.mix(node) + prints[some, w]
                node = kernel.mix(node)
                took = part.select(["doc_id", "text_key"]).take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [*took.columns, pa.array(kernel.signed(node)), *(pa.array(kernel.signed(np.ascontiguousarray(prints[some, w]))) for w in range(n_words)), kernel.ragged(kernel.signed(np.ascontiguousarray(keys[some])).ravel(), np.full(len(some), TABLES), pa.int64())],
                    names=["doc_id", "text_key", "node", *(f"f{w}" for w in range(n_words)), "keys"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(describe, "doc_id long, text_key long, node long, " + ", ".join(f"f{w} long" for w in range(n_words)) + ", keys array<long>")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, kept_id, kept_key) of every document that goes because another of its group stays.

    Of a group the document with the least id stays; text_key is a hash of the text and
    tells rows apart that share an id.

    Defined cases: null, empty and word-free texts are copies of nothing; a null id orders
    after all others; rows equal in id and text are one document, and no copy of each other;
    rows that share an id with other texts are documents of their own; an empty table gives no
    rows; other columns are not looked at.
    """
    return grouped(kernel.cut(members(docs)), radius)


def grouped(rows: DataFrame, radius: int) -> DataFrame:
    """groups() of what members() gave."""
    names = [f"f{w}" for w in range(BITS // 64)]
    # Documents with one fingerprint are one node, so thousands of exact copies meet once; it has the
    # block keys of all of them, as the same words in another order have other shingles.
    nodes = rows.groupBy("node", "keys").agg(*(F.first(c).alias(c) for c in names))
    nodes, path = kernel.written(nodes)
    parts = graph.components(near_edges(nodes.select(F.explode("keys").alias("key"), "node", *names), radius))
    kernel.remove(rows.sparkSession, path)
    documents = rows.select("doc_id", "text_key", "node").distinct()
    placed = documents.join(parts, "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    # Cut, so that the join below meets two shuffled tables and Spark can split a component of very many.
    kept = kernel.cut(placed.groupBy("component").agg(F.min(order).alias("kept"), F.count("*").alias("n")).where("n > 1").select("component", "kept"))
    joined = placed.join(kept, "component").where(~(F.col("doc_id").eqNullSafe(F.col("kept.id")) & (F.col("text_key") == F.col("kept.key"))))
    return joined.select("doc_id", "text_key", F.col("kept.id").alias("kept_id"), F.col("kept.key").alias("kept_key"))


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, that are no near copy of one that stays; of rows repeated in full, one.

    Defined cases: null, empty and word-free texts stay; of a group the document with the least
    id stays, a null id ordering after all others, and of rows that share an id and differ in
    text each is decided on its own; columns may have any names; an empty table gives no rows.
    """
    rows = kernel.cut(members(docs))
    gone = kernel.cut(grouped(rows, radius).select("doc_id", "text_key"))
    key, i, k, ri, rk = kernel.fresh(docs, "simhash_key", "simhash_gone_id", "simhash_gone_key", "simhash_repeated_id", "simhash_repeated_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    gone = gone.select(F.col("doc_id").alias(i), F.col("text_key").alias(k))
    stay = keyed.join(gone, keyed["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k)), "left_anti")
    # Rows repeated in full are rare, and only they are brought together to leave one of each.
    repeated = kernel.cut(rows.groupBy(F.col("doc_id").alias(ri), F.col("text_key").alias(rk)).count().where("count > 1").select(ri, rk))
    if not repeated.isEmpty():
        same = stay["doc_id"].cast("long").eqNullSafe(F.col(ri)) & (F.col(key) == F.col(rk))
        stay = stay.join(repeated, same, "left_anti").unionByName(stay.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key]))
    return stay.select(*(f"`{c.replace('`', '``')}`" for c in docs.columns))
