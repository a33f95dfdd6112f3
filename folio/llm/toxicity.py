"""Toxicity by a factorization machine over hashed terms.

The score of a document is  bias + sum(w_i) + sum over pairs of <v_i, v_j>  over the distinct
hashed terms i it has: the pair part learns that two terms together, such as an insult and a
mention of a group, mean what neither does alone. Terms are lower-case words and their
leading bytes, so inflected and compounded forms share evidence. The machine is trained here
from labelled documents, by limited-memory BFGS on the logistic loss. Every term in enough
documents takes part, whatever its own odds: these only say how freely its weight may move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from . import kernel

BUCKETS = 1 << 31  # so many that a very long text hardly meets a chosen one by chance
SIEVE = 1 << 22
PREFIXES = (3, 4, 5, 6, 7, 8)
#: At most so many labelled documents train the machine: those with the least digests of their ids.
SAMPLE_ROWS = 12_000
MIN_DOCS = 3
#: A term whose odds alone say so much has RIDGE; of others, the weight and the factors have the two of WEAK_RIDGE. None is left out.
MIN_LIFT, MIN_Z = 3.0, 3.0
FACTORS, STEPS, MEMORY, RIDGE, WEAK_RIDGE = 4, 40, 8, 2e-4, (5e-2, 1e-2)
CHUNK = 1 << 18
THRESHOLD = 0.5

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hash buckets of all terms of some texts, repeats included."""
    data, offsets = kernel.flat(texts)
    starts, ends, first = kernel.spans(data, offsets, LETTER[data])
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    low = LOWER[data]
    if len(low) > 1:  # capital letters of Latin-1 in UTF-8
        low[1:] += np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97), 32, 0).astype(np.uint8)
    prefix = kernel.Prefix(low, kernel.BASE)
    size = ends - starts
    out_rows, out = [rows], [kernel.mix(prefix.slices(starts, ends))]
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        out_rows.append(rows[long])
        out.append(kernel.mix(prefix.slices(starts[long], starts[long] + n) + np.uint64(n * 0x51ED27)))
    return np.concatenate(out_rows), (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64)


def distinct(rows: np.ndarray, values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    both = rows * below + values
    both.sort()
    both = both[np.diff(both, prepend=-1) > 0]
    rows = both // below
    return rows, both - rows * below


@dataclass
class Machine:
    """buckets are sorted; weights and factors belong to them."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table by the low bits of a bucket: the place of the first one with these bits, in an order by them; that order, and the buckets in it."""
        low = self.buckets & (SIEVE - 1)
        order = np.argsort(low, kind="stable")
        first = np.full(SIEVE, -1, np.int32)
        first[low[order[::-1]]] = np.arange(len(order) - 1, -1, -1, dtype=np.int32)
        return first, order, np.append(self.buckets[order], -1)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some terms are among the buckets, and the places of these."""
        first, order, known = self.slots
        place = first[terms & (SIEVE - 1)]
        found = known[place] == terms  # the last of known, where place is -1, is no bucket
        seek = np.flatnonzero(~found & (place >= 0))
        while len(seek):  # buckets that share the low bits lie one after the other
            place[seek] += 1
            got = known[place[seek]]
            found[seek[got == terms[seek]]] = True
            seek = seek[(got != terms[seek]) & (((got ^ terms[seek]) & (SIEVE - 1)) == 0) & (got >= 0)]
        hit = np.flatnonzero(found)
        return hit, order[place[hit]]

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of being toxic, for each text."""
        n = len(texts)
        total = np.full(n, self.bias)
        if len(self.buckets):
            rows, terms = term_buckets(texts)
            hit, at = self.find(terms)
            rows, at = distinct(rows[hit], at, len(self.buckets))
            total += machine_sum(rows, at, n, self.weights, self.factors)[0]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def machine_sum(rows: np.ndarray, at: np.ndarray, n: int, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, sums = np.bincount(rows, weights[at], n), np.empty((n, factors.shape[1]))
    for k in range(factors.shape[1]):
        v = factors[at, k]
        sums[:, k] = np.bincount(rows, v, n)
        out += 0.5 * (sums[:, k] ** 2 - np.bincount(rows, v * v, n))
    return out, sums


def evidence(have, bad, n, positive, log, sqrt):
    """Log odds of a term in toxic against other documents, and its standard error; of arrays or columns."""
    a, b, c, d = bad + 0.5, positive - bad + 0.5, have - bad + 0.5, n - positive - have + bad + 0.5
    return log(a / b) - log(c / d), sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def fit(lists: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Machine:
    """train() of documents in memory, from the distinct term buckets of each and its label (0 or 1)."""
    n, positive = len(lists), int(toxic.sum())
    if not positive or positive == n:
        return nothing()
    sizes, terms = [len(x) for x in lists], np.concatenate(lists)
    known, at, have = np.unique(terms, return_inverse=True, return_counts=True)
    bad = np.bincount(at, np.repeat(toxic, sizes), len(known))
    odds, error = evidence(have, bad, n, positive, np.log, np.sqrt)
    best = np.flatnonzero(have >= MIN_DOCS)
    ends = np.cumsum(sizes)
    kept = np.concatenate([[0], np.cumsum(have[at] >= MIN_DOCS)])
    chosen = have[at] >= MIN_DOCS
    return learn((np.cumsum(have >= MIN_DOCS) - 1)[at[chosen]].astype(np.int32), kept[np.concatenate([[0], ends])], toxic, known[best].astype(np.int64), odds[best], np.abs(odds / error)[best], seed)


def nothing() -> Machine:
    return Machine(np.zeros(0, np.int64), -10.0, np.zeros(0), np.zeros((0, FACTORS)))


def gathered(starts: np.ndarray, index: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The sum of columns[k, index[starts[i] : starts[i + 1]]] for each k and i. Column by column, so that what is drawn from stays in the processor's cache."""
    n = len(starts) - 1
    out, lo = np.zeros((len(columns), n)), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CHUNK, "right")) - 1)
        some = lo + np.flatnonzero(np.diff(starts[lo : hi + 1]))
        if len(some):
            part = index[starts[lo] : starts[hi]].astype(np.intp)
            drawn = np.empty(len(part))
            for k, column in enumerate(columns):
                np.take(column, part, out=drawn, mode="clip")
                out[k, some] = np.add.reduceat(drawn, starts[some] - starts[lo])
        lo = hi
    return out


def turned(at: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of each of n buckets, in order and one bucket after the other, and where each bucket begins; document i has at[ends[i] : ends[i + 1]]. A stretch at a time, as the whole in 64-bit numbers is large."""
    stretches = [slice(lo, lo + CHUNK) for lo in range(0, len(at), CHUNK)]
    first = np.zeros(n + 1, np.int64)
    for stretch in stretches:
        first[1:] += np.bincount(at[stretch], minlength=n)
    np.cumsum(first, out=first)
    rows, free = np.empty(len(at), np.int32), first[:-1].copy()
    for stretch in stretches:
        order = np.argsort(at[stretch], kind="stable")
        bucket = at[stretch][order]
        begin = np.flatnonzero(np.diff(bucket, prepend=-1))
        count = np.diff(begin, append=len(bucket))
        rows[free[bucket] + np.arange(len(bucket)) - np.repeat(begin, count)] = np.searchsorted(ends[1:], stretch.start + order, "right")
        free[bucket[begin]] += count
    return rows, first


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """By one thread: those of a BLAS wait at work."""
    return np.einsum("i,i", a, b)


def minimum(loss, x: np.ndarray) -> np.ndarray:
    """Where limited-memory BFGS gets from x; loss gives the value and the gradient."""
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        way, parts = -grad, []
        for s, y, r in reversed(past):
            parts.append(r * dot(s, way))
            way = way - parts[-1] * y
        way = way / (past[-1][2] * dot(past[-1][1], past[-1][1])) if past else way * (0.01 / max(1e-12, np.abs(grad).max()))
        for (s, y, r), part in zip(past, reversed(parts), strict=True):
            way = way + s * (part - r * dot(y, way))
        slope, far = dot(grad, way), 1.0
        if slope > -1e-10:
            break
        while (there := loss(x + far * way))[0] > value + 1e-4 * far * slope:
            far *= 0.3
            if far < 1e-6:
                return x
        s, y = far * way, there[1] - grad
        x, (value, grad) = x + s, there
        if dot(s, y) > 1e-12:
            past = [*past, (s.astype(np.float32), y.astype(np.float32), 1 / dot(s, y))][-MEMORY:]
    return x


def learn(at: np.ndarray, ends: np.ndarray, toxic: np.ndarray, buckets: np.ndarray, odds: np.ndarray, z: np.ndarray, seed: int = 7) -> Machine:
    """The machine over some buckets, from those that each document has: document i the buckets[at[ends[i] : ends[i + 1]]]."""
    n, positive = len(toxic), int(toxic.sum())
    if not len(buckets):
        return nothing()
    ends = ends.astype(np.int64)
    rows, first = turned(at, ends, len(buckets))
    strong = (np.abs(odds) >= np.log(MIN_LIFT)) & (z >= MIN_Z)
    ridge = np.where(strong, RIDGE, np.array([WEAK_RIDGE[0]] + [WEAK_RIDGE[1]] * FACTORS)[:, None])
    weight = np.where(toxic > 0, 0.5 / positive, 0.5 / (n - positive)) * n * 0.5 + 0.5  # half of the balanced weights
    start = np.concatenate([np.where(strong, np.clip(odds, -3, 3) * 0.3, 0)[None], np.random.default_rng(seed).normal(0, 0.02, (len(buckets), FACTORS)).T])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        p = x[1:].reshape(1 + FACTORS, -1)
        v = p[1:]
        sums = gathered(ends, at, np.concatenate([(p[0] - 0.5 * (v * v).sum(0))[None], v]))
        total = x[0] + sums[0] + 0.5 * (sums[1:] ** 2).sum(0)
        slope = (1 / (1 + np.exp(-np.clip(total, -500, 500))) - toxic) * weight / n
        back = gathered(first, rows, np.concatenate([slope[None], slope * sums[1:]]))
        back[1:] -= v * back[:1]
        value = (weight * (np.logaddexp(0, total) - toxic * total)).mean() + 0.5 * (ridge * p * p).sum()
        back += ridge * p
        return value, np.concatenate([[slope.sum()], back.ravel()])

    x = minimum(loss, np.concatenate([[np.log(positive / (n - positive))], start.ravel()]))
    p = x[1:].reshape(1 + FACTORS, -1)
    return Machine(buckets, float(x[0]), p[0].copy(), p[1:].T.copy())


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most sample_rows labelled documents: those whose ids have the least digests, and of these rows the least.

    All terms in MIN_DOCS of these documents or more take part, so one that says nothing alone
    can in a pair. They are counted where the documents are; what reaches the driver are these
    terms, and which of them each document has, sample_rows documents at most.

    Labels of no document, null labels and null ids are left out; a document labelled twice
    is toxic if any label says so; rows that share an id share its label, and those equal in
    id and text count once. Without documents of both kinds the machine calls nothing toxic.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample_rows)
    )
    # Bounded by sample_rows, so safe to broadcast at any size; the texts aren't shuffled.
    row = F.concat(F.md5(F.col("doc_id").cast("string")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("string")))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", row.alias("row"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                rows, values = distinct(*term_buckets(part.column("text")), BUCKETS)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("toxic"), kernel.ragged(values.astype(np.int32), np.bincount(rows, minlength=part.num_rows), pa.int32())], names=["row", "toxic", "terms"])

    listed = kernel.cut(sample.mapInArrow(terms, "row string, toxic int, terms array<int>"))
    n, n_rows = listed.agg(F.count_distinct("row"), F.count("*")).first()
    if n < n_rows or n > sample_rows:  # ids that several rows have: of equal rows one, and of all as many as the bound
        last = listed.select("row").distinct().orderBy("row").limit(sample_rows).agg(F.max("row")).first()[0]
        listed = kernel.cut(listed.where(F.col("row") <= F.lit(last)).dropDuplicates(["row"]))
    n, positive = listed.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not positive or positive == n:
        return nothing()
    counted = listed.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.count("*").alias("have"), F.sum("toxic").alias("bad")).where(F.col("have") >= MIN_DOCS)
    odds, error = evidence(F.col("have"), F.col("bad"), F.lit(n), F.lit(positive), F.log, F.sqrt)
    best = counted.select("term", odds.alias("odds"), (F.abs(odds) / error).alias("z")).toArrow().sort_by("term")
    buckets = best.column("term").to_numpy().astype(np.int64)
    model = docs.sparkSession.sparkContext.broadcast(buckets)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            values, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            at = np.minimum(np.searchsorted(model.value, values), len(model.value) - 1)
            keep = model.value[at] == values
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("toxic"), kernel.ragged(at[keep].astype(np.int32), np.bincount(row[keep], minlength=batch.num_rows), pa.int32())], names=["row", "toxic", "terms"])

    odds, z = best.column("odds").to_numpy(), best.column("z").to_numpy()
    del best, counted
    if not len(buckets):
        return nothing()
    # The driver's JVM gives its garbage back before the terms come and before they are trained on, as both together are the driver's peak.
    kernel.release(docs.sparkSession)
    at, ends, toxic = in_order(listed.mapInArrow(narrow, "row string, toxic int, terms array<int>").toArrow())
    pa.default_memory_pool().release_unused()
    kernel.release(docs.sparkSession)
    return learn(at, ends, toxic, buckets, odds, z)


def in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of (row, toxic, terms), where those of each row end, and toxic, in the order of the rows' digests, whatever order tasks end in."""
    order = pc.sort_indices(table.column("row")).to_numpy()
    lists = table.column("terms").chunks
    size = np.concatenate([np.asarray(x.value_lengths()) for x in lists]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size[order])])
    to = np.empty(len(order), np.int64)
    to[order] = ends[:-1]
    at, row = np.empty(ends[-1], np.int32), 0
    for chunk in lists:
        values, lo = chunk.flatten().to_numpy(), 0
        for n in size[row : row + len(chunk)].tolist():
            at[to[row] : to[row] + n] = values[lo : lo + n]
            row, lo = row + 1, lo + n
    return at, ends, table.column("toxic").to_numpy().astype(float)[order]


def score(docs: DataFrame, machine: Machine, out: tuple[str, str] = ("toxicity", "toxic"), threshold: float = THRESHOLD) -> DataFrame:
    """docs, with the score and the verdict of each row. One pass, nothing shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    schema = StructType([*docs.schema.fields, StructField(out[0], DoubleType()), StructField(out[1], BooleanType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                p = model.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(p >= threshold)], names=[*part.schema.names, *out])

    return kernel.map_rows(docs, apply, schema)


def classify(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row of docs, by a machine trained on labels of the documents in training.

    Defined cases: null and empty texts have the score of no term at all, and are not toxic;
    rows with a null or a repeated id are scored each by itself; an empty table gives no rows;
    without labels of both kinds nothing is toxic; other columns are not looked at.
    """
    return score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), train(training, labels)).select("doc_id", "toxicity", "toxic")


def drop_toxic(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not toxic.

    Defined cases: null and empty texts stay; rows with a null or repeated id are each decided
    by their own text, and repeated rows go or stay together; columns may have any names;
    without labels of both kinds all rows stay; an empty table gives no rows.
    """
    a, b = kernel.fresh(docs, "toxicity", "toxic")
    return score(docs, train(training, labels), (a, b)).where(~F.col(b)).drop(a, b)
