"""Where documents may share passages: windows of words, gathered by their minimizers.

Two passages of WIDTH words are equal only if they hold the same minimizer, the GRAM-word run
with the least hash, at the same place. So consecutive windows with one minimizer travel as
one stretch of text, about twenty windows at once, and only stretches that meet another with
the same minimizer are looked at further. Every window of every text is in one stretch.

Stretches first travel without their text, as coordinates and a 128-bit cryptographic digest
of their bytes. Where all stretches of a minimizer have one digest, that settles them. Only
different stretches of one minimizer have their texts fetched, one of each kind however often
it occurs, to be compared in one task; a passage with a million copies costs that task no
more than one with two.

A minimizer with more than HOT_KINDS kinds, such as a line of boilerplate in very many
surroundings, goes to no one task: each window of its kinds gets a digest of its bytes where
the text is, and Spark's partial aggregation brings equal windows together.

A document is a (doc_id, text) pair: rows equal in both are one document. A null id comes
after all others. Documents that share an id are told apart by a 64-bit hash of the text,
those with a null id by two. Words lie between blanks, tabs and line ends, and passages are
equal if their words are, whatever lies between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, kernel

WIDTH, GRAM = 50, 11
POSITION_BITS = 31  # of a packed minimizer: the place of its first word in its piece; no text has so many words
HOT_KINDS = 20_000
FETCH_BYTES = 32 << 20
DOCUMENT = ["no_id", "id", "text_key"]
KIND = ["key", "body", "more"]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


@dataclass
class Stretches:
    """Stretches of the texts of one piece, as word numbers of it."""

    words: kernel.Words
    row: np.ndarray
    start: np.ndarray  # first word
    windows: np.ndarray  # so WIDTH - 1 more words
    key: np.ndarray  # hash of the minimizer
    at: np.ndarray  # its place in the stretch
    body: np.ndarray  # digest of all words, two numbers
    before: np.ndarray  # hash of the first window and the word before it, 0 where the text begins
    after: np.ndarray  # of the last and the word after it

    @staticmethod
    def of(texts: pa.Array) -> Stretches:
        words = kernel.Words(texts)
        n = len(words.starts)
        none = np.zeros(0, np.int64)
        if n < WIDTH:
            return Stretches(words, none, none, none, none.view(np.uint64), none, none.view(np.uint64).reshape(0, 2), none.view(np.uint64), none.view(np.uint64))
        rows = words.rows
        whole = kernel.Prefix(words.hashes, kernel.WORD_BASE)
        grams = kernel.mix(whole.slices(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1)))
        low = np.uint64((1 << POSITION_BITS) - 1)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), WIDTH - GRAM + 1)  # the leftmost of equal ones
        place = (least & low).astype(np.int64)
        good = rows[: n - WIDTH + 1] == rows[WIDTH - 1 :]
        new = good.copy()
        new[1:] &= ~good[:-1] | (place[1:] != place[:-1])
        start = np.flatnonzero(new)
        if not len(start):
            return Stretches(words, none, none, none, none.view(np.uint64), none, none.view(np.uint64).reshape(0, 2), none.view(np.uint64), none.view(np.uint64))
        windows = np.add.reduceat(good.astype(np.int64), start)
        end = start + windows + WIDTH - 1
        row = rows[start]
        text, begins, ends = words.joined()
        body = kernel.digests(text, begins[start], ends[end - 1])
        # Runs of WIDTH + 1 words that lead into the stretch and out of it.
        into, out = start > words.first[row], end < words.first[row + 1]
        before = np.where(into, kernel.mix(whole.slices(np.maximum(start - 1, 0), start + WIDTH)), np.uint64(0))
        after = np.where(out, kernel.mix(whole.slices(end - WIDTH, np.minimum(end + 1, n))), np.uint64(0))
        return Stretches(words, row, start, windows, grams[place[start]], place[start] - start, body, before, after)


STRETCH = "key long, body long, more long, no_id boolean, id long, text_key long, start int, windows int, before long, after long"


def identity(doc_id: Column, text: Column) -> list[Column]:
    """What tells documents apart, as DOCUMENT. A null id gives way to a second hash of the text."""
    own = doc_id.cast("long")
    return [own.isNull().alias("no_id"), F.coalesce(own, F.xxhash64(F.lit("no id"), text)).alias("id"), F.xxhash64(text).alias("text_key")]


def keyed(docs: DataFrame) -> DataFrame:
    """(no_id, id, text_key, text) of every row."""
    text = F.col("text").cast("string")
    return docs.select(*identity(F.col("doc_id"), text), text.alias("text"))


def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All stretches of all texts of keyed(), without their text."""
    for batch in batches:
        for part in kernel.pieces(batch, "text"):
            s = Stretches.of(part.column("text"))
            if not len(s.start):
                continue
            row = pa.array(s.row)
            begin = s.start - s.words.first[s.row]
            body = kernel.signed(s.body)
            columns = [
                pa.array(kernel.signed(s.key)), pa.array(body[:, 0]), pa.array(body[:, 1]), *(part.column(c).take(row) for c in DOCUMENT),
                pa.array(begin, pa.int32()), pa.array(s.windows, pa.int32()), pa.array(kernel.signed(s.before)), pa.array(kernel.signed(s.after)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in STRETCH.split(", ")])


def place(prefix: str = "") -> Column:
    """A stretch's coordinates; they order occurrences."""
    return F.struct(*(F.col(f"{prefix}{c}") for c in (*DOCUMENT, "start")))


@dataclass
class Repeats:
    """Stretches whose minimizer occurs at two or more places.

    occurrences: (key, body, more, no_id, id, text_key, start, windows), each place once.
    kinds: one row for each (key, body, more): the first of its places, how many there are,
    whether the minimizer has other kinds (many), and so many that they go to no one task (hot),
    and the least and largest hash before and after.
    """

    occurrences: DataFrame
    kinds: DataFrame


def repeats(docs: DataFrame, ways: bool = True) -> Repeats:
    """ways: whether the kinds have the words before and after; if so, Python tasks write the tables between."""
    around = ["before", "after"] if ways else []

    def keep(df: DataFrame) -> tuple[DataFrame, str | None]:
        return kernel.stored(df) if ways else (kernel.cut(df), None)

    every, path = kernel.stored(keyed(docs), cut_up, STRETCH) if ways else kernel.written(keyed(docs).mapInArrow(cut_up, STRETCH).drop("before", "after"))
    # Partial aggregation leaves one row a task of a passage however many copies it has.
    body = F.struct("body", "more")
    often = every.groupBy("key").agg(F.min(place()).alias("first"), F.max(place()).alias("last"), F.min(body).alias("b0"), F.max(body).alias("b1")).where("first <> last")
    often, often_path = keep(often.select(F.col("key").alias("often_key"), (F.col("b0") != F.col("b1")).alias("many")))
    kernel.release(docs.sparkSession)
    some = every.join(often, F.col("key") == F.col("often_key")).drop("often_key")
    if not keyed(docs).groupBy(*DOCUMENT).count().where("count > 1").isEmpty():  # rows equal in id and text are one
        # Spread over more than the key, so that the join may split a minimizer of very many.
        some = some.repartition("key", *DOCUMENT, "start").dropDuplicates(["key", *DOCUMENT, "start"])
    some, _ = keep(some)
    for done in filter(None, (path, often_path)):
        kernel.remove(docs.sparkSession, done)
    kinds = some.groupBy(*KIND).agg(
        F.min(place()).alias("first"), F.count("*").alias("copies"), F.first("windows").alias("windows"), F.first("many").alias("many"),
        *(f(c).alias(f"{c}_{n}") for c in around for n, f in (("least", F.min), ("most", F.max))),
    )
    kinds, _ = keep(kinds.select(*KIND, "first.*", "copies", "windows", "many", *(f"{c}_{n}" for c in around for n in ("least", "most"))))
    hot = kernel.small(kinds.where("many").groupBy("key").count().where(F.col("count") > HOT_KINDS).select(F.col("key").alias("hot_key")))
    kinds = kinds.join(hot, F.col("key") == F.col("hot_key"), "left").withColumn("hot", F.col("hot_key").isNotNull()).drop("hot_key")
    found = Repeats(some.select(*KIND, *DOCUMENT, "start", "windows"), kinds)
    del every, often, some
    kernel.release(docs.sparkSession)
    return found


def fetched(kinds: DataFrame, docs: DataFrame, extra: list[str], emit: Callable, schema: str) -> DataFrame:
    """What emit gives for the kinds of each piece of texts, from (its stretches, the number of each kind's stretch, the columns of the kinds).

    Coordinates of a document meet its text once, and the text moves once.
    """
    fields = [*KIND, "start", "windows", *extra]
    wanted = kinds.groupBy(*DOCUMENT).agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    wanted = wanted.withColumnsRenamed({c: f"w_{c}" for c in DOCUMENT})
    # Rows equal in id and text would each give the stretch; the later step takes one.
    same = F.col("no_id") == F.col("w_no_id")
    for c in DOCUMENT[1:]:
        same &= F.col(c) == F.col(f"w_{c}")
    joined = keyed(docs).join(wanted, same).select(*DOCUMENT, "text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                lists = part.column("wanted")
                flat = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                s = Stretches.of(part.column("text"))
                # A wanted stretch by its row and start.
                span = np.int64(len(s.words.starts) + 1)
                mine = s.row * span + (s.start - s.words.first[s.row])
                want = row * span + flat.field("start").to_numpy().astype(np.int64)
                i = np.searchsorted(mine, want)
                if len(want) and (i.max() >= len(mine) or (mine[i] != want).any()):
                    raise RuntimeError("a stretch isn't where its coordinates say")
                take = pa.array(row)
                yield from emit(s, i, {**{c: part.column(c).take(take) for c in DOCUMENT}, **{c: flat.field(c) for c in fields}})

    return joined.mapInArrow(fetch, schema)


def typed(kinds: DataFrame, columns: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in kinds.schema}
    return ", ".join(f"{c} {types[c]}" for c in columns)


def with_text(kinds: DataFrame, docs: DataFrame, extra: list[str]) -> DataFrame:
    """(*KIND, *DOCUMENT, start, windows, *extra, at, words) of the kinds: the text of each, and its minimizer's place in it."""
    columns = [*DOCUMENT, *KIND, "start", "windows", *extra]

    def emit(s: Stretches, i: np.ndarray, table: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        begin, end = s.words.starts[s.start[i]], s.words.ends[s.start[i] + s.windows[i] + WIDTH - 2]
        size = end - begin
        upto = np.cumsum(size)
        lo = 0
        while lo < len(size):  # many stretches overlap in one long text, so it may come out several times over
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + FETCH_BYTES, "right")))
            offsets = np.concatenate([[0], np.cumsum(size[lo:hi])])
            text = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(pa.array(offsets, pa.int32()).to_numpy()), pa.py_buffer(kernel.gather(s.words.data, begin[lo:hi], size[lo:hi]))])
            yield pa.RecordBatch.from_arrays([*(table[c].slice(lo, hi - lo) for c in columns), pa.array(s.at[i[lo:hi]], pa.int32()), text], names=[*columns, "at", "words"])
            lo = hi

    return fetched(kinds, docs, extra, emit, typed(kinds, columns) + ", at int, words binary")


def single_windows(kinds: DataFrame, docs: DataFrame, extra: list[str]) -> DataFrame:
    """(*KIND, *DOCUMENT, start, windows, *extra, j, w0, w1, edge_in, edge_out) of every window of the kinds: its number j in the stretch, the digest (w0, w1) of its bytes, and the hashes of the edges that lead into and out of it within the stretch (0: the stretch begins or ends)."""
    columns = [*DOCUMENT, *KIND, "start", "windows", *extra]

    def emit(s: Stretches, i: np.ndarray, table: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        text, begins, ends = s.words.joined()
        whole = kernel.Prefix(s.words.hashes, kernel.WORD_BASE)
        for lo in range(0, len(i), 4096):
            some = i[lo : lo + 4096]
            m = s.windows[some]
            of = np.repeat(np.arange(len(some)), m)
            j = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
            word = s.start[some][of] + j
            digest = kernel.signed(kernel.digests(text, begins[word], ends[word + WIDTH - 1]))
            into, out = j > 0, j < m[of] - 1
            edge_in = np.where(into, kernel.mix(whole.slices(np.maximum(word - 1, 0), word + WIDTH)), np.uint64(0))
            edge_out = np.where(out, kernel.mix(whole.slices(word, np.minimum(word + WIDTH + 1, len(s.words.starts)))), np.uint64(0))
            take = pa.array(lo + of)
            yield pa.RecordBatch.from_arrays(
                [*(table[c].take(take) for c in columns), pa.array(j, pa.int32()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(kernel.signed(edge_in)), pa.array(kernel.signed(edge_out))],
                names=[*columns, "j", "w0", "w1", "edge_in", "edge_out"],
            )

    return fetched(kinds, docs, extra, emit, typed(kinds, columns) + ", j int, w0 long, w1 long, edge_in long, edge_out long")


def by_minimizer(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies work to tables that hold whole minimizers, many small ones at once."""

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield work(table)

    return blocks.each(rows, ["key"], one, schema, tuple(KIND[1:]))


@dataclass
class Bucket:
    """Kinds of stretches with their words, and all of their windows."""

    table: dict[str, np.ndarray]
    words: kernel.Words
    prefix: kernel.Prefix
    stretch: np.ndarray  # of each window
    word: np.ndarray  # its first
    group: np.ndarray  # windows can be equal only within a group: one minimizer, at one place

    @staticmethod
    def of(rows: pa.Table) -> Bucket:
        rows = rows.combine_chunks()
        table = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "words"}
        new = np.ones(rows.num_rows, bool)  # the same kind from rows equal in id and text
        new[1:] = np.any([table[c][1:] != table[c][:-1] for c in KIND], axis=0)
        if not new.all():
            rows, table = rows.filter(pa.array(new)), {c: v[new] for c, v in table.items()}
        words = kernel.Words(rows.column("words"))
        m = table["windows"].astype(np.int64)
        stretch = np.repeat(np.arange(len(m)), m)
        step = np.arange(len(stretch)) - np.repeat(np.cumsum(m) - m, m)
        key = np.cumsum(np.concatenate([[0], table["key"][1:] != table["key"][:-1]])) if len(m) else m
        group = key[stretch] * (2 * WIDTH) + (table["at"].astype(np.int64)[stretch] - step)
        return Bucket(table, words, kernel.Prefix(words.hashes, kernel.WORD_BASE), stretch, words.first[stretch] + step, group)

    def same(self, a: np.ndarray, b: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether `count` words from word a on are byte for byte those from b on."""
        w = self.words
        of = np.repeat(np.arange(len(a)), count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        x, y = np.repeat(a, count) + step, np.repeat(b, count) + step
        ok = np.ones(len(a), bool)
        ok[of[~kernel.equal(w.data, w.starts[x], w.ends[x], w.data, w.starts[y], w.ends[y])]] = False
        return ok

    def runs(self, *labels: np.ndarray) -> np.ndarray:
        """Where a run begins of consecutive windows of one stretch in which each label stays."""
        new = np.ones(len(self.stretch), bool)
        new[1:] = self.stretch[1:] != self.stretch[:-1]
        for x in labels:
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)


def islands(spans: DataFrame, *columns: Column) -> DataFrame:
    """(*DOCUMENT, start_word, end_word, ...) of maximal spans from overlapping or touching (*DOCUMENT, w0, w1), with aggregates of each."""
    line = Window.partitionBy(*DOCUMENT).orderBy("w0", "w1")
    marked = spans.withColumn("seen", F.max("w1").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("island", F.sum((F.col("seen").isNull() | (F.col("w0") > F.col("seen"))).cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*DOCUMENT, "island").agg(F.min("w0").alias("start_word"), F.max("w1").alias("end_word"), *columns).drop("island")
