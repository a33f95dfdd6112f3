"""Repeated spans by de Bruijn graph compaction.

Nodes are runs of WIDTH words and edges runs of WIDTH + 1, which lead from one node to the
next. Of the nodes that occur at two or more places, a chain in which each node has one way
out and the next one way in is a nonbranching path: all of its nodes occur together wherever
one does. A path ends at a branch, and where a text begins or ends.

Occurrences of one node meet in one task by their minimizer (windows.py), so ways in and out
are counted there, and chains of nodes with one minimizer compact there into segments. What
remains are the ends of segments: Spark joins link a segment's way out with the way in that is
the same edge, and further joins follow these links by doubling, so a path of n segments takes
log n rounds. Each occurrence of a path is then verified by its source coordinates: the
segments found in a document must lie at their distances along the path, all of them. As nodes
are told apart by their bytes, or by a cryptographic digest of them, the path's text is then
that of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, kernel, suffixes, windows
from .windows import DOCUMENT, KIND, WIDTH

KINDS = 1024  # compacted at once, if no minimizer has more: some 30 windows each, with some 20 numbers of 8 bytes
WAYS = ["before_least", "before_most", "after_least", "after_most"]
SEGMENTS = "key long, body long, more long, j0 int, j1 int, segment long, way_in long, way_out long, copies long"


def compact(rows: pa.Table) -> pa.RecordBatch:
    """The segments of each kind of stretch: nodes [j0, j1), and the edge that is the only way in or out (0: none, or several)."""
    bucket = windows.Bucket.of(rows)
    t, words = bucket.table, bucket.words
    n = len(bucket.word)
    node = bucket.prefix.slices(bucket.word, bucket.word + WIDTH)
    # Equal nodes by hash within a group, then by their bytes.
    order = np.lexsort((node, bucket.group))
    new = np.ones(n, bool)
    new[1:] = (node[order[1:]] != node[order[:-1]]) | (bucket.group[order[1:]] != bucket.group[order[:-1]])
    label = np.empty(n, np.int64)
    label[order] = np.cumsum(new) - 1
    label = suffixes.verified(bucket, label, suffixes.owners(bucket, label))
    top = int(label.max(initial=-1)) + 1
    copies = np.zeros(top, np.int64)
    np.add.at(copies, label, t["copies"][bucket.stretch])
    # The least and largest edges into and out of each node; those within a stretch are known here, the others came along.
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = bucket.stretch[1:] != bucket.stretch[:-1]
    last[:-1] = first[1:]
    edge = np.zeros(n, np.int64)
    inner = np.flatnonzero(~last)
    edge[inner] = kernel.signed(kernel.mix(bucket.prefix.slices(bucket.word[inner], bucket.word[inner] + WIDTH + 1)))
    least = {"in": np.concatenate([[0], edge[:-1]])[:n], "out": edge}
    most = {k: v.copy() for k, v in least.items()}
    for way, at, name in (("in", first, "before"), ("out", last, "after")):
        least[way] = np.where(at, t[f"{name}_least"][bucket.stretch], least[way])
        most[way] = np.where(at, t[f"{name}_most"][bucket.stretch], most[way])
    only: dict[str, np.ndarray] = {}
    for way in least:
        lo, hi = np.full(top, np.iinfo(np.int64).max), np.full(top, np.iinfo(np.int64).min)
        np.minimum.at(lo, label, least[way])
        np.maximum.at(hi, label, most[way])
        only[way] = np.where(lo == hi, lo, 0)[label]
    repeated = copies[label] > 1
    # A segment goes on while the one way out of a node is the one way into the next.
    begin = repeated.copy()
    begin[1:] &= ~(repeated[:-1] & ~first[1:] & (only["out"][:-1] != 0) & (only["in"][1:] != 0))
    starts = np.flatnonzero(begin)
    stops = repeated.copy()
    stops[:-1] &= begin[1:] | ~repeated[1:] | first[1:]
    ends = np.flatnonzero(stops)
    q = bucket.stretch[starts]
    j0 = bucket.word[starts] - words.first[q]
    text, from_, to = words.joined()
    name = kernel.digests(text, from_[bucket.word[starts]], to[bucket.word[starts] + WIDTH - 1])[:, 0]
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array(t[c][q]) for c in KIND), pa.array(j0, pa.int32()), pa.array(j0 + ends - starts + 1, pa.int32()), pa.array(kernel.signed(np.ascontiguousarray(name))),
            pa.array(only["in"][starts]), pa.array(only["out"][ends]), pa.array(copies[label[starts]]),
        ],
        names=[x.split()[0] for x in SEGMENTS.split(", ")],
    )


def compact_each(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """compact() of whole minimizers, some at a time."""
    for some in blocks.portions(table, ["key"], KINDS):
        yield compact(some)


def compact_apart(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """What compact() gives, for kinds too many for one task, with a segment for each node: equal nodes meet by digest, in Spark's partial aggregation."""
    each = windows.single_windows(kinds, docs, ["copies", *WAYS]).dropDuplicates([*KIND, "j"])
    first, last = F.col("j") == 0, F.col("j") == F.col("windows") - 1
    ways = {f"{way}_{n}": F.when(at, F.col(f"{name}_{n}")).otherwise(F.col(f"edge_{way}")) for way, at, name in (("in", first, "before"), ("out", last, "after")) for n in ("least", "most")}
    each = kernel.cut(each.select(*KIND, "j", "w0", "w1", "copies", *(c.alias(n) for n, c in ways.items())))
    node = kernel.cut(each.groupBy(F.col("w0").alias("v0"), F.col("w1").alias("v1")).agg(F.sum("copies").alias("copies"), *((F.min if n.endswith("least") else F.max)(n).alias(n) for n in ways)).where("copies > 1"))
    placed = each.select(*KIND, "j", "w0", "w1").join(node, (F.col("w0") == F.col("v0")) & (F.col("w1") == F.col("v1")))
    return placed.select(*KIND, F.col("j").alias("j0"), (F.col("j") + 1).alias("j1"), F.col("w0").alias("segment"), only("in").alias("way_in"), only("out").alias("way_out"), "copies")


def only(name: str) -> Column:
    return F.when(F.col(f"{name}_least") == F.col(f"{name}_most"), F.col(f"{name}_least")).otherwise(F.lit(0))


def paths(segments: DataFrame) -> DataFrame:
    """(segment, path, distance, length): the path of each segment, named by its first one; how far in it begins; and all nodes of the path.

    segments: (segment, nodes, way_in, way_out), each once.
    """
    a = segments.where("way_out <> 0").select(F.col("segment").alias("before"), F.col("nodes").alias("distance"), F.col("way_out").alias("edge"))
    b = segments.where("way_in <> 0").select("segment", F.col("way_in").alias("edge"))
    back = b.join(a, "edge").select("segment", "before", "distance")
    # A segment points back to another of its path, over a distance; each round doubles what has been passed.
    now, at = kernel.stored(segments.select("segment").join(back, "segment", "left").select("segment", F.coalesce("before", "segment").alias("path"), F.coalesce("distance", F.lit(0).cast("long")).alias("distance")))
    while True:
        on = now.where("path <> segment").select(F.col("segment").alias("path"), F.col("path").alias("further"), F.col("distance").alias("more"))
        after, path = kernel.stored(now.join(on, "path", "left").select("segment", F.coalesce("further", "path").alias("path"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), F.col("further").isNotNull().alias("moved")))
        kernel.remove(segments.sparkSession, at)
        now, at = after.drop("moved"), path
        if after.where("moved").isEmpty():
            break
    sized = now.join(segments.select("segment", "nodes"), "segment")
    length = sized.groupBy("path").agg(F.sum("nodes").alias("length"))
    return sized.join(length, "path").select("segment", "path", "distance", "length")


def path_occurrences(docs: DataFrame) -> DataFrame:
    """(*DOCUMENT, path, w0, w1, copies): where each nonbranching path occurs, as words [w0, w1)."""
    found = windows.repeats(docs)
    compared, _ = blocks.each(windows.with_text(found.kinds.where("many and not hot"), docs, ["copies", *WAYS]), ["key"], compact_each, SEGMENTS, tuple(KIND[1:]), apply=kernel.stored)
    if not (hot := found.kinds.where("hot")).isEmpty():
        compared = compared.unionByName(kernel.stored(compact_apart(hot, docs))[0])
    alike = found.kinds.where("not many").select(*KIND, F.lit(0).alias("j0"), F.col("windows").alias("j1"), F.xxhash64(*KIND).alias("segment"), only("before").alias("way_in"), only("after").alias("way_out"), "copies")
    placed = compared.unionByName(alike)
    kernel.release(docs.sparkSession)
    segments = placed.groupBy("segment").agg(F.first(F.col("j1") - F.col("j0")).cast("long").alias("nodes"), F.first("way_in").alias("way_in"), F.first("way_out").alias("way_out"))
    known = paths(kernel.stored(segments)[0])
    located = placed.join(known, "segment").select(*KIND, "j0", "j1", "path", "distance", "length", "copies")
    spans = found.occurrences.join(located, KIND).withColumn("w0", F.col("start") + F.col("j0")).withColumn("w1", F.col("start") + F.col("j1") + (WIDTH - 1))
    whole = spans.groupBy(*DOCUMENT, "path", (F.col("w0") - F.col("distance")).alias("origin"), "length").agg(F.sum(F.col("j1") - F.col("j0")).alias("seen"), F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.max("copies").alias("copies"))
    return whole.where((F.col("seen") == F.col("length")) & (F.col("w1") - F.col("w0") == F.col("length") + (WIDTH - 1))).select(*DOCUMENT, "path", "w0", "w1", "copies")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, paths, copies) of each maximal span of words whose every WIDTH-word run occurs at another place too.

    paths are the nonbranching paths that the span goes along and copies the places of the
    most frequent of them. Words are numbered from 0 and end_word is the one after the last.

    Defined cases: texts that are null, empty or shorter than WIDTH words have none; a span
    may repeat within one document; the first occurrence is in the result like the others;
    rows equal in id and text are one document; rows that share an id with other texts are
    documents of their own; texts are taken whole; an empty table gives no rows; other columns
    are not looked at.
    """
    spans = windows.islands(path_occurrences(docs), F.array_sort(F.collect_set("path")).alias("paths"), F.max("copies").alias("copies"))
    return spans.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "start_word", "end_word", "paths", "copies")
