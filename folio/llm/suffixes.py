"""Duplicate passages by a suffix sort that compares by hash.

Two suffixes are compared through their longest common extension, found by binary search over
prefix polynomial hashes: a logarithmic number of slice comparisons, however long they agree.
A merge sort with this comparison brings equal passages side by side; they are then compared
byte for byte, so that a hash collision can't join them. Stretches that are equal as a whole are
known by a cryptographic digest of their bytes and enter the sort once.

Suffixes that can begin with the same WIDTH words meet in one task by the minimizer of those
words (windows.py), so the sort is of many small groups, which take each of its steps
together. Of each repeated passage the first occurrence stays, in the order of document and
place; the others are duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, windows
from .windows import DOCUMENT, KIND, WIDTH


def common(prefix: kernel.Prefix, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """How many words from a on and from b on agree, up to limit, by binary search over hashes."""
    out = np.full(len(a), limit)
    part = np.flatnonzero(prefix.slices(a, a + limit) != prefix.slices(b, b + limit))
    x, y = a[part], b[part]
    lo, hi = np.zeros(len(part), np.int64), np.full(len(part), limit - 1)  # agree for lo, not for more than hi
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = prefix.slices(x, x + mid) == prefix.slices(y, y + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    out[part] = lo
    return out


def less(prefix: kernel.Prefix, values: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the suffix at a comes before that at b, and whether they agree up to limit. Words go in the order of their hashes."""
    n = common(prefix, a, b, limit)
    equal = n == limit
    top = len(values) - 1
    return ~equal & (values[np.minimum(a + n, top)] < values[np.minimum(b + n, top)]), equal


def merge_sort(prefix: kernel.Prefix, values: np.ndarray, at: np.ndarray, group: np.ndarray, limit: int = WIDTH) -> np.ndarray:
    """A stable order of suffixes by group, then by their first `limit` words. All runs of one length are merged together."""
    order = np.argsort(group, kind="stable")
    if not len(order):
        return order
    sorted_group = group[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    size = np.diff(np.append(begin, len(order)))
    of = np.repeat(np.arange(len(begin)), size)
    rank = np.arange(len(order)) - begin[of]  # place within the group
    run = 1
    while run < size.max():
        live = np.flatnonzero(size[of] > run)  # a group that is one run is done
        r, base, whole = rank[live], begin[of[live]], size[of[live]]
        pair = r // (2 * run) * (2 * run)
        left = r - pair < run
        # Each element looks for its place in the other run of its pair.
        lo = np.where(left, np.minimum(pair + run, whole), pair)
        hi = np.where(left, np.minimum(pair + 2 * run, whole), np.minimum(pair + run, whole))
        other = lo.copy()
        me = at[order[live]]
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            mid = (lo[go] + hi[go]) // 2
            it = at[order[base[go] + mid]]
            before, equal = less(prefix, values, it, me[go], limit)
            before |= equal & ~left[go]  # of equal ones the left run's come first
            lo[go[before]] = mid[before] + 1
            hi[go[~before]] = mid[~before]
        moved = np.where(left, r + (lo - other), pair + (r - pair - run) + (lo - other))
        after = order.copy()
        after[base + moved] = order[live]
        order = after
        run *= 2
    return order


def classes(bucket: windows.Bucket) -> np.ndarray:
    """A number for each window, equal for equal windows of a group: first by the sort, then verified."""
    order = merge_sort(bucket.prefix, bucket.words.hashes, bucket.word, bucket.group)
    label = np.empty(len(order), np.int64)
    if not len(order):
        return label
    group, at = bucket.group[order], bucket.word[order]
    new = np.ones(len(order), bool)
    near = np.flatnonzero(group[1:] == group[:-1]) + 1
    new[near] = bucket.prefix.slices(at[near], at[near] + WIDTH) != bucket.prefix.slices(at[near - 1], at[near - 1] + WIDTH)
    label[order] = np.cumsum(new) - 1
    return label


def verified(bucket: windows.Bucket, label: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The labels, after each window has been compared by bytes with its class's owner (the number of a window). What differs gets classes by its bytes."""
    if not len(label):
        return label
    shift = bucket.word - bucket.word[owner]
    begin = bucket.runs(shift)  # windows in a row that agree with windows in a row are compared as one
    count = np.diff(np.append(begin, len(label))) + WIDTH - 1
    good = bucket.same(bucket.word[begin], bucket.word[owner[begin]], count)
    if not good.all():
        label = label.copy()
        known: dict[tuple, int] = {}
        top = int(label.max()) + 1
        w = bucket.words
        # A collision may also have misled the sort, so all windows of its groups go by their bytes.
        for i in np.flatnonzero(np.isin(bucket.group, bucket.group[np.repeat(~good, count - WIDTH + 1)])):
            span = range(bucket.word[i], bucket.word[i] + WIDTH)
            content = (int(bucket.group[i]), *(w.data[w.starts[k] : w.ends[k]].tobytes() for k in span))
            label[i] = known.setdefault(content, top + len(known))
    return label


def owners(bucket: windows.Bucket, label: np.ndarray) -> np.ndarray:
    """The first window of each window's class, in the order of document and place."""
    if not len(label):
        return label
    t = bucket.table
    start = t["start"].astype(np.int64)[bucket.stretch] + bucket.word - bucket.words.first[bucket.stretch]
    order = np.lexsort((start, *(t[c][bucket.stretch] for c in reversed(DOCUMENT)), label))
    head = np.ones(len(order), bool)
    head[1:] = label[order[1:]] != label[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = order[head][np.cumsum(head) - 1]
    return out


RANGES = "key long, body long, more long, j0 int, j1 int, o_no_id boolean, o_id long, o_text_key long, o_start int"


def settle(rows: pa.Table) -> pa.RecordBatch:
    """For each kind of stretch, ranges of its windows [j0, j1) and where the first occurrence of the range is."""
    bucket = windows.Bucket.of(rows)
    label = classes(bucket)
    label = verified(bucket, label, owners(bucket, label))
    owner = owners(bucket, label)
    t = bucket.table
    begin = bucket.runs(bucket.word - bucket.word[owner])
    end = np.append(begin[1:], len(label))
    q, o = bucket.stretch[begin], bucket.stretch[owner[begin]]
    j0 = bucket.word[begin] - bucket.words.first[q]
    there = t["start"].astype(np.int64)[o] + bucket.word[owner[begin]] - bucket.words.first[o]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(t[c][q]) for c in KIND), pa.array(j0, pa.int32()), pa.array(j0 + end - begin, pa.int32()), *(pa.array(t[c][o]) for c in DOCUMENT), pa.array(there, pa.int32())],
        names=[x.split()[0] for x in RANGES.split(", ")],
    )


def settle_apart(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """What settle() gives, for kinds too many for one task: equal windows meet by digest, in Spark's partial aggregation."""
    each = kernel.cut(windows.single_windows(kinds, docs, []).select(*KIND, *DOCUMENT, "j", (F.col("start") + F.col("j")).alias("start"), "w0", "w1").dropDuplicates([*KIND, "j"]))
    owner = kernel.cut(each.groupBy(F.col("w0").alias("v0"), F.col("w1").alias("v1")).agg(F.min(windows.place()).alias("o")))
    placed = each.join(owner, (F.col("w0") == F.col("v0")) & (F.col("w1") == F.col("v1"))).select(*KIND, "j", *(F.col(f"o.{c}").alias(f"o_{c}") for c in (*DOCUMENT, "start")))
    # Windows in a row whose owners are in a row are one range.
    shift = [*KIND, "o_no_id", "o_id", "o_text_key", "shift"]
    line = placed.withColumn("shift", F.col("o_start") - F.col("j")).withColumn("run", F.col("j") - F.row_number().over(Window.partitionBy(*shift).orderBy("j")))
    return line.groupBy(*shift, "run").agg(F.min("j").alias("j0"), (F.max("j") + 1).alias("j1"), F.min("o_start").alias("o_start")).select(*(x.split()[0] for x in RANGES.split(", ")))


def duplicates(docs: DataFrame) -> DataFrame:
    """(*DOCUMENT, start_word, end_word, first_ids) of each maximal span of words whose every WIDTH-word window has an earlier occurrence.

    first_ids are the documents of those first occurrences.
    """
    found = windows.repeats(docs, ways=False)
    compared = windows.by_minimizer(windows.with_text(found.kinds.where("many and not hot"), docs, []), settle, RANGES)
    if not (hot := found.kinds.where("hot")).isEmpty():
        compared = compared.unionByName(settle_apart(hot, docs))
    alike = found.kinds.where("not many").select(*KIND, F.lit(0).alias("j0"), F.col("windows").alias("j1"), *(F.col(c).alias(f"o_{c}") for c in (*DOCUMENT, "start")))
    ranges = compared.unionByName(alike)
    own = F.col("start") + F.col("j0") == F.col("o_start")
    for c in DOCUMENT:
        own &= F.col(c) == F.col(f"o_{c}")
    hits = found.occurrences.join(ranges, KIND).where(~own)
    spans = hits.select(*DOCUMENT, (F.col("start") + F.col("j0")).alias("w0"), (F.col("start") + F.col("j1") + (WIDTH - 1)).alias("w1"), F.when(~F.col("o_no_id"), F.col("o_id")).alias("o_id"))
    return windows.islands(spans, F.array_sort(F.collect_set("o_id")).alias("first_ids"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, first_ids) of every duplicate passage, of WIDTH words at least.

    Words are numbered from 0 within a document and end_word is the one after the last.

    Defined cases: texts that are null, empty or shorter than WIDTH words have none; a passage
    repeated within one document is a duplicate from its second occurrence on; a null id
    comes after all others and isn't listed in first_ids; rows equal in id and text are one
    document; rows that share an id with other texts are documents of their own; texts are
    taken whole; an empty table gives no rows; other columns are not looked at.
    """
    return duplicates(docs).select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "start_word", "end_word", "first_ids")


def drop_repeated(docs: DataFrame) -> DataFrame:
    """docs with duplicate passages cut out of their texts; all other rows and columns stay as they are.

    What was around a cut passage is joined as it stands: a passage takes the white space
    after it along. Where docs has an integer column n_chars, it is counted anew for texts
    that change.

    Defined cases: a document with nothing left stays, with what is left of its text; null,
    empty and short texts stay as they are, and null ones null; of repeated rows each is cut
    alike; rows with a null or shared id are each cut by their own text; any other column may
    have any name; an empty table gives no rows.
    """
    spans = kernel.cut(duplicates(docs).groupBy(*DOCUMENT).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")))
    n, i, k, s = kernel.fresh(docs, "suffix_no_id", "suffix_id", "suffix_key", "suffix_spans")
    spans = spans.select(F.col("no_id").alias(n), F.col("id").alias(i), F.col("text_key").alias(k), F.col("spans").alias(s))
    none, own, key = windows.identity(docs["doc_id"], docs["text"].cast("string"))
    joined = docs.join(spans, (own == F.col(i)) & (key == F.col(k)) & (none == F.col(n)), "left").drop(n, i, k)
    schema = docs.schema
    counts = next((f.name for f in schema.fields if f.name.lower() == "n_chars" and f.dataType.typeName() in ("long", "integer")), None)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                texts, spans = part.column("text"), part.column(s)
                changed = np.flatnonzero(~np.asarray(spans.is_null()))
                out = {c: part.column(c) for c in part.schema.names if c != s}
                if len(changed):
                    words = kernel.Words(texts)
                    new, sizes = texts.to_pylist(), out[counts].to_pylist() if counts else []
                    for r in changed:
                        first, count, end = words.first[r], words.counts[r], words.offsets[r + 1]
                        left, at = [], words.offsets[r]
                        for a, b in sorted((x["start_word"], x["end_word"]) for x in spans[int(r)].as_py()):
                            left.append(words.data[at : words.starts[first + a]].tobytes())
                            at = words.starts[first + b] if b < count else end
                        left.append(words.data[at:end].tobytes())
                        new[r] = b"".join(left).decode()
                        if counts:
                            sizes[r] = len(new[r])
                    out["text"] = pa.array(new, texts.type)
                    if counts:
                        out[counts] = pa.array(sizes, out[counts].type)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return kernel.map_rows(joined, rewrite, schema)
