import re
import tracemalloc
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import debruijn, kernel, suffixes, windows

W = windows.WIDTH
LAST = 10**18  # stands for a null id, which comes after all others


def split(text):
    return [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]


def spans(places):
    out = []
    for p in sorted(places):
        if out and p <= out[-1][1]:
            out[-1][1] = p + W
        else:
            out.append([p, p + W])
    return {tuple(x) for x in out}


def brute(rows):
    docs = sorted({(d if d is not None else LAST, t) for d, t in rows if t}, key=lambda x: (x[0], x[1]))
    at = defaultdict(list)
    for n, (d, t) in enumerate(docs):
        w = split(t)
        for p in range(len(w) - W + 1):
            at[tuple(w[p : p + W])].append((n, p))
    later, every = defaultdict(set), defaultdict(set)
    for places in at.values():
        for i, (n, p) in enumerate(places):
            if i:
                later[n].add(p)
            if len(places) > 1:
                every[n].add(p)

    def flat(found):
        return sorted((docs[n][0], a, b) for n, p in found.items() for a, b in spans(p))

    return flat(later), flat(every)


def first_ids(rows):
    """{(doc_id, start): documents of the first occurrences} of each duplicate passage of documents whose ids are their own."""
    docs = sorted({(d, t) for d, t in rows if t})
    first, own = {}, defaultdict(dict)
    for d, t in docs:
        w = split(t)
        for p in range(len(w) - W + 1):
            o = first.setdefault(tuple(w[p : p + W]), (d, p))
            if o != (d, p):
                own[d][p] = o[0]
    return {(d, a): sorted({found[p] for p in range(a, b - W + 1) if p in found}) for d, found in own.items() for a, b in spans(found)}


def graph_spans(rows):
    """{(doc_id, start): (number of paths, most copies)} by a graph of word tuples, compacted in plain Python."""
    docs = sorted({(d, t) for d, t in rows if t})
    words = [split(t) for _, t in docs]
    at, ins, outs = defaultdict(list), defaultdict(set), defaultdict(set)
    for n, w in enumerate(words):
        for p in range(len(w) - W + 1):
            node = tuple(w[p : p + W])
            at[node].append((n, p))
            ins[node].add(w[p - 1] if p else None)
            outs[node].add(w[p + W] if p + W < len(w) else None)
    one = {k: {x: next(iter(ways[x])) if len(ways[x]) == 1 else None for x in at} for k, ways in (("in", ins), ("out", outs))}
    out = {}
    for n, w in enumerate(words):
        found = {p for p in range(len(w) - W + 1) if len(at[tuple(w[p : p + W])]) > 1}
        for a, b in spans(found):
            names, copies = set(), 0
            for p in sorted(found & {*range(a, b - W + 1)}):
                node = tuple(w[p : p + W])
                copies = max(copies, len(at[node]))
                back = tuple(w[p - 1 : p + W - 1]) if p - 1 in found else None
                if back is None or one["out"][back] is None or one["in"][node] is None:
                    names.add(node)
            out[docs[n][0], a] = (len(names), copies)
    return out


@pytest.fixture(scope="module")
def corpus(words):
    passage, other = words(100, 60), words(101, 55)
    rows = [(i, words(i, 120)) for i in range(8)]
    rows += [(10, words(10, 30) + " " + passage + "\n" + words(11, 30)), (11, passage + " " + words(12, 40)), (12, words(13, 10) + "\t" + passage.replace(" ", "\n")), (13, passage + " " + other), (14, other + " " + passage), (15, words(100, 49))]
    rows += [(20, words(14, 500)), (21, words(14, 500)), (22, " ".join(w if i != 250 else "changed" for i, w in enumerate(words(14, 500).split())))]
    rows += [(30, "la la " * 60), (31, " ".join(["one two three four five six seven"] * 20)), (32, words(15, 70) + " " + words(15, 70))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_suffixes_against_brute_force(spark, corpus):
    got = suffixes.repeated_passages(frame(spark, corpus)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == brute(corpus)[0]
    assert {(r.doc_id, r.start_word): r.first_ids for r in got} == first_ids(corpus)
    first = {r.doc_id: r.first_ids for r in got}
    assert first[11] == [10] and first[21] == [20] and 15 not in first and 0 not in first


def test_debruijn_against_brute_force(spark, corpus):
    got = debruijn.repeated_spans(frame(spark, corpus)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == brute(corpus)[1]
    by = {r.doc_id: r for r in got}
    assert by[20].paths == by[21].paths and by[20].copies >= 3
    loops = (30, 31)  # a path that a text goes along twice is one of its paths
    want = graph_spans(corpus)
    assert {(r.doc_id, r.start_word): (len(r.paths), r.copies) for r in got if r.doc_id not in loops} == {k: v for k, v in want.items() if k[0] not in loops}


def test_paths_are_maximal(spark, words):
    """Two texts with one long stretch in common: it is one path, of many segments, found by doubling."""
    shared = words(1, 900)
    df = frame(spark, [(1, words(2, 20) + " " + shared + " " + words(3, 20)), (2, words(4, 20) + " " + shared + " " + words(5, 20))])
    got = debruijn.path_occurrences(df).collect()
    assert len({r.path for r in got}) <= 3 and max(r.w1 - r.w0 for r in got) >= 898
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in debruijn.repeated_spans(df).collect()) == [(1, 20, 920), (2, 20, 920)]


@pytest.mark.parametrize("seed", range(3))
def test_merge_sort(seed):
    r = np.random.default_rng(seed)
    values = r.integers(0, 3, 400).astype(np.uint64)
    at, group = r.integers(0, 300, 200), r.integers(0, 7, 200)
    order = suffixes.merge_sort(kernel.Prefix(values, kernel.WORD_BASE), values, at, group, 50)
    want = sorted(range(200), key=lambda i: (group[i], values[at[i] : at[i] + 50].tolist(), i))
    assert order.tolist() == want


def test_collisions_are_seen(words, monkeypatch):
    """With hashes that all collide, verification by bytes still tells windows apart."""
    a, b = words(1, 52), words(2, 52)
    t = pa.table({"key": [1, 1, 1], "body": [1, 2, 3], "more": [0, 0, 0], "no_id": [False] * 3, "id": [1, 2, 3], "text_key": [1, 1, 1], "start": pa.array([0, 0, 0], pa.int32()), "windows": pa.array([3, 3, 3], pa.int32()), "at": pa.array([5, 5, 5], pa.int32()), "words": pa.array([a.encode(), b.encode(), a.encode()])})
    bucket = windows.Bucket.of(t)
    label = suffixes.verified(bucket, bucket.group * 0, suffixes.owners(bucket, bucket.group * 0))
    assert label[0] != label[3] and label[0] == label[6] and label[1] != label[0]


def test_compaction_takes_some_kinds_at_a_time(words):
    """Memory goes by KINDS, not by the rows that come at once; a minimizer stays whole."""
    n = 6000
    key = np.repeat(np.arange(n // 2), 2)  # two kinds each, with the first 60 of 70 words in common
    text = [f"{words(k, 60)} {words(n + i, 10)}".encode() for i, k in enumerate(key.tolist())]
    numbers = {c: np.arange(1, n + 1) for c in ("body", *debruijn.WAYS)}
    fixed = {"no_id": np.zeros(n, bool), "id": np.arange(n), **{c: np.zeros(n, np.int64) for c in ("more", "text_key")}, "copies": np.ones(n, np.int64)}
    t = pa.table({"key": key, **numbers, **fixed, **{c: np.full(n, v, np.int32) for c, v in (("start", 0), ("windows", 21), ("at", 30))}, "words": pa.array(text, pa.binary())})
    peaks, found = [], []
    for work in (debruijn.compact_each, lambda t: [debruijn.compact(t)]):
        tracemalloc.start()
        found.append(pa.Table.from_batches(list(work(t))))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert found[0].num_rows == n and found[0] == found[1]
    assert peaks[0] < peaks[1] / 3


def test_tables_between_start_no_processes(spark, corpus):
    """Spark's writers start a process for each file on a local file system, and leave a .crc beside it; of these there is only that of the hot minimizers."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {*shared.rglob(".*.crc")}
    assert debruijn.repeated_spans(frame(spark, corpus)).count() > 10
    assert len({p.parent for p in {*shared.rglob(".*.crc")} - before}) <= 1


def test_stored(spark, empty, monkeypatch):
    """Tables of several row groups, tasks without rows, and no rows at all."""
    monkeypatch.setattr(kernel, "GROUP_ROWS", 3)
    df = spark.range(0, 40_000, 1, 3).select("id", (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") > 5, F.col("id").cast("int")).alias("some"), F.lit(None).cast("string").alias("none"))
    for rows in (df, df.where("id < 7"), df.where("id < 0"), empty):
        table, path = kernel.stored(rows)
        assert table.dtypes == rows.dtypes and sorted(table.collect(), key=str) == sorted(rows.collect(), key=str)
        assert not [p for p in Path(path.removeprefix("file://")).iterdir() if p.name.startswith("_")]
        kernel.remove(spark, path)
    table, _ = kernel.stored(df.select("id"), lambda batches: (b.slice(0, 1) for b in batches), "id long")
    assert 3 <= table.count() < 40 and table.columns == ["id"]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_with_equal_polynomial_hashes(spark, words):
    """A long word and its complement collide under every polynomial hash modulo 2**64; texts that differ in it are no copies."""
    t = thue_morse(2048)
    other = t.translate(str.maketrans("ab", "ba"))
    both = np.frombuffer((t + other).encode(), np.uint8)
    for base in (kernel.BASE, kernel.WORD_BASE):
        assert len(set(kernel.Prefix(both, base).slices(np.array([0, 2048]), np.array([2048, 4096])))) == 1
    head, tail, more = words(1, 30), words(2, 30), words(3, 400)
    rows = [(1, f"{head} {t} {tail}"), (2, f"{head} {other} {tail}"), (3, f"{more} {head} {t} {tail} {words(4, 300)}"), (4, f"{words(5, 300)} {head} {other} {tail} {words(6, 300)}")]
    for some in (rows[:2], [rows[0], rows[3]]):
        df = frame(spark, some)
        assert suffixes.repeated_passages(df).collect() == [] and debruijn.repeated_spans(df).collect() == []
        assert {r.doc_id: r.text for r in suffixes.drop_repeated(df).collect()} == dict(some)
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in suffixes.repeated_passages(frame(spark, rows)).collect()) == brute(rows)[0] == [(3, 400, 461), (4, 300, 361)]


def test_many_surroundings_of_one_line(spark, words, corpus, monkeypatch):
    """Minimizers with more kinds than one task takes: the result is that of the sort."""
    line = words(77, 30)
    rows = corpus + [(100 + i, f"{words(200 + i, 25)} {line} {words(300 + i % 4, 40)}") for i in range(30)] + [(140, f"{words(501, 9)} {words(14, 500)}")]
    df = frame(spark, rows)
    want = [sorted(map(tuple, f(df).collect())) for f in (suffixes.repeated_passages, lambda x: debruijn.repeated_spans(x).drop("paths"))]
    n = {r.doc_id: len(r.paths) for r in debruijn.repeated_spans(df).collect()}
    monkeypatch.setattr(windows, "HOT_KINDS", 1)
    assert windows.repeats(df).kinds.where("hot").count() > 30
    got = [sorted(map(tuple, f(df).collect())) for f in (suffixes.repeated_passages, lambda x: debruijn.repeated_spans(x).drop("paths"))]
    assert got == want
    assert {r.doc_id: len(r.paths) for r in debruijn.repeated_spans(df).collect()} == n


def test_long_texts_and_ids_at_the_edge(spark, words, monkeypatch):
    """Texts beyond a chunk, the largest id beside null ones, and texts that come out in parts."""
    monkeypatch.setattr(windows, "FETCH_BYTES", 2000)
    long = words(1, 260_000)
    assert len(long) > kernel.CHUNK_BYTES
    shared = " ".join(long.split()[200_000:200_300])
    rows = [(1, long), ((1 << 63) - 1, words(2, 40) + " " + shared), (None, shared + " " + words(3, 30)), (None, words(4, 70))]
    got = suffixes.repeated_passages(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word, r.first_ids) for r in got), key=str) == [((1 << 63) - 1, 40, 340, [1]), (None, 0, 300, [1])]
    got = debruijn.repeated_spans(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word, r.copies) for r in got), key=str) == [(1, 200_000, 200_300, 3), ((1 << 63) - 1, 40, 340, 3), (None, 0, 300, 3)]


def test_messy(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    later, every = brute(rows)
    got = suffixes.repeated_passages(messy).collect()
    assert sorted((r.doc_id if r.doc_id is not None else LAST, r.start_word, r.end_word) for r in got) == later == [(7, 0, 80)]
    got = debruijn.repeated_spans(messy).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == every == [(6, 0, 80), (7, 0, 80)]
    assert suffixes.repeated_passages(empty).collect() == [] and debruijn.repeated_spans(empty).collect() == []


def test_drop_repeated(spark, messy, empty, corpus):
    df = frame(spark, corpus).withColumn("n_chars", F.length("text")).withColumn("Spans", F.lit(1))
    kept = suffixes.drop_repeated(df)
    assert kept.columns == df.columns
    left = {r.doc_id: r for r in kept.collect()}
    cut = defaultdict(list)
    for d, a, b in brute(corpus)[0]:
        cut[d].append((a, b))
    for d, text in corpus:
        w = split(text)
        assert split(left[d].text) == [x for i, x in enumerate(w) if not any(a <= i < b for a, b in cut[d])]
        assert left[d].n_chars == len(left[d].text)
        if d not in cut:
            assert left[d].text == text
    out = suffixes.drop_repeated(messy)
    assert out.columns == messy.columns and out.count() == 11
    assert [r.text for r in out.where("doc_id = 7").collect()] == [""]
    assert suffixes.drop_repeated(empty).collect() == []
