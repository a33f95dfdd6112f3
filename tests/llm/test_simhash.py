import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import blocks, graph, simhash


def brute(prints, radius):
    x = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1).astype(int)
    return (x[:, None] != x[None]).sum(2) <= radius


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_planes_against_brute_force(n):
    r = np.random.default_rng(n)
    prints = r.integers(0, 1 << 63, (n, 4), np.uint64)
    prints[n // 2 :] = prints[: n - n // 2] ^ (np.uint64(1) << r.integers(0, 64, (n - n // 2, 4)).astype(np.uint64))
    planes = simhash.transpose(prints)
    q, w = (x.ravel() for x in np.mgrid[0:n, 0 : planes.shape[1]])
    some, bits = simhash.within(planes, prints, q, w, np.where(w * 64 + 64 > n, ~simhash.FIRST[n - n // 64 * 64], np.uint64(0)), 5)
    got = np.zeros((n, planes.shape[1] * 64), bool)
    at, place = np.nonzero(np.unpackbits(bits.view(np.uint8)).reshape(-1, 64))
    got[q[some[at]], w[some[at]] * 64 + place] = True
    assert (got[:, :n] == brute(prints, 5)).all() and not got[:, n:].any()


@pytest.mark.parametrize("together", [1, 7, 1 << 16])
def test_every_pair_of_a_block_and_no_other(together, monkeypatch):
    """Blocks of all sizes, the small ones within words of planes that they share; near fingerprints of other blocks are no pairs."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    r = np.random.default_rng(5)
    sizes = np.concatenate([[1, 2, 3, 1, 1, 2, 63, 64, 65, 1, 200, 2], r.integers(1, 6, 40)])
    base = r.integers(0, 1 << 63, (3, 4), np.uint64)
    prints = base[r.integers(0, 3, sizes.sum())]
    for _ in range(4):
        prints[:, r.integers(0, 4)] ^= np.uint64(1) << r.integers(0, 64, len(prints)).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), sizes)
    want = {(i, j) for i, j in np.argwhere(brute(prints, 9)).tolist() if i < j and block[i] == block[j]}
    got = [(i, j) for p, q in simhash.near_pairs(begin, prints, 9) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    a, b = simhash.compare(begin, np.arange(len(prints)), prints, 9)
    assert {*zip(a.tolist(), b.tolist(), strict=True)} <= want and components(a, b, len(prints)) == components(*np.array(sorted(want)).T, len(prints))


def components(a, b, n):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for x, y in zip(a, b, strict=True):
            label[x] = label[y] = min(label[x], label[y])
        if label == before:
            return label


def test_a_block_of_very_many_is_split(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    want = {tuple(r) for r in simhash.groups(df).collect()}
    monkeypatch.setattr(blocks, "ROWS", 7)
    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(2, i) for i in range(5)], "key long, node long")
    met = {(r.key, r.lo, r.hi): [] for r in blocks.tiled(rows, "key", "node").collect()}
    for r in blocks.tiled(rows, "key", "node").collect():
        met[r.key, r.lo, r.hi].append(r.node)
    assert {(min(a, b), max(a, b)) for (k, _, _), v in met.items() if k == 1 for a in v for b in v if a != b} == {(i, j) for i in range(40) for j in range(i + 1, 40)}
    assert sorted(met[2, 0, 0]) == [*range(5)] and max(map(len, met.values())) <= 25
    assert {tuple(r) for r in simhash.groups(df).collect()} == want


def test_planes_are_used_on_the_smallest_tables(spark, sf_dir, monkeypatch):
    sliced = []
    here = simhash.within
    monkeypatch.setattr(simhash, "within", lambda *a: sliced.append(len(a[2])) or here(*a))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts, prints, keys = simhash.fingerprints(pa.array(texts))
    key = keys[counts > 0, 0]
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    simhash.compare(begin, order, prints[counts > 0][order], simhash.RADIUS)
    assert sum(sliced) > 10


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join("edit" + str(r.randint(0, 99)) if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus(words):
    rows = [(i, words(i, 150)) for i in range(60)]
    rows += [(100 + i, edited(words(i, 150), 0.04, i)) for i in range(30)]
    rows += [(200 + i, words(5, 150)) for i in range(70)]  # a block with many exact copies
    rows += [(300 + i, edited(words(7, 150), 0.03, i)) for i in range(80)]
    return rows


def test_copies_are_found_and_others_left(spark, corpus):
    got = {r.doc_id: r.kept_id for r in simhash.groups(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    near = [100 + i for i in range(30)]
    assert sum(got.get(d) == d - 100 for d in near) >= 0.9 * len(near)
    assert all(got[200 + i] == 5 for i in range(70)) and sum(got.get(300 + i) == 7 for i in range(80)) >= 72
    assert not any(i in got for i in range(60))


def test_search_against_all_pairs(spark, corpus):
    texts = [t for _, t in corpus]
    _, prints, _ = simhash.fingerprints(pa.array(texts))
    near = brute(prints, simhash.RADIUS)
    label = np.arange(len(texts))
    for _ in range(20):
        label = np.array([label[near[i]].min() for i in range(len(texts))])
    want = {(corpus[i][0], corpus[k][0]) for i, k in enumerate(label) if i != k}
    got = {tuple(r) for r in simhash.groups(spark.createDataFrame(corpus, "doc_id long, text string")).select("doc_id", "kept_id").collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50}


def test_nodes_of_very_many_edges(spark, monkeypatch):
    r = np.random.default_rng(8)
    edges = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(30, 50)] + [(int(a), int(b)) for a, b in r.integers(200, 400, (150, 2))]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {(x.node, x.component) for x in graph.components(df).collect()}
    monkeypatch.setattr(graph, "HOT", 3)
    assert {(x.node, x.component) for x in graph.components(df).collect()} == want and (100, 0) in want


def test_messy(messy, empty):
    got = [(r.doc_id, r.kept_id) for r in simhash.groups(messy).collect()]
    assert got == [(7, 6)]
    kept = simhash.drop_near_copies(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, None, 2, 3, 4, 5, 6, 6, 8], key=str)  # of the repeated row, one
    assert simhash.groups(empty).collect() == [] and simhash.drop_near_copies(empty).collect() == []


def test_a_node_has_the_keys_of_all_its_documents(spark):
    """Documents 1 and 2 have one fingerprint and different blocks; 3 meets only the one, 4 only the other."""
    rows = [(1, 11, 1, 0, 0, 0, 0, [1, 2]), (2, 12, 1, 0, 0, 0, 0, [3, 4]), (3, 13, 2, 1, 0, 0, 0, [1, 5]), (4, 14, 3, 2, 0, 0, 0, [3, 6]), (5, 15, 4, 4, 0, 0, 0, [7, 8])]
    df = spark.createDataFrame(rows, "doc_id long, text_key long, node long, f0 long, f1 long, f2 long, f3 long, keys array<long>")
    for at in (df, df.orderBy(F.desc("doc_id"))):
        assert {(r.doc_id, r.kept_id) for r in simhash.grouped(at.coalesce(1), simhash.RADIUS).collect()} == {(2, 1), (3, 1), (4, 1)}
