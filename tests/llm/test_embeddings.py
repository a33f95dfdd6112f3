import numpy as np
import pytest

from pyspark.sql import functions as F

from folio.llm import blocks, embeddings


def planted(n=400, dim=24, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[100:160] = x[:60] + r.normal(size=(60, dim)) * 0.05 * np.linalg.norm(x[:60], axis=1, keepdims=True) / np.sqrt(dim)
    x[200:230] = x[0] + r.normal(size=(30, dim)) * 0.2
    x[250] = 3 * x[0]
    return x


def brute(x, threshold):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= threshold
    label = list(range(len(x)))
    for _ in range(len(x)):
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
        if new == label:
            break
        label = new
    return {(i, k) for i, k in enumerate(label) if i != k}


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_exhaustive_against_brute_force(spark):
    x = planted()
    assert {tuple(r) for r in embeddings.groups(frame(spark, x)).collect()} == brute(x, embeddings.THRESHOLD)


def counted(x, threshold):
    """{(vector, least of its group, other vectors near it)}; equal vectors count once."""
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= threshold
    least = dict(brute(x, threshold))
    same = (x[:, None] == x[None]).all(2)
    return {(i, least.get(i, i), len({int(np.flatnonzero(same[j])[0]) for j in np.flatnonzero(near[i] & ~same[i])})) for i in range(len(x))}


@pytest.mark.parametrize("rows", [16_384, 20])
def test_classes_and_links(spark, rows, monkeypatch):
    """Also with so small tiles that buckets and groups are split."""
    monkeypatch.setattr(blocks, "ROWS", rows)
    x = planted()
    x[300:303] = x[0]
    got = [tuple(r) for r in embeddings.classes(frame(spark, x)).collect()]
    assert len(got) == len(x) and set(got) == counted(x, embeddings.THRESHOLD)


def test_oracle_where_there_are_pairs(spark, tmp_path):
    import duckdb

    x = planted()
    x[300:303] = x[0]
    frame(spark, x).selectExpr("vec_id", "cast(embedding as array<float>) embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in embeddings.classes(spark.read.parquet(str(tmp_path / "embeddings.parquet"))).collect()]
    want = duck.sql(embeddings.oracle_sql()).fetchall()
    assert sorted(got) == sorted(want) and sum(r[2] > 0 for r in want) > 90


def test_one_rule_for_all_sizes():
    for n in (1, 500, 2048, 2049, 10**6, 10**10):
        bits, tables = embeddings.plan(n, embeddings.THRESHOLD)
        share = (1 - np.arccos(embeddings.THRESHOLD) / np.pi) ** bits
        assert bits >= embeddings.LEAST_BITS and 1 - (1 - share) ** tables >= embeddings.RECALL


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95])
def test_tiles_against_all_pairs(threshold):
    x = planted(300)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embeddings.near(x[:150], x[150:], threshold)
    want = np.argwhere(x[:150] @ x[150:].T >= threshold)
    assert sorted(zip(i, j, strict=True)) == sorted(map(tuple, want))


def test_messy(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.01]), (7, [1.0, 0.01]), (7, [0.0, 5.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 1.0]), (10, [0.0, 1e-300])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    assert sorted(((r.vec_id, r.kept_id) for r in embeddings.groups(df).collect()), key=str) == [(10, 7), (7, 1), (None, 1)]
    assert embeddings.groups(df.limit(0)).collect() == [] and embeddings.classes(df.limit(0)).collect() == []
    got = [tuple(r) for r in embeddings.classes(df.withColumns({"component": F.lit(1), "links": F.lit("x"), "Bucket": F.lit(None)})).collect()]
    assert len(got) == len(rows) - 1 and {(None, 1, 1), (1, 1, 1), (2, 2, 0), (7, 1, 1), (10, 7, 1), (7, 7, 1), (6, 6, 0)} <= set(got)


def test_every_length_is_compared(spark):
    x, y = planted(300), planted(300, dim=8, seed=2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    got = {tuple(r) for r in embeddings.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    short = {(1000 + i, 1000 + k) for i, k in brute(y, embeddings.THRESHOLD)}
    assert got == brute(x, embeddings.THRESHOLD) | short and short


@pytest.mark.parametrize("n", [900, 12_000])
def test_recall(spark, n):
    """With the parameters as they are, and pairs just above the threshold, among few vectors and many."""
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = r.normal(size=(400, 48))
    off -= (off * x[:400]).sum(1, keepdims=True) * x[:400]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = r.uniform(embeddings.THRESHOLD + 0.001, 0.95, (400, 1))
    x[n - 400 :] = cosine * x[:400] + np.sqrt(1 - cosine**2) * off
    got = {tuple(p) for p in embeddings.groups(frame(spark, x)).collect()}
    want = {(n - 400 + i, i) for i in range(400)}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_no_pair_at_the_threshold_is_left_out(spark):
    """Each of 400 pairs just above the threshold, and one that is at it in double precision, with their links."""
    r = np.random.default_rng(5)
    n = 3000
    x = r.normal(size=(n, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = r.normal(size=(400, 48))
    off -= (off * x[:400]).sum(1, keepdims=True) * x[:400]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = embeddings.THRESHOLD + 1e-5
    x[n - 400 :] = cosine * x[:400] + np.sqrt(1 - cosine**2) * off
    x[n - 401], x[n - 402] = np.eye(48)[0], np.r_[9.0, 4.0, 1.0, 1.0, 1.0, np.zeros(43)]  # 9 / sqrt(100)
    got = {tuple(p) for p in embeddings.classes(frame(spark, x)).collect()}
    first = {i: n - 400 + i for i in range(400)} | {n - 402: n - 401}
    of = first | {j: i for i, j in first.items()}
    assert got == {(i, min(i, of.get(i, i)), int(i in of)) for i in range(n)}


@pytest.mark.parametrize("tiles", range(1, 9))
def test_every_two_tiles_meet_once(tiles):
    met = [embeddings.tile_pair(k, tiles) for k in range(tiles * (tiles // 2 + 1))]
    assert sorted(tuple(sorted(p)) for p in met if p) == [(i, j) for i in range(tiles) for j in range(i, tiles)]
