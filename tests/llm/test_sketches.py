import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import blocks, sketches


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def shingle_set(text, k=sketches.SHINGLE):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_exact_below_size_and_merge(spark, words):
    a, b = words(1, 60), words(1, 30) + " " + words(2, 40)
    df = frame(spark, [(1, a, "x"), (2, b, "x")])
    each = sketches.sketch(df)
    pair = each.where("doc_id = 1").select(F.col("sketch").alias("a")).crossJoin(each.where("doc_id = 2").select(F.col("sketch").alias("b")))
    got = pair.select(sketches.distinct(F.col("a")), sketches.resemblance(F.col("a"), F.col("b")), sketches.containment(F.col("a"), F.col("b"))).first()
    x, y = shingle_set(a), shingle_set(b)
    assert got[0] == len(x)
    assert got[1] == pytest.approx(len(x & y) / len(x | y)) and got[2] == pytest.approx(len(x & y) / len(x))


def test_parts_merge_into_the_whole(spark, words):
    parts = [words(s, 400) for s in range(5)]
    df = frame(spark, [(i, p, "one") for i, p in enumerate(parts)]).repartition(3)
    merged = sketches.merge(sketches.sketch(df), "source").first().sketch
    union = sorted({h for r in sketches.sketch(df, size=10**6).collect() for h in r.sketch})
    assert merged == union[: sketches.SIZE]


def test_estimates(spark, words):
    shared = words(1, 3000)
    a, b = shared + " " + words(2, 1500), shared + " " + words(3, 500)
    each = sketches.sketch(frame(spark, [(1, a, "x"), (2, b, "x")]))
    pair = each.where("doc_id = 1").select(F.col("sketch").alias("a")).crossJoin(each.where("doc_id = 2").select(F.col("sketch").alias("b")))
    n, r, c = pair.select(sketches.distinct(F.col("a")), sketches.resemblance(F.col("a"), F.col("b")), sketches.containment(F.col("b"), F.col("a"))).first()
    x, y = shingle_set(a), shingle_set(b)
    assert n == pytest.approx(len(x), rel=0.3) and r == pytest.approx(len(x & y) / len(x | y), abs=0.15) and c == pytest.approx(len(x & y) / len(y), abs=0.25)


def test_messy(messy, empty):
    from pyspark.sql import functions as F

    got = sketches.fingerprints(messy.withColumns({"sketch": F.lit(1), "component": F.lit("x"), "links": F.lit(None)})).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[2].sketch == [] and by[2].distinct_shingles == 0 and by[2].links == 0 and by[2].nearest_id is None
    assert by[3].sketch == [] and by[4].sketch == []
    assert len(by[5].sketch) == sketches.SIZE and by[1].distinct_shingles == 2 and by[5].source_shingles == pytest.approx(by[5].distinct_shingles)
    assert by[7].sketch == next(r.sketch for r in got if r.doc_id == 6 and len(r.sketch) > 1)
    assert {r.links for r in got} == {0}
    assert sketches.fingerprints(empty).collect() == []


def edited(text, share, seed):
    r = np.random.default_rng(seed)
    return " ".join(f"edit{r.integers(0, 99)}" if r.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def corpus(words):
    line = words(99, 30)  # in very many documents, short ones among them
    rows = [(i, line + " " + words(i, 5 + i), "one") for i in range(60)]
    rows += [(100 + i, edited(words(i, 300), 0.01 * (i % 4), i), "one") for i in range(5) for _ in range(3)]
    rows += [(200 + i, edited(words(7, 900), 0.004, i), "two") for i in range(60)]
    rows += [(300 + i, edited(words(8, 60), 0.02, i), "two") for i in range(40)]
    rows += [(400 + i, words(400 + i, 200 + i), None) for i in range(40)] + [(500, None, None), (501, "", "one"), (502, rows[0][1], "two")]
    return rows


@pytest.mark.parametrize(("often", "rows"), [(500, 16_384), (3, 16)])
def test_links_against_all_pairs(spark, corpus, often, rows, monkeypatch):
    """Every pair of different sketches, by the columns' own estimates; also with late hashes, and with tiles so small that blocks are split."""
    monkeypatch.setattr(sketches, "OFTEN", often)
    monkeypatch.setattr(blocks, "ROWS", rows)
    df = frame(spark, corpus)
    got = sketches.fingerprints(df).collect()
    assert len(got) == len(corpus)
    each = sketches.sketch(df).select("sketch_id", "sketch").where(F.size("sketch") > 0).distinct()
    a, b = each.select(F.col("sketch_id").alias("i"), F.col("sketch").alias("a")), each.select(F.col("sketch_id").alias("j"), F.col("sketch").alias("b"))
    pairs = a.join(b, F.col("i") != F.col("j")).select("i", "j", sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("a"), F.col("b")).alias("c")).where(F.col("r") >= sketches.ALIKE)
    want = {}
    for i, j, r, c in pairs.collect():
        n, best = want.get(i, (0, (0, 0, 0)))
        want[i] = n + 1, max(best, (r, -j, c))
    assert len(want) > 60 and max(n for n, _ in want.values()) > 20
    for r in got:
        if r.sketch_id not in want:
            assert r.links == 0 and r.nearest_id is None and r.resemblance is None
            continue
        n, (alike, other, part) = want[r.sketch_id]
        assert (r.links, r.nearest_id) == (n, -other) and (r.resemblance, r.containment) == (pytest.approx(alike), pytest.approx(part))
    if often == 3:
        some = sketches.sketch(df).where(F.size("sketch") > 0)
        assert len(sketches.frequent(some, sketches.SIZE)) > 0


def test_query_against_exact_sets(spark, corpus, tmp_path):
    """The registered query: numbers of shingles, and of short texts the exact resemblance and containment."""
    from folio.llm import queries

    frame(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_sketches(spark, str(tmp_path)).collect()
    exact = {i: shingle_set(t or "") for i, t, _ in corpus}
    source = {s: set().union(*(exact[i] for i, _, x in corpus if x == s)) for s in ("one", "two", None)}
    of = {i: s for i, _, s in corpus}
    by = {r.sketch_id: r.doc_id for r in got}
    near = 0
    for r in got:
        assert r.distinct_shingles == pytest.approx(len(exact[r.doc_id]), rel=0 if len(exact[r.doc_id]) < sketches.SIZE else 0.35)
        assert r.source_shingles == pytest.approx(len(source[of[r.doc_id]]), rel=0.35)
        if r.nearest_id is not None:
            x, y = exact[r.doc_id], exact[by[r.nearest_id]]
            slack = 1e-9 if len(x | y) < sketches.SIZE else 0.2
            near += slack < 0.1
            assert r.resemblance == pytest.approx(len(x & y) / len(x | y), abs=slack) and r.containment == pytest.approx(len(x & y) / len(x), abs=slack)
    assert near > 20



def test_rare_hashes_bring_sketches_together(spark):
    """Sketches in sevens with their 30 least hashes in common, too few for a link: none meet. Those with all but 10 in common do, and are linked."""
    r = np.random.default_rng(4)
    rows = r.integers(0, 1 << 62, (700, sketches.SIZE))
    rows[:, :30] = np.repeat(r.integers(-(1 << 63), 0, (100, 30)), 7, axis=0)
    alike = r.integers(0, 1 << 62, (2, sketches.SIZE))
    alike[1, 10:] = alike[0, 10:]
    df = spark.createDataFrame([(i, sorted(v.tolist())) for i, v in enumerate(np.concatenate([rows, alike]))], "sketch_id long, sketch array<long>")
    often, level = sketches.frequent(df, sketches.SIZE), sketches.levels(df)
    met = {x.node for x in sketches.meeting(sketches.first_hashes(df, often, level, sketches.SIZE, sketches.ALIKE)).collect()}
    assert met >= {700, 701} and len(met) < 20


def test_sketches_stay_in_their_files(spark, corpus):
    """Spark joins places of sketches, and reads no sketch to shuffle it, however many links there are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sketches.fingerprints(frame(spark, corpus))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert len(found.collect()) == len(corpus)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any("FileScan parquet" in x and "sketch:array" in x for x in plan.splitlines())


def test_quick_estimate():
    """Of sketches of all lengths, those of one hash and of equal ones included."""
    r = np.random.default_rng(8)
    size, n = 16, 3000
    x, y = np.full((2, n, size), np.iinfo(np.int64).max)
    nx, ny = r.integers(1, size + 1, (2, n))
    for k in range(n):
        x[k, : nx[k]] = np.sort(r.choice(24, nx[k], replace=False))
        y[k, : ny[k]] = np.sort(r.choice(24, ny[k], replace=False))
    x[:50], nx[:50] = y[:50], ny[:50]
    assert (sketches.alikeness(x, nx, y, ny, size) == sketches.estimate(x, nx, y, ny, size)[0]).all()


def test_a_large_group_is_counted_in_a_row_a_sketch():
    """However many pairs of a block are linked; before, each stretch of pairs had rows of its own."""
    import pyarrow as pa

    r = np.random.default_rng(9)
    n, size = 600, 128
    rows = np.repeat(r.integers(-(1 << 62), 1 << 62, (1, size)), n, axis=0)
    rows[np.arange(n)[:, None], r.integers(0, size, (n, 5))] = r.integers(-(1 << 62), 1 << 62, (n, 5))
    rows.sort(1)
    zero = pa.array(np.zeros(n, np.int32))
    table = pa.table({"component": pa.array(np.zeros(n, np.int64)), "sketch_id": pa.array(np.arange(n) * 7), "sketch": pa.array(rows.tolist(), pa.list_(pa.int64())), "lo": zero, "hi": zero, "tile": zero})
    got = sketches.counted(table, size, sketches.ALIKE).to_pylist()
    i, j = np.triu_indices(n, 1)
    full = np.full(n, size)
    alike, one, two = sketches.estimate(rows[i], full[i], rows[j], full[j], size)
    want: dict = {}
    for a, b, s, c, d in zip(i.tolist(), j.tolist(), alike, one, two, strict=True):
        if s >= sketches.ALIKE:
            for me, it, part in ((a, b, c), (b, a, d)):
                k, best = want.get(me, (0, (0, 0, 0)))
                want[me] = k + 1, max(best, (s, -it, part))
    assert len(got) == len(want) > 500 and max(k for k, _ in want.values()) > 300
    assert {g["node"]: (g["links"], (g["resemblance"], -g["other_id"], g["containment"])) for g in got} == {7 * me: (k, (s, 7 * it, c)) for me, (k, (s, it, c)) in want.items()}
