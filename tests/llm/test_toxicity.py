import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import toxicity


def test_learns_an_interaction():
    """An insult or a group alone is fine, both together are toxic: no sum of weights can say so."""
    r = random.Random(1)
    texts, labels = [], []
    for i in range(1200):
        insult, group = i % 2, i // 2 % 2
        filler = [r.choice(["oak", "elm", "ash", "fir", "yew", "bay"]) for _ in range(8)]
        texts.append(" ".join(filler + ["wretch"] * insult + ["villagers"] * group))
        labels.append(insult & group)
    rows, values = toxicity.distinct(*toxicity.term_buckets(pa.array(texts)), toxicity.BUCKETS)
    lists = np.split(values, np.searchsorted(rows, np.arange(1, len(texts))))
    machine = toxicity.fit(lists[:800], np.array(labels[:800], float))
    said = machine.score(pa.array(texts[800:])) >= toxicity.THRESHOLD
    assert (said == np.array(labels[800:], bool)).mean() > 0.98
    assert np.abs(machine.factors).max() > 0.1


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 3)
    test = labels.where("held").select(F.col("doc_id").alias("l_id"), F.col("toxic").alias("truth"))
    got = toxicity.classify(docs, docs, labels.where("not held")).join(test, F.col("doc_id") == F.col("l_id")).select("toxic", "truth").toPandas()
    hit = (got.toxic == (got.truth == 1)).mean()
    found = got.toxic[got.truth == 1].mean()
    assert hit > 0.96 and found > 0.8 and got.toxic[got.truth == 0].mean() < 0.02


def test_messy(spark, messy, empty, words):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, 0), (6, None), (8, 0), (8, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.classify(messy, messy, labels).collect()
    assert len(got) == 11 and all(0 <= r.toxicity <= 1 for r in got)
    kept = toxicity.drop_toxic(messy, messy, labels.limit(0))
    assert kept.columns == messy.columns and kept.count() == 11  # no labels: nothing is toxic
    assert toxicity.classify(empty, messy, labels).collect() == [] and toxicity.drop_toxic(empty, empty, labels).collect() == []
    assert {r.toxic for r in toxicity.classify(messy, empty, labels).collect()} == {False}


def test_learns_a_pair_of_terms_that_say_little_alone(spark):
    """An insult and a group at about twice the rate in toxic texts: each alone has odds below MIN_LIFT, both together decide."""
    r = random.Random(4)
    filler = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(3000):
        words, toxic = r.choices(filler, [1 / (j + 1) for j in range(3000)], k=60), r.random() < 0.12
        kind = r.random()
        if toxic:
            words += ["scum"] if kind < 0.6 else ["wretch", "villagers"]
        else:
            words += ["wretch"] if kind < 0.2 else ["villagers"] if kind < 0.4 else []
        rows.append((i, " ".join(words), int(toxic), toxic and kind >= 0.6))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    known = rows[:2000]
    n, positive = len(known), sum(x[2] for x in known)
    for term in ("wretch", "villagers"):
        have = [x[2] for x in known if term in x[1].split()]
        assert np.exp(abs(toxicity.evidence(len(have), sum(have), n, positive, np.log, np.sqrt)[0])) < toxicity.MIN_LIFT
    labels = spark.createDataFrame([(x[0], x[2]) for x in known], "doc_id long, toxic int")
    said = {x.doc_id: x.toxic for x in toxicity.classify(docs, docs, labels).collect()}
    pairs = [said[x[0]] for x in rows[2000:] if x[3]]
    assert sum(pairs) >= 0.8 * len(pairs) and len(pairs) > 30
    assert sum(said[x[0]] for x in rows[2000:] if not x[2]) <= 0.01 * 1000


def small_machine(seed):
    r = np.random.default_rng(seed)
    lists = [np.unique(r.integers(0, 40, r.integers(0, 9))) for _ in range(60)]
    return r, lists, (r.random(60) < 0.4).astype(float)


def test_machine_sum_is_that_of_all_pairs():
    r, lists, _ = small_machine(1)
    w, v = r.normal(size=40), r.normal(size=(40, 4))
    rows, at = np.repeat(np.arange(60), [len(x) for x in lists]), np.concatenate(lists)
    got, _ = toxicity.machine_sum(rows, at, 60, w, v)
    want = [sum(w[i] for i in x) + sum(v[i] @ v[j] for i in x for j in x if i < j) for x in lists]
    assert np.allclose(got, want)


def test_gradient(monkeypatch):
    """The loss's gradient against differences, where the search starts and somewhere else."""
    r, lists, toxic = small_machine(2)
    asked = []
    monkeypatch.setattr(toxicity, "minimum", lambda loss, x: asked.append(loss) or x)
    machine = toxicity.fit(lists, toxic)
    size = 1 + machine.weights.size + machine.factors.size
    for x in (np.zeros(size), r.normal(0, 0.3, size)):
        _, grad = asked[0](x)
        for k in [0, *r.integers(1, size, 30)]:
            step = np.zeros(size)
            step[k] = 1e-6
            assert abs((asked[0](x + step)[0] - asked[0](x - step)[0]) / 2e-6 - grad[k]) < 1e-6


def test_the_sample_is_bounded_by_rows(spark, words, monkeypatch):
    """Ids that many rows share, and repeated rows: no more documents than the bound reach the driver, the same ones however the rows lie."""
    seen = []
    here = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda at, ends, toxic, *rest: seen.append((len(toxic), at.tobytes(), toxic.tobytes())) or here(at, ends, toxic, *rest))
    rows = [(i % 6, f"{words(i % 40, 20)} {'wretch' if i % 6 < 3 else 'oak'}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(6)], "doc_id long, toxic int")
    distinct = len(set(rows))
    for most, want in ((1000, distinct), (30, 30)):
        for df in (docs, docs.orderBy(F.rand(1)).repartition(5)):
            toxicity.train(df, labels, most)
        assert seen[-1] == seen[-2] and seen[-1][0] == want


def test_training_takes_little_memory_beside_its_input():
    """Documents of each bucket in their order, in no more than their own size and stretches of the input; whole 64-bit copies took five times it."""
    import tracemalloc

    r = np.random.default_rng(6)
    ends = np.concatenate([[0], np.cumsum(r.integers(0, 4000, 2000))])
    at = r.integers(0, 5000, ends[-1]).astype(np.int32)
    want = np.repeat(np.arange(2000, dtype=np.int32), np.diff(ends))[np.argsort(at, kind="stable")]
    tracemalloc.start()
    rows, first = toxicity.turned(at, ends, 5000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows == want).all() and (np.diff(first) == np.bincount(at, minlength=5000)).all()
    assert peak < at.nbytes + 20e6
