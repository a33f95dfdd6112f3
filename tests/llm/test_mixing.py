import hashlib
import re
from collections import defaultdict

from folio.llm import mixing
from folio.llm.queries import WEIGHTS


def brute(rows, weights, default, fraction, seed=mixing.SEED):
    by, docs = defaultdict(list), []
    for doc_id, text, source in rows:
        h = hashlib.md5((f"{seed}:{doc_id}" if doc_id is not None else str(seed) if text is None else f"{seed}#{text}").encode()).hexdigest()
        by[source].append((h, len(re.findall(r"[^ \t\n\r]+", text or "")), doc_id))
    total = sum(n for x in by.values() for _, n, _ in x)
    for source, x in by.items():
        run = 0
        for h in sorted({h for h, _, _ in x}):
            run += sum(n for g, n, _ in x if g == h)
            docs += [(run / weights.get(source, default), source or "", h, n, d, source) for g, n, d in x if g == h]
    out, used, docs = [], 0, sorted(docs, key=lambda d: (d[0], d[5] is not None, d[1], d[2]))
    i = 0
    while i < len(docs):
        same = [d for d in docs if (d[0], d[5], d[2]) == (docs[i][0], docs[i][5], docs[i][2])]
        used += sum(d[3] for d in same)
        if used > total * fraction // 1:
            break
        out += [(d[4], d[5], d[3]) for d in same]
        i += len(same)
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_against_brute_force(spark, words):
    rows = [(i, words(i, i * 7 % 40), f"src{i % 5}") for i in range(120)] + [(3, words(3, 5), "src3")]
    rows += [(None, words(200 + i, 20), "src1") for i in range(30)] + [(None, words(200, 20), "src1"), (None, None, "src2"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for fraction in (0.0, 0.1, 0.5, 0.93, 1.0):
        got = [(r.doc_id, r.source, r.n_tokens) for r in mixing.mix_sources(df, WEIGHTS, budget_fraction=fraction).collect()]
        assert key(got) == key(brute(rows, WEIGHTS, mixing.DEFAULT_WEIGHT, fraction)), fraction


def test_order_and_budget(spark, words):
    df = spark.createDataFrame([(i, words(i, 10), f"src{i % 3}") for i in range(90)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, budget_tokens=300).collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got) and sum(r.n_tokens for r in got) <= 300
    assert mixing.mix_sources(df, budget_tokens=10**9).count() == 90


def test_messy(messy, empty):
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    got = [(r.doc_id, r.source, r.n_tokens) for r in mixing.mix_sources(messy, WEIGHTS).collect()]
    assert key(got) == key(brute(rows, WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.BUDGET_FRACTION))
    kept = mixing.keep_mixed(messy, weights=WEIGHTS)
    assert kept.columns == messy.columns and kept.count() == len(got)
    assert mixing.mix_sources(empty).collect() == [] and mixing.keep_mixed(empty).collect() == []
