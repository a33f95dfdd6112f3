import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import kernel, lattice

PATH = None


def vocabulary():
    return lattice.load_pieces(kernel.tokenizer_file(lattice.VOCABULARY))


@pytest.fixture(scope="module")
def start():
    labels, given = vocabulary()
    return lattice.Lattice(lattice.Trie.of(labels), lattice.starting_scores(given)), dict(zip(labels, lattice.starting_scores(given), strict=True))


def brute(word, p):
    @lru_cache(None)
    def f(i):
        return 1.0 if i == len(word) else sum(math.exp(p[word[i:j]]) * f(j) for j in range(i + 1, len(word) + 1) if word[i:j] in p)

    return math.log(f(0))


def test_sums_all_segmentations(start):
    model, p = start
    texts = ["the", "internationalization of it", "Straße 中文 😀", "a" * 60, "x\ny\tz", ""]
    total, n, size = lattice.Scorer(model).score(pa.array(texts))
    for t, x, k in zip(texts, total[:, 0], n, strict=True):
        assert k == len(t.split()) and x == pytest.approx(sum(brute(lattice.MARK + w.encode(), p) for w in t.split()), abs=1e-8)
    assert size.tolist() == [len("".join(t.split()).encode()) for t in texts]


def test_words_alone_and_together_agree(start, monkeypatch):
    model, _ = start
    texts = ["incomprehensibilities", "b" * 40, "漢字" * 90, "x" * 200, "longer" * 30, "words" * 33, "of a kind" * 20]
    data, off = kernel.flat(pa.array(texts))
    args, got = lattice.marked(data, off[:-1], off[1:]), []
    for few in (1, 100):
        monkeypatch.setattr(lattice, "FEW", few)
        used = np.zeros(len(model.scores))
        got.append((model.words(*args, np.arange(7.0), used), used))
    assert got[0][0] == pytest.approx(got[1][0]) and got[0][1] == pytest.approx(got[1][1])


def test_unspaced_text_goes_together(start, monkeypatch):
    """Long words of text without blanks share their steps: about as many as the longest has bytes and its arcs, however many words there are."""
    model, _ = start
    r = np.random.default_rng(1)
    text = " ".join("".join(chr(0x4E00 + c) for c in r.integers(0, 3000, r.integers(30, 60))) for _ in range(400))
    steps = []
    here = np.logaddexp
    monkeypatch.setattr(np, "logaddexp", lambda *a: steps.append(1) or here(*a))
    total, n, size = lattice.Scorer(model).score(pa.array([text]))
    assert size[0] > 50_000 and len(steps) < 3000


def test_scores_of_the_vocabulary_itself(spark, words):
    """Normalised and otherwise as they are; a score doesn't depend on other rows, even for words whose polynomial hashes are equal."""
    labels, scores = vocabulary()
    given = lattice.given_scores(scores)
    assert np.exp(given).sum() == pytest.approx(1) and np.diff(given) == pytest.approx(np.diff(scores))
    t = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    texts = [t, t.translate(str.maketrans("ab", "ba")), words(1, 50), "the cat", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    together = {r.doc_id: r.log_prob for r in lattice.score_given(df).collect()}
    for i in range(5):
        assert lattice.score_given(df.where(f"doc_id = {i}")).first().log_prob == together[i]
    p = dict(zip(labels, given, strict=True))
    assert together[3] == pytest.approx(brute_log(lattice.MARK + b"the", p) + brute_log(lattice.MARK + b"cat", p))
    both = {r.doc_id: r.vocabulary_log_prob for r in lattice.score_corpus(df).collect()}
    assert both == together and together[0] != together[1]


def brute_log(word, p):
    ahead = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in p:
                ahead[j] = np.logaddexp(ahead[j], ahead[i] + p[word[i:j]])
    return ahead[-1]


def test_colliding_hashes(start, monkeypatch):
    model, _ = start
    texts = pa.array(["one two three one", "two", "four"])
    want = lattice.Scorer(model).score(texts)[0]
    monkeypatch.setattr(kernel, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert lattice.Scorer(model).score(texts)[0] == pytest.approx(want)


def test_corpus_against_brute_force(spark, words):
    """score_corpus(): expectation maximization and forward sums over all segmentations in plain Python."""
    labels, given = vocabulary()
    texts = ["the cat sat", "the cat", None, "a cat!  the\tcat", ""]
    p = dict(zip(labels, lattice.starting_scores(given), strict=True))
    said = [lattice.MARK + w.encode() for t in texts for w in (t or "").split()]
    for _ in range(lattice.EPOCHS):
        uses = dict.fromkeys(p, lattice.SMOOTHING)
        for w in said:
            ways = list(segmentations(w, p))
            total = sum(math.exp(sum(p[x] for x in way)) for way in ways)
            for way in ways:
                for x in way:
                    uses[x] += math.exp(sum(p[y] for y in way)) / total
        whole = sum(uses.values())
        p = {x: math.log(n / whole) for x, n in uses.items()}
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in lattice.score_corpus(df).collect():
        t = texts[r.doc_id]
        want = None if t is None else sum(brute(lattice.MARK + w.encode(), p) for w in t.split())
        assert r.log_prob == (want if want is None else pytest.approx(want, abs=1e-4))
        if t:
            assert r.bits_per_byte == pytest.approx(-want / math.log(2) / sum(len(w.encode()) for w in t.split()), abs=1e-4)


def segmentations(word, p):
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        if word[:j] in p:
            for rest in segmentations(word[j:], p):
                yield [word[:j], *rest]


def test_training_raises_the_likelihood(spark, words):
    df = spark.createDataFrame([(i, words(i, 60)) for i in range(20)], "doc_id long, text string")
    totals = [sum(r.log_prob for r in lattice.score_corpus(df, epochs=e).collect()) for e in (0, 1, 3)]
    assert totals[0] < totals[1] < totals[2]


@pytest.mark.parametrize("most", [400_000, 3])
def test_counts_every_document(spark, most, monkeypatch):
    monkeypatch.setattr(lattice, "COUNTED_WORDS", most)
    df = spark.createDataFrame([(1, "a b a"), (2, "b\na"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.word: r.n for r in lattice.word_counts(df).collect()} == {"a": 3, "b": 2}


def test_messy(messy, empty):
    got = lattice.score_corpus(messy).collect()
    assert len(got) == 11
    by = {r.doc_id: r for r in got}
    assert by[2].log_prob is None and by[2].n_words == 0
    assert by[3].log_prob == 0 and by[3].bits_per_byte is None and by[4].n_words == 0
    assert by[5].n_words == 6001 and by[5].log_prob < -1000 and by[None].n_words == 70
    assert lattice.score_corpus(empty).collect() == []
