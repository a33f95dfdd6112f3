import base64
import random

import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import bpe, kernel

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def known():
    return public(kernel.tokenizer_file(bpe.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdest lrvm'\n\t.,!09éß中😀 　", max_size=60))
def test_tokens_are_those_of_a_public_library(text):
    known = _known()
    assert bpe.automaton().encode_text(text) == known.encode_ordinary(text)


_cache = {}


def _known():
    if not _cache:
        _cache["x"] = public(kernel.tokenizer_file(bpe.VOCABULARY))
    return _cache["x"]


def test_merges_against_brute_force(known):
    r = random.Random(3)
    texts = ["".join(r.choice(["aa", "the", "in", "ing", "er", "ab", "on", " "]) for _ in range(r.randint(1, 60))) for _ in range(500)] + ["a" * 500, "the" * 300, " " * 300, "<|endoftext|>"]
    got = bpe.Encoder(bpe.automaton()).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [known.encode_ordinary(t) for t in texts]


def test_another_vocabulary():
    path = kernel.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    text = "Der schnelle braune Fuchs springt über den faulen Hund. 那只敏捷的狐狸"
    assert bpe.automaton(path).encode_text(text) == public(path).encode_ordinary(text)


def test_gadget_of_equal_parts():
    """aa merges from the left: aaa is aa, a."""
    labels = [bytes([b]) for b in range(256)] + [b"aa"]
    a = bpe.Automaton.compile(labels)
    assert a.encode_text("aaaaa") == [256, 256, 97]


def test_forgetting_changes_nothing(known, monkeypatch, words):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    encoder = bpe.Encoder(bpe.automaton())
    for seed in range(4):
        text = words(seed, 200)
        assert encoder.encode(pa.array([text]))[0].tolist() == known.encode_ordinary(text)


def test_hash_collisions_are_seen(known, monkeypatch):
    monkeypatch.setattr(bpe.kernel, "mix", lambda x: x * 0)
    text = "one two six ten the cat"
    assert bpe.Encoder(bpe.automaton()).encode(pa.array([text]))[0].tolist() == known.encode_ordinary(text)


def test_long_words_go_together(known, monkeypatch):
    """Text without blanks: words of very many bytes share their steps, and give the tokens that they give one by one."""
    r = random.Random(2)
    lengths = [r.randint(20, 50) for _ in range(300)] + [400, 410, 420, 430, 440, 3000]
    text = "。".join("".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)) for n in lengths)
    alone = []
    here = bpe.Automaton._alone
    monkeypatch.setattr(bpe.Automaton, "_alone", lambda self, word: alone.append(len(word)) or here(self, word))
    assert bpe.automaton().encode_text(text) == known.encode_ordinary(text)
    assert len(alone) <= 2 and sum(alone) < 12_000
    monkeypatch.setattr(bpe, "FEW", 10**9)
    assert bpe.automaton().encode_text(text[:3000]) == known.encode_ordinary(text[:3000])


def test_a_text_longer_than_a_chunk(spark, known, words):
    text = words(9, 200_000) + " " + "x" * 3000
    assert len(text) > kernel.CHUNK_BYTES
    df = spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert got[1].decoded == text and got[1].tokens == known.encode_ordinary(text) and got[2].tokens == known.encode_ordinary("a")


def test_decode_nothing_and_clashing_names(spark, known):
    df = spark.createDataFrame([(1, known.encode_ordinary("a b"), "old", "x"), (2, None, "old", "y"), (3, [], None, None)], "doc_id long, tokens array<int>, DECODED string, `k.l` string")
    got = bpe.decode(df)
    assert got.columns == ["doc_id", "tokens", "k.l", "decoded"] and [(r.doc_id, r.decoded) for r in got.collect()] == [(1, "a b"), (2, None), (3, "")]
    assert bpe.decode(df.limit(0)).collect() == [] and bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_messy(messy, known):
    got = bpe.encode(messy).collect()
    assert len(got) == 11 and "TOKENS" not in got[0].asDict() and got[0]["a.b"] == "dot"
    for r in got:
        assert r.tokens == (None if r.text is None else known.encode_ordinary(r.text))


def test_round_trip(messy, empty):
    from pyspark.sql import functions as F

    want = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in messy.collect()))
    for df in (bpe.round_trip(messy), bpe.decode(bpe.encode(messy.select("doc_id", "text"))).withColumn("x", F.lit(1))):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.decoded or "", r.decoded is None) for r in df.collect()))
        assert got == want
    assert bpe.round_trip(empty).collect() == []


def test_unknown_tokens(spark):
    bad = spark.createDataFrame([([10**6],)], "tokens array<int>")
    with pytest.raises(Exception, match="unknown"):
        bpe.decode(bad).collect()
