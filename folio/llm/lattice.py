"""Document probability under a unigram subword model, over all segmentations.

A word, with the vocabulary's word mark before it, is a lattice: an arc for each piece of an
existing vocabulary that its bytes spell, from any byte. Its probability is the sum over all
paths of the product of their pieces' probabilities, taken by a forward recursion in log
space; a document's is the product over its words.

The vocabulary is given, and its scores, normalised to add up to 1, weight the segmentations:
such a probability depends on the text alone. Beside it a document gets its probability under
the corpus: expectation maximization over the lattices of all words adapts the pieces'
probabilities to what the documents use. The corpus is gathered as word counts, so this costs
by the distinct words; what reaches the driver is one number for each piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .bpe import FEW, Trie, alike

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁".encode()
EPOCHS = 2
SMOOTHING = 0.1
KNOWN_WORDS = 1_000_000  # whose scores a task remembers; it forgets all and goes on beyond
COUNTED_WORDS = 400_000  # that a task counts before it sends them on


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Labels of a SentencePiece vocabulary and its scores. A byte that is no piece of its own stands for itself; control pieces spell nothing and are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            scores[model.id_to_piece(i).encode()] = model.get_score(i)
    least = min(scores.values(), default=0.0)
    for b in range(256):
        scores.setdefault(bytes([b]), least - 1)
    return list(scores), np.array(list(scores.values()))


def given_scores(scores: np.ndarray) -> np.ndarray:
    """The vocabulary's own scores as log probabilities that add up to 1."""
    top = scores.max()
    return scores - (top + np.log(np.exp(scores - top).sum()))


def starting_scores(scores: np.ndarray) -> np.ndarray:
    """Where training starts: log probabilities that fall with the place in the vocabulary's own order, as 1 / (place + 1)."""
    place = np.empty(len(scores))
    place[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    p = 1 / (place + 1)
    return np.log(p / p.sum())


@dataclass
class Lattice:
    trie: Trie
    scores: np.ndarray  # log probability of each label

    def together(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, weights: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Log probability of each of many words; adds the expected use of each piece, times the words' weights, to `expected`."""
        n, longest = len(starts), int(size.max())
        grid = np.zeros((n, longest), np.uint8)
        grid[np.arange(longest) < size[:, None]] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        ahead = np.full((longest + 1, n), -np.inf)
        ahead[0] = 0
        row, step, token = self.trie.row, self.trie.next, self.trie.token
        arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for i in range(longest):
            live = np.flatnonzero(size > i)
            node = np.ones(len(live), np.int32)
            for j in range(i, longest):
                node = step[row[node], grid[live, j]]
                go = (node > 0) & (size[live] > j)
                live, node = live[go], node[go]
                if not len(live):
                    break
                arc = token[node]
                some = np.flatnonzero(arc >= 0)
                if len(some):
                    at, arc = live[some], arc[some]
                    ahead[j + 1, at] = np.logaddexp(ahead[j + 1, at], ahead[i, at] + self.scores[arc])
                    if expected is not None:
                        arcs.append((i, j + 1, at, arc))
        total = ahead[size, np.arange(n)]
        if expected is not None:
            behind = np.full((longest + 1, n), -np.inf)
            behind[size, np.arange(n)] = 0
            for i, j, at, arc in reversed(arcs):
                rest = self.scores[arc] + behind[j, at]
                behind[i, at] = np.logaddexp(behind[i, at], rest)
                expected += np.bincount(arc, weights[at] * np.exp(ahead[i, at] + rest - total[at]), len(expected))
        return total

    def alone(self, word: bytes, weight: float = 0.0, expected: np.ndarray | None = None) -> float:
        """together() of one long word."""
        n = len(word)
        ahead = np.full(n + 1, -np.inf)
        ahead[0] = 0.0
        row, step, token, scores = self.trie.row, self.trie.next, self.trie.token, self.scores
        arcs: list[tuple[int, int, int]] = []
        for i in range(n):
            node, a = 1, ahead[i]
            for j in range(i, n):
                node = step[row[node], word[j]]
                if not node:
                    break
                if (arc := token[node]) >= 0:
                    ahead[j + 1] = np.logaddexp(ahead[j + 1], a + scores[arc])
                    if expected is not None:
                        arcs.append((i, j + 1, int(arc)))
        if expected is not None:
            behind = np.full(n + 1, -np.inf)
            behind[n] = 0.0
            for i, j, arc in reversed(arcs):
                rest = scores[arc] + behind[j]
                behind[i] = np.logaddexp(behind[i], rest)
                expected[arc] += weight * np.exp(ahead[i] + rest - ahead[n])
        return float(ahead[n])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word, word mark included. data has the mark before each word already."""
        size = ends - starts
        out = np.zeros(len(size))
        for some in alike(size):
            if len(some) >= FEW:
                out[some] = self.together(data, starts[some], size[some], None if weights is None else weights[some], expected)
                continue
            for i in some:
                out[i] = self.alone(data[starts[i] : ends[i]].tobytes(), 0.0 if weights is None else float(weights[i]), expected)
        return out


def marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words end to end with the mark before each, and where each begins and ends."""
    size = ends - starts
    wide = size + len(MARK)
    begin = np.cumsum(wide) - wide
    out = np.empty(int(wide.sum()), np.uint8)
    for k, b in enumerate(MARK):
        out[begin + k] = b
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin + len(MARK), size) + step] = data[np.repeat(starts, size) + step]
    return out, begin, begin + wide


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents. Words lie between blanks, tabs, line ends and the like. Each task counts its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                data, offsets = kernel.flat(part.column("text"))
                starts, ends, _ = kernel.spans(data, offsets, ~kernel.SPACE[data])
                size = ends - starts
                words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()).to_numpy()), pa.py_buffer(kernel.gather(data, starts, size))])
                seen = words.value_counts()
                held.append(pa.table({"word": seen.field("values"), "n": seen.field("counts")}))
                if sum(t.num_rows for t in held) > COUNTED_WORDS:
                    held = [summed()]
                    if held[0].num_rows > COUNTED_WORDS // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from summed().to_batches()

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def train(words: DataFrame, path: str, epochs: int = EPOCHS) -> Lattice:
    """Piece probabilities by expectation maximization over counted words; without words they stay where they start."""
    labels, given = load_pieces(path)
    lattice = Lattice(Trie.of(labels), starting_scores(given))
    if epochs and words.isEmpty():
        return lattice
    for _ in range(epochs):
        model = words.sparkSession.sparkContext.broadcast(lattice)  # bounded by the vocabulary

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = model.value
            expected = np.zeros(len(now.scores))
            for batch in batches:
                for part in kernel.pieces(batch, "word"):
                    data, offsets = kernel.flat(part.column("word"))
                    now.words(*marked(data, offsets[:-1], offsets[1:]), part.column("n").to_numpy().astype(float), expected)
            used = np.flatnonzero(expected)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "uses": pa.array(expected[used])})

        uses = words.mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        counts = np.full(len(labels), SMOOTHING)
        counts[uses.column("piece").to_numpy()] += uses.column("uses").to_numpy()
        # Rounded, so the order in which tasks end leaves no trace.
        lattice = Lattice(lattice.trie, np.round(np.log(counts / counts.sum()), 6))
        model.unpersist()
    return lattice


class Scorer:
    """Some lattices and the words it has met, by their bytes' hash; each is compared with the bytes it stands for."""

    def __init__(self, *lattices: Lattice):
        self.lattices = lattices
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.byte_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.values = np.zeros((0, len(self.lattices)))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        args = marked(data, starts, ends)
        return np.stack([x.words(*args) for x in self.lattices], 1)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities (a column for each lattice), words and bytes within words of each text."""
        data, offsets = kernel.flat(texts)
        n = len(offsets) - 1
        starts, ends, first = kernel.spans(data, offsets, ~kernel.SPACE[data])
        counts = np.diff(first)
        if not len(starts):
            return np.zeros((n, len(self.lattices))), counts, np.zeros(n, np.int64)
        keys = kernel.word_hashes(data, starts, ends)
        distinct, at_first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KNOWN_WORDS and len(self.keys):
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = at >= len(self.keys)
        new[~new] = self.keys[at[~new]] != distinct[~new]
        if new.any():
            begin, end = starts[at_first[new]], ends[at_first[new]]
            both, known = np.concatenate([self.keys, distinct[new]]), len(self.slot)
            order = np.argsort(both, kind="stable")
            self.keys, self.slot = both[order], np.concatenate([self.slot, known + np.arange(len(begin))])[order]
            self.bytes, self.byte_at = np.concatenate([self.bytes, kernel.gather(data, begin, end - begin)]), np.concatenate([self.byte_at, self.byte_at[-1] + np.cumsum(end - begin)])
            self.values = np.concatenate([self.values, self.words(data, begin, end)])
            at = np.searchsorted(self.keys, distinct)
        slot = self.slot[at][which]
        each = self.values[slot]
        strange = np.flatnonzero(~kernel.equal(data, starts, ends, self.bytes, self.byte_at[slot], self.byte_at[slot + 1]))  # other bytes with the same hash
        if len(strange):
            each[strange] = self.words(data, starts[strange], ends[strange])
        rows = np.repeat(np.arange(n), counts)
        return np.stack([np.bincount(rows, x, n) for x in each.T], 1), counts, np.bincount(rows, ends - starts, n).astype(np.int64)


def score(docs: DataFrame, lattices: dict[str, Lattice]) -> DataFrame:
    """(doc_id, n_words, and for each lattice `x` its x_log_prob and x_bits_per_byte) of every row of docs, in one pass without a shuffle; for a lattice named "" without the x_.

    bits_per_byte counts the bytes within words; it is null where there are none.
    """
    model = docs.sparkSession.sparkContext.broadcast(list(lattices.values()))  # bounded by the vocabulary
    names = [f"{x}_{c}".strip("_") for x in lattices for c in ("log_prob", "bits_per_byte")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                totals, words, size = scorer.score(part.column("text"))
                null = np.asarray(part.column("text").is_null())
                columns = []
                for total in totals.T:
                    rate = np.divide(-total / np.log(2), size, out=np.zeros(len(size)), where=size > 0)
                    columns += [pa.array(total, mask=null), pa.array(rate, mask=size == 0)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), *columns], names=["doc_id", "n_words", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, n_words long, " + ", ".join(f"{c} double" for c in names))


def given(path: str | None = None) -> Lattice:
    """The lattice of a vocabulary with its own scores."""
    labels, scores = load_pieces(path or kernel.tokenizer_file(VOCABULARY))
    return Lattice(Trie.of(labels), given_scores(scores))


def score_given(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_byte) of every document by the vocabulary's own scores. The defined cases are those of score_corpus(), and no row changes another's score."""
    return score(docs, {"": given(path)})


def score_corpus(docs: DataFrame, path: str | None = None, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, n_words, vocabulary_log_prob, vocabulary_bits_per_byte, log_prob, bits_per_byte) of every document.

    The first two scores are by the vocabulary's own scores, the others by the probabilities
    that its pieces have in all documents together.

    Defined cases: a null text has a null log probability and no words; an empty text, or one
    of blanks, has no words and log probability 0; texts and words are taken whole, however
    long; a character that no piece spells goes byte by byte; rows with a null or repeated id
    are scored each by itself, and repeated rows count as often as they occur; an empty table
    gives no rows; other columns are not looked at.
    """
    path = path or kernel.tokenizer_file(VOCABULARY)
    return score(docs, {"vocabulary": given(path), "": train(kernel.cut(word_counts(docs)), path, epochs)})
