"""Byte-level BPE encoding and decoding with a tokenization automaton.

The automaton is compiled from the merges, one merge gadget after the other, in rank order
(Berglund, Martens and van der Merwe, 2024). It starts as one state with a loop for each byte
and accepts exactly the correct tokenizations once all gadgets are built. The gadget for a
merge (x, y) -> z

* takes from the state that x leads to, and from all states split off it later, the arc y and
  the arcs that are later built from y;
* adds an arc z wherever x and then y led, to the state that y led to, split off.

So the state that z leads to descends from that of y, and the arc z from the arc x. Numbered
in preorder of these two trees, later children first, the arcs that one gadget takes away
form a rectangle of states and arcs. The automaton is kept as these rectangles, for each x as
the pieces of the arc axis with the least rank that takes them: 50,000 merges need about
100,000 pieces, where the full table has 2.5 billion arcs.

A word has one accepted path, and each of its prefixes too, so encoding goes over the bytes
once: from each position the arcs that the bytes ahead spell are found in a trie of the arc
labels, and the one that the state there allows ends the path of the next position. Many
words take each step together. Decoding emits the arcs' labels.

Words are split off by the vocabulary's published pattern, over whole texts.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from . import kernel

VOCABULARY = "byte_bpe_50k.tiktoken"
NEVER = 1 << 30
CELLS = 1 << 21  # words times bytes that are encoded together
FEW = 5  # fewer words of about one length are encoded one by one
KNOWN_WORDS = 400_000  # words whose tokens a task remembers; it forgets all and goes on beyond
OTHER, SPACES, LETTERS, NUMBERS = 0, 1, 2, 3


# --- The trie of labels, which the lattice scorer uses too ---


@dataclass
class Trie:
    """next[row[node], byte] is a node, 0 if there is none; node 1 is the root; token[node] is -1 where no label ends."""

    row: np.ndarray
    next: np.ndarray
    token: np.ndarray

    @staticmethod
    def of(labels: list[bytes]) -> Trie:
        """Row 0 has no arcs and belongs to all leaves."""
        edges: dict[tuple[int, int], int] = {}
        token = [-1, -1]
        inner: set[int] = set()
        for i, label in enumerate(labels):
            node = 1
            for b in label:
                to = edges.get((node, b))
                if to is None:
                    to = edges[node, b] = len(token)
                    token.append(-1)
                    inner.add(node)
                node = to
            if label:
                token[node] = i
        row = np.zeros(len(token), np.int32)
        row[sorted(inner)] = np.arange(1, len(inner) + 1)
        table = np.zeros((len(inner) + 1, 256), np.int32)
        if edges:
            keys, to = np.array(list(edges)), np.fromiter(edges.values(), np.int32)
            table[row[keys[:, 0]], keys[:, 1]] = to
        return Trie(row, table, np.array(token, np.int32))

    def __getstate__(self) -> tuple:
        at = np.flatnonzero(self.next)
        return self.row, self.token, self.next.shape, at.astype(np.int32), self.next.ravel()[at]

    def __setstate__(self, state: tuple) -> None:
        self.row, self.token, shape, at, to = state
        self.next = np.zeros(shape, np.int32)
        self.next.ravel()[at] = to


# --- Compiling ---


def load_ranks(path: str) -> list[bytes]:
    """Token bytes in the order of their ranks, from a file of base64 labels and ranks."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(label)) for label, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without a gap")
    return [label for _, label in pairs]


def merges_of(labels: list[bytes]) -> np.ndarray:
    """The two parts each token is merged from; -1 twice for a byte, and for a token that no merges reach."""
    rank = {label: i for i, label in enumerate(labels)}
    parts = np.full((len(labels), 2), -1, np.int64)
    for i, label in enumerate(labels):
        if len(label) < 2:
            continue
        word = [label[j : j + 1] for j in range(len(label))]
        while len(word) > 2:
            best, where = i, -1
            for j in range(len(word) - 1):
                r = rank.get(word[j] + word[j + 1], NEVER)
                if r < best:
                    best, where = r, j
            if where < 0:
                break
            word[where : where + 2] = [word[where] + word[where + 1]]
        if len(word) == 2 and word[0] in rank and word[1] in rank:
            parts[i] = rank[word[0]], rank[word[1]]
    return parts


def preorder(parent: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Preorder number, children (later first) and the end of the subtree of each node of a forest whose children have larger numbers."""
    n = len(parent)
    order = np.lexsort((-np.arange(n), parent))
    starts = np.searchsorted(parent[order], np.arange(n + 1))
    children = [order[starts[i] : starts[i + 1]] for i in range(n)]
    size = np.ones(n, np.int64)
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    pre, at = np.zeros(n, np.int64), 0
    for i in range(n):
        if parent[i] < 0:
            pre[i], at = at, at + size[i]
        below = pre[i] + 1
        for c in children[i]:
            pre[c], below = below, below + size[c]
    return pre, children, pre + size


@dataclass
class Automaton:
    """The compiled tokenization automaton; states and arcs both go by token number."""

    labels: list[bytes]
    trie: Trie
    spine: np.ndarray  # the state that this one was split off, -1 for a byte's
    arc: np.ndarray  # an arc's place on the arc axis
    piece: np.ndarray  # sorted: state * arcs + where a piece begins
    rank: np.ndarray  # the least rank that takes the piece from the state itself
    flat: np.ndarray = field(default=None)  # all labels end to end
    at: np.ndarray = field(default=None)  # where each begins
    byte_token: np.ndarray = field(default=None)

    @staticmethod
    def compile(labels: list[bytes]) -> Automaton:
        n = len(labels)
        parts = merges_of(labels)
        if {x for x in labels if len(x) == 1} != {bytes([b]) for b in range(256)}:
            raise ValueError("the vocabulary must have every byte")
        reached = [label if len(label) == 1 or parts[i, 0] >= 0 else b"" for i, label in enumerate(labels)]  # others are on no path
        arc, children, end = preorder(parts[:, 0])
        takes: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for z in range(n):
            x, y = parts[z]
            if x < 0:
                continue
            # Arcs built from y by merges of this rank (x = y: the leftmost goes first) or later ones go with it.
            later = children[y][: np.searchsorted(-children[y], -z, "right")]
            takes[x].append((int(arc[y]), int(end[later[-1]]) if len(later) else int(arc[y]) + 1, z))
        piece, rank = [], []
        for x in range(n):
            cuts = sorted({0, *(v for a, b, _ in takes[x] for v in (a, b))})
            least = np.full(len(cuts), NEVER)
            at = np.array(cuts)
            for a, b, z in takes[x]:
                span = slice(np.searchsorted(at, a), np.searchsorted(at, b))
                least[span] = np.minimum(least[span], z)
            changed = np.concatenate([[True], least[1:] != least[:-1]])
            piece.append(at[changed] + x * n)
            rank.append(least[changed])
        lengths = np.array([len(x) for x in labels])
        byte_token = np.zeros(256, np.int64)
        for i, label in enumerate(labels):
            if len(label) == 1:
                byte_token[label[0]] = i
        return Automaton(labels, Trie.of(reached), parts[:, 1].copy(), arc, np.concatenate(piece), np.concatenate(rank), np.frombuffer(b"".join(labels), np.uint8), np.concatenate([[0], np.cumsum(lengths)]), byte_token)

    def allows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has the arc. A state lacks what its own gadgets took, and what was taken from the one it was split off before that."""
        n = len(self.labels)
        column = self.arc[token]
        ok = np.ones(len(state), bool)
        live, at, limit = np.arange(len(state)), state.astype(np.int64), np.full(len(state), NEVER)
        while len(live):
            taken = self.rank[np.searchsorted(self.piece, at * n + column, "right") - 1]
            good = taken >= limit
            ok[live[~good]] = False
            above = self.spine[at]
            go = good & (above >= 0)
            live, limit, at, column = live[go], at[go], above[go], column[go]
        return ok

    # --- Encoding ---

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words, end to end, and how many each has."""
        size = ends - starts
        counts = np.zeros(len(size), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for some in alike(size):
            if len(some) >= FEW:
                found.append((some, *self._together(data, starts[some], size[some])))
                continue
            for i in some:
                tokens = self._alone(data[starts[i] : ends[i]])
                found.append((np.array([i]), tokens, np.array([len(tokens)])))
        for some, _, each in found:
            counts[some] = each
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for some, tokens, each in found:
            out[np.repeat(begin[some] - (np.cumsum(each) - each), each) + np.arange(len(tokens))] = tokens
        return out, counts

    def _together(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, longest = len(starts), int(size.max())
        grid = np.zeros((n, longest), np.uint8)
        inside = np.arange(longest) < size[:, None]
        grid[inside] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        state = np.full((n, longest + 1), -1, np.int32)  # the last arc of each prefix's path
        row, step, token = self.trie.row, self.trie.next, self.trie.token
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
                ask = np.flatnonzero((arc >= 0) & (state[live, j + 1] < 0))
                if len(ask):
                    if i:
                        ask = ask[self.allows(state[live[ask], i], arc[ask])]
                    state[live[ask], j + 1] = arc[ask]
        # Back from the ends.
        length = np.diff(self.at)
        back = np.full((n, longest), -1, np.int32)
        at, live, k, counts = size.copy(), np.arange(n), longest, np.zeros(n, np.int64)
        while len(live):
            k -= 1
            arc = state[live, at[live]]
            back[live, k] = arc
            counts[live] += 1
            at[live] -= length[arc]
            live = live[at[live] > 0]
        # Rows are filled from the right end on, each to its own length.
        return back[back >= 0], counts

    def _alone(self, word: np.ndarray) -> np.ndarray:
        n, text = len(word), word.tolist()
        state, length = [-1] * (n + 1), np.diff(self.at)
        row, step, token = self.trie.row, self.trie.next, self.trie.token
        known: dict[tuple[int, int], bool] = {}
        for i in range(n):
            node, s = 1, state[i]
            for j in range(i, n):
                node = step[row[node], text[j]]
                if not node:
                    break
                arc = int(token[node])
                if arc >= 0 and state[j + 1] < 0:
                    ok = i == 0 or known.get((s, arc))
                    if ok is None:
                        ok = known[s, arc] = bool(self.allows(np.array([s]), np.array([arc]))[0])
                    if ok:
                        state[j + 1] = arc
        out = []
        while n:
            out.append(state[n])
            n -= int(length[state[n]])
        return np.array(out[::-1], np.int32)

    def encode_text(self, text: str) -> list[int]:
        """One text, for tests and for use without a session."""
        return Encoder(self).encode(pa.array([text]))[0].tolist()

    # --- Decoding ---

    def decode(self, tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts from their tokens: the labels of the arcs, one after the other."""
        size = self.at[tokens + 1] - self.at[tokens]
        ends = np.cumsum(size)
        data = self.flat[np.repeat(self.at[tokens] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], np.cumsum(counts)])
        offsets = np.concatenate([[0], ends])[cuts]
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTERS
        elif kind == "N":
            out[cp] = NUMBERS
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACES
    return out


_class_table: list[np.ndarray] = []


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each word begins. The pattern: '(?:[sdmt]|ll|ve|re)| ?letters+| ?numbers+| ?others+|spaces+ not before a non-space|spaces+."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    if not _class_table:
        _class_table.append(_classes())
    table = _class_table[0]
    kind = table[data]  # right for ASCII; the rest follows
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [data[np.minimum(lead + k, n - 1)].astype(np.int64) for k in range(4)]
        two, three = b[0] < 0xE0, (b[0] >= 0xE0) & (b[0] < 0xF0)
        cp = np.where(two, (b[0] & 31) << 6 | b[1] & 63, np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
        own = table[np.minimum(cp, 0x10FFFF)]
        width = np.where(two, 2, np.where(three, 3, 4))
        for k in range(4):
            more = width > k
            kind[np.minimum(lead[more] + k, n - 1)] = own[more]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    kinds = kind[starts]
    # A space run before something in the same text gives up its last character, a blank to the next word, another as a word.
    inner = np.flatnonzero((kinds == SPACES) & ~edge[ends])
    last = ends[inner] - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    begin[last] = True
    blank = data[last] == 32
    begin[ends[inner[blank]]] = False
    # Contractions: a lone apostrophe that no blank belongs to, then letters of the same text.
    lone = starts[(kinds == OTHER) & (ends - starts == 1) & (data[starts] == 39) & ~edge[ends]]
    lone = lone[begin[lone]]
    lone = lone[kind[lone + 1] == LETTERS]
    a, b = data[lone + 1], np.where(lone + 2 < n, data[np.minimum(lone + 2, n - 1)], 0)
    b[edge[lone + 2]] = 0
    one = np.isin(a, list(b"sdmt"))
    two = (a == 108) & (b == 108) | (a == 118) & (b == 101) | (a == 114) & (b == 101)
    begin[lone[one | two] + 1] = False
    after = np.concatenate([lone[one] + 2, lone[two] + 3])
    begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """An automaton and the words it has met, by their bytes' hash; each is compared with the bytes it stands for."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.bytes, self.byte_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.tokens, self.token_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        tokens, counts = self.automaton.encode_words(data, starts, ends)
        size = ends - starts
        words = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        n = len(self.slot)
        self.bytes, self.byte_at = np.concatenate([self.bytes, words]), np.concatenate([self.byte_at, self.byte_at[-1] + np.cumsum(size)])
        self.tokens, self.token_at = np.concatenate([self.tokens, tokens]), np.concatenate([self.token_at, self.token_at[-1] + np.cumsum(counts)])
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        self.keys, self.slot = both[order], np.concatenate([self.slot, np.arange(n, n + len(keys))])[order]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        tokens, counts = self.flat(texts)
        return np.split(tokens, np.cumsum(counts)[:-1])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, end to end, and how many each has."""
        data, offsets = kernel.flat(texts)
        starts = split_words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = kernel.mix(kernel.Prefix(data, kernel.BASE).slices(starts, ends)) + (ends - starts).astype(np.uint64)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > KNOWN_WORDS and len(self.keys):
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = at >= len(self.keys)
        new[~new] = self.keys[at[~new]] != distinct[~new]
        if new.any():
            self._learn(data, distinct[new], starts[first[new]], ends[first[new]])
            at = np.searchsorted(self.keys, distinct)
        slot = self.slot[at][which]
        self._verify(data, starts, ends, slot)
        each = self.token_at[slot + 1] - self.token_at[slot]
        total = np.cumsum(each)
        tokens = self.tokens[np.repeat(self.token_at[slot] - (total - each), each) + np.arange(int(total[-1]))]
        words = np.concatenate([[0], total])
        per_text = words[np.searchsorted(starts, offsets[1:])] - words[np.searchsorted(starts, offsets[:-1])]
        return tokens, per_text

    def _verify(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> None:
        """Words whose hash belongs to other bytes get slots of their own, in place."""
        size = ends - starts
        same = kernel.equal(data, starts, ends, self.bytes, self.byte_at[slot], self.byte_at[slot + 1])
        for i in np.flatnonzero(~same):
            n = len(self.byte_at) - 1
            tokens, _ = self.automaton.encode_words(data, starts[i : i + 1], ends[i : i + 1])
            self.bytes, self.byte_at = np.append(self.bytes, data[starts[i] : ends[i]]), np.append(self.byte_at, self.byte_at[-1] + size[i])
            self.tokens, self.token_at = np.append(self.tokens, tokens), np.append(self.token_at, self.token_at[-1] + len(tokens))
            slot[i] = n
            # No key leads to it: such a word is met again as a stranger.


def alike(size: np.ndarray) -> Iterator[np.ndarray]:
    """Words grouped by length, each group's longest at most twice its shortest but for short ones; a group has about CELLS bytes at most."""
    hi, top = 8, int(size.max(initial=0))
    lo = 0
    while lo < top:
        of = np.flatnonzero((size > lo) & (size <= hi))
        step = max(FEW, CELLS // hi)
        for i in range(0, len(of), step):
            yield of[i : i + step]
        lo, hi = hi, 2 * hi


# --- On DataFrames ---

_compiled: dict[str, Automaton] = {}


def automaton(path: str | None = None) -> Automaton:
    """Compiled once in a process for each vocabulary file."""
    path = path or kernel.tokenizer_file(VOCABULARY)
    if path not in _compiled:
        _compiled[path] = Automaton.compile(load_ranks(path))
    return _compiled[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) and the tokens of each row's text, in one pass without a shuffle.

    A column of docs named like `out`, in any letter case, makes way for the tokens.

    Defined cases: a null text has null tokens and an empty one none; texts are encoded whole,
    however long; strings of special tokens are ordinary text; repeated rows stay; an empty
    table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    (source,) = kernel.fresh(docs.select(*(f"`{c.replace('`', '``')}`" for c in keep)), "bpe_text")
    rows = docs.select(*(F.col(f"`{c.replace('`', '``')}`") for c in keep), F.col(text).alias(source))
    model = docs.sparkSession.sparkContext.broadcast(automaton(path))  # bounded by the vocabulary

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for part in kernel.pieces(batch, source):
                texts = part.column(source)
                tokens, counts = encoder.flat(texts)
                lists = kernel.ragged(tokens, counts, pa.int32())
                if texts.null_count:
                    lists = pc.if_else(texts.is_null(), None, lists)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, out])

    schema = StructType([f for f in rows.schema if f.name != source]).add(out, ArrayType(IntegerType()))
    return kernel.map_rows(rows, apply, schema)


def decode(docs: DataFrame, path: str | None = None, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """docs and the text of each row's tokens.

    Defined cases: null tokens give a null text and no tokens an empty one; null or unknown
    token numbers are an error; repeated rows stay; a column named like `out`, in any letter
    case, makes way; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    model = docs.sparkSession.sparkContext.broadcast(automaton(path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(tokens)
            values, counts = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths().fill_null(0))
            if len(values) and (values.dtype.kind not in "iu" or values.min() < 0 or values.max() >= len(model.value.labels)):
                raise ValueError("a token number is null or unknown")
            texts = model.value.decode(values, counts).cast(pa.string())
            if lists.null_count:
                texts = pc.if_else(lists.is_null(), None, texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, out])

    schema = docs.select(*(f"`{c.replace('`', '``')}`" for c in keep)).schema.add(out, "string")
    return kernel.map_rows(docs, apply, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens, decoded) of every document: encode() and decode(), with their defined cases, in one task."""
    model = docs.sparkSession.sparkContext.broadcast(automaton(path))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                texts = part.column("text")
                tokens, counts = encoder.flat(texts)
                lists, decoded = kernel.ragged(tokens, counts, pa.int32()), model.value.decode(tokens, counts).cast(pa.string())
                if texts.null_count:
                    lists, decoded = pc.if_else(texts.is_null(), None, lists), pc.if_else(texts.is_null(), None, decoded)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoded], names=["doc_id", "tokens", "decoded"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, rows.drop("text").schema.add("tokens", ArrayType(IntegerType())).add("decoded", "string"))
