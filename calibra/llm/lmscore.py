"""Language-model scores by online logistic context mixing of bit predictors.

*Bits.*  A text is its words (lower-cased A-Z, between ASCII spaces) and an
end.  A word among the ``WORDS`` most frequent ones (seen ``LEAST_COUNT`` times or more), the end, or an escape is
written in a Huffman code of the training counts; an escaped word is spelled
in a Huffman code of bytes, up to the space behind it.  Every bit is a branch
at a node of one of the two trees, so a text's probability is the product of
its bits'.

*Predictors.*  Each context keeps, hashed with the node, how often either
branch was taken in training, as the log of their ratio: for word bits the
node alone, the class of the word before, and the class of the last frequent
word before that; for spelling bits the node alone and the 1, 2, 3 and 5
bytes before it in the word.

*Mixing.*  A bit's probability is the logistic of the weighted sum of its
predictors plus an adjustment by the sum's own size.  Weights are chosen by a
gate (depth of the node, or longest context seen), and both weights and
adjustments are refined while a document is read: each block of ``BLOCK``
tokens is scored by what the blocks before it taught, from the first of a text
to its last.  They start from what all training documents ended with, each
read by the counts of the half of them that it is not in; then both halves'
counts are added.

*Passes.*  Once the words are chosen, every text becomes a row of symbols (its
stream), from which contexts are counted and texts are scored; texts
themselves are read twice, for the words and for the stream.

*Counts.*  All training documents are counted; word counts, context counts
and the base score's rare words are Spark aggregations and joins that grow
with the corpus.  What is broadcast is of fixed size: ``WORDS`` words and
hashed tables.

Nulls and odd cases: a null text is an empty one (its end alone); a null id
is neither held out nor learned from; rows that repeat an id are scored each;
with no training documents every branch is even and the base score is 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from calibra.llm.common import in_arrow, split_ascii, written

WORDS = 1 << 17
LEAST_COUNT = 3  # rarer words are spelled, and teach how new words are
BLOCK = 128  # tokens
_FIXED = float(1 << 20)  # weights are summed as integers, so that their order does not matter
CLASSES = 512  # of words as contexts: the most frequent, then by their last bytes
OWN_CLASS = 448
NODES = 2048  # nodes of the word tree, heaviest first, that contexts are kept for
SPELL_SLOTS = (1 << 16, 1 << 18, 1 << 20, 1 << 21)
SPELL_ORDERS = (1, 2, 3, 5)
WORD_GATES, SPELL_GATES = 4, 5
_CHUNK = 4096  # slots that are summed together
_TOKENS = 3 << 20  # tokens that are counted together
_TOGETHER = 24 * 1024  # tokens that are read at once; of a longer text so many at a time
_PAIRS = 1 << 18  # tokens whose pairs of context and symbol are counted together
_STRETCH = 1 << 13  # of those pairs, whose bits are added together
_RATE, _ADJUST = 0.6, 2.0
_LANE = 32  # sizes that are adjusted, and at least the gates
TABLES = ("before", "recent", "spell1", "spell2", "spell3", "spell5")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _words_of_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all texts (no nulls) in a row, and where those of each text start, then the end."""
    return split_ascii(pc.ascii_lower(texts.view(pa.string())))


class Tree:
    """Canonical Huffman tree of symbols 0..n-1.

    Symbols of a length stand in the order of ``rank``, so that related ones
    share branches; nodes are numbered from the root, heaviest first.  The
    branches' log ratios are those of ``seen``, if given, in place of the counts.
    """

    def __init__(self, counts: np.ndarray, rank: np.ndarray, seen: np.ndarray | None = None):
        n = len(counts)
        counts = np.maximum(counts, counts.sum() * 2.0 ** -36)  # codes stay below 60 bits
        order = np.argsort(counts, kind="stable")
        weight = counts[order].astype(np.float64).tolist() + [0.0] * (n - 1)
        parent = np.zeros(2 * n - 1, np.int64)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):  # the two lightest of two sorted queues
            for _ in (0, 1):
                if inner >= new or leaf < n and weight[leaf] <= weight[inner]:
                    low, leaf = leaf, leaf + 1
                else:
                    low, inner = inner, inner + 1
                parent[low] = new
                weight[new] += weight[low]
        depth = np.zeros(2 * n - 1, np.int64)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        self.length = np.empty(n, np.int64)
        self.length[order] = depth[:n]
        # canonical codes: each is the one before it plus one, widened to its own length
        sort = np.lexsort((rank, self.length))
        code, last, out = 0, 0, []
        for size in self.length[sort].tolist():
            code <<= size - last
            out.append(code)
            code, last = code + 1, size
        codes = np.empty(n, np.int64)
        codes[sort] = out
        which = np.repeat(np.arange(n), self.length)
        self.start = np.cumsum(self.length) - self.length
        at = np.arange(len(which)) - self.start[which]
        left = self.length[which] - at
        prefix = codes[which] >> left
        self.bit = (codes[which] >> (left - 1) & 1).astype(np.uint8)
        _, node = np.unique(prefix + (np.int64(1) << at), return_inverse=True)  # a leading one tells the depth
        mass = np.bincount(node, counts[which])
        ones = np.bincount(node, counts[which] * self.bit)
        heavy = np.argsort(-mass, kind="stable")
        number = np.empty(len(heavy), np.int32)
        number[heavy] = np.arange(len(heavy))
        self.node = number[node]
        if seen is not None:
            mass, ones = np.bincount(node, seen[which]), np.bincount(node, seen[which] * self.bit)
        self.ratio = np.log((ones + 0.5) / (mass - ones + 0.5))[heavy].astype(np.float32)

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each symbol, where each bit stands in ``node`` and ``bit``), in order."""
        length = self.length[symbols]
        ends = np.cumsum(length)
        return length, np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[symbols] - ends + length, length)

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the symbols, node, bit) of every bit, in order."""
        length, at = self.places(symbols)
        return np.repeat(np.arange(len(symbols)), length), self.node[at], self.bit[at]


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slot(context: np.ndarray, node: np.ndarray, slots: int) -> np.ndarray:
    return _hashed((context.astype(np.uint64) * np.uint64(256) + node.astype(np.uint64)) * _SPREAD, slots)


def _hashed(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(64 - slots.bit_length() + 1)).view(np.int64)


_PREPARED = ("tree", "byte_tree", "classes", "escape", "end", "own", "packed", "ratios")


@dataclass
class Model:
    """What scoring needs; all of bounded size."""

    words: dict[bytes, int]
    known: np.ndarray  # the words' and the end's counts in all training texts
    counts: np.ndarray  # of the words, then of escaped words, then of ends
    byte_counts: np.ndarray
    tables: dict[str, np.ndarray]
    weights: tuple[np.ndarray, np.ndarray]  # word and spelling: gates by predictors
    total: int  # training tokens
    distinct: int  # and how many different ones
    ready: bool = False
    seen: tuple[np.ndarray, np.ndarray] | None = None  # counts and byte counts of one half, while the other is read

    def prepare(self) -> Model:
        """Trees and classes, worked out where they are used."""
        if not self.ready:
            names = list(self.words)
            rank = np.empty(len(names) + 2, np.int64)  # the escape and the end before the words in order of their letters
            rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
            rank[-2:] = -2, -1
            seen = self.seen or (None, None)
            self.tree, self.byte_tree = Tree(self.counts, rank, seen[0]), Tree(self.byte_counts, np.arange(256), seen[1])
            self.classes = np.concatenate([_tail_classes(names), [CLASSES - 1, CLASSES - 1]])
            self.classes[:min(OWN_CLASS, len(names))] = np.arange(min(OWN_CLASS, len(names)))
            self.escape, self.end = len(self.words), len(self.words) + 1
            node = self.tree.node  # by place in the tree's codes; contexts have one column for all nodes past NODES, empty
            gate = (node >= 16).astype(np.int32) + (node >= 256) + (node >= NODES)
            self.packed = np.minimum(node, NODES) << 3 | gate << 1 | self.tree.bit  # column, gate and bit are read at once
            self.own = self.tree.ratio[node]
            self.ratios = {t: v.astype(np.float32) for t, v in self.tables.items()}
            for t in TABLES[:2]:
                if t in self.ratios:
                    self.ratios[t] = np.pad(self.ratios[t].reshape(CLASSES, NODES), ((0, 0), (0, 1))).ravel()
            self.ready = True
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in _PREPARED} | {"ready": False}

    # ---- contexts ----

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(symbols of the words and the end, escaped words)."""
        n = len(self.words)
        sym = np.fromiter(map(self.words.get, words, repeat(n)), np.int32, len(words))
        spelled = [words[k] for k in np.nonzero(sym == n)[0].tolist()]
        return np.append(sym, np.int32(n + 1)), spelled

    def contexts(self, sym: np.ndarray, sizes: np.ndarray, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts in a row: class of the word before each symbol, and of the last frequent word before that."""
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        cls = self.classes[sym]
        cls[sym == self.escape] = _tail_classes(spelled)
        here = np.arange(len(sym))
        before = np.where(here > first, np.concatenate([[0], cls[:-1]]), CLASSES - 1)
        frequent = np.maximum.accumulate(np.where(sym < OWN_CLASS, here, -1))
        at = np.concatenate([[-1, -1], frequent])[:len(sym)]
        return before, np.where(at >= first, sym[at], CLASSES - 1)

    def spelling(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(word, place in it, node, bit, contexts) of the spelling bits."""
        word, place, contexts, which, node, bit = self._spelled(spelled)
        return word[which], place[which], node, bit, [c[which] for c in contexts]

    def spelling_slots(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
        """``spelling`` with the contexts' slots in place of the contexts; ``_slot``, with what a byte's bits share worked out once."""
        word, place, contexts, which, node, bit = self._spelled(spelled)
        own = node.astype(np.uint64) * _SPREAD
        slots = (_hashed((c * np.uint64(256) * _SPREAD)[which] + own, n) for c, n in zip(contexts, SPELL_SLOTS))
        return word[which], place[which], node, bit, slots

    def _spelled(self, spelled: list[bytes]):
        """Of every byte: word, place in it, contexts; of every bit: which byte, node, bit."""
        raw = np.frombuffer(b" ".join(spelled) + b" ", np.uint8)
        sizes = np.array([len(w) + 1 for w in spelled])
        word = np.repeat(np.arange(len(spelled)), sizes)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        back = [np.where(place >= k, np.concatenate([np.full(min(k, len(raw)), 32, np.uint8), raw[:max(0, len(raw) - k)]]), 32).astype(np.uint64)
                for k in range(1, 6)]
        contexts, at = [], np.zeros(len(raw), np.uint64)
        for k, b in enumerate(back, 1):
            at = at * np.uint64(257) + b
            if k in SPELL_ORDERS:
                contexts.append(at)
        return word, place, contexts, *self.byte_tree.bits(raw.astype(np.int64))


def _tail_classes(words: list[bytes]) -> np.ndarray:
    """Classes of words by their last two bytes."""
    if not words:
        return np.empty(0, np.int64)
    raw = np.frombuffer(b" ".join(words), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(size + 1) - 2
    return OWN_CLASS + (raw[last] * 31 + raw[last - (size > 1)]) % (CLASSES - 1 - OWN_CLASS)


class _Mixer:
    """Weights and adjustments of some texts, a lane of ``_LANE`` places each."""

    def __init__(self, start: np.ndarray, lanes: int):
        self.gates, self.lanes = len(start), lanes
        self.w = np.zeros((start.shape[1], lanes, _LANE), np.float32)  # predictors by lanes and gates
        self.w[:, :, :self.gates] = start.T[:, None]
        self.w = self.w.reshape(start.shape[1], -1)
        self.adjust = np.zeros(lanes * _LANE, np.float32)
        self.nats = np.zeros(lanes)

    def weights(self) -> np.ndarray:
        return self.w.reshape(-1, self.lanes, _LANE)[:, :, :self.gates].transpose(1, 2, 0).reshape(self.lanes, -1)

    def read(self, x: np.ndarray, bit: np.ndarray, gate: np.ndarray, at: np.ndarray, edges: np.ndarray, scores: bool = True) -> None:
        """Bits by block and lane, given by where the lane starts; block b is edges[0, b]:edges[2, b], and the lanes before edges[1, b] go on and learn.

        Nats are added with ``scores``.  All indices are in range: ``clip`` only spares their check.
        """
        k = len(self.w)
        bit = bit.astype(np.float32)
        of_all = at + gate
        for a, m, b in edges.T.tolist():
            if a == b:
                continue
            of, y = of_all[a:b], bit[a:b]
            z = self.w[0].take(of, mode="clip")
            z *= x[0, a:b]
            for j in range(1, k):
                part = self.w[j].take(of, mode="clip")
                part *= x[j, a:b]
                z += part
            size = z * 2
            size += 16
            size = np.clip(size, 0, _LANE - 1, out=size).astype(np.int64)
            size += at[a:b]
            z += self.adjust.take(size, mode="clip")
            np.clip(z, -12, 12, out=z)
            odds = np.exp(np.negative(z))
            if scores:
                z *= 1 - y
                z += np.log1p(odds)
                # a block's bits stand lane by lane
                first = np.searchsorted(at[a:b], np.arange(self.lanes + 1) * _LANE)
                met = np.nonzero(np.diff(first))[0]
                self.nats[met] += np.add.reduceat(z, first[met], dtype=np.float64)
            if a == m:
                continue
            m -= a
            err, of, size = odds[:m], of[:m], size[:m]
            err += 1
            np.divide(1, err, out=err)
            np.subtract(y[:m], err, out=err)
            n = _RATE / (np.bincount(of) + 48)  # the longest texts have the first lanes, so the others need no places
            for j in range(k):
                self.w[j, :len(n)] += np.bincount(of, err * x[j, a:a + m], len(n)) * n
            n = np.bincount(size) + 48
            self.adjust[:len(n)] += (_ADJUST * np.bincount(size, err, len(n)) / n).astype(np.float32)


def _read(model: Model, sym: np.ndarray, before: np.ndarray, recent: np.ndarray, sizes: np.ndarray, spelled: list[bytes],
          mixers: tuple[_Mixer, _Mixer], goes_on: bool, scores: bool = True) -> None:
    """Read texts in a row, longest first, a lane each; with ``goes_on`` their last blocks teach as well, with ``scores`` nats are added."""
    n = len(sizes)
    lane = np.repeat(np.arange(n), sizes)
    block = (np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // BLOCK
    blocks = np.arange(int(block.max()) + 1)
    learn = np.full(len(blocks), n) if goes_on else np.searchsorted(-sizes, -(blocks + 1) * BLOCK, "left")
    marks = np.stack([blocks * n, blocks * n + learn, (blocks + 1) * n])
    order = np.argsort(block, kind="stable")
    key = (block * n + lane)[order]
    length, at = model.tree.places(sym[order])
    x = np.empty((3, len(at)), np.float32)
    model.own.take(at, out=x[0], mode="clip")
    packed = model.packed.take(at, mode="clip")
    column = packed >> 3
    for j, context in ((1, before), (2, recent)):
        where = np.repeat(context[order] * (NODES + 1), length)
        where += column
        model.ratios[TABLES[j - 1]].take(where, out=x[j], mode="clip")
    upto = np.concatenate([[0], np.cumsum(length)])
    mixers[0].read(x, packed & 1, packed >> 1 & 3, np.repeat(lane[order] * _LANE, length), upto[np.searchsorted(key, marks)], scores)

    if spelled:
        escaped = sym == model.escape
        which = (np.cumsum(escaped) - 1)[order][escaped[order]]
        key = key[escaped[order]]
        word, place, node, bit, slots = model.spelling_slots([spelled[k] for k in which.tolist()])
        x = np.empty((5, len(node)), np.float32)
        model.byte_tree.ratio.take(node, out=x[0], mode="clip")
        for j, slot in enumerate(slots, 1):
            model.ratios[TABLES[j + 1]].take(slot, out=x[j], mode="clip")
        gate = (x[3] != 0) + 2 * (x[4] != 0)
        gate[place == 0] = 4
        mixers[1].read(x, bit, gate, (key % n * _LANE).take(word, mode="clip"), np.searchsorted(word, np.searchsorted(key, marks)), scores)


def score_texts(model: Model, texts: list[tuple[np.ndarray, list[bytes]]], *, tuning: bool = False, scores: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nats, word weights, spelling weights) of each text, given as its symbols and escaped words.

    The weights are those at the end of the text if ``tuning``, else those
    before its last block.  Without ``scores`` the nats are left at 0.
    """
    n = len(texts)
    size = np.array([len(s) for s, _ in texts])
    nats, weights = np.zeros(n), [np.zeros((n, w.size), np.float32) for w in model.weights]
    order = np.argsort(-size, kind="stable").tolist()
    while order:
        some, left = [order[0]], size[order[0]]
        if left <= _TOGETHER:
            for k in order[1:]:
                if left + size[k] > _TOGETHER:
                    break
                some.append(k)
                left += size[k]
        order = order[len(some):]
        mixers = tuple(_Mixer(w, len(some)) for w in model.weights)
        sym = np.concatenate([texts[k][0] for k in some])
        spelled = [w for k in some for w in texts[k][1]]
        before, recent = model.contexts(sym, size[some], spelled)
        if len(some) > 1:
            _read(model, sym, before, recent, size[some], spelled, mixers, tuning, scores)
        else:  # a stretch at a time, each by what the ones before it taught
            escapes = np.concatenate([[0], np.cumsum(sym == model.escape)])
            for a in range(0, len(sym), _TOGETHER):
                b = min(a + _TOGETHER, len(sym))
                _read(model, sym[a:b], before[a:b], recent[a:b], np.array([b - a]), spelled[escapes[a]:escapes[b]], mixers, tuning or b < len(sym), scores)
        nats[some] = mixers[0].nats + mixers[1].nats
        for w, mixer in zip(weights, mixers):
            w[some] = mixer.weights()
    return nats, *weights


def _few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that little of them is copied at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


# ---- streams ------------------------------------------------------------

def streams(rows: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """The rows with their text (binary) made symbols, written.

    row (a number of its own), the other columns, size (bytes of the words and
    one each), symbols (32-bit integers, with the end), spelled (words that
    have no symbol, space-joined).
    """
    names_of = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(words)
    schema = StructType([StructField("row", LongType()), *(rows.schema[c] for c in names_of), StructField("size", LongType()),
                         StructField("symbols", BinaryType()), StructField("spelled", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, n = shared.value.get, len(shared.value)
        row = TaskContext.get().partitionId() << 40
        for b in _few(batches, 2048):
            words, upto = _words_of_all(b["text"])
            met = words.dictionary_encode()  # a word is looked up once, however often it stands in the texts
            names = met.dictionary.to_numpy(zero_copy_only=False).tolist()
            sym = np.fromiter(map(get, names, repeat(n)), np.int32, len(names))[met.indices.to_numpy()]
            rare = sym == n
            of_rare = pa.array(np.concatenate([[0], np.cumsum(rare)])[upto], pa.int32())
            spelled = pc.binary_join(pa.ListArray.from_arrays(of_rare, words.filter(pa.array(rare)).view(pa.string())), " ").view(pa.binary())
            length = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)])[upto]
            ended = np.insert(sym, upto[1:], np.int32(n + 1))
            cuts = (4 * (upto + np.arange(len(upto)))).astype(np.int32)
            symbols = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(ended)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + b.num_rows)), *(b[c] for c in names_of), pa.array(np.diff(length) + np.diff(upto), pa.int64()),
                 symbols, spelled], schema.names)
            row += b.num_rows

    return written(rows.transform(in_arrow, run, schema), "streams")


def _unpacked(b: pa.RecordBatch) -> list[tuple[np.ndarray, list[bytes]]]:
    return [(np.frombuffer(s, np.int32), w.split(b" ") if w else [])
            for s, w in zip(b["symbols"].to_pylist(), b["spelled"].to_pylist())]


# ---- learning -----------------------------------------------------------

def _word_counts(train: DataFrame) -> DataFrame:
    """word (binary), c (all training texts), m (those of the first half)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []  # words, and which stand in texts of the second half
        tokens = 0

        def out() -> pa.RecordBatch:
            met = pa.chunked_array([w for w, _ in held], pa.binary()).combine_chunks().dictionary_encode()
            of, names = met.indices.to_numpy(), met.dictionary
            c, n = (np.bincount(k, minlength=len(names)) for k in (of, of[np.concatenate([s for _, s in held])]))
            held.clear()
            return pa.RecordBatch.from_arrays([names, pa.array(c, pa.int64()), pa.array(c - n, pa.int64())], ["word", "c", "m"])

        for b in _few(batches):
            words, upto = _words_of_all(b["text"])
            held.append((words, np.repeat(b["second"].to_numpy(zero_copy_only=False).astype(bool), np.diff(upto))))
            tokens += len(words)
            if tokens >= _TOKENS:
                yield out()
                tokens = 0
        if held:
            yield out()

    return train.transform(in_arrow, run, "word binary, c long, m long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


_BRANCH = "name int, chunk int, slots binary, counts binary"


def _met(sums: Iterable[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of _BRANCH from sums (name, first chunk, counts by slot): the slots of
    a chunk that were met (16 bits), how often 0 and how often 1 (64 bits)."""
    rows: list[tuple[int, int, bytes, bytes]] = []

    def out() -> pa.RecordBatch:
        name, chunk, slots, counts = zip(*rows)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(chunk, pa.int32()), pa.array(slots, pa.binary()),
                                           pa.array(counts, pa.binary())], ["name", "chunk", "slots", "counts"])

    for name, first, total in sums:
        for k, part in enumerate(total.reshape(-1, _CHUNK, 2), first):
            met = np.nonzero(part.any(axis=1))[0]
            if len(met):
                rows.append((name, k, met.astype(np.uint16).tobytes(), part[met].tobytes()))
            if len(rows) == 64:
                yield out()
    if rows:
        yield out()


def _contexts(stream: DataFrame, model) -> DataFrame:
    """Branches of the word contexts, over the streams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value.prepare()
        sums = [(k, np.zeros(2 * CLASSES * NODES)) for k in (0, 1)]
        symbols = len(m.words) + 2
        held: list[tuple[np.ndarray, list[bytes]]] = []

        def count() -> None:
            sizes = np.array([len(s) for s, _ in held])
            sym = np.concatenate([s for s, _ in held])
            contexts = m.contexts(sym, sizes, [w for _, ws in held for w in ws])
            for context, (_, total) in zip(contexts, sums):
                pair, n = np.unique(context.astype(np.int64) * symbols + sym, return_counts=True)
                for a in range(0, len(pair), _STRETCH):  # what is made for a stretch stays in the caches
                    group, symbol = np.divmod(pair[a:a + _STRETCH], symbols)
                    length, at = m.tree.places(symbol)
                    packed = m.packed.take(at)
                    column = packed >> 3
                    keep = np.nonzero(column < NODES)[0]
                    place = np.repeat(group * NODES, length)
                    place += column
                    place *= 2
                    place += packed & 1
                    np.add.at(total, place.take(keep), np.repeat(n[a:a + _STRETCH].astype(np.float64), length).take(keep))
            held.clear()

        tokens = 0
        for b in _few(batches):
            for s in _unpacked(b):
                held.append(s)
                tokens += len(s[0])
                if tokens >= _PAIRS:
                    count()
                    tokens = 0
        if held:
            count()
        yield from _met((k, 0, total) for k, total in sums)

    return stream.select("symbols", "spelled").transform(in_arrow, run, _BRANCH)


def _spellings(vocabulary: DataFrame, model) -> DataFrame:
    """Branches of the spelling contexts, over the words that are spelled, by their counts n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value.prepare()
        sums = [(j, np.zeros(2 * n)) for j, n in enumerate(SPELL_SLOTS, 2)]
        for b in batches:
            rows = [(w, c) for w, c in zip(b["word"].to_pylist(), b["n"].to_pylist()) if w not in m.words]
            for at in range(0, len(rows), 10_000):
                some = rows[at:at + 10_000]
                word, _, _, bit, slots = m.spelling_slots([w for w, _ in some])
                weight = np.array([c for _, c in some], np.float64)[word]
                for slot, (_, total) in zip(slots, sums):
                    np.add.at(total, 2 * slot + bit, weight)
        yield from _met((k, 0, total) for k, total in sums)

    return vocabulary.transform(in_arrow, run, _BRANCH)


def _summed(branches: DataFrame, finish=_met, schema: str = _BRANCH) -> DataFrame:
    """The branches' chunks, added.

    A task adds rows as they come; it holds the chunks that meet in it, the
    size of all tables at most, however many tasks sent them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in _few(batches, 64):
            for name, chunk, slots, counts in zip(*(b[c].to_pylist() for c in ("name", "chunk", "slots", "counts"))):
                total = sums.setdefault((name, chunk), np.zeros((_CHUNK, 2)))
                total[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts).reshape(-1, 2)
        yield from finish((name, chunk, total) for (name, chunk), total in sums.items())

    return branches.repartition("name", "chunk").transform(in_arrow, run, schema)


def _ratios(sums: Iterable[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Log ratios of chunks (16 bits a slot), 0 where a slot was never met."""
    for name, chunk, total in sums:
        zero, one = total.T
        ratio = np.log((one + 0.4) / (zero + 0.4)).astype(np.float32).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([chunk], pa.int32()), pa.array([ratio.tobytes()], pa.binary())],
                                         ["name", "chunk", "data"])


def _tables(branches: DataFrame) -> dict[str, np.ndarray]:
    """Log ratios by slot, of all tables; their sizes are fixed."""
    out = {t: np.zeros(n, np.float16) for t, n in zip(TABLES, (CLASSES * NODES,) * 2 + SPELL_SLOTS)}
    for r in _summed(branches, _ratios, "name int, chunk int, data binary").collect():  # at most the slots of all tables, two bytes each
        out[TABLES[r["name"]]][r.chunk * _CHUNK:(r.chunk + 1) * _CHUNK] = np.frombuffer(r.data, np.float16)
    return out


def fit(documents: DataFrame, train: Column, *, words: int = WORDS) -> tuple[Model, DataFrame]:
    """(model, vocabulary) from the rows where ``train`` holds; vocabulary: word, c of all training words."""
    return learn(documents, train, words=words)[:2]


def learn(documents: DataFrame, train: Column, *, words: int = WORDS) -> tuple[Model, DataFrame, DataFrame]:
    """``fit``, and the streams of all ``documents``, which ``score_streams`` takes."""
    every_row = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
                                 F.coalesce(F.xxhash64("doc_id") % 2 != 0, F.lit(False)).alias("second"))
    rows = every_row.where("train").select("text", "second")
    vocabulary = written(_word_counts(rows), "vocabulary")
    n_docs, n_second = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("second").cast("long")), F.lit(0))).first()
    total, distinct, in_first = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    often = vocabulary.where(F.col("c") >= LEAST_COUNT)
    # how many words have each count says from which count on there are at most that many
    upto = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    least = often.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", F.sum("n").over(upto).alias("n")) \
        .where(F.col("n") <= words).agg(F.min("c")).first()[0]
    top = sorted(often.where(F.col("c") >= least).collect(), key=lambda r: (-r.c, bytes(r.word))) if least else []

    def counts(of, tokens: int, docs: int) -> np.ndarray:
        known = [of(r) for r in top]
        return np.maximum(np.array(known + [tokens - sum(known), docs], np.float64), 0.5)

    model = Model({bytes(r.word): k for k, r in enumerate(top)}, np.array([r.c for r in top] + [n_docs], np.float64),
                  counts(lambda r: r.c, total, n_docs), np.ones(256),
                  {},
                  (np.tile(np.array([0.4, 0.4, 0.4], np.float32), (WORD_GATES, 1)), np.tile(np.array([0.1, 0.2, 0.3, 0.4, 0.4], np.float32), (SPELL_GATES, 1))),
                  total + n_docs, distinct + (n_docs > 0))
    stream = streams(every_row, model.words)
    c, m = F.col("c"), F.col("m")
    every, first, second = (_byte_counts(vocabulary.select("word", n.alias("n")), set(model.words)) for n in (c, m, c - m))
    model.byte_counts = every
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(model)

    def branches(texts: Column, n: Column) -> DataFrame:
        return _contexts(stream.where(F.col("train") & texts), shared).unionAll(
            _spellings(vocabulary.select("word", n.alias("n")).where("n > 0"), shared))

    # each half is read by what the other taught, then both count
    halves = [written(_summed(branches(~F.col("second"), m)), "branches"), written(_summed(branches(F.col("second"), c - m)), "branches")]
    seen = [(counts(lambda r: r.m, in_first, n_docs - n_second), first), (counts(lambda r: r.c - r.m, total - in_first, n_second), second)]
    ends = [_ended(stream.where(F.col("train") & other), context.broadcast(replace(model, tables=_tables(half), seen=taught, ready=False)))
            for half, taught, other in zip(halves, seen, (F.col("second"), ~F.col("second")))]
    model = replace(model, tables=_tables(halves[0].unionAll(halves[1])), weights=_mean_weights(ends[0].unionAll(ends[1]), model.weights), ready=False)
    return model, vocabulary, stream.drop("train", "second")


def _byte_counts(vocabulary: DataFrame, known: set[bytes]) -> np.ndarray:
    """How often each byte stands in the words that are spelled, and the space behind them; 1 at least."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(256)
        for b in batches:
            rows = [(w, c) for w, c in zip(b["word"].to_pylist(), b["n"].to_pylist()) if c and w not in shared.value]
            if rows:
                raw = np.frombuffer(b" ".join([w for w, _ in rows]) + b" ", np.uint8)
                sums += np.bincount(raw, np.repeat([float(c) for _, c in rows], [len(w) + 1 for w, _ in rows]), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(sums)], ["byte", "n"])

    out = np.ones(256)
    for r in vocabulary.transform(in_arrow, run, "byte long, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] += r.n
    return out


def _ended(stream: DataFrame, shared) -> DataFrame:
    """place, total: the weights that the texts end with, summed by the root of their length; place -1 holds the roots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            for some in _few([b]):
                texts = _unpacked(some)
                root = np.sqrt([len(t) for t, _ in texts])[:, None]
                _, w, s = score_texts(shared.value.prepare(), texts, tuning=True, scores=False)
                more = np.rint(np.hstack([np.ones_like(root), w, s]) * root * _FIXED).astype(np.int64).sum(axis=0)
                sums = more if sums is None else sums + more
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums) - 1)), pa.array(sums)], ["place", "total"])

    return stream.select("symbols", "spelled").transform(in_arrow, run, "place long, total long")


def _mean_weights(ends: DataFrame, start: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the weights that texts end with, by the root of their length; ``start`` without texts."""
    got = {r.place: r.total for r in ends.groupBy("place").agg(F.sum("total").alias("total")).collect()}  # a row a weight
    if not got:
        return start
    mean = np.array([got[k] for k in range(len(got) - 1)], np.float64) / got[-1]
    return tuple(part.reshape(w.shape).astype(np.float32) for part, w in zip(np.split(mean, [start[0].size]), start))


# ---- scoring ------------------------------------------------------------

def score(documents: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (both log10), bits_per_byte of every row."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return score_streams(streams(rows, model.words), model, vocabulary)


def score_streams(rows: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """``score`` of texts given as their streams.

    Words beyond the model's are counted by a join with the vocabulary.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.prepare()
        seen = np.log10(np.concatenate([m.known[:-1], [0.0, m.known[-1]]]) + 0.1)
        seen[m.escape] = 0
        knows = np.ones(len(seen), np.int64)
        knows[m.escape], knows[m.end] = 0, m.known[-1] > 0
        for b in _few(batches):
            texts = _unpacked(b)
            nats, _, _ = score_texts(m, texts)
            rare = [Counter(w) for _, w in texts]
            offsets = pa.array(np.cumsum([0] + [len(r) for r in rare]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b["row"], b["doc_id"], pa.array([len(s) for s, _ in texts], pa.int64()),
                 pa.array([int(knows[s].sum()) for s, _ in texts], pa.int64()),
                 pa.array([float(seen[s].sum()) for s, _ in texts]), pa.array(-nats / math.log(10)), b["size"],
                 pa.ListArray.from_arrays(offsets, pa.array([w for r in rare for w in r], pa.binary())),
                 pa.ListArray.from_arrays(offsets, pa.array([n for r in rare for n in r.values()], pa.int64()))],
                ["row", "doc_id", "n_tokens", "n_known", "base", "score", "size", "words", "times"])

    sums = StructType([StructField("row", LongType()), rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("n_known", LongType()),
                       StructField("base", DoubleType()), StructField("score", DoubleType()), StructField("size", LongType())])
    found = written(rows.transform(in_arrow, run, StructType(sums.fields + [StructField("words", ArrayType(BinaryType())), StructField("times", ArrayType(LongType()))])), "scored")
    rare = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", F.col("r.words").alias("word"), F.col("r.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(vocabulary.select("word", "c"), "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * F.log10(c + 0.1)).alias("base"))
    nothing = {"doc_id": F.lit(None).cast(rows.schema["doc_id"].dataType), "n_tokens": F.lit(0), "score": F.lit(0.0), "size": F.lit(0)}
    both = found.select(*sums.names).unionByName(rare.withColumns(nothing).select(*sums.names))
    each = math.log10(model.total + 0.1 * (model.distinct + 1))
    return both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(k).alias(k) for k in sums.names[2:]]).select(
        "doc_id", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / (F.col("size") + 1)).alias("bits_per_byte"))
