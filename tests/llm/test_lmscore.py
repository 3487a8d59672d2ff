"""LM scores: base counts against brute force, a proper distribution, held-out gain, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from calibra.llm import lmscore
from calibra.llm.queries import QUERIES

from tests.conftest import SF01


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_base_and_held_out_gain(spark):
    docs = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(t for i, ts in docs.items() if i not in held for t in ts)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op4_lm_score"](spark, SF01).collect()}
    assert set(got) == set(docs)
    for i, ts in docs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ts), sum(t in c for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert r.score < 0
    # the table is small; the model comes near the base, which spends nothing on how unknown words are spelled
    assert sum(got[i].score for i in held) > 1.1 * sum(got[i].base_score for i in held)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_trees_are_prefix_codes():
    rng = np.random.default_rng(0)
    for counts in ([1, 1], [5, 1, 1, 9], rng.integers(1, 10**9, 3000).tolist(), [2.0**k for k in range(55)]):
        tree = lmscore.Tree(np.array(counts, float), np.arange(len(counts))[::-1])
        assert math.isclose(sum(2.0 ** -tree.length), 1)
        paths = {tuple(zip(*(a.tolist() for a in tree.bits(np.array([k]))[1:]))) for k in range(len(counts))}
        assert len(paths) == len(counts)
        heads = {p[:d] for p in paths for d in range(len(p))}
        assert not heads & paths
        assert all(p[0][0] == 0 for p in paths)  # the root is the heaviest


def test_probabilities_add_up(spark):
    """All texts of one word, over a closed set: what is spelled and what has a symbol share one distribution."""
    docs = spark.createDataFrame([(i, "aa ab aa ba aa ab bb" + " aa" * (i % 5)) for i in range(60)], "doc_id long, text string")
    model, _ = lmscore.fit(docs, F.lit(True))
    texts = [[]] + [[w] for w in model.words] + [[bytes([a, b])] for a in range(33, 127) for b in range(33, 127) if bytes([a, b]) not in model.words] \
        + [[bytes([a])] for a in range(33, 127)]
    model.prepare()
    nats = lmscore.score_texts(model, [model.symbols(t) for t in texts])[0]
    assert 0 < np.exp(-nats).sum() <= 1 + 1e-6


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "a b a"), (4, "Word of it " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    model, vocabulary = lmscore.fit(docs, F.coalesce(F.col("doc_id") != 4, F.lit(False)))
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in lmscore.score(docs, model, vocabulary).collect())
    assert got == [(0, 4, 4), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 180_001, 1)]
    empty, vocabulary = lmscore.fit(docs, F.lit(False))
    bare = {r.doc_id: r for r in lmscore.score(docs, empty, vocabulary).collect()}
    assert bare[2].base_score == 0 and bare[3].n_known == 0 and bare[3].score < 0
    assert lmscore.score(docs.where("false"), model, vocabulary).count() == 0


def plain_mix(start, bits, block_of):
    """Nats of bits (predictors, bit, gate), one at a time; what a block taught is applied behind it."""
    w, adjust, nats = start.astype(float).copy(), [0.0] * 32, 0.0
    for b in sorted(set(block_of)):
        of_gate, of_size = {}, {}
        for (x, bit, gate), at in zip(bits, block_of):
            if at != b:
                continue
            z = sum(a * c for a, c in zip(x, w[gate]))
            size = int(min(max(z * 2 + 16, 0), 31))
            z = min(max(z + adjust[size], -12), 12)
            p = 1 / (1 + math.exp(-z))
            nats -= math.log(p if bit else 1 - p)
            of_gate.setdefault(gate, []).append([(bit - p) * v for v in x])
            of_size.setdefault(size, []).append(bit - p)
        for gate, steps in of_gate.items():
            w[gate] += lmscore._RATE * np.sum(steps, axis=0) / (len(steps) + 48)
        for size, steps in of_size.items():
            adjust[size] += lmscore._ADJUST * sum(steps) / (len(steps) + 48)
    return nats


def test_score_equals_reading_bit_by_bit(spark, monkeypatch):
    """Texts shorter than a block, of several, and longer than what is read at once."""
    monkeypatch.setattr(lmscore, "BLOCK", 8)
    rng = np.random.default_rng(5)
    names = ["w%d" % k for k in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(names, 30).tolist())) for i in range(80)], "doc_id long, text string")
    model, _ = lmscore.fit(docs, F.lit(True))
    model.prepare()
    texts = [[w.encode() for w in rng.choice(names + ["new", "w99x"], n).tolist()] for n in (0, 1, 5, 7, 8, 9, 20, 33, 300)]
    want = []
    for words in texts:
        sym, spelled = model.symbols(words)
        before, recent = [lmscore.CLASSES - 1], []
        for w, s in zip(words, sym):
            before.append(int(lmscore._tail_classes([w])[0]) if s == model.escape else int(model.classes[s]))
        for k in range(len(sym)):
            frequent = [int(s) for s in sym[:max(0, k - 1)] if s < lmscore.OWN_CLASS]
            recent.append(frequent[-1] if frequent else lmscore.CLASSES - 1)
        bits, block = [], []
        for k, s in enumerate(sym):
            for node, bit in zip(*(a.tolist() for a in model.tree.bits(np.array([s]))[1:])):
                deep = node >= lmscore.NODES
                x = [float(model.tree.ratio[node])] + [0.0 if deep else float(model.tables[t][c * lmscore.NODES + node])
                                                      for t, c in (("before", before[k]), ("recent", recent[k]))]
                bits.append((x, bit, (node >= 16) + (node >= 256) + deep))
                block.append(k // lmscore.BLOCK)
        nats = plain_mix(model.weights[0], bits, block)
        bits, block = [], []
        at = [k for k, s in enumerate(sym) if s == model.escape]
        for k, w in zip(at, spelled):
            _, place, node, bit, contexts = model.spelling([w])
            for j in range(len(node)):
                x = [float(model.byte_tree.ratio[node[j]])] + [
                    float(model.tables[t][lmscore._slot(c[j:j + 1], node[j:j + 1], n)[0]])
                    for t, c, n in zip(lmscore.TABLES[2:], contexts, lmscore.SPELL_SLOTS)]
                bits.append((x, int(bit[j]), 4 if place[j] == 0 else (x[3] != 0) + 2 * (x[4] != 0)))
                block.append(k // lmscore.BLOCK)
        want.append(nats + plain_mix(model.weights[1], bits, block))
    symbols = [model.symbols(t) for t in texts]
    for together in (1 << 16, 64, 16):
        monkeypatch.setattr(lmscore, "_TOGETHER", together)
        for tuning in (False, True):
            assert np.allclose(lmscore.score_texts(model, symbols, tuning=tuning)[0], want, rtol=1e-4)


def test_streams_hold_every_word_once(spark):
    texts = ["One two  three\n" * 40, None, "", "x" * 300, " y "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    words = {b"one": 0, b"three": 1}
    got = {r.doc_id: r for r in lmscore.streams(rows, words).collect()}
    assert len({r.row for r in got.values()}) == len(texts)
    for k, t in enumerate(texts):
        want = lmscore.words_of((t or "").encode())
        sym, spelled = np.frombuffer(got[k].symbols, np.int32).tolist(), iter(bytes(got[k].spelled).split())
        assert sym.pop() == 3 and [{0: b"one", 1: b"three"}.get(x) or next(spelled) for x in sym] == want and not list(spelled)
        assert got[k].size == sum(map(len, want)) + len(want)


def test_few_documents_teach_and_all_count(spark):
    docs = spark.createDataFrame([(i, "the green river walks by the old house " * 3) for i in range(40)], "doc_id long, text string")
    model, vocabulary = lmscore.fit(docs, F.lit(True))
    assert set(model.words) == set(b"the green river walks by old house".split())
    assert model.counts[model.words[b"the"]] == 240 and model.counts[-1] == 40  # tuning documents too
    assert np.count_nonzero(model.tables["before"]) and model.seen is None
    one, _ = lmscore.fit(docs.where("doc_id = 0"), F.lit(True))
    assert one.counts[one.words[b"the"]] == 6
    bits = {r.doc_id: r.bits_per_byte for r in lmscore.score(docs, model, vocabulary).collect()}
    assert max(bits.values()) < 1


def test_start_weights_come_from_every_training_text(spark):
    text = lambda k: " ".join(f"w{(k * i) % 7}" for i in range(60))
    docs = spark.createDataFrame([(k, text(k + 1)) for k in range(6)], "doc_id long, text string")
    model, _ = lmscore.fit(docs, F.lit(True))
    other, _ = lmscore.fit(docs.where("doc_id <> 5"), F.lit(True))
    assert not np.allclose(model.weights[0], 0.4) and not np.allclose(model.weights[0], other.weights[0], atol=1e-7)


def test_slots_of_spelling_equal_those_of_its_contexts():
    """What a byte's bits share is worked out once, and paths read columns, gates and bits at once."""
    names = [b"w%d" % k for k in range(3000)]
    counts = np.arange(3002, 0, -1).astype(float)
    model = lmscore.Model(dict(zip(names, range(3000))), np.ones(3001), counts, np.arange(1.0, 257.0), {}, (np.zeros((4, 3)), np.zeros((5, 5))), 1, 1).prepare()
    spelled = [b"a", b"some", "ünd".encode(), b"\xff\x00long-word"]
    word, place, node, bit, contexts = model.spelling(spelled)
    got = model.spelling_slots(spelled)
    assert all((a == b).all() for a, b in zip((word, place, node, bit), got))
    for slots, context, n in zip(got[4], contexts, lmscore.SPELL_SLOTS, strict=True):
        assert (slots == lmscore._slot(context, node, n)).all() and slots.max() < n
    node = model.tree.node
    assert (model.packed >> 3 == np.minimum(node, lmscore.NODES)).all() and (model.packed & 1 == model.tree.bit).all()
    assert ((model.packed >> 1 & 3) == np.searchsorted([16, 256, lmscore.NODES], node, "right")).all()


def test_tuning_reads_weights_without_adding_nats(spark):
    docs = spark.createDataFrame([(i, "the green river walks by the old house " * 3) for i in range(40)], "doc_id long, text string")
    model, _ = lmscore.fit(docs, F.lit(True))
    model.prepare()
    texts = [model.symbols(t.split()) for t in (b"the old river", b"", b"a new house by the old one " * 40)]
    want, got = lmscore.score_texts(model, texts, tuning=True), lmscore.score_texts(model, texts, tuning=True, scores=False)
    assert want[0].all() and not got[0].any()
    assert all((a == b).all() for a, b in zip(want[1:], got[1:], strict=True))


def test_words_of_all_texts_are_those_of_each():
    texts = [b"One two\x0bTHREE\n", b"", "É İX \x1c y".encode(), b"  ", b"\xff\xfeA b"]
    words, upto = lmscore._words_of_all(pa.array(texts, pa.binary()))
    words = words.to_pylist()
    assert [words[a:b] for a, b in zip(upto, upto[1:])] == [lmscore.words_of(t) for t in texts]
