"""Toxicity: automaton against edit distances, held-out labels, quotation, odd rows."""

import math
import random
import zlib

from calibra.llm import toxicity
from calibra.llm.queries import QUERIES

from tests.conftest import SF01


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = ["bad", "fool", "idiot", "clown", "clowns", "worthless", "pathetic", "disgusting"]
    m = toxicity.Matcher(dict.fromkeys(terms, 1.0), {})
    words = set(terms)
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randrange(4)):
                k, op = rng.randrange(len(w) + 1), rng.randrange(3)
                if op == 0:
                    w.insert(k, rng.choice("abcdiostx"))
                elif w and op == 1:
                    w.pop(min(k, len(w) - 1))
                elif w:
                    w[min(k, len(w) - 1)] = rng.choice("abcdiostx")
            words.add("".join(w))
    for w in words - {""}:
        near = [(d, t) for t in terms if (d := distance(w, t)) <= toxicity._edits(t)]
        assert m.match(w) == ((min(near)[1], min(near)[0]) if near else None), w


def test_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SF01).collect()}
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    assert sum(y == p for y, p in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_misspelt_and_quoted(spark):
    rng = random.Random(1)
    common = ["the", "of", "and", "house", "river", "table", "green", "walk", "clock"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(common) + rng.choice(["", "s", "ing"]) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "worthless"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"idiot", "moron", "worthless"} <= set(model.terms)
    tests = [(1, "walk the river you id1ot of the table"), (2, 'they wrote the word "idiot" of the table'),
             (3, "walk of the green clock"), (4, None), (5, ""), (6, "a wortless table"), (None, "you moron"), (None, "you moron"),
             (7, "house " * 60000 + "moron")]  # the last only has to come through
    got = {(r.doc_id, round(r.score, 6)) for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    by = {i: s for i, s in got}
    assert min(by[1], by[6], by[None]) > 0.5 > max(by[2], by[3], by[4], by[5]) and by[3] == by[4] == by[5]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_misspelt_within_a_learned_stem(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "house", "river", "table", "green", "walk", "clock"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(common) + rng.choice(["", "s", "ing"]) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["worthless", "wortling", "wortmonger", "wortish"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("worthless".startswith(s) for s in model.stems)
    m = model.matcher()
    assert m.match("w0rthless") == ("worthless", 1) and m.match("vortling") == ("wortling", 1)
    assert m.match("worthless") == ("worthless", 0) and m.match("wortful")[1] == 0
    assert model.score(m.features("walk the river you w0rthless of the table")) > 0.5 > model.score(m.features("walk the river of the table"))


def test_quotations_of_any_length():
    m = toxicity.Matcher({"moron": 1.0}, {})
    far = "house river " * 40  # 480 letters

    def quoted(text):
        return [h["quoted"] for h in m.hits(text)]

    assert quoted(f'he "{far} moron {far}" walks') == [True]
    assert quoted(f'he "{far}" moron {far} "river"') == [False]
    assert quoted(f'a "b" {far} "c moron d" moron "e"') == [True, False]
    assert quoted('he "walks\nmoron" home') == [False]  # not closed on the line
    for a, b in ("“”", "«»", "„“", "‘’"):
        assert quoted(f"x {a}{far} moron {far}{b} moron") == [True, False]
    assert quoted("„house“ moron „river“ “moron”") == [False, True]
    assert quoted("the ‘river’s moron’ moron") == [True, False]  # an apostrophe closes nothing
    assert quoted('"' * 30_000 + "moron") == [False]


def test_score_is_the_logistic_of_plain_sums():
    model = toxicity.Model({"moron": 2.0, "worthless": 3.0}, {}, frozenset(), (-2.0, 1.5, -0.5, 0.25))
    m = model.matcher()
    text = "you moron walk by the green house and the river by the old table of the house " + "a w0rthless clock " + "river " * 12 + '"moron"'
    n = len(text.split())
    abuse = 2.0 * 1.25 + 3.0 * 0.8
    features = (math.log1p(abuse), math.log1p(2.0), math.log1p(100 * abuse / n))
    assert all(math.isclose(a, b) for a, b in zip(m.features(text), features))
    z = -2.0 + 1.5 * features[0] - 0.5 * features[1] + 0.25 * features[2]
    assert math.isclose(model.score(m.features(text)), 1 / (1 + math.exp(-z)))
