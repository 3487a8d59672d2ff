"""Quality rules: base counts against plain definitions, held-out verdicts, odd rows."""

import random
import re

import numpy as np

from calibra.llm import quality
from calibra.llm.queries import QUERIES

from tests.conftest import SF01


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(words) < 400 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if hit is None else len(hit)]


def test_base_counts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, SF01).collect()}
    assert len(got) == len(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    for d in docs:
        r, want = got[d.doc_id], brute_counts(d.text)
        have = [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words]
        assert have[:4] == want[:4]
        assert want[4] in (None, have[4])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    judged = [r for r in got.values() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == (labels[r.doc_id] == 1) for r in judged]) > 0.9


def test_repeats_of_many_words():
    rng = random.Random(2)
    for distinct in (2, 40, 9000):
        words = [b"w%d" % rng.randrange(distinct) for _ in range(300)]
        words += words[50:60] + [b"end"]
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        want = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert quality.repeated(words) == len(want)
    assert quality.repeated([b"w%d" % i for i in range(20000)] * 2) == 40000  # too many words to number a window at once


def test_decision_list_finds_planted_rules():
    rng = np.random.default_rng(3)
    x = rng.random((6000, 3))
    y = ~((x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95))
    rules = quality.learn(x[:4000], y[:4000], ["a", "b", "c"])
    bad = np.zeros(2000, bool)
    for r in rules.rules:
        bad |= quality._holds(list(r), x[4000:], ["a", "b", "c"])
    assert rules.label == 0 and (bad == ~y[4000:]).mean() > 0.97
    assert quality.learn(x, np.ones(6000), ["a", "b", "c"]).rules == ()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\n "), (None, "a b"), (5, "a b"), (5, "a b"), (6, "x y z\n" * 30000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, n_words double")
    stats = quality.measured(docs)
    assert stats.count() == 7
    got = {r.doc_id: r for r in stats.collect()}
    assert (got[6].n_words, got[6].n_dup_lines, got[6].n_repeat_words) == (90000, 29999, 90000)
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rules = quality.fit(stats, labels)
    assert rules.rules == () and rules.default == 1
    assert quality.fit(stats, labels.where("false")).default == 1
    assert stats.where("false").withColumn("v", rules.verdict()).count() == 0


def test_rows_that_repeat_an_id_teach_as_one_whole_row(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "learn", lambda x, y, names: seen.update(x=x.tolist(), y=y.tolist()))
    rows = [(1, *[float(k == 0) for k in range(len(quality.STATISTICS))]), (1, *[float(k == 1) for k in range(len(quality.STATISTICS))])]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"`{c}` double" for c in quality.STATISTICS))
    quality.fit(stats, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert seen["x"] in ([list(rows[0][1:])], [list(rows[1][1:])]) and seen["y"] == [True]


def test_covering_ends_by_itself_and_the_conditions_are_its_rules(spark):
    """Forty planted stripes take more rules than any fixed few; verdicts equal the rules applied row by row."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.random(12_000) * 40, rng.random(12_000)])
    y = ~((x[:, 0] % 1 < 0.5) & (x[:, 1] < 0.9))
    rules = quality.learn(x, y, ["a", "b"])
    assert all(rules.rules) and len(rules.rules) < 12_000 / quality.LEAST_COVER
    some = x[:500]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(some)], "i long, a double, b double")
    got = {r.i: r.v for r in df.select("i", rules.verdict().alias("v")).collect()}
    for i, row in enumerate(some):
        value = dict(zip("ab", row))
        hit = any(all(value[c.name] >= c.cut if c.above else value[c.name] < c.cut for c in rule) for rule in rules.rules)
        assert got[i] == (rules.label if hit else rules.default)
    assert spark.range(1).select(quality.DecisionList((), 0, 1).verdict().alias("v")).first().v == 1
