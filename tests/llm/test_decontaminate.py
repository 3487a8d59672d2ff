"""Decontamination against brute force, windows of every length, odd rows."""

import random

import pytest

from calibra.llm import decontaminate
from calibra.llm.queries import QUERIES

from tests.conftest import SF001
from tests.llm.test_pipeline import item_words


def brute(docs, items):
    out = []
    for i, text in docs:
        words, hit, found = item_words(text), set(), set()
        for item_id, t in items:
            item = item_words(t)
            n = min(13, len(item))
            wins = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)} if item else set()
            for p in range(len(words) - n + 1 if item else 0):
                if tuple(words[p:p + n]) in wins:
                    hit |= set(range(p, p + n))
                    found.add(str(item_id))
        out.append((i, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_against_brute_force(spark, broadcast_rows):
    """Few words, so that windows meet often; items shorter than a window and a shingle; broadcast and shuffled."""
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "b", "C", "dé", "É", "e9"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 4, 5, 6, 12, 13, 14, 20, 30])] + [(50, None), (51, "...")]
    items += [(60, items[9][1]), (None, "a b c d")]
    docs = [(k, ", ".join(word() for _ in range(rng.randrange(60)))) for k in range(40)]
    docs += [(100 + k, "x y z " * 40 + items[10][1].replace(" ", " - ") + " z" * k) for k in range(0, 400, 50)]
    docs += [(200, items[11][1]), (200, "other text"), (201, None), (202, ""), (203, items[11][1]), (203, items[11][1]), (None, items[8][1])]
    for some in (items, items[7:], items[:1]):  # with single words every text is hit
        got = decontaminate.contamination(
            spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, win string"),
            spark.createDataFrame([(i, t, "x") for i, t in some], "item_id long, text string, start string"), broadcast_rows=broadcast_rows)
        assert rows_of(got) == brute(docs, [x for x in some if x[0] is not None])


def test_filter_keeps_clean_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text, 7), (1, "clean", 8), (None, text, 9), (None, "clean", 10), (2, None, 11)], "doc_id long, text string, n long")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [8, 10, 11]
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 5


def test_query_on_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in QUERIES["op1_decontaminate"](spark, SF001).collect()), key=str)
    assert got == [(i, n, h, len(f), c) for i, n, h, f, c in want]
