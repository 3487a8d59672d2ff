"""SetSketch near-duplicates against all pairs, and the sketch's own properties."""

import random

import numpy as np
import pytest

from calibra.llm import setsketch
from calibra.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def plain(rows):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs."""
    def grams(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[top(k)] = min(low.get(top(k), d), d)
    return sorted(((d, len(sets[k]), low.get(top(k))) for k, (d, _) in enumerate(rows)), key=str)


def corpus():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 6)))
    rows, base = [], [[word() for _ in range(r.choice([5, 30, 120, 400]))] for _ in range(12)]
    for k in range(240):  # near copies at all distances, in chains
        w = list(r.choice(base))
        for _ in range(r.randrange(max(2, len(w) // 12))):
            w[r.randrange(len(w))] = word()
        rows.append((k, r.choice([" ", "\n", "\t "]).join(w)))
    common = [word() for _ in range(150)]  # a passage that many texts share, without being links
    rows += [(300 + k, " ".join(common + [word() for _ in range(60)])) for k in range(60)]
    rows += [(900, rows[0][1]), (5, rows[0][1].upper().lower()), (901, None), (902, ""), (903, " \n"), (904, "one Two"), (905, "ONE two"),
             (906, "one"), (None, rows[3][1]), (None, "nobody else says this at all"), (7, "long " + "w x y z v u " * 30_000), (7, rows[9][1]),
             (907, " ".join(f"w{k}" for k in range(40_000))), (908, " ".join(f"w{k}" for k in range(200, 40_000)))]
    return rows


@pytest.mark.parametrize("tile", [16, 512])
def test_components_equal_all_pairs(spark, tile):
    rows = corpus()
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA + ", node int, set_key string")
    got = setsketch.near_duplicates(docs, tile=tile)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_query_on_odd_rows_and_empty_table(spark, tmp_path):
    rows = [(4, "a b c d e f g h i"), (2, "A b c d e f g h i"), (None, "a b c d e f g h i"), (1, None), (8, "x"), (9, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "o/documents.parquet"))
    got = QUERIES["op13_setsketch_near_dedup"](spark, str(tmp_path / "o")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(4, 6, 2, False), (2, 6, 2, True), (None, 6, 2, False), (1, 0, 1, True),
                                                       (8, 1, 8, True), (9, 1, 8, False)], key=str)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert QUERIES["op13_setsketch_near_dedup"](spark, str(tmp_path / "e")).count() == 0


def test_registers_merge_by_maximum_and_slices_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) for _ in range(2))
    ra, rb, rab = setsketch.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == rab).all()
    monkeypatch.setattr(setsketch, "_BLOCK", 700)
    assert (setsketch.registers([a[:300], a, b[:9], b])[[1, 3]] == [ra, rb]).all()


@pytest.mark.parametrize("true,na,nb", [(0.8, 1000, 1000), (0.8, 1000, 850), (0.5, 600, 900), (0.95, 2000, 2000), (0.1, 500, 800)])
def test_estimate_is_near_the_truth(true, na, nb):
    rng = np.random.default_rng(11)
    inter = round(true * (na + nb) / (1 + true))
    got = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, na + nb - inter, dtype=np.uint64) * np.uint64(2)
        a, b = setsketch.registers([np.sort(x[:na]), np.sort(x[na - inter:])])
        got.append(setsketch.estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([na]), np.array([nb]))[0])
    error = (true * (1 - true) / 128) ** 0.5
    assert abs(np.mean(got) - true) < 4 * error / 60 ** 0.5 and np.std(got) < 1.4 * error


def test_forest_joins_what_the_links_join():
    rng = np.random.default_rng(2)
    for n in (2, 30, 200):
        i, j = rng.integers(0, n, (2, n))
        i, j = i[i != j], j[i != j]
        value = rng.random(len(i))
        take = setsketch._forest(i, j, value, n)

        def groups(a, b):
            low = list(range(n))
            for _ in range(n):
                for x, y in zip(a, b):
                    low[x] = low[y] = min(low[x], low[y])
            return low
        assert groups(i, j) == groups(i[take], j[take]) and len(take) < n
