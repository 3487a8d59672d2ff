"""SimHash near-dedup against brute force over all pairs."""

import subprocess
import sys

import numpy as np
import pytest
import xxhash

from calibra.llm import common, simhash
from calibra.llm.common import in_arrow
from calibra.llm.queries import QUERIES

from tests.conftest import ROOT, SF001


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    words = [w.decode() for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=3):
    """doc_id -> smallest id reachable, by comparing every pair."""
    ids = [i for i, _ in rows]
    fps = np.array([f for _, f in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= radius)[0]:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    low = {}
    for k, i in enumerate(ids):
        low[find(k)] = min(low.get(find(k), i), i)
    return [low[find(k)] for k in range(len(rows))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    prints = [(d.doc_id, brute_fingerprint(d.text)) for d in docs]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_near_dedup"](spark, SF001).collect()}
    assert got == want


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_join_the_same_groups(spark, tile):
    """Chains, dense groups and strangers; small tiles split the dense group."""
    rng = np.random.default_rng(5)
    fps = list(rng.integers(0, 2**64, 40, dtype=np.uint64))
    for base in fps[:6]:  # dense: all within a few bits of one
        for _ in range(30):
            x = int(base)
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.append(np.uint64(x))
    x = int(fps[10])
    for b in range(0, 30, 3):  # a chain, three bits a step
        x ^= 0b111 << b
        fps.append(np.uint64(x))
    fps = sorted({int(f) for f in fps})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, tile=tile)).collect()}
    signed = {f: int(np.uint64(f).view(np.int64)) for f in fps}
    want = brute_components([(signed[f], f) for f in fps])
    assert [roots.get(signed[f], signed[f]) for f in fps] == want


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "One", "d"), (5, "one", "e"), (5, "one", "e"),
            (None, "one", "f"), (7, "x " * 50000, "g"), (None, "lonely words here", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 4), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (7, 7)]
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, "lonely words here"), (4, "One"), (7, "x " * 50000)]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    """A partition of 18 MB is not sent as one batch."""
    def bounded(df, run, schema):
        def small(batches):
            for b in batches:
                assert b.nbytes < 6 << 20
                yield b

        return in_arrow(df, lambda batches: run(small(batches)), schema)

    monkeypatch.setattr(simhash, "in_arrow", bounded)
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 400) AS text")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {0}
    assert spark.conf.get(size) == before


def test_workers_give_memory_back_after_each_task(spark, monkeypatch):
    said, runs = [], []

    class Frame:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            runs.append(run)

    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))
    in_arrow(Frame(), lambda batches: (said.append(b) or b for b in batches), "x long")
    assert list(runs[0](iter([1, 2]))) == [1, 2] and said == [1, 2, "back"]
    ended_early = runs[0](iter([3, 4]))
    next(ended_early)
    ended_early.close()
    assert said[3:] == [3, "back"]


def test_memory_that_arrow_freed_goes_back():
    """In a process of its own, like a worker's."""
    code = """
import re, pyarrow as pa
from calibra.llm.common import give_back
def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
before = mb()
held = [pa.array([b"x" * 100_000], pa.binary()) for _ in range(2000)]
kept = held[::100]
del held
give_back()
assert mb() - before < 60, mb() - before
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
