"""Mixing: targets by repeated sharing, takes that meet them, odd rows."""

import random
from collections import defaultdict

from calibra.llm import mixing
from calibra.llm.queries import QUERIES

from tests.conftest import SF01


def share_again(sizes, weights=(5, 2, 1), total=1.5, repeat=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = set()
    while True:
        left = total * sum(sizes.values()) - sum(repeat * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped) if len(capped) < len(names) else 0
        more = {s for s in names if s not in capped and weight[s] * level > repeat * sizes[s]}
        if not more:
            return {s: repeat * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


def test_targets(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 17):
        sizes = {(f"s{k}" if k else None): rng.choice([0, 1, 7, 1000, 10**6, 10**9]) + rng.randrange(50) for k in range(n)}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = share_again(sizes)
        assert all(abs(r.target - want[r.source]) <= 1e-9 * (1 + want[r.source]) for r in got) and len(got) == n


def test_takes_meet_targets_and_repeat(spark):
    rows = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in QUERIES["op3_mix_sources"](spark, SF01).collect()]
    assert sorted(rows) == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in QUERIES["op3_mix_sources"](spark, SF01).collect())
    assert all(0 <= t <= 2 * s for _, s, _, _, t in rows)
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "source").collect()}
    taken, size = defaultdict(int), defaultdict(int)
    for i, s, _, _, t in rows:
        taken[docs[i]] += t
        size[docs[i]] += s
    want = share_again(size)
    assert all(abs(taken[s] - want[s]) <= 2 for s in size)


def test_segments_are_the_mix(spark):
    """Every stretch of a slot lies in its document; slots of a source come spread over the whole schedule."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    placed, segments = mixing.mix(docs)
    rows = segments.collect()
    size = {r.doc_id: r["size"] for r in placed.collect()}
    assert all(0 <= r.from_token and r.from_token + r.n_tokens <= size[r.doc_id] and r.n_tokens > 0 for r in rows)
    slots = defaultdict(set)
    for r in rows:
        slots[r.sid].add(r.slot)
    last = max(max(s) for s in slots.values())
    for s in slots.values():
        own = sorted(s)
        assert len(own) < 20 or max(b - a for a, b in zip(own, own[1:])) < 6 * last / len(own)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y z", "b"), (3, "x y z", "b"), (3, "x y", "b"), (None, "q " * 30, None), (None, "q " * 30, None),
            (7, "w " * 100_000, "a"), (8, "one", "c")]
    docs = spark.createDataFrame([(i, t, s, "k") for i, t, s in rows], "doc_id long, text string, source string, start string")
    got = mixing.takes(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len((t or "").split())) for i, t, _ in rows)
    want = share_again({"a": 100_000, "b": 8, "c": 1, None: 60})
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and sorted(r.doc_id or 0 for r in again.collect()) == [0] * 4 + [3] * 6 + [7] * 1 + [8] * 2
    assert mixing.takes(docs.where("false")).count() == 0
    assert [r.taken for r in mixing.takes(docs.where("doc_id < 3")).collect()] == [0, 0]
