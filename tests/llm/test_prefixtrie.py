"""Conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from calibra.llm import prefixtrie
from calibra.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(conversations):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = set()
    for node, who in members.items():
        under = [m for m in members if m[:len(node)] == node]
        childless = [m for m in under if not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m)
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
                 sum(len(m) == len(node) + 1 for m in under), len(childless), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def ordered(rows):
    """{conv_id: turns} in the operator's order of turns."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [x[-1] for x in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def turn_frames(spark, conversations):
    turns = [(c, p, hashlib.sha256(repr(t).encode()).hexdigest(), len(t[1].encode())) for c, ts in conversations.items() for p, t in enumerate(ts)]
    return (spark.createDataFrame(turns, "conv_id long, pos long, digest string, bytes long"),
            spark.createDataFrame([(c, len(ts)) for c, ts in conversations.items()], "conv_id long, n long"))


@pytest.mark.parametrize("height", [2, 3, 16])
def test_trie_of_any_band_height(spark, height):
    r = random.Random(5)
    convs = {}
    for c in range(60):  # prefixes of others, copies, branches, one long conversation and one without turns
        base = convs.get(r.randrange(c), []) if c else []
        convs[c] = base[:r.randrange(len(base) + 1)] + [("user", r.choice("aé")) for _ in range(r.randrange(4))]
    convs[60] = [("user", "x")] * 41
    convs[61] = [("user", "x")] * 37 + [("user", "z")]
    convs[62] = []
    got = prefixtrie.prefix_trie(*turn_frames(spark, convs), height=height).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()
    assert len(got) == len(plain(convs)) and set(map(tuple, got)) == plain(convs)


def test_query_on_odd_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["é" * 3, "b", "", None])) for c in range(-7, 40)
            if c % 7 for t in range(r.randrange(1, 11))]
    rows += [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "a", "tie"), (None, 0, "user", "x"),
             (50, 0, "user", "t" * 50_000), (55, 0, "user", "t" * 50_000)]
    spark.createDataFrame([(*x, 0, "k") for x in rows], SCHEMA + ", pos int, key string") \
        .write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op12_conversation_trie"](spark, str(tmp_path)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    want = plain(rebuilt(ordered(rows)))
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_empty_table_and_turnless_conversation(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e/conversations.parquet"))
    assert QUERIES["op12_conversation_trie"](spark, str(tmp_path / "e")).count() == 0
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # no donor, its one turn is cut
    spark.createDataFrame([(c, 0, "user", "x")], SCHEMA).write.parquet(str(tmp_path / "o/conversations.parquet"))
    got = QUERIES["op12_conversation_trie"](spark, str(tmp_path / "o")).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(c, 0, None, 1, 0, 1, 0)]
    assert got[0].ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


def test_ends_are_hashed_over_chunks(spark):
    n = 3000  # more than a chunk, in one node
    ends = spark.createDataFrame([("k", c) for c in range(n)] + [("l", 5)], "key string, conv_id long")
    got = {r.key: r.ends_sha256 for r in prefixtrie._ends_hash(ends).collect()}
    assert got == {"k": hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest(), "l": hashlib.sha256(b"5").hexdigest()}
