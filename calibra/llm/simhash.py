"""SimHash near-duplicates: tiled exact comparison of fingerprints.

*Fingerprint*: 64 bits; a bit is 1 if it is set in over half the XXH64 hashes
of a text's word shingles (repeats included).

*Links*: fingerprints that differ in at most ``radius`` bits.  Every distinct
fingerprint is one row, however many documents share it.  Two fingerprints
within the radius agree on at least one of ``radius + 1`` bit bands, so tiles
hold the fingerprints that agree on one band; a tile further holds one class
of population counts, and a large class is split by a hash into tiles of
about ``tile`` rows.  Tile pairs are equi-joined: same band, classes that can
lie within the radius (others are never formed), and each pair is compared in
full by numpy exclusive-or and bit counts, a slice at a time.  A pair of
tiles returns a spanning forest of its links, not all of them: at most as
many links as it has rows.

*Groups*: connected components of the links.

Nulls and odd cases: a null or wordless text has fingerprint zero, linked
like any other; a text of fewer words than a shingle is hashed whole; rows
with the same text share a fingerprint and so a group; a null document id
keeps its row and counts for a group only if the group has no other; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from calibra.llm.common import in_arrow, small_batches, written
from calibra.llm.components import components

_SLICE = 1 << 15
POP_CLASS = 4  # population counts 4k..4k+3 share a tile


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1:] - 1).tolist()
    h = xxhash.xxh64_digest
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        raw = b"".join([h(joined[s:e], seed) for s, e in zip(starts[at:at + _SLICE], ends[at:at + _SLICE])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")  # digests are big-endian


def fingerprints(documents: DataFrame, *, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_key (hash of the whole text) and fp (the 64 bits as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.fromiter((fingerprint(t, shingle, seed) for t in b["text"].to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(got.view(np.int64))],
                                             ["doc_id", "text_key", "fp"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    out = StructType([rows.schema["doc_id"], StructField("text_key", LongType()), StructField("fp", LongType())])
    return rows.transform(in_arrow, run, out)


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands over the 64 bits."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def tiles(distinct: DataFrame, *, radius: int, tile: int) -> DataFrame:
    """band, value, pop (class), part, fps: each distinct fingerprint once in every band."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"),
                               F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1)).alias("value"))
                      for i, (a, w) in enumerate(_bands(radius))])
    rows = distinct.select("fp", F.floor(F.bit_count("fp") / POP_CLASS).cast("int").alias("pop"),
                           F.explode(bands).alias("b")).select("fp", "pop", "b.band", "b.value")
    large = rows.groupBy("band", "value", "pop").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile) \
        .select("band", "value", "pop", F.ceil(F.col("n") / tile).alias("parts"))
    return rows.join(large, ["band", "value", "pop"], "left") \
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")) \
        .groupBy("band", "value", "pop", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps"))


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (or, if a is b, within) two tiles."""
    same = b is a
    pool = a if same else np.concatenate([a, b])
    root = np.arange(len(pool))
    off = 0 if same else len(a)
    pa_, pb_ = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    near = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        x = a[at:at + step]
        close = np.abs(pa_[at:at + step, None] - pb_[None, :]) <= radius
        if not close.any():
            continue
        close &= np.bitwise_count(x[:, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(close)
        i, j = i + at, j + off
        keep = i < j if same else slice(None)
        near.append(_thin(i[keep], j[keep], len(pool)))
    if not near:
        return a[:0], a[:0]
    i, j = _thin(np.concatenate([x for x, _ in near]), np.concatenate([y for _, y in near]), len(pool))
    return pool[i], pool[j]


def _thin(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest index of its component) for the links i-j among n nodes."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    own = np.nonzero(low != np.arange(n))[0]
    return own, low[own]


def links(distinct: DataFrame, *, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b): links that join the same groups as all pairs within the radius."""
    t = written(tiles(distinct, radius=radius, tile=tile), "tiles")
    reach = -(-radius // POP_CLASS)  # classes further apart than this can't hold a link
    left = t.select("band", "value", F.col("pop").alias("lp"), F.col("part").alias("lt"), F.col("fps").alias("lf"),
                    F.explode(F.sequence(F.col("pop"), F.col("pop") + reach)).alias("pop"))
    pairs = left.join(t, ["band", "value", "pop"]) \
        .where((F.col("pop") > F.col("lp")) | (F.col("part") >= F.col("lt"))) \
        .where((F.size("lf") > 1) | (F.size("fps") > 1) | (F.col("pop") > F.col("lp")) | (F.col("part") > F.col("lt"))) \
        .select("lf", "fps", ((F.col("pop") == F.col("lp")) & (F.col("part") == F.col("lt"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            lf, rf = batch["lf"], batch["fps"]
            lo, ro = lf.offsets.to_numpy(), rf.offsets.to_numpy()
            lv, rv = lf.values.to_numpy().view(np.uint64), rf.values.to_numpy().view(np.uint64)
            for k, same in enumerate(batch["same"].to_pylist()):
                a, b = lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]]
                if len(a) * len(b) <= 16:  # too few for arrays to pay
                    x = [(i, j) for i in a.tolist() for j in b.tolist()
                         if (i ^ j).bit_count() <= radius and (i < j or not same)]
                    found_a.append(np.array([i for i, _ in x], np.uint64))
                    found_b.append(np.array([j for _, j in x], np.uint64))
                    continue
                x, y = _forest(a, a if same else b, radius)
                if len(x):
                    found_a.append(x)
                    found_b.append(y)
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f).view(np.int64)) for f in (found_a, found_b)], ["a", "b"])

    return pairs.transform(in_arrow, run, "a long, b long")


def near_duplicates(documents: DataFrame, *, shingle: int = 3, radius: int = 3, seed: int = 42,
                    tile: int = 2048) -> DataFrame:
    """doc_id, text_key, fp, root (smallest fingerprint of the group) and
    component_id (smallest doc_id of the group) of every row."""
    with small_batches(documents.sparkSession):
        prints = written(fingerprints(documents, shingle=shingle, seed=seed), "fingerprints")
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
        roots = components(links(distinct.select("fp"), radius=radius, tile=tile))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    smallest = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "smallest")
    of = rooted.join(smallest, "root").select(F.col("fp").alias("of_fp"), "root", "component_id")
    return prints.join(written(of, "groups"), prints.fp == F.col("of_fp")) \
        .select("doc_id", "text_key", "fp", "root", "component_id")


def deduplicate(documents: DataFrame, **how) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Among several texts with that id it is the one with the smallest hash,
    and of rows that repeat both one stays.
    """
    groups = near_duplicates(documents, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    kept = groups.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_kept"), F.col("first.text_key").alias("_kept_text"))
    keyed = documents.withColumn("_text_key", F.xxhash64("text"))
    return keyed.join(kept, keyed["doc_id"].eqNullSafe(F.col("_kept")) & (F.col("_text_key") == F.col("_kept_text")), "left_semi") \
        .dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
