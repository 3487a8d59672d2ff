"""Near-duplicates by Jaccard similarity, found with SetSketch registers.

*Sketch*: a register is the truncated minimum of exponential variables, one a
shingle, on an exponential scale: ``floor(1 - log_b(min x))``, kept in 16
bits.  Registers of two sets join by their maximum, so long texts are sketched
in slices, and equal registers are as likely as the sets are alike.

*Candidates*: four registers make a band key, and sets that agree on a band
meet in a bucket.  With 32 bands a pair at the threshold of 0.8 is missed with
a probability of 5e-8.  Large buckets are cut into tiles and tiles meet in
pairs; a pair of sets is looked at in the first band that it shares only.

*Estimate*: from how many registers are larger, smaller and equal, and the two
set sizes, the similarity with the greatest joint likelihood.  Pairs whose
estimate is ``sigmas`` standard errors under the threshold are out.

*Verification*: on whole shingle sets.  The first round verifies a maximum
spanning forest of each tile pair's estimates, not all pairs, and groups the
sets by the links that hold; the second looks only at buckets that still have
several groups.  There every plausible pair across groups is verified, in
blocks that hold each set once and return a spanning forest.  So no link
between two groups is lost, and a dense group gives rows in proportion to its
size, not its pairs.

Equal sets (copies) are one set throughout.  Shingles are told apart by 64-bit
hashes and sets by 128-bit hashes.

Nulls and odd cases: a null or wordless text has an empty set, which is linked
with nothing; a text of fewer words than a shingle is one shingle; rows that
repeat an id each get their row; rows with a null id are linked like others,
but a group takes the smallest id that is not null, and a group without ids
has a null ``component_id``; an empty table gives an empty result; other
columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from calibra.llm.common import in_arrow, written
from calibra.llm.components import components

BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2  # b, a and q of the registers
BANDS, ROWS = 32, 4
TILE = 512
_SIDE = 128
_BLOCK = 1 << 15
_WORDS = 1 << 19  # hashes that a task keeps at hand


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(w))):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[k:k + n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(32)))


def _multipliers(m: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """uint16 registers (sets x m) of sets that are not empty."""
    low = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    a = _multipliers(m)

    def lower(first: int, part: list[np.ndarray]) -> None:
        pool = np.concatenate(part)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in part])[:-1]])
        for i in range(m):
            got = np.minimum.reduceat(pool * a[i], starts)
            low[first:first + len(part), i] = np.minimum(low[first:first + len(part), i], got)

    first, part, size = 0, [], 0
    for k, s in enumerate(sets):
        if len(s) > _BLOCK:  # slices merge by their minima
            if part:
                lower(first, part)
            for at in range(0, len(s), _BLOCK):
                lower(k, [s[at:at + _BLOCK]])
            first, part, size = k + 1, [], 0
            continue
        part.append(s)
        size += len(s)
        if size >= _BLOCK:
            lower(first, part)
            first, part, size = k + 1, [], 0
    if part:
        lower(first, part)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def sketched(documents: DataFrame, *, shingle: int = 4) -> DataFrame:
    """doc_id, text_key, set_key, n_shingles and keys (a long of four registers a band; null for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t, shingle, hashes) for t in part["text"].to_pylist()]
                full = [s for s in sets if len(s)]
                got = iter(registers(full).view(np.int64) if full else ())
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], part["text_key"], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(got) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "set_key", "n_shingles", "keys"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    out = StructType([rows.schema["doc_id"], StructField("text_key", LongType()), StructField("set_key", BinaryType()),
                      StructField("n_shingles", LongType()), StructField("keys", ArrayType(LongType()))])
    return rows.transform(in_arrow, run, out)


def estimate(larger: np.ndarray, smaller: np.ndarray, na: np.ndarray, nb: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The similarity of the greatest likelihood, from counts of larger and smaller registers and the set sizes."""
    u = na / (na + nb)
    v = 1 - u
    equal = m - larger - smaller
    c, log_b = (BASE - 1) / BASE, math.log(BASE)
    p = lambda x: -np.log1p(-x * c) / log_b
    dp = lambda x: c / (1 - x * c) / log_b
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave: halve the range by its slope's sign
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 1e-15), np.maximum(v - u * j, 1e-15)
        slope = -larger * v * dp(x) / p(x) - smaller * u * dp(y) / p(y) \
            + equal * (v * dp(x) + u * dp(y)) / np.maximum(1 - p(x) - p(y), 1e-15)
        lo, hi = np.where(slope > 0, j, lo), np.where(slope > 0, hi, j)
    return (lo + hi) / 2


def _plausible(a: dict, b: dict | None, band: int, cut: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, estimate) of the pairs between two tiles, or within one, that may reach the threshold.

    A pair that shares an earlier band is left to it; ``i`` counts in a, ``j`` in b.
    """
    other = a if b is None else b
    found = []
    step = max(1, (1 << 16) // max(1, len(other["node"])))
    for at in range(0, len(a["node"]), step):
        k, n, g = (a[c][at:at + step] for c in ("keys", "n", "group"))
        ok = (n[:, None] * least <= other["n"]) & (other["n"] * least <= n[:, None]) & (g[:, None] != other["group"])
        if b is None:
            ok &= np.arange(at, at + len(n))[:, None] < np.arange(len(other["node"]))
        i, j = np.nonzero(ok)
        for e in range(band):
            keep = k[i, e] != other["keys"][j, e]
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        x, y = k.view(np.uint16)[i], other["keys"].view(np.uint16)[j]
        got = estimate((x > y).sum(1), (x < y).sum(1), n[i].astype(np.float64), other["n"][j].astype(np.float64))
        keep = got >= cut
        found.append((i[keep] + at, j[keep], got[keep]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _forest(i: np.ndarray, j: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Indices of a maximum spanning forest of the links i-j: each tree takes its best link, again and again."""
    tree, chosen = np.arange(n), []
    order = np.argsort(-value, kind="stable")
    while len(order):
        order = order[tree[i[order]] != tree[j[order]]]
        ends = np.concatenate([tree[i[order]], tree[j[order]]])
        at = np.concatenate([np.arange(len(order))] * 2)
        # the first (best) link of each tree
        _, best = np.unique(ends[np.argsort(at, kind="stable")], return_index=True)
        take = order[np.unique(np.sort(at, kind="stable")[best])]
        chosen.append(take)
        while True:  # trees joined by the links taken get their smallest number
            low = tree.copy()
            a, b = tree[i[take]], tree[j[take]]
            m = np.minimum(low[a], low[b])
            np.minimum.at(low, a, m)
            np.minimum.at(low, b, m)
            new = low[low[tree]]
            if (new == tree).all():
                break
            tree = new
    return np.unique(np.concatenate(chosen)) if chosen else order


def _tiles(members: DataFrame, tile: int, several: bool) -> DataFrame:
    """band, key, part, tile (node, n, group, keys): sets that agree on a band; several: buckets with more than one group."""
    rows = members.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = members.select("node", "group", F.posexplode("keys").alias("band", "key")).groupBy("band", "key") \
        .agg(F.count(F.lit(1)).alias("size"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    sizes = sizes.where("lo <> hi" if several else "size > 1").select("band", "key", F.ceil(F.col("size") / tile).alias("parts"))
    full = rows.join(written(sizes, "buckets"), ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    return full.join(members, "node").groupBy("band", F.col("key"), "part") \
        .agg(F.collect_list(F.struct("node", "n", "group", "keys")).alias("tile"))


def _compared(members: DataFrame, run, schema: str, *, tile: int, several: bool) -> DataFrame:
    """What ``run(band, a, b)`` yields for every two tiles of a bucket (b is None: one tile with itself)."""
    t = written(_tiles(members, tile, several), "tiles")
    left = t.select("band", "key", F.col("part").alias("of"), F.col("tile").alias("other"))
    pairs = left.join(t, ["band", "key"]).where((F.col("part") > F.col("of")) | ((F.col("part") == F.col("of")) & (F.size("tile") > 1))) \
        .select("band", (F.col("part") == F.col("of")).alias("same"), "other", "tile")

    def columns(tiles: pa.ListArray, k: int) -> dict:
        s = tiles.values.slice(tiles.offsets[k].as_py(), tiles.offsets[k + 1].as_py() - tiles.offsets[k].as_py())
        order = np.argsort(s.field("node").to_numpy())  # collect_list has no order
        out = {c: s.field(c).to_numpy()[order] for c in ("node", "n", "group")}
        return out | {"keys": np.ascontiguousarray(s.field("keys").flatten().to_numpy().reshape(len(order), -1)[order])}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (band, same) in enumerate(zip(batch["band"].to_pylist(), batch["same"].to_pylist())):
                yield from run(band, columns(batch["other"], k), None if same else columns(batch["tile"], k))

    return pairs.transform(in_arrow, each, schema)


def _forest_pairs(members: DataFrame, *, tile: int, cut: float, least: float) -> DataFrame:
    """(a, b) with a < b: of every two tiles a maximum spanning forest by estimate."""
    def run(band: int, a: dict, b: dict | None) -> Iterator[pa.RecordBatch]:
        i, j, value = _plausible(a, b, band, cut, least)
        if len(i):
            off = 0 if b is None else len(a["node"])
            take = _forest(i, j + off, value, off + len((b or a)["node"]))
            x, y = a["node"][i[take]], (b or a)["node"][j[take]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return _compared(members, run, "a long, b long", tile=tile, several=False).distinct()


def _open_blocks(members: DataFrame, *, tile: int, cut: float, least: float) -> DataFrame:
    """nodes, i, j: all plausible pairs of different groups, in blocks of up to 2 * _SIDE nodes; i and j index nodes."""
    def run(band: int, a: dict, b: dict | None) -> Iterator[pa.RecordBatch]:
        i, j, _ = _plausible(a, b, band, cut, least)
        other = b or a
        blocks = i // _SIDE * (1 << 20) + j // _SIDE
        for block in np.unique(blocks):
            x, y = a["node"][i[blocks == block]], other["node"][j[blocks == block]]
            nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            at = at.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([nodes]), pa.array([at[:len(x)]]), pa.array([at[len(x):]])], ["nodes", "i", "j"])

    return _compared(members, run, "nodes array<long>, i array<int>, j array<int>", tile=tile, several=True)


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs i-j of sorted sets that are not empty."""
    out = np.zeros(len(i), np.int64)
    for k in np.unique(i):
        at = np.nonzero(i == k)[0]
        for first in range(0, len(at), 64):  # a bounded number of sets side by side
            part = at[first:first + 64]
            pool = np.concatenate([sets[x] for x in j[part]])
            starts = np.concatenate([[0], np.cumsum([len(sets[x]) for x in j[part]])[:-1]])
            place = np.minimum(np.searchsorted(sets[k], pool), len(sets[k]) - 1)
            out[part] = np.add.reduceat((sets[k][place] == pool).astype(np.int64), starts)
    return out


def _block_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): of every block a spanning forest of the links that hold on whole sets."""
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    has = blocks.select("block", F.posexplode("nodes").alias("at", "node")).join(sets, "node") \
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "shingles"))).alias("got")) \
        .select("block", F.col("got.shingles").alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                nodes, i, j = (b[c][k].values.to_numpy() for c in ("nodes", "i", "j"))
                own = [s.values.to_numpy().view(np.uint64) for s in b["sets"][k]]
                n = np.array([len(s) for s in own])
                inter = _shared(own, i, j)
                ok = 100 * inter >= percent * (n[i] + n[j] - inter)
                i, j = i[ok], j[ok]
                take = _forest(i, j, np.zeros(len(i)), len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i[take]]), pa.array(nodes[j[take]])], ["a", "b"])

    return blocks.join(has, "block").select("nodes", "i", "j", "sets").transform(in_arrow, run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that are links, by the sizes of intersection and union of whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", inter.alias("inter"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.where(100 * F.col("inter") >= percent * (F.col("total") - F.col("inter"))).select("a", "b")


def links(documents: DataFrame, distinct: DataFrame, *, percent: int, shingle: int, sigmas: float, tile: int) -> DataFrame:
    """(a, b): verified links that join the same groups as all pairs at the threshold."""
    least = percent / 100
    how = {"tile": tile, "cut": least - sigmas * math.sqrt(least * (1 - least) / (BANDS * ROWS)), "least": least}
    rows = distinct.select("node", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    active = written(rows.join(written(shared, "shared"), ["band", "key"], "left_semi").select("node").distinct(), "active")
    members = written(distinct.join(active, "node").select("node", F.col("n_shingles").alias("n"), F.col("node").alias("group"), "keys"),
                      "members")
    first = written(_forest_pairs(members, **how), "first_pairs")

    chosen = distinct.join(active, "node").select("node", "set_key", F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            sets = [shingles(t, shingle, hashes) for t in b["text"].to_pylist()]
            ok = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, b["set_key"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["node"].filter(pa.array(ok)),
                                              pa.array([s.view(np.int64) for s, x in zip(sets, ok) if x], pa.list_(pa.int64()))],
                                             ["node", "shingles"])

    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    sets = texts.join(chosen, texts.doc_id.eqNullSafe(F.col("_doc")) & (texts.text_key == F.col("_text"))) \
        .select("node", "set_key", "text").transform(in_arrow, run, "node long, shingles array<long>").dropDuplicates(["node"])
    sets = written(sets, "sets")

    found = written(_verified(first, sets, percent), "first_links")
    grouped = members.drop("group").join(components(found), "node", "left") \
        .select("node", "n", F.coalesce("root", "node").alias("group"), "keys")
    more = _block_links(_open_blocks(written(grouped, "grouped"), **how), sets, percent)
    return found.unionByName(written(more, "more_links"))


def near_duplicates(documents: DataFrame, *, percent: int = 80, shingle: int = 4, sigmas: float = 4.5,
                    tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (smallest doc_id of the group) of every row.

    Sets are linked if their intersection is at least ``percent`` hundredths
    of their union.
    """
    rows = written(sketched(documents, shingle=shingle), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    distinct = written(rows.where("n_shingles > 0").groupBy("set_key")
                       .agg(first, F.first("keys").alias("keys"), F.first("n_shingles").alias("n_shingles"))
                       .withColumn("node", F.monotonically_increasing_id()), "distinct")
    found = links(documents, distinct, percent=percent, shingle=shingle, sigmas=sigmas, tile=tile)
    roots = components(found).join(distinct.select("node", "set_key", F.col("first.doc_id").alias("low")), "node")
    roots = written(roots, "roots")
    smallest = written(roots.groupBy("root").agg(F.min("low").alias("low")), "smallest")
    linked = roots.select("set_key", "root").join(smallest, "root").select("set_key", F.col("low").alias("group_low"))
    of = written(distinct.join(linked, "set_key", "left").select(
        F.col("set_key").alias("_set"), F.coalesce("group_low", "first.doc_id").alias("component_id")), "components")
    full = rows.where("n_shingles > 0").join(of, rows.set_key == F.col("_set")).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
