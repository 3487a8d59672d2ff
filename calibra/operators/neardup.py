"""Near-duplicate detection at a Jaccard threshold (D2), exact.

Token sets are word tokens (lower-cased letters/digits).  Identical token
sets are collapsed first, so exact copies - however many - become one set
with a multiplicity and never produce pairs (they are reported by the
duplicate-item table).  Candidate pairs of distinct sets come from prefix
filtering: with tokens ordered by ascending document frequency (counted by
hash slot, so that a table of fixed size gives the order), two sets
with Jaccard >= t share a token among the first |x| - ceil(t |x|) + 1
tokens of each.  Prefixes hold each set's rarest tokens, so frequent words
never form candidate groups; a length filter (t |x| <= |y| <= |x| / t), the
places of the shared tokens and the parities of both sets in hash
buckets (two sets' parities differ in no more buckets than the sets differ in
tokens) prune further where prefixes meet, and every candidate is verified
exactly.  Only prefixes, as hashes, and the tokens of candidates are shuffled:
for verification sets of a cluster meet in tiles, so a set travels once a
tile, not once a candidate.

``near_duplicates`` returns every pair, which in a cluster of k distinct
near-copies is k (k - 1) / 2 rows.  ``near_duplicate_groups`` returns one row a
document instead: MinHash bands bring alike sets together, each is verified
against a few representatives of its bucket only, and the links that hold are
followed to groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.session import ensure_checkpoint_dir, free_shuffles, ship_package, written

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
SLOTS = 1 << 22  # of token frequencies, which decide how rare a token is
BITS = 256  # of a set's parities
PARITIES = [f"p{i}" for i in range(BITS // 64)]
LARGE, MORE_BITS = 1024, 768  # sets of so many tokens have more parities
TILE = 1 << 21  # tokens of the sets that one task verifies against each other or against as many others
TILE_SETS = 512  # and so many sets at most, as short ones have many pairs
MARKS = 1 << 22  # slots that tell which sets stand in no candidate


def token_set(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.array_distinct(F.split(F.lower(t), TOKEN_SPLIT)), "")


def set_key(tokens: str) -> Column:
    return F.sha2(F.array_join(F.sort_array(tokens), " "), 256)


def distinct_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    toks = docs.select(F.col(id_col).alias("doc_id"), token_set(text_col).alias("tokens")) \
        .filter(F.size("tokens") > 0)
    return toks.groupBy(set_key("tokens").alias("set_id")).agg(
        F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_members"),
        F.any_value("tokens").alias("tokens")).withColumn("L", F.size("tokens"))


def written_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (a number of its own), doc_id, set_id, tokens and L of every document with a token, worked out and written once."""
    # the filter stays behind the number, so that no text is split twice
    toks = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), token_set(text_col).alias("tokens")) \
        .filter(F.size("tokens") > 0)
    return written(toks.select("row", "doc_id", set_key("tokens").alias("set_id"), "tokens", F.size("tokens").alias("L")), "token_sets", "zstd")


def one_a_set(toks: DataFrame) -> DataFrame:
    """set_id, rep_id, n_members and the row that stands for the set."""
    return toks.groupBy("set_id").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_members"), F.min("row").alias("row"))


def _hashed(toks: DataFrame) -> DataFrame:
    return toks.select("row", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))


def _lists(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(rows, sizes, hashes one after the other) of a few sets at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            some = b.slice(at, rows)
            hashes = some["hashes"]
            yield some["row"], np.diff(hashes.offsets.to_numpy()), hashes.flatten().to_numpy()


def token_frequencies(toks: DataFrame) -> np.ndarray:
    """How many token sets hold a token of each of ``SLOTS`` hash slots."""
    met = toks.select(F.explode("tokens").alias("token")).groupBy(F.xxhash64("token").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).count().toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[met["slot"].to_numpy()] = met["count"].to_numpy()
    return out


def prefixes(toks: DataFrame, threshold: float) -> DataFrame:
    """row, L, the set's first tokens as hashes (``keys``), in an order that all sets share, and its parities.

    The order is that of the tokens' slots by frequency, then of their hashes,
    so a set's prefix needs no other set.  Tokens of one hash count as equal,
    which only adds candidates.
    """
    ship_package(toks.sparkSession)
    shared = toks.sparkSession.sparkContext.broadcast(np.minimum(token_frequencies(toks), (1 << 24) - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sizes, h in _lists(batches):
            which = np.repeat(np.arange(len(sizes)), sizes)
            key = shared.value[h & (SLOTS - 1)].astype(np.int64) << 39 | (h.view(np.uint64) >> np.uint64(25)).astype(np.int64)
            key = key[np.lexsort((key, which))]
            # the small epsilon only ever lengthens the prefix (safe)
            first = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1
            place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]), pa.int32()), pa.array(key[place < first[which]]))
            few = _parities(which, h.view(np.uint64) >> np.uint64(56), len(sizes), BITS)
            large = sizes >= LARGE
            more = _parities((np.cumsum(large) - 1)[which[large[which]]], (h[large[which]].view(np.uint64) >> np.uint64(24)) % np.uint64(MORE_BITS),
                             large.sum(), MORE_BITS)
            ends = np.concatenate([[0], np.cumsum(large * more.shape[1])])
            yield pa.RecordBatch.from_arrays([row, pa.array(sizes, pa.int32()), keys, *[pa.array(p) for p in few.T],
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(more.ravel()))], ["row", "L", "keys", *PARITIES, "more"])

    return _hashed(toks).mapInArrow(run, "row long, L int, keys array<long>, " + ", ".join(f"{p} long" for p in PARITIES) + ", more array<long>")


def _parities(which: np.ndarray, bucket: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Of ``n`` sets, whose number ``which`` has for every token, whether each bucket has an odd number of tokens; 64 buckets a word."""
    met = np.bincount(which * bits + bucket.astype(np.int64), minlength=n * bits)
    return np.packbits((met & 1).astype(np.uint8)).view(np.int64).reshape(n, bits // 64)


def candidates(prefix: DataFrame, threshold: float) -> DataFrame:
    """(ra, rb, la, lb): pairs of sets, with their sizes, that prefixes, sizes and parities let reach the threshold.

    A shared token has at most the smaller place of common tokens before it
    and the shorter rest behind it (one is added, for two tokens of one key).
    Where one of the two tokens before it is shared as well, the pair comes
    from that one, so that alike sets do not meet once a token.
    """
    t = threshold
    one = prefix.select("row", "L", *PARITIES, "more", "keys", F.posexplode("keys").alias("at", "key")).where(F.col("key") >= 2 << 39)  # a slot met once has no partner
    one = one.select("row", "L", *PARITIES, "more", "at", "key", *[F.coalesce(F.get("keys", F.col("at") - k), F.lit(-1)).alias(f"before{k}") for k in (1, 2)])
    a, b = one.alias("a"), one.alias("b")
    both = F.col("a.L") + F.col("b.L")
    around = F.least("a.at", "b.at") + F.least(F.col("a.L") - F.col("a.at"), F.col("b.L") - F.col("b.at")) + 1
    apart = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in PARITIES), F.lit(0))
    differ = F.aggregate(F.zip_with("a.more", "b.more", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    small = (F.size("a.more") == 0) | (F.size("b.more") == 0)
    earlier = F.lit(False)
    for k in (1, 2):
        earlier |= (F.col(f"a.before{k}") >= 0) & F.col(f"a.before{k}").isin(F.col("b.before1"), F.col("b.before2"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.row") < F.col("b.row"))
                  & (F.col("b.L") >= F.col("a.L") * t) & (F.col("a.L") >= F.col("b.L") * t) & ~earlier
                  & (around * (1 + t) >= both * t - 1e-6) & (apart * (1 + t) <= both * (1 - t) + 1e-6)
                  & (small | (differ * (1 + t) <= both * (1 - t) + 1e-6))) \
        .select(F.col("a.row").alias("ra"), F.col("b.row").alias("rb"), F.col("a.L").alias("la"), F.col("b.L").alias("lb")).distinct()


def tiles(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """The pairs with home, lo and hi: those of one (home, lo, hi) have about ``2 * tile`` tokens and ``2 * TILE_SETS`` sets at most.

    A set's home is the smallest row among its partners and itself, a pair's
    the smaller one of its sets', so that a cluster whose sets are all alike
    is one home.  A home of many tokens is cut into tiles by its sets' rows.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("ra").alias("row"), F.col("rb").alias("other")),
                                          F.struct(F.col("rb").alias("row"), F.col("ra").alias("other")))).alias("e")).select("e.*")
    homes = ends.groupBy("row").agg(F.least("row", F.min("other")).alias("home"))
    near = pairs.join(homes.toDF("ra", "ha"), "ra").join(homes.toDF("rb", "hb"), "rb") \
        .select("ra", "rb", "la", "lb", F.least("ha", "hb").alias("home"))
    met = near.select("home", F.explode(F.array(F.struct(F.col("ra").alias("row"), F.col("la").alias("L")),
                                                F.struct(F.col("rb").alias("row"), F.col("lb").alias("L")))).alias("e")).distinct()
    cut = met.groupBy("home").agg(F.ceil(F.greatest(F.sum("e.L") / tile, F.count(F.lit(1)) / TILE_SETS)).alias("n"))
    ta, tb = (F.pmod(F.xxhash64(c), F.col("n")) for c in ("ra", "rb"))
    return near.join(cut, "home").select("ra", "rb", "home", F.least(ta, tb).alias("lo"), F.greatest(ta, tb).alias("hi"))


def _mark(row):
    """A slot of ``MARKS`` for the number of a row, as a column or in numpy."""
    part = F.shiftright(row, 33) if isinstance(row, Column) else row >> 33
    mixed = row + part * 2654435761
    return mixed.bitwiseAND(F.lit(MARKS - 1)) if isinstance(row, Column) else mixed & (MARKS - 1)


def marked_texts(toks: DataFrame, rows: DataFrame) -> DataFrame:
    """row, set_id and the tokens as one text, of the sets whose slots ``rows`` have: of all in ``rows``, and a few others."""
    ship_package(toks.sparkSession)
    seen = np.zeros(MARKS, bool)
    seen[rows.select(_mark(F.col("row")).alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    shared = toks.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            some = b.filter(pa.array(marks[_mark(b["row"].to_numpy())]))
            yield pa.RecordBatch.from_arrays([some["row"], some["set_id"], pc.binary_join(some["tokens"], " ")], ["row", "set_id", "text"])

    return toks.select("row", "set_id", "tokens").mapInArrow(run, "row long, set_id string, text string")


def overlaps(placed: DataFrame, toks: DataFrame) -> DataFrame:
    """ra, rb, la, lb, inter and whether the set_id of ra is the larger one, counted from the tokens tile by tile."""
    go = placed.select("home", "lo", "hi", F.explode(F.array("ra", "rb")).alias("row")).distinct()
    texts = marked_texts(toks, placed.select(F.explode(F.array("ra", "rb")).alias("row"))).join(go, "row")
    none = F.lit(None)
    dealt = texts.select("home", "lo", "hi", F.col("row").alias("ra"), none.cast("long").alias("rb"), "set_id", "text") \
        .unionByName(placed.select("home", "lo", "hi", "ra", "rb", none.cast("string").alias("set_id"), none.cast("string").alias("text"))) \
        .repartition("home", "lo", "hi").sortWithinPartitions("home", "lo", "hi", F.col("rb").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, words, of, inside = None, {}, {}, None, None
        for b in batches:
            out = []
            for *tile, ra, rb, set_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if tile != at:
                    at, sets, words, of = tile, {}, {}, None
                if rb is None:
                    sets[ra] = set_id, np.fromiter((words.setdefault(w, len(words)) for w in text.split(" ")), np.int32)
                    continue
                two, y = sets[rb]
                if of != rb:  # a set's pairs come together
                    of, inside = rb, np.zeros(len(words), bool)
                    inside[y] = True
                one, x = sets[ra]
                out.append((ra, rb, len(x), len(y), np.count_nonzero(inside[x]), one > two))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays(columns, names)

    names, kinds = ["ra", "rb", "la", "lb", "inter", "after"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    return dealt.mapInArrow(run, "ra long, rb long, la int, lb int, inter int, after boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.9) -> DataFrame:
    """Pairs of distinct token sets with Jaccard >= threshold.

    Output: doc_a < doc_b (smallest doc id of each set), members of each
    set, intersection and union sizes, Jaccard.
    """
    t = float(threshold)
    toks = written_sets(docs, id_col, text_col)
    sets = written(one_a_set(toks), "sets")
    pairs = written(candidates(prefixes(toks, t).join(sets.select("row"), "row", "left_semi"), t), "candidates")
    free_shuffles(docs.sparkSession)
    placed = written(tiles(pairs), "tiles")
    free_shuffles(docs.sparkSession)
    v = overlaps(placed, toks).withColumn("union_size", F.col("la") + F.col("lb") - F.col("inter"))
    v = v.withColumn("jaccard", F.col("inter") / F.col("union_size")).filter(F.col("jaccard") >= t)
    who = sets.select("row", "rep_id", "n_members")
    v = v.join(who.toDF("ra", "rep_a", "n_a"), "ra").join(who.toDF("rb", "rep_b", "n_b"), "rb")
    # of two sets of one id, or without, the second by set_id comes first
    first = F.coalesce(F.col("rep_a") < F.col("rep_b"), F.lit(False)) \
        | (~F.coalesce(F.col("rep_a") != F.col("rep_b"), F.lit(False)) & F.col("after"))
    return v.select(
        F.least("rep_a", "rep_b").alias("doc_a"), F.greatest("rep_a", "rep_b").alias("doc_b"),
        F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("members_a"),
        F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("members_b"),
        F.col("inter").cast("int").alias("inter"), F.col("union_size").cast("int").alias("union_size"),
        "jaccard")


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(size * threshold - 1e-9) + 1


# ---------------------------------------------------------------------------
# Groups: MinHash bands, verified links to representatives, membership
# ---------------------------------------------------------------------------

BANDS, ROWS = 12, 6  # at a similarity of 0.9 a pair shares no band once in 10,000


def minima(toks: DataFrame) -> DataFrame:
    """row and signature of every token set where it lies: minima of its hashed tokens under ``BANDS * ROWS`` seeds."""
    ship_package(toks.sparkSession)
    seeds = np.random.RandomState(42).randint(0, 1 << 63, (2, BANDS * ROWS), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sizes, h in _lists(batches):
            start, h = np.cumsum(sizes) - sizes, h.view(np.uint64)
            sig = [np.minimum.reduceat((h ^ a) * (b | np.uint64(1)), start) for a, b in seeds.T]
            flat = pa.array(np.stack(sig, axis=1).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([row, pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * len(sig), pa.int32()), flat)],
                                             ["row", "sig"])

    return _hashed(toks).mapInArrow(run, "row long, sig array<long>")


def signatures(ex: DataFrame, n: int = BANDS * ROWS) -> DataFrame:
    """set_id and ``n`` minima of seeded token hashes, from one row a token: one hash aggregate."""
    mins = ex.groupBy("set_id").agg(*[F.min(F.xxhash64(F.lit(i), "token")).alias(f"m{i}") for i in range(n)])
    return mins.select("set_id", F.array(*[f"m{i}" for i in range(n)]).alias("sig"))


def buckets(sigs: DataFrame) -> DataFrame:
    """set_id, band, key: the buckets of every set."""
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[F.get("sig", b * ROWS + r) for r in range(ROWS)]).alias("key"))
                      for b in range(BANDS)])
    return sigs.select("set_id", F.explode(bands).alias("b")).select("set_id", "b.band", "b.key")


def head_links(rows: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """(sa, sb): of every bucket, each set with its representatives, where their ``root`` differs.

    The representatives are the bucket's smallest set by one order a seed, so
    that a set far from one of them meets others, here and in the other
    bands.  Rows are linear in the sets: a bucket is an aggregate and a join,
    never a list.
    """
    orders = [F.min(F.struct(F.xxhash64(F.lit(seed), "set_id").alias("at"), "set_id", "root")) for seed in seeds]
    heads = rows.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                            F.array_distinct(F.array(*orders)).alias("heads")) \
        .where("lo <> hi").select("band", "key", F.explode("heads").alias("head"))
    return rows.join(heads, ["band", "key"]).where("root <> head.root").select(
        F.least("set_id", "head.set_id").alias("sa"), F.greatest("set_id", "head.set_id").alias("sb")).distinct()


def small_bucket_links(rows: DataFrame, few: int) -> DataFrame:
    """(sa, sb): all pairs of different roots in buckets of at most ``few`` sets, so at most ``few`` a set and band."""
    small = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")) \
        .where((F.col("n") <= few) & (F.col("lo") != F.col("hi"))).select("band", "key")
    one = rows.join(small, ["band", "key"])
    two = one.select("band", "key", F.col("set_id").alias("sb"), F.col("root").alias("other"))
    return one.withColumnRenamed("set_id", "sa").join(two, ["band", "key"]).where("sa < sb AND root <> other").select("sa", "sb").distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node of each linked node's component.

    Every round a node takes the smallest label of itself and its neighbours,
    then its label's label.  A hub costs one group of an aggregate; rounds are
    checkpointed and end when no label changes.
    """
    ensure_checkpoint_dir(links.sparkSession)
    both = links.select(F.col(a).alias("n"), F.col(b).alias("o")).unionByName(links.select(F.col(b).alias("n"), F.col(a).alias("o"))).checkpoint()
    labels = both.groupBy(F.col("n").alias("node")).agg(F.least("node", F.min("o")).alias("root")).checkpoint()
    while True:
        near = both.join(labels, both.o == labels.node).groupBy("n").agg(F.min("root").alias("low"))
        low = labels.join(near, labels.node == near.n).select("node", "root", F.least("root", "low").alias("low"))
        of = labels.select(F.col("node").alias("_of"), F.col("root").alias("_root"))
        new = low.join(of, F.col("low") == F.col("_of"), "left") \
            .select("node", F.col("root").alias("was"), F.least("low", F.coalesce("_root", "low")).alias("root")).checkpoint()
        if not new.where("was <> root").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9,
                          few: int = 64) -> DataFrame:
    """doc_id, group_id (smallest doc_id of its near-copies, itself included), group_size and n_links (verified links of its set).

    Every document with a token has a row; those without one, and null texts,
    have none.  Links are verified exactly; which pairs are tried is decided
    by MinHash and, in buckets of more than ``few`` sets, by representatives,
    so a group may miss a member; ``near_duplicates`` is the exact form.
    """
    toks = written_sets(docs, id_col, text_col)
    sets = written(one_a_set(toks), "sets")
    sigs = minima(toks).join(sets.select("row", "set_id"), "row")
    rows = written(buckets(sigs).withColumn("root", F.col("set_id")), "buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.select(F.explode(F.array("sa", "sb")).alias("set_id")).distinct()
        whole = sets.join(met, "set_id", "left_semi").join(toks.select("row", "tokens"), "row")
        left, right = (whole.select(F.col("set_id").alias(c), F.col("tokens").alias(f"t{c}")) for c in ("sa", "sb"))
        inter = F.size(F.array_intersect("tsa", "tsb"))
        return pairs.join(left, "sa").join(right, "sb").withColumn("inter", inter) \
            .where(F.col("inter") / (F.size("tsa") + F.size("tsb") - F.col("inter")) >= threshold).select("sa", "sb").checkpoint()

    tried = head_links(rows, (1, 2, 3)).checkpoint()
    links = verified(tried)
    # a second look, only where a bucket still holds several groups
    roots = connected(links, "sa", "sb").withColumnRenamed("root", "low")
    rows = rows.join(roots, rows.set_id == roots.node, "left").select("set_id", "band", "key", F.coalesce("low", "root").alias("root")).checkpoint()
    again = small_bucket_links(rows, few).unionByName(head_links(rows, (4, 5, 6, 7, 8))).distinct().join(tried, ["sa", "sb"], "left_anti")
    links = links.unionByName(verified(again))
    degree = links.select(F.explode(F.array("sa", "sb")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_links"))
    roots = connected(links, "sa", "sb")
    whole = sets.join(roots, sets.set_id == roots.node, "left").join(degree, "set_id", "left") \
        .select("set_id", F.coalesce("root", "set_id").alias("root"), "rep_id", "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links")).checkpoint()
    groups = whole.groupBy("root").agg(F.min("rep_id").alias("group_id"), F.sum("n_members").alias("group_size"))
    of = whole.join(groups, "root").select("set_id", "group_id", "group_size", "n_links")
    return toks.select("doc_id", "set_id").join(of, "set_id").select("doc_id", "group_id", "group_size", "n_links")
