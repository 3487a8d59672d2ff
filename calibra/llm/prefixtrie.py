"""Prefix trie of conversations, rolled up in bands of depth.

Every distinct sequence of a conversation's first d turns is a node at depth
d, below the textless root.

*Keys*: a node's key is a hash of its whole sequence, built without walking
it: turns are cut into bands of ``height`` positions, each band hashes its own
prefixes, and the sequence of band hashes is treated in the same way, so that
the rounds grow with the logarithm of the longest conversation and no row
holds more than ``height`` turns.

*Roll-up*: a node explodes only to its ancestors inside its own band, which
sums each node's share of the band.  What a band's first nodes have so far is
again a trie, of bands instead of turns, and is rolled up in the same way;
then each band's first nodes hand their completed totals to the nodes of the
band above.  Explosion is at most ``height`` rows a node and a band's first
node, and the rounds are logarithmic in the depth.

Ends of a node (the members that stop there) may be a third of all
conversations: their ids are sorted over the whole cluster, joined in chunks,
and one task streams a node's chunks through the hash.

Nulls and odd cases: rows without a conversation id belong to no conversation
and are left out; null turns come first, turns with equal numbers follow the
order of their digests, and repeated rows are turns of their own; a null role
or text is empty; a member without turns ends at the root; an empty table has
no members and so no nodes, the root included; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import in_arrow, written
from calibra.llm.ranking import ranked

HEIGHT = 16
_CHUNK_BITS = 10
ROOT = ""


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), digest and bytes (of the text) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"),
        F.monotonically_increasing_id().alias("_at"))
    return ranked(written(rows, "turns"), "conv_id", ["turn", "digest", "_at"]).drop("turn", "_at")


def _bands(rows: DataFrame, height: int) -> DataFrame:
    """conv_id, band, keys, bytes: the keys of up to ``height`` consecutive positions.

    rows: conv_id, pos, digest, bytes.
    """
    item = F.struct("pos", "digest", "bytes")
    bands = rows.groupBy("conv_id", F.expr(f"pos div {height}").alias("band")) \
        .agg(F.sort_array(F.collect_list(item)).alias("items")) \
        .select("conv_id", "band", F.col("items.digest").alias("digests"), F.col("items.bytes").alias("bytes"))
    local = F.transform("digests", lambda _, i: F.sha2(F.array_join(F.slice("digests", F.lit(1), i + 1), "").cast("binary"), 256))
    bands = written(bands.select("conv_id", "band", "bytes", local.alias("keys")), "bands")
    if not bands.where("band > 0").limit(1).count():
        return bands
    over = _bands(bands.select("conv_id", F.col("band").alias("pos"), F.element_at("keys", -1).alias("digest"),
                               F.lit(0).cast("bigint").alias("bytes")), height)
    so_far = over.select(F.col("conv_id").alias("_c"), F.posexplode("keys").alias("_i", "_before"), F.col("band").alias("_b")) \
        .select("_c", (F.col("_b") * height + F.col("_i") + 1).alias("_next"), "_before")
    joined = bands.join(so_far, (F.col("conv_id") == F.col("_c")) & (F.col("band") == F.col("_next")), "left")
    whole = F.transform("keys", lambda k: F.when(F.col("_before").isNull(), k)
                        .otherwise(F.sha2(F.concat(F.col("_before"), k).cast("binary"), 256)))
    return written(joined.select("conv_id", "band", "bytes", whole.alias("keys")), "keys")


def _with_path(nodes: DataFrame, bands: DataFrame, height: int) -> DataFrame:
    """``nodes`` (key, conv_id, pos, ...) with path: the keys of the node's band down to itself."""
    of = bands.select(F.col("conv_id").alias("_c"), F.col("band").alias("_b"), "keys")
    return nodes.join(of, (nodes.conv_id == F.col("_c")) & (F.expr(f"pos div {height}") == F.col("_b"))) \
        .select(*nodes.columns, F.slice("keys", F.lit(1), (F.col("pos") % height + 1).cast("int")).alias("path"))


def _rollup(nodes: DataFrame, bands: DataFrame, sums: list[str], height: int) -> DataFrame:
    """key and the sums over the key's whole subtree.

    nodes: key, conv_id (a member), pos, sums, path; bands: conv_id, band, keys.
    """
    total = [F.sum(c).alias(c) for c in sums]
    within = written(nodes.select(F.explode("path").alias("key"), *sums).groupBy("key").agg(*total), "within")
    if not nodes.where(F.col("pos") >= height).limit(1).count():
        return within
    tops = nodes.where(F.col("pos") % height == 0).select("key", "conv_id", F.expr(f"pos div {height}").alias("pos")) \
        .join(within, "key")
    over = written(bands.groupBy("conv_id", F.expr(f"band div {height}").alias("over"))
                   .agg(F.sort_array(F.collect_list(F.struct("band", F.element_at("keys", 1).alias("key")))).alias("tops"))
                   .select("conv_id", F.col("over").alias("band"), F.col("tops.key").alias("keys")), "tops")
    tops = written(_with_path(tops, over, height), "band_tops")
    done = _rollup(tops, over, sums, height)
    above = bands.select(F.col("conv_id").alias("_c"), (F.col("band") + 1).alias("_b"), "keys")
    handed = tops.where("pos > 0").select("key", F.col("conv_id").alias("_of"), "pos").join(done, "key") \
        .join(above, (F.col("_of") == F.col("_c")) & (F.col("pos") == F.col("_b"))) \
        .select(F.explode("keys").alias("key"), *sums)
    return written(within.unionByName(handed).groupBy("key").agg(*total), "whole")


def _streamed_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's chunks, comma-joined; the rows come sorted by (key, chunk)."""
    now, state = None, None
    for b in batches:
        keys, hashes = [], []
        for key, ids in zip(b["key"].to_pylist(), b["ids"].to_pylist()):
            if key != now:
                if state:
                    keys.append(now)
                    hashes.append(state.hexdigest())
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def _ends_hash(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of (key, conv_id) rows."""
    chunk = F.shiftright("_id", _CHUNK_BITS)  # of the sorted rows: ascending within a key
    chunks = ends.orderBy("key", "conv_id").withColumn("_id", F.monotonically_increasing_id()) \
        .groupBy("key", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids")) \
        .select("key", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk") \
        .transform(in_arrow, _streamed_hash, "key string, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id
    (the parent's conv_id), n_convs, n_children, n_leaves (of the subtree),
    saved (bytes of the subtree that members share beyond the first: per node
    n_convs - 1 times the bytes of its last turn) and ends_sha256 (of the ids
    of the members that end there).

    turns: conv_id, pos (0, 1, ... without gaps), digest, bytes; members:
    conv_id, n (turns, may be 0), one row a conversation.
    """
    bands = _bands(turns, height)
    rows = bands.select("conv_id", "band", F.posexplode(F.arrays_zip("keys", "bytes")).alias("i", "x")) \
        .select("conv_id", (F.col("band") * height + F.col("i")).alias("pos"), F.col("x.keys").alias("key"), F.col("x.bytes").alias("bytes"))
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("pos").alias("pos"),
                                    F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = _with_path(nodes, bands, height)
    # the parent of a band's first node is the last key of the band before
    last = bands.select(F.col("conv_id").alias("_c"), (F.col("band") + 1).alias("_b"), F.element_at("keys", -1).alias("_last"))
    first = (F.col("pos") % height == 0) & (F.col("pos") > 0)
    inner = nodes.where(~first).withColumn("parent", F.when(F.col("pos") == 0, ROOT).otherwise(F.element_at("path", -2)))
    outer = nodes.where(first).join(last, (F.col("conv_id") == F.col("_c")) & (F.expr(f"pos div {height}") == F.col("_b"))) \
        .withColumn("parent", F.col("_last")).select(*inner.columns)
    nodes = written(inner.unionByName(outer), "nodes")
    children = written(nodes.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    valued = written(nodes.join(children, "key", "left")
                     .withColumns({"n_children": F.coalesce("n_children", F.lit(0)),
                                   "leaves": F.col("n_children").isNull().cast("bigint"),
                                   "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "valued")
    whole = _rollup(valued.select("key", "conv_id", "pos", "path", "leaves", "saved"), bands, ["leaves", "saved"], height)

    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    below = valued.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                       F.count(F.when(F.col("pos") == 0, 1)).alias("children")).first()
    long = lambda v: F.lit(v).cast("bigint")
    top = members.limit(1).select(long(root.conv_id).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"),
                                  long(root.n_convs).alias("n_convs"), long(below.children).alias("n_children"),
                                  long(below.leaves or 1).alias("n_leaves"), long(below.saved or 0).alias("saved"), F.lit(ROOT).alias("key"))
    mine = valued.drop("leaves", "saved", "path", "bytes").join(whole, "key").select(
        "key", "conv_id", (F.col("pos") + 1).alias("depth"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved", "parent")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = mine.where("depth > 1").join(parents, "parent")
    flat = mine.where("depth = 1").withColumn("parent_conv_id", long(root.conv_id))
    every = top.unionByName(deep.select(*top.columns)).unionByName(flat.select(*top.columns))

    final = members.where("n > 0").select(F.col("conv_id").alias("_c"), F.expr(f"(n - 1) div {height}").alias("_b"))
    ends = bands.join(final, (F.col("conv_id") == F.col("_c")) & (F.col("band") == F.col("_b"))) \
        .select(F.element_at("keys", -1).alias("key"), "conv_id") \
        .unionByName(members.where("n = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    hashes = written(_ends_hash(written(ends, "ends")), "hashes")
    none = hashlib.sha256().hexdigest()
    return every.join(hashes, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))).drop("key")
