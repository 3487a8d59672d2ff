"""Merkle manifest of a dataset: hash trees built by lag and lead windows.

Every row is a leaf.  Within a group the leaves are ordered, and every
``arity`` consecutive nodes hash to a parent (the last run may have fewer,
even one) until one node, the group's subroot, remains; the subroots, ordered
by group (null first, then bytewise), hash to the root in the same way.

*Bands*: ``height`` levels are built at once.  The rows of a group are cut
into blocks of ``arity ** height`` consecutive ones, and a window over
(group, block) has all that those levels need.  At level k a node stands on
its first leaf's row, so its siblings are at the fixed offsets
``j * arity ** k``: lag and lead columns, masked by the node's slot in its run
and by the run's length, supply them, and the rows of first children hash the
parents.  A block's top nodes are the rows of the next band: each band has
``arity ** height`` times fewer rows, and no task holds more than a block.

*Paths*: per level a row has the digests before and after its own node in the
run, taken from the node's first row.  They go down again by joins on
(group, block); a path holds a row's whole proof.

Nulls and odd cases: null columns hash as ``-``; rows with equal order keys
(a repeated id) are ordered by their digest, and equal rows are
interchangeable; null ids come first; a null group is a group of its own; a
group of one row is its own subroot and a table of one row its own root, with
an empty path; an empty table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import written
from calibra.llm.ranking import ranked

PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row's values: ``-`` for null, else UTF-8 byte count, colon, value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                    for t in texts])


def _band(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """``nodes`` (g, pos, n, digest, ...) with block, path within the block, and top (on first rows)."""
    block = nodes.withColumn("block", F.expr(f"pos div {arity ** height}")).withColumn("_d", F.col("digest"))
    w = Window.partitionBy("g", "block").orderBy("pos")
    entries = []
    for level in range(height):
        span = arity ** level
        slot = F.expr(f"pos div {span} % {arity}")
        first, alive = F.col("pos") % span == 0, F.col("n") > span
        for j in range(1, arity):
            block = block.withColumns({f"_b{j}": F.lag("_d", j * span).over(w), f"_a{j}": F.lead("_d", j * span).over(w)})
        before = F.concat(*[F.when(slot >= j, F.col(f"_b{j}")).otherwise("") for j in range(arity - 1, 0, -1)])
        after = F.concat(*[F.when(slot < arity - j, F.coalesce(f"_a{j}", F.lit(""))).otherwise("") for j in range(1, arity)])
        block = block.withColumn(f"_e{level}", F.when(first & alive, F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(alive, digest(F.col("_d"), F.col(f"_e{level}.after"))).otherwise(F.col("_d"))
        block = block.withColumn("_d", F.when(F.col("pos") % (span * arity) == 0, parent))
        entries.append(F.last(f"_e{level}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    path = F.filter(F.array(*entries), lambda e: e.isNotNull()).cast(PATH)
    return block.select(*nodes.columns, "block", path.alias("path"), F.col("_d").alias("top"))


def _climb(nodes: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The written bands from the leaves up, and the one node left in each group (g, digest)."""
    span, bands = arity ** height, []
    while True:
        band = written(_band(nodes, arity, height), "band")
        bands.append(band)
        tops = band.where(F.col("pos") % span == 0).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("digest"))
        if (band.agg(F.max("n")).first()[0] or 0) <= span:
            return bands, tops.select("g", "digest")
        nodes = tops


def _descend(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves' rows with whole paths; above: (g, _path, ...) of each group, carried along."""
    extra = [c for c in above.columns if c not in ("g", "_path")]
    above = above.withColumn("_pos", F.lit(0).cast("bigint"))
    for k in range(len(bands) - 1, -1, -1):
        band = bands[k]
        up = above.select(F.col("g").alias("_g"), "_pos", "_path", *extra)
        joined = band.join(up, (band["g"] == F.col("_g")) & (band["block"] == F.col("_pos")))
        path = F.concat(band["path"], F.col("_path"))
        if k:
            above = joined.select(band["g"], band["pos"].alias("_new"), path.alias("_new_path"), *extra) \
                .withColumnsRenamed({"_new": "_pos", "_new_path": "_path"})
        else:
            keep = [band[c] for c in band.columns if c not in ("path", "top", "block")]
            return joined.select(*keep, path.alias("path"), *extra)
    raise AssertionError


def manifest(rows: DataFrame, *, leaf_col: str = "leaf", group: str = "lang", order: str = "doc_id",
             arity: int = 2, height: int = 6) -> DataFrame:
    """The columns of ``rows`` with ``subroot``, ``root`` and ``path``.

    ``rows`` has the leaves' digests in ``leaf_col``; other columns are
    carried along, but for columns named like the three, which are replaced.
    ``path`` holds, level by level from the leaf to the root, the digests that
    stand ``before`` and ``after`` the row's own node in its run.
    """
    new = ["subroot", "root", "path"]
    kept = [c for c in rows.columns if c not in new]
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit(""))
    # the last key splits a hot run of equal rows; they are interchangeable
    slim = written(rows.select(F.struct(*kept).alias("row"), key.alias("g"), F.col(leaf_col).alias("digest"),
                               F.col(order).alias("_order"), F.monotonically_increasing_id().alias("_at")), "leaves")
    nodes = ranked(slim, "g", ["_order", "digest", "_at"]).drop("_order", "_at")
    bands, subroots = _climb(nodes, arity, height)
    one = ranked(subroots.withColumnRenamed("g", "of").withColumn("g", F.lit("")), "g", ["of"])
    top_bands, top = _climb(one, arity, height)
    of_groups = _descend(top_bands, top.select("g", F.array().cast(PATH).alias("_path"), F.col("digest").alias("root")))
    above = of_groups.select(F.col("of").alias("g"), F.col("path").alias("_path"), F.col("digest").alias("subroot"), "root")
    return _descend(bands, above).select("row.*", *new)


def proof(path: Column) -> Column:
    """The siblings of a path, level by level, left to right, in one string."""
    return F.array_join(F.transform(path, lambda e: F.concat(e["before"], e["after"])), "")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf_digest, lambda acc, e: digest(e["before"], acc, e["after"]))
