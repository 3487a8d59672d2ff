"""Connected components of a link table, by Spark jobs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each linked node.

    Alternates the large-star and small-star steps: each node links its
    larger neighbours (then its smaller ones and itself) to the smallest
    neighbour.  A node's neighbourhood is never gathered: its minimum is a
    grouped aggregate, joined back to the links, so a hub costs one group.
    The rounds (logarithmic in a chain's length) end when a round changes
    nothing; each round is a written table.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b") \
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    while True:
        large = _star(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        small = written(_star(large, False), "links")
        # a fixed point: the stars' edges are the same set as before
        before, after = (x.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
                         for x in (links, small))
        links = small
        if tuple(before) == tuple(after):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")) \
                .unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: links holds both directions; small: from the larger to the smaller node."""
    # written, so that both sides of the join are plain shuffles, which Spark splits under a hub
    low = written(links.groupBy("a").agg(F.min("b").alias("low"))
                  .select(F.col("a").alias("n"), F.least("a", "low").alias("low")), "low")
    near = links.join(low, links.a == low.n)
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("low").alias("b")) \
            .unionAll(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()
