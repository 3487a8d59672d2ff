"""Running sums and order statistics over groups of any size, without a window over a group.

Rows are range-partitioned by (group, order); inside a partition a window
over (group, partition) adds up, and a table of one row a (group, partition)
has what lies before.  A group with a third of all rows, or of one instant's
rows, is dealt to many tasks like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.session import ensure_checkpoint_dir


def running_sums(rows: DataFrame, keys: list[str], order: list[str], amount: Column, before: str, total: str | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the earlier rows of the group (0.0 for the first), and the group's ``total``.

    The sorted rows are checkpointed, so that sums and offsets see one
    numbering.  Nulls order first; a null key is a group; rows that tie in
    ``order`` follow each other as the sort puts them.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = rows.withColumn("_amount", amount.cast("double")).orderBy(*keys, *order) \
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint().withColumn("_part", F.shiftright("_id", 33))
    names = [f"_k{i}" for i in range(len(keys))]
    every = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    earlier = every.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_part").alias("_of")) \
        .agg(F.sum("_amount").alias("_sum")) \
        .select(*names, "_of", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_off"), F.sum("_sum").over(every).alias("_all"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    same = placed["_part"] == offsets["_of"]
    for k, n in zip(keys, names):
        same = same & placed[k].eqNullSafe(offsets[n])
    joined = placed.withColumn("_local", F.sum("_amount").over(inside)).join(offsets, same)
    more = [F.col("_all").alias(total)] if total else []
    return joined.select(*rows.columns, (F.col("_off") + F.coalesce(F.col("_local"), F.lit(0.0))).alias(before), *more)


def quantiles(values: DataFrame, value: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles (linear interpolation) of a column over all rows; null values don't count.

    Equal values are counted first; the counts' running sums tell which
    values hold the wanted ranks, and only those few rows reach the driver.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    sums = running_sums(counted, [], ["v"], F.col("w"), "before", "total")
    places = [F.lit(p) * (F.col("total") - 1) for p in probabilities]
    ranks = [f(x) for x in places for f in (F.floor, F.ceil)]
    holds = [(F.col("before") <= r) & (r < F.col("before") + F.col("w")) for r in ranks]
    wanted = holds[0]
    for h in holds[1:]:
        wanted = wanted | h
    rows = sums.where(wanted).select("v", "total", F.array(*holds).alias("holds")).collect()  # two rows a probability at most
    out: list[float | None] = []
    for i, p in enumerate(probabilities):
        if not rows:
            out.append(None)
            continue
        lo, hi = (next(r.v for r in rows if r.holds[2 * i + k]) for k in (0, 1))
        at = p * (rows[0].total - 1)
        out.append(lo + (hi - lo) * (at - int(at)))
    return out
