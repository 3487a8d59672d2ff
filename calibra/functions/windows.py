"""Skew-safe ordered numbering.

``row_number()`` over a partition sorts the whole partition in one task; a
key holding a third of all rows would serialise the job.  The segmented form
cuts each partition into buckets of a monotone function of the first order
column, numbers rows inside (partition, bucket) and adds the count of all
earlier buckets, taken from a table of one row per (partition, bucket).
The result equals the plain row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmented_row_number(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                         bucket: Column, out: str = "row_number") -> DataFrame:
    """1-based row number per partition in ``order_cols`` order.

    ``bucket`` must be non-decreasing in the first order column (e.g.
    ``floor(key / width)``), so buckets never interleave in the order.
    """
    b = df.withColumn("_seg", bucket)
    local = Window.partitionBy(*partition_cols, "_seg").orderBy(*order_cols)
    numbered = b.withColumn("_local", F.row_number().over(local))
    counts = b.groupBy(*partition_cols, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition_cols).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*partition_cols, "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # left join to a table distinct on its keys: Catalyst drops it (and the
    # count) when a query does not use the number
    return numbered.join(offsets, [*partition_cols, "_seg"], "left").withColumn(
        out, (F.col("_off") + F.col("_local")).cast("int")).drop("_seg", "_local", "_off")
