"""Row numbers within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.llm.common import written


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0-based place in its group) and ``n`` (rows of the group).

    One range-partitioned sort by (group, order) deals a large group to many
    tasks; ``monotonically_increasing_id`` then numbers the rows inside a
    partition, and a table of one row a (partition, group) has the offsets.
    The sorted rows are written first, so that both uses see one numbering.
    Nulls order first; a null group is a group.  ``order`` should be unique,
    else rows that tie land where the sort puts them (and in one task).
    """
    part = F.shiftright("_id", 33)
    sorted_rows = written(rows.orderBy(F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
                          .withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_part", part)
    every = Window.partitionBy("_group")
    before = every.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_rows.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")) \
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")) \
        .select("_group", "_of", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                F.sum("_n").over(every).alias("n"))
    return sorted_rows.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))) \
        .withColumn("pos", F.col("_id") - F.col("_first") + F.col("_off")) \
        .select(*rows.columns, "pos", "n")
