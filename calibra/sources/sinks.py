"""Sinks (S6, S8, S9, S10): append logs, result tables, run metadata.

Writers take a path on shared storage; nothing is collected to the driver
except the one-row metadata document.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append records as JSON lines (one file per task, never rewritten)."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """Result-table sink; bins are partitioned by model_id."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def replace_partitions(df: DataFrame, path: str, partition_by: str = "model_id") -> None:
    """Put ``df`` in place of the partitions it has rows of; other partitions' files stay as they are.

    Rows are staged first and moved in at commit, so a failed write changes
    nothing and a repeated one gives the same table.  ``df`` must not read
    from ``path``.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def remove_partition(spark, path: str, value: str, partition_by: str = "model_id") -> bool:
    """Take one partition (a model's rows) out of a table; False if it has none.  Other files stay."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition_by, value)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{escaped}")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run_metadata(raw: DataFrame, n_bootstrap: int = 2000) -> DataFrame:
    """One aggregation pass over the raw table -> a one-row document."""
    usable = F.col("parse_ok") & F.col("confidence").isNotNull()
    return raw.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count(F.when(usable, F.lit(1))).alias("n_analyzed"),
        F.countDistinct("model_id").alias("n_models"),
        F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("models"),
        (F.max("trial_index") + 1).cast("int").alias("trials_per_question"),
        F.max("temperature").alias("temperature"),
        F.max("max_output_tokens").alias("max_output_tokens"),
        F.lit(n_bootstrap).alias("n_bootstrap"))


def metadata_json(meta: DataFrame) -> str:
    """The one-row metadata table as a JSON document (driver side, one row)."""
    row = meta.first()
    return json.dumps(row.asDict() if row else {}, indent=2, default=str)
