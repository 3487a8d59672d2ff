"""Structured Streaming monitors (ST1-ST4).

The collection log is append-only; a Spark user runs it as a stream:

ST1 ingest   file source with an explicit schema, exactly once per
             (question, model, trial) via ``dropDuplicatesWithinWatermark``;
             ``start_landing`` keeps that for good, against the landed table
ST2 progress per-model counts, parse rate and cost (update mode)
ST3 drift    tumbling event-time windows of accuracy / gap / ECE, using the
             same single-level aggregate builders as batch, so one stateful
             operator suffices (append mode, late rows dropped)
ST4 alerts   per-run spend above a cap (update mode)

Each ``*_frame`` function is pure DataFrame code that works on a batch or a
streaming DataFrame; ``start_*`` wires sources and sinks with a checkpoint
folder on reliable storage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions import metrics as M
from calibra.operators import ops as OPS
from calibra.operators.scoring import response_features, score_responses
from calibra.session import ensure_checkpoint_dir

KEYS = ["question_id", "model_id", "trial_index"]


def event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast in the session time zone."""
    return df.withColumn(col, F.col(col).cast(T.TimestampType()))


def ingest_frame(raw: DataFrame, ts_col: str = "collection_timestamp",
                 delay: str = "1 hour", keys=KEYS) -> DataFrame:
    """ST1: exactly one scored row per cell, duplicates within the delay dropped."""
    deduped = event_time(raw, ts_col).withWatermark(ts_col, delay) \
        .dropDuplicatesWithinWatermark(list(keys))
    return score_responses(deduped)


def land_new(batch: DataFrame, path: str, keys=KEYS, partition: str = "model_id") -> None:
    """ST1 for good: append to the table at ``path`` the rows of a batch whose key it does not hold yet.

    The table is partitioned, and only the partitions that the batch has are
    read for its keys, so a batch costs what its own models have landed.  A
    batch that is run again after a failure writes nothing twice: its rows
    are either landed as a whole (the write commits once) or not at all.
    Rows of a batch that repeat a key are one of them.
    """
    keys = list(keys)
    spark = batch.sparkSession
    once = batch.dropDuplicates(keys)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        parts = [r[0] for r in batch.select(partition).distinct().collect()]  # one value a partition of the batch
        landed = spark.read.schema(batch.schema).parquet(path).where(
            F.col(partition).isin([p for p in parts if p is not None]) | (F.col(partition).isNull() if None in parts else F.lit(False)))
        landed = landed.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        once = once.join(landed, same, "left_anti")
    once.write.mode("append").partitionBy(partition).parquet(path)


def start_landing(stream: DataFrame, path: str, name: str, checkpoint: str, keys=KEYS, partition: str = "model_id"):
    """Run ``land_new`` on every batch of a stream; a key is written once, however late it comes again."""
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True) \
        .foreachBatch(lambda batch, _: land_new(batch, path, keys, partition)).start()


def progress_frame(scored: DataFrame) -> DataFrame:
    """ST2: per-model rows, parse rate and cost so far."""
    costed = OPS.rates(scored, "backend", "model_name").withColumn("_cost", OPS.cost_expr())
    return costed.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("parse_ok").cast("double")).alias("parse_ok_rate"),
        F.sum("_cost").alias("cost_usd"))


def drift_frame(scored: DataFrame, ts_col: str = "collection_timestamp", window: str = "30 days",
                delay: str | None = None) -> DataFrame:
    """ST3: per window and model: n, accuracy, gap, ECE (one aggregation)."""
    f = response_features(scored)
    if delay is not None:
        f = event_time(f, ts_col).withWatermark(ts_col, delay)
    agg = f.groupBy(F.window(ts_col, window).alias("w"), "model_id").agg(
        F.count(F.lit(1)).alias("n"),
        M.accuracy("correct").alias("accuracy"),
        M.gap("confidence_norm", "correct").alias("overconfidence_gap"),
        M.ece("confidence_norm", "correct").alias("ece"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "model_id", "n", "accuracy", "overconfidence_gap", "ece")


def spend_alert_frame(costed: DataFrame, cap: float, run_col: str = "run_id") -> DataFrame:
    """ST4: runs whose spend so far exceeds the cap (alert; the exact cut is W1)."""
    return costed.groupBy(run_col).agg(F.sum("cost_usd").alias("run_cost_usd"),
                                       F.count(F.lit(1)).alias("n_calls")) \
        .filter(F.col("run_cost_usd") > F.lit(cap))


# ---------------------------------------------------------------------------
# Wiring
# ---------------------------------------------------------------------------

def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def start(frame: DataFrame, name: str, mode: str, sink: str = "memory", path: str | None = None,
          available_now: bool = True, checkpoint: str | None = None):
    """Start a query; ``availableNow`` processes what exists and stops."""
    spark = frame.sparkSession
    w = frame.writeStream.outputMode(mode).queryName(name).option(
        "checkpointLocation", checkpoint or checkpoint_path(spark, name))
    if available_now:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").start()
    if sink == "parquet":
        return w.format("parquet").option("path", path).start()
    raise ValueError(sink)


def append_batches(frame: DataFrame, path: str, name: str, checkpoint: str | None = None):
    """ST1 sink: each micro-batch lands in its own ``batch_id=N`` folder.

    The write overwrites that folder, so a batch replayed after a failure
    (same id, same input offsets) replaces its earlier partial output instead
    of duplicating it: exactly-once output on top of at-least-once delivery.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    spark = frame.sparkSession
    return (frame.writeStream.foreachBatch(write).queryName(name)
            .option("checkpointLocation", checkpoint or checkpoint_path(spark, name))
            .trigger(availableNow=True).start())


def daily_spend_frame(costed: DataFrame, ts_col: str = "ts", delay: str = "1 hour",
                      window: str = "1 day") -> DataFrame:
    """Per-provider spend per event-time window; closed windows only in append mode."""
    c = event_time(costed, ts_col).withWatermark(ts_col, delay)
    agg = c.groupBy(F.window(ts_col, window).alias("w"), "provider").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("cost_usd").alias("cost_usd"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "provider", "n_calls", "cost_usd")


def spend_alert_stateful(costed: DataFrame, cap: float, run_col: str = "run_id", ts_col: str = "ts",
                         idle: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """ST4 with bounded state: one alert per run, state dropped when the run goes idle.

    A custom stateful operator (``applyInPandasWithState``) keeps per run the
    spend so far; the first call that takes it over the cap emits one alert
    row (with that call's time).  An event-time timeout removes a run's state
    once the watermark passes its last call plus ``idle``, so state grows
    with active runs, not with all runs ever seen.  Each group's batch is a
    small pandas frame of that run's new calls.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from calibra.session import ship_package

    ship_package(costed.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    key_type = dict(costed.dtypes)[run_col]
    out_schema = f"{run_col} {key_type}, run_cost_usd double, n_calls long, crossed_at timestamp"
    state_schema = "total double, n long, alerted boolean, last_ms long"

    def fn(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        total, n, alerted, last_ms = state.get if state.exists else (0.0, 0, False, 0)
        out = []
        for pdf in batches:
            pdf = pdf.sort_values([ts_col], kind="mergesort")
            running = total + pdf["cost_usd"].fillna(0.0).cumsum()
            if not alerted:
                over = (running > cap).to_numpy().nonzero()[0]
                if len(over):
                    i = int(over[0])
                    alerted = True
                    out.append({run_col: key[0], "run_cost_usd": float(running.iloc[i]),
                                "n_calls": int(n + i + 1), "crossed_at": pdf[ts_col].iloc[i]})
            total = float(running.iloc[-1]) if len(pdf) else total
            n += len(pdf)
            if len(pdf):
                last_ms = max(last_ms, int(pd.Timestamp(pdf[ts_col].max()).value // 1_000_000))
        state.update((total, n, alerted, last_ms))
        state.setTimeoutTimestamp(max(last_ms + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out)

    c = event_time(costed, ts_col).withWatermark(ts_col, delay)
    return c.groupBy(run_col).applyInPandasWithState(
        fn, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
