"""The study's analysis step as one Spark job graph.

    raw responses --score once--> scored table (parquet, by model)
        -> parse rates, overall + bootstrap CIs, reliability bins,
           difficulty / domain tables, regression + rank tests,
           hard-vs-easy bootstrap p, Holm, robustness slices,
           verbal vs internal, run metadata

The scored table is written once to the output folder (shared storage on
a cluster) and read back: the reply regexes run once, every later table
reads only the columns it needs, and an executor loss never recomputes the
parse (lineage is cut at the written table).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.operators import calibration as C
from calibra.operators import inference as INF
from calibra.operators import scoring as S
from calibra.sources.sinks import run_metadata, write_table


def overall_with_ci(feat: DataFrame, models: list[str] | None = None, n_boot: int = 2000,
                    seed: int = 42) -> DataFrame:
    """A2 + I4: the per-model table with bootstrap intervals of accuracy, gap and ECE."""
    base = C.overall_by_model(feat, models)
    boot = INF.bootstrap_cells(feat, n_boot=n_boot, seed=seed)
    wide = boot.groupBy("model_id").pivot("metric", ["accuracy", "overconfidence_gap", "ece"]).agg(
        F.first("ci_lo").alias("ci_lo"), F.first("ci_hi").alias("ci_hi"))
    wide = wide.select("model_id",
                       F.col("accuracy_ci_lo").alias("accuracy_ci_lo"), F.col("accuracy_ci_hi").alias("accuracy_ci_hi"),
                       F.col("overconfidence_gap_ci_lo").alias("gap_ci_lo"),
                       F.col("overconfidence_gap_ci_hi").alias("gap_ci_hi"),
                       F.col("ece_ci_lo").alias("ece_ci_lo"), F.col("ece_ci_hi").alias("ece_ci_hi"))
    return base.join(wide, "model_id", "left")


def regression_table(feat: DataFrame, n_boot: int = 2000, seed: int = 100) -> DataFrame:
    """I1 + I2 + A8 + I5: per model regression, Spearman, hard-easy gap and its bootstrap p."""
    reg = INF.difficulty_regression(feat)
    sp = INF.spearman_with_p(feat).drop("n")
    boot = INF.bootstrap_cells(feat, n_boot=n_boot, seed=seed).filter(F.col("metric") == "hard_minus_easy_gap")
    hme = boot.select("model_id", F.col("point").alias("hard_minus_easy_gap"),
                      F.col("p_le_0").alias("hard_gt_easy_p_boot"))
    return reg.join(sp, "model_id").join(hme, "model_id")


def holm_tests(reg: DataFrame, models: list[str]) -> DataFrame:
    """I6 over {model}_slope_ne_0 and {model}_hard_gt_easy, in model order."""
    order = F.lit(len(models))
    for i, m in enumerate(models):
        order = F.when(F.col("model_id") == m, F.lit(i)).otherwise(order)
    pv = reg.select(F.explode(F.array(
        F.struct(F.concat(F.col("model_id"), F.lit("_slope_ne_0")).alias("test"),
                 F.col("p_value").alias("p_raw"), (order * 2).alias("input_ord")),
        F.struct(F.concat(F.col("model_id"), F.lit("_hard_gt_easy")).alias("test"),
                 F.col("hard_gt_easy_p_boot").alias("p_raw"), (order * 2 + 1).alias("input_ord")))).alias("t"))
    return INF.holm(pv.select("t.*"))


# columns that later tables read and the v1 layout has not (or names otherwise)
_LATER_COLUMNS = {"internal_prob_answer": "double", "bank_source": "string", "trial_index": "int", "temperature": "double",
                  "max_output_tokens": "int", "config_version": "string", "answer_index": "int", "input_tokens": "int",
                  "output_tokens": "int", "collection_timestamp": "string"}


def with_later_columns(raw: DataFrame) -> DataFrame:
    """v1 results under the v2 names; what v1 did not record is NULL."""
    for old, new in (("trial", "trial_index"), ("timestamp_utc", "collection_timestamp")):
        if old in raw.columns and new not in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    return raw.withColumns({c: F.lit(None).cast(t) for c, t in _LATER_COLUMNS.items() if c not in raw.columns})


def _read_back(like: DataFrame, path: str, fmt: str) -> DataFrame:
    r = like.sparkSession.read.schema(like.schema)
    return r.option("header", True).option("quote", '"').option("escape", '"').csv(path) if fmt == "csv" else r.format(fmt).load(path)


def run_audit(spark: SparkSession, raw: DataFrame, out_dir: str, models: list[str] | None = None,
              n_boot: int = 2000, fmt: str = "parquet") -> dict:
    """Score once, write every result table under ``out_dir``; return metadata.

    With ``models`` only their rows are analysed, in every table; tables are
    in that order of models (else by name), then of difficulty.
    """
    scored_path = os.path.join(out_dir, "scored")
    raw = with_later_columns(raw if models is None else S.primary_models(raw, models))
    scored = raw if "parse_ok" in raw.columns else S.score_responses(raw)
    write_table(scored, scored_path, partition_by="model_id")
    scored = spark.read.parquet(scored_path)
    feat = S.response_features(scored)
    tables = {
        "parse_rates": C.parse_rates(scored, models),
        "overall_by_model": overall_with_ci(feat, models, n_boot),
        "summary_by_model_difficulty": C.summary_by_difficulty(feat, models),
        "ece_by_model_domain": C.ece_by_domain(feat),
        "verbal_vs_internal": INF.add_correlation_p(C.verbal_vs_internal(feat), "pearson_r_verbal_internal",
                                                    "n_with_internal", out="pearson_p"),
        "original_vs_full": C.robustness_slices(feat),
        "confidence_dispersion": C.confidence_dispersion(feat),
    }
    for name, df in tables.items():
        small = C.ordered(df, models, by_difficulty="difficulty" in df.columns) if "model_id" in df.columns else df
        write_table(small, os.path.join(out_dir, name), fmt=fmt)
    write_table(S.slim_export(scored), os.path.join(out_dir, "slim_results"), fmt=fmt)
    write_table(C.reliability_bins(feat), os.path.join(out_dir, "reliability_bins"), fmt=fmt,
                partition_by="model_id")
    reg_path = os.path.join(out_dir, "difficulty_regression")
    reg = C.ordered(regression_table(feat, n_boot), models)
    write_table(reg, reg_path, fmt=fmt)
    reg = _read_back(reg, reg_path, fmt)
    model_order = models or sorted(r.model_id for r in reg.select("model_id").collect())
    write_table(holm_tests(reg, model_order), os.path.join(out_dir, "holm_corrected_tests"), fmt=fmt)
    meta_df = run_metadata(scored, n_bootstrap=n_boot)
    meta_df.coalesce(1).write.mode("overwrite").json(os.path.join(out_dir, "run_metadata"))
    return spark.read.json(os.path.join(out_dir, "run_metadata")).first().asDict()
