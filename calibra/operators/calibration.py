"""Grouped calibration tables.

Each table is one ``groupBy().agg()`` over the feature table: partial
aggregation on the map side reduces every task's rows to one buffer per
group before the shuffle, so a hot model (a third of all rows) costs no more
shuffle than a cold one.  Expected calibration error is an ordinary
aggregate expression (``functions.metrics.ece``): no second pass, no join of
per-bin results.

Empty categories (unobserved model x difficulty cells) appear with n = 0 and
NULL means when a configured spine is given, like a categorical group-by
that keeps unobserved categories.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import metrics as M
from calibra.operators.scoring import primary_models
from calibra.schemas import DIFFICULTY_ORDER, DOMAIN_ORDER, N_BINS

SCORE = "confidence_norm"
CORRECT = "correct"
# Fixed value: note of a group with too few internal probabilities.
INSUFFICIENT_INTERNAL_NOTE = "insufficient / unavailable internal probs"


def _core_aggs(score=SCORE, correct=CORRECT, weight=None, with_n=True) -> list:
    aggs = []
    if with_n:
        aggs.append(F.count(F.lit(1)).alias("n"))
    aggs += [
        M.accuracy(correct, weight).alias("accuracy"),
        M.mean_score(score, weight).alias("mean_confidence"),
        M.gap(score, correct, weight).alias("overconfidence_gap"),
        M.ece(score, correct, weight).alias("ece"),
    ]
    return aggs


def _spine(spark: SparkSession, names: list[str], values: list[list]) -> DataFrame:
    """All combinations of a few configured categories (a fixed literal dim)."""
    rows = list(itertools.product(*values))
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema)


def _with_spine(agg: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    out = spine.join(agg, keys, "left")
    if "n" in agg.columns:
        out = out.withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("bigint")))
    if "ece" in agg.columns:
        out = out.withColumn("ece", F.coalesce(F.col("ece"), F.lit(0.0)))
    return out


def parse_rates(raw: DataFrame, models: list[str] | None = None) -> DataFrame:
    """A1: n and parse-ok rate per model over all raw rows."""
    src = raw if models is None else primary_models(raw, models)
    agg = src.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("parse_ok").cast("double")).alias("parse_ok_rate"))
    if models is None:
        return agg
    return _with_spine(agg, _spine(raw.sparkSession, ["model_id"], [models]), ["model_id"])


def overall_by_model(feat: DataFrame, models: list[str] | None = None) -> DataFrame:
    """A2: n, accuracy, mean confidence, gap, ECE, conf SD (0-100), share >= 95."""
    src = feat if models is None else primary_models(feat, models)
    agg = src.groupBy("model_id").agg(
        *_core_aggs(),
        F.stddev_samp(F.col("confidence").cast("double")).alias("conf_sd"),
        M.share_at_least("confidence", 95).alias("pct_conf_ge_95"))
    if models is None:
        return agg
    return _with_spine(agg, _spine(feat.sparkSession, ["model_id"], [models]), ["model_id"])


def summary_by_difficulty(feat: DataFrame, models: list[str] | None = None) -> DataFrame:
    """A3: per model x difficulty: n, accuracy, mean confidence, gap, ECE."""
    src = feat if models is None else primary_models(feat, models)
    agg = src.groupBy("model_id", "difficulty").agg(*_core_aggs())
    if models is None:
        return agg
    spine = _spine(feat.sparkSession, ["model_id", "difficulty"], [models, DIFFICULTY_ORDER])
    return _with_spine(agg, spine, ["model_id", "difficulty"])


def ece_by_model(feat: DataFrame, score: str = SCORE) -> DataFrame:
    """A4: expected calibration error per model (single pass)."""
    return feat.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), M.ece(score, CORRECT).alias("ece"))


def reliability_bins(feat: DataFrame, score: str = SCORE, n_bins: int = N_BINS) -> DataFrame:
    """A5: non-empty reliability bins per model.

    ``groupBy(model, bin)``: partial aggregation leaves at most n_bins rows
    per model and task, so the shuffle is tiny whatever the row count.
    """
    b = M.bin_index(F.col(score).cast("double"), n_bins)
    # Unbinned rows form a NULL group that is dropped after the aggregation.
    # The predicate reads the aggregated count on purpose: a predicate on the
    # grouping key alone would be pushed below the aggregate and the parse
    # projection, re-evaluating the whole score expression per row.
    out = feat.groupBy("model_id", b.alias("bin")).agg(
        F.avg(F.col(CORRECT)).alias("accuracy"),
        F.avg(F.col(score).cast("double")).alias("confidence"),
        F.count(F.lit(1)).alias("count"))
    out = M.drop_null_groups(out, ["bin"], "count")
    lo, hi = M.bin_bound(F.col("bin"), "lo", n_bins), M.bin_bound(F.col("bin"), "hi", n_bins)
    return out.select("model_id", F.col("bin").cast("int").alias("bin"),
                      lo.alias("bin_lo"), hi.alias("bin_hi"), ((lo + hi) / 2).alias("bin_center"),
                      "accuracy", "confidence", "count")


def ece_by_domain(feat: DataFrame) -> DataFrame:
    """ECE and n per model x domain."""
    return feat.groupBy("model_id", "domain").agg(
        M.ece(SCORE, CORRECT).alias("ece"), F.count(F.lit(1)).alias("n"))


def verbal_vs_internal(feat: DataFrame, internal_col: str = "internal_prob_answer",
                       min_rows: int = 30) -> DataFrame:
    """A7 (+ I3): verbal confidence vs an internal probability, same rows.

    Groups with fewer than ``min_rows`` raw non-null internal values get a
    note instead of metrics; the threshold counts before numeric coercion.
    Pearson's p-value is added by ``inference.add_pearson_p``.
    """
    raw_present = F.col(internal_col).isNotNull()
    ip = F.col(internal_col).cast("string").try_cast("double") \
        if dict(feat.dtypes).get(internal_col) == "string" else F.col(internal_col).cast("double")
    usable = ip.isNotNull()
    w = F.when(usable, F.lit(1.0)).otherwise(F.lit(0.0))
    agg = feat.groupBy("model_id").agg(
        F.count(F.when(raw_present, F.lit(1))).alias("n_raw_internal"),
        F.count(F.when(usable, F.lit(1))).alias("n_usable"),
        M.safe_corr(F.when(usable, F.col(SCORE)), ip).alias("r"),
        M.ece(F.when(usable, F.col(SCORE)), F.col(CORRECT), w).alias("ece_v"),
        M.ece(ip, F.col(CORRECT), w).alias("ece_i"))
    enough = F.col("n_raw_internal") >= min_rows
    return agg.select(
        "model_id",
        F.when(enough, F.col("n_usable")).otherwise(F.col("n_raw_internal")).alias("n_with_internal"),
        F.when(~enough, F.lit(INSUFFICIENT_INTERNAL_NOTE)).alias("note"),
        F.when(enough, F.col("r")).alias("pearson_r_verbal_internal"),
        F.when(enough, F.col("ece_v")).alias("ece_verbal"),
        F.when(enough, F.col("ece_i")).alias("ece_internal"))


def hard_minus_easy(feat: DataFrame) -> DataFrame:
    """gap(hard) - gap(easy) per model and the YES/NO flag."""
    d = F.col("difficulty")
    agg = feat.groupBy("model_id").agg(
        M.conditional_gap(SCORE, CORRECT, d == "easy").alias("easy_gap"),
        M.conditional_gap(SCORE, CORRECT, d == "hard").alias("hard_gap"))
    diff = F.col("hard_gap") - F.col("easy_gap")
    return agg.select("model_id", "easy_gap", "hard_gap", diff.alias("hard_minus_easy_gap"),
                      F.when(diff.isNull(), F.lit("INCOMPLETE"))
                      .when(diff > 0, F.lit("YES")).otherwise(F.lit("NO")).alias("hard_gt_easy"))


def robustness_slices(feat: DataFrame, subset_label: str = "original_180",
                      full_label: str = "full_540") -> DataFrame:
    """J10 + A9: metrics on the original subset and on everything, one scan.

    Each row is exploded into the slices it belongs to, then one groupBy.
    """
    labels = F.when(F.col("bank_source") == subset_label,
                    F.array(F.lit(subset_label), F.lit(full_label))).otherwise(F.array(F.lit(full_label)))
    return (feat.select(F.explode(labels).alias("bank"), "model_id", SCORE, CORRECT)
            .groupBy("bank", "model_id").agg(*_core_aggs()))


def confidence_dispersion(feat: DataFrame, by_difficulty: bool = False) -> DataFrame:
    """A10: mean, sample SD and share >= 95 of confidence on the 0-100 scale."""
    keys = ["model_id", "difficulty"] if by_difficulty else ["model_id"]
    c = F.col("confidence").cast("double")
    return feat.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(c).alias("mean_confidence_0_100"),
        F.stddev_samp(c).alias("sd_confidence"),
        M.share_at_least(c, 95).alias("pct_confidence_ge_95"))


def verification_counts(raw: DataFrame) -> DataFrame:
    """Rows, parsed rows, accuracy and mean confidence per model x difficulty."""
    usable = F.col("parse_ok") & F.col("confidence").isNotNull()
    return raw.groupBy("model_id", "difficulty").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(usable, F.lit(1))).alias("n_analyzed"),
        F.avg(F.col("parse_ok").cast("double")).alias("parse_ok_rate"),
        F.avg(F.when(usable, F.col("is_correct").cast("double"))).alias("accuracy"),
        F.avg(F.when(usable, F.col("confidence").cast("double"))).alias("mean_confidence_0_100"))


def capability_vs_ece(feat: DataFrame) -> DataFrame:
    """Accuracy against ECE per model (chart-ready)."""
    return feat.groupBy("model_id").agg(
        M.accuracy(CORRECT).alias("accuracy"), M.ece(SCORE, CORRECT).alias("ece"))


def ece_heatmap(feat: DataFrame, domains: list[str] = DOMAIN_ORDER) -> DataFrame:
    """ECE pivot model x domain (explicit pivot values, no extra job)."""
    cells = ece_by_domain(feat)
    return cells.groupBy("model_id").pivot("domain", domains).agg(F.first("ece"))


def difficulty_pivots(feat: DataFrame) -> DataFrame:
    """R2: accuracy, mean confidence (0-100) and gap pivoted by difficulty."""
    cells = feat.groupBy("model_id", "difficulty").agg(
        F.avg(CORRECT).alias("acc"),
        F.avg(F.col("confidence").cast("double")).alias("conf"),
        M.gap(SCORE, CORRECT).alias("gap"))
    p = cells.groupBy("model_id").pivot("difficulty", DIFFICULTY_ORDER).agg(
        F.first("acc").alias("accuracy"), F.first("conf").alias("confidence"),
        F.first("gap").alias("gap"))
    return p


def ordered(df: DataFrame, models: list[str] | None = None, by_difficulty: bool = False) -> DataFrame:
    """K6: presentation order - configured model order, then easy < medium < hard.

    Sorting happens only on small result tables, right before a sink.
    """
    cols = []
    if models:
        ordinal = F.lit(len(models))
        for i, m in reversed(list(enumerate(models))):
            ordinal = F.when(F.col("model_id") == m, F.lit(i)).otherwise(ordinal)
        cols.append(ordinal)
    cols.append(F.col("model_id"))
    if by_difficulty:
        d = F.col("difficulty")
        cols.append(F.when(d == "easy", 0).when(d == "medium", 1).when(d == "hard", 2).otherwise(3))
    return df.orderBy(*cols)
