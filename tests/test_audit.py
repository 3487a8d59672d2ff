"""End-to-end audit pipeline at the smallest scale."""
import os
import tempfile

from calibra.plans.audit import run_audit
from calibra.sources import fixtures as FX
from tests.conftest import SF001


def test_run_audit_writes_all_tables(spark):
    out = tempfile.mkdtemp(prefix="calibra-audit-", dir="/tmp")
    raw = FX.raw_responses(spark, SF001).drop("l_linenumber", "l_discount")
    meta = run_audit(spark, raw, out, models=FX.FIXTURE_MODELS, n_boot=200)
    assert meta["n_raw"] == raw.count() and meta["n_models"] == 3
    for name in ["scored", "parse_rates", "overall_by_model", "summary_by_model_difficulty", "reliability_bins",
                 "ece_by_model_domain", "verbal_vs_internal", "original_vs_full", "difficulty_regression",
                 "holm_corrected_tests", "slim_results", "run_metadata"]:
        assert os.path.isdir(os.path.join(out, name)), name
    holm = spark.read.parquet(os.path.join(out, "holm_corrected_tests")).collect()
    assert len(holm) == 6 and sorted(r["rank"] for r in holm) == list(range(1, 7))
    overall = spark.read.parquet(os.path.join(out, "overall_by_model")).collect()
    for r in overall:
        assert r.accuracy_ci_lo <= r.accuracy <= r.accuracy_ci_hi
        assert r.ece_ci_lo <= r.ece_ci_hi
    bins = spark.read.parquet(os.path.join(out, "reliability_bins"))
    assert sorted(r.model_id for r in bins.select("model_id").distinct().collect()) == ["A", "N", "R"]
    slim = spark.read.parquet(os.path.join(out, "slim_results"))
    assert "raw_response" not in slim.columns


def test_only_configured_models_in_every_table(spark):
    out = tempfile.mkdtemp(prefix="calibra-audit-", dir="/tmp")
    raw = FX.raw_responses(spark, SF001).drop("l_linenumber", "l_discount")
    meta = run_audit(spark, raw, out, models=["R", "A"], n_boot=100, fmt="csv")
    assert meta["n_models"] == 2 and meta["n_raw"] == raw.filter("model_id in ('R', 'A')").count()
    read = lambda name: spark.read.option("header", True).csv(os.path.join(out, name))
    assert sorted(int(r["rank"]) for r in read("holm_corrected_tests").collect()) == [1, 2, 3, 4]
    assert [r.model_id for r in read("overall_by_model").collect()] == ["R", "A"]
    for name in ("parse_rates", "ece_by_model_domain", "original_vs_full", "confidence_dispersion", "difficulty_regression", "slim_results"):
        assert {r.model_id for r in read(name).select("model_id").distinct().collect()} == {"R", "A"}, name


def test_v1_csv_results_give_the_same_tables(spark):
    """S1 + P1 + P2 end to end: a v1 CSV (text flags, '80.0' confidences,
    multi-line replies) read back gives the same calibration table."""
    from pyspark.sql import functions as F

    from calibra.operators import calibration as C
    from calibra.operators.scoring import response_features
    from calibra.schemas import RESPONSE_V1_SCHEMA
    from calibra.sources.readers import read_results_csv

    scored = FX.responses(spark, SF001)
    v1 = scored.select(
        "question_id", "subject", "domain", "difficulty", "model_id", "backend", "model_name",
        F.col("trial_index").alias("trial"), "temperature", F.lit("prompt\nwith lines").alias("prompt"),
        "raw_response", "error", "predicted_letter", "correct_letter",
        F.when(F.col("is_correct"), "True").otherwise("False").alias("is_correct"),
        F.format_string("%.1f", F.col("confidence").cast("double")).alias("confidence"),
        F.when(F.col("parse_ok"), "True").otherwise("False").alias("parse_ok"),
        F.col("collection_timestamp").cast("string").alias("timestamp_utc"))
    out = tempfile.mkdtemp(prefix="calibra-v1-", dir="/tmp")
    v1.write.option("header", True).option("quote", '"').option("escape", '"').csv(out + "/csv")
    back = read_results_csv(spark, out + "/csv", RESPONSE_V1_SCHEMA)
    assert back.count() == scored.count()
    a = {r.model_id: r for r in C.overall_by_model(response_features(back)).collect()}
    b = {r.model_id: r for r in C.overall_by_model(response_features(scored)).collect()}
    for m in b:
        assert a[m].n == b[m].n and abs(a[m].ece - b[m].ece) < 1e-12 and abs(a[m].accuracy - b[m].accuracy) < 1e-12
    v1_out = tempfile.mkdtemp(prefix="calibra-audit-", dir="/tmp")
    meta = run_audit(spark, back, v1_out, models=FX.FIXTURE_MODELS, n_boot=100)
    assert meta["n_raw"] == scored.count()
    assert spark.read.parquet(os.path.join(v1_out, "holm_corrected_tests")).count() == 6
    assert spark.read.parquet(os.path.join(v1_out, "verbal_vs_internal")).count() == 3
