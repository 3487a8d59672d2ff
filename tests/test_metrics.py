"""ECE and reliability bins: traps T1-T4, T16, T17 and property tests."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibra.functions import metrics as M
from calibra.operators import calibration as C


def ref_ece(conf, correct, n_bins=10):
    """Definition: equal-width bins from linspace, [lo, hi) except the last."""
    conf, correct = np.asarray(conf, float), np.asarray(correct, float)
    edges = np.linspace(0, 1, n_bins + 1)
    total = 0.0
    for i in range(n_bins):
        lo, hi = edges[i], edges[i + 1]
        m = (conf >= lo) & ((conf <= hi) if i == n_bins - 1 else (conf < hi))
        if m.sum():
            total += m.mean() * abs(correct[m].mean() - conf[m].mean())
    return total


def test_edges_equal_linspace():
    assert M.bin_edges() == list(np.linspace(0, 1, 11))


def test_bin_edges_trap(spark):
    vals = [0.0, 0.1, 0.29, 0.3, 0.31, 0.6, 0.7, 0.9, 0.95, 1.0, 1.2, -0.1, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(M.bin_index("s")).collect()]
    # 0.3, 0.6 and 0.7 fall in the LOWER bin; 1.0 in the last; outside / NaN / NULL unbinned
    assert got == [0, 1, 2, 2, 3, 5, 6, 9, 9, 9, None, None, None, None]


def test_ece_counts_unbinned_rows_in_n(spark):
    rows = [(0.95, 1.0), (0.95, 0.0), (1.2, 1.0), (float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "s double, c double")
    got = df.agg(M.ece("s", "c")).first()[0]
    assert got == pytest.approx((2 / 4) * abs(0.5 - 0.95))


def test_empty_group_ece_is_zero_and_spine(spark):
    feat = spark.createDataFrame(
        [("m1", "easy", 80, 0.8, 1.0)], "model_id string, difficulty string, confidence int, "
        "confidence_norm double, correct double")
    out = {(r.model_id, r.difficulty): r for r in C.summary_by_difficulty(feat, ["m1", "m2"]).collect()}
    assert len(out) == 6
    assert out[("m2", "hard")].n == 0 and out[("m2", "hard")].ece == 0.0
    assert out[("m2", "hard")].accuracy is None


def test_sd_is_sample_on_0_100_scale(spark):
    feat = spark.createDataFrame([("m", c, c / 100.0, 1.0) for c in (90, 95, 100)],
                                 "model_id string, confidence int, confidence_norm double, correct double")
    r = C.overall_by_model(feat).first()
    assert r.conf_sd == pytest.approx(np.std([90, 95, 100], ddof=1))
    assert r.pct_conf_ge_95 == pytest.approx(2 / 3)
    assert r.mean_confidence == pytest.approx(0.95)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.booleans()), min_size=1, max_size=60))
def test_ece_matches_definition_and_bins(spark, rows):
    data = [("m", c, c / 100.0, float(k)) for c, k in rows]
    feat = spark.createDataFrame(data, "model_id string, confidence int, confidence_norm double, correct double")
    got = C.ece_by_model(feat).first().ece
    conf = [c / 100.0 for c, _ in rows]
    corr = [float(k) for _, k in rows]
    assert got == pytest.approx(ref_ece(conf, corr), abs=1e-12)
    bins = C.reliability_bins(feat).collect()
    assert sum(b["count"] for b in bins) == len(rows)
    from_bins = sum(b["count"] / len(rows) * abs(b.accuracy - b.confidence) for b in bins)
    assert got == pytest.approx(from_bins, abs=1e-12)
    gap = abs(np.mean(conf) - np.mean(corr))
    assert got >= gap - 1e-12


def test_weighted_ece_equals_repeated_rows(spark):
    df = spark.createDataFrame([(0.35, 1.0, 2.0), (0.35, 0.0, 1.0), (0.95, 1.0, 3.0)], "s double, c double, w double")
    rep = spark.createDataFrame([(0.35, 1.0)] * 2 + [(0.35, 0.0)] + [(0.95, 1.0)] * 3, "s double, c double")
    assert df.agg(M.ece("s", "c", "w")).first()[0] == pytest.approx(rep.agg(M.ece("s", "c")).first()[0])


def test_hard_minus_easy_null_when_tier_missing(spark):
    feat = spark.createDataFrame([("m", "easy", 0.9, 1.0), ("k", "easy", 0.9, 1.0), ("k", "hard", 0.8, 0.0)],
                                 "model_id string, difficulty string, confidence_norm double, correct double")
    out = {r.model_id: r for r in C.hard_minus_easy(feat).collect()}
    assert out["m"].hard_minus_easy_gap is None and out["m"].hard_gt_easy == "INCOMPLETE"
    assert out["k"].hard_minus_easy_gap == pytest.approx(0.8 - (0.9 - 1.0))
    assert out["k"].hard_gt_easy == "YES"


def test_internal_threshold_counts_raw_values_before_coercion(spark):
    """< 30 raw non-null values -> note; the count is taken before coercion."""
    rows = [("m29", 0.8, 1.0, "0.7") for _ in range(29)] + [("m30", 0.8, 1.0, "0.7") for _ in range(29)] \
        + [("m30", 0.8, 1.0, "junk")]
    feat = spark.createDataFrame(rows, "model_id string, confidence_norm double, correct double, "
                                       "internal_prob_answer string")
    out = {r.model_id: r for r in C.verbal_vs_internal(feat).collect()}
    assert out["m29"].note == "insufficient / unavailable internal probs" and out["m29"].n_with_internal == 29
    assert out["m30"].note is None and out["m30"].n_with_internal == 29
    assert out["m30"].ece_verbal == pytest.approx(0.2) and out["m30"].ece_internal == pytest.approx(0.3)


def test_presentation_order(spark):
    df = spark.createDataFrame([("A", "hard"), ("R", "easy"), ("A", "easy"), ("N", "medium")],
                               "model_id string, difficulty string")
    got = [(r.model_id, r.difficulty) for r in C.ordered(df, ["R", "A", "N"], by_difficulty=True).collect()]
    assert got == [("R", "easy"), ("A", "easy"), ("A", "hard"), ("N", "medium")]
