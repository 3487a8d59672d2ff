"""Inference: published goldens, brute-force checks, Holm traps."""
import math

import numpy as np
import pandas as pd
import pytest

from calibra.functions import stats as ST
from calibra.operators import inference as INF

# Published per-model regression rows (n = 2700 each): slope, se, p, rho, rho_p.
REGRESSION_GOLDEN = [
    (0.02621666666666673, 0.006624270808870144, 7.763811614482804e-05, 0.04211209845283075, 0.028657496726485678,
     0.013227507363544146, 0.03920582596978931),
    (0.16291666666666704, 0.010026937122557053, 1.0428718045729258e-56, 0.2222410476300119, 1.448949075985994e-31,
     0.1432554107541085, 0.1825779225792256),
    (0.07363888888888905, 0.0075398643417408425, 3.6313433450033663e-22, 0.18030402582974456, 3.656766218739815e-21,
     0.05885439382753607, 0.08842338395024202),
]


@pytest.mark.parametrize("slope,se,p,rho,rho_p,lo,hi", REGRESSION_GOLDEN)
def test_t_tail_goldens(slope, se, p, rho, rho_p, lo, hi):
    assert ST.t_two_sided_p(slope / se, 2698) == pytest.approx(p, rel=1e-9)
    t = rho * math.sqrt(2698 / (1 - rho * rho))
    assert ST.t_two_sided_p(t, 2698) == pytest.approx(rho_p, rel=1e-9)
    q = ST.t_quantile(0.975, 2698)
    assert slope - q * se == pytest.approx(lo, rel=1e-9)
    assert slope + q * se == pytest.approx(hi, rel=1e-9)


def test_pearson_and_chi2_goldens():
    r = 0.22195165701888564
    t = r * math.sqrt(2698 / (1 - r * r))
    assert ST.t_two_sided_p(t, 2698) == pytest.approx(1.7411181757105158e-31, rel=1e-9)
    # 99/98/70 parsed of 120 per tier
    obs = np.array([[99, 98, 70], [21, 22, 50]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    chi2 = ((obs - exp) ** 2 / exp).sum()
    assert chi2 == pytest.approx(23.5738, abs=1e-4)
    assert ST.chi2_sf(chi2, 2) == pytest.approx(7.604e-06, rel=1e-3)
    assert ST.chi2_sf(3.0, 5) == pytest.approx(0.6999858358786271, rel=1e-12)


def test_chi2_operator_matches_hand_computation(spark):
    rows = ([("m", "easy", True)] * 99 + [("m", "easy", False)] * 21 + [("m", "medium", True)] * 98
            + [("m", "medium", False)] * 22 + [("m", "hard", True)] * 70 + [("m", "hard", False)] * 50)
    df = spark.createDataFrame(rows, "model_id string, difficulty string, parse_ok boolean")
    r = INF.parse_missingness_chi2(df).first()
    assert r.chi2 == pytest.approx(23.5738, abs=1e-4) and r.dof == 2
    assert r.p_value == pytest.approx(7.6035e-06, rel=1e-3)


def _feat(spark, rows):
    return spark.createDataFrame(rows, "model_id string, difficulty_numeric int, overconfidence_gap_row double")


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 4, 500)
    y = 0.05 * x + rng.normal(0, 0.3, 500)
    df = _feat(spark, [("m", int(a), float(b)) for a, b in zip(x, y)])
    r = INF.difficulty_regression(df).first()
    X = np.column_stack([np.ones_like(x, float), x])
    beta, res, *_ = np.linalg.lstsq(X, y, rcond=None)
    sigma2 = res[0] / (len(x) - 2)
    se = math.sqrt(sigma2 * np.linalg.inv(X.T @ X)[1, 1])
    assert r.slope == pytest.approx(beta[1], rel=1e-9)
    assert r.se == pytest.approx(se, rel=1e-9)
    assert r.p_value == pytest.approx(ST.t_two_sided_p(beta[1] / se, len(x) - 2), rel=1e-9)
    assert r.r_squared == pytest.approx(1 - res[0] / ((y - y.mean()) ** 2).sum(), rel=1e-9)


def test_constant_x_gives_nulls(spark):
    r = INF.difficulty_regression(_feat(spark, [("m", 2, 0.1), ("m", 2, 0.3), ("m", 2, 0.2)])).first()
    assert r.slope is None and r.se is None and r.p_value is None


def test_spearman_matches_pandas_average_ranks(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(1, 4, 300)
    y = np.round(rng.normal(0, 1, 300), 1)
    df = _feat(spark, [("m", int(a), float(b)) for a, b in zip(x, y)])
    got = INF.spearman_with_p(df).first()
    s = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert got.spearman_rho == pytest.approx(s, rel=1e-9)
    t = s * math.sqrt(298 / (1 - s * s))
    assert got.spearman_p == pytest.approx(ST.t_two_sided_p(t, 298), rel=1e-9)


def test_holm_published_and_traps(spark):
    names = ["claude_haiku_slope_ne_0", "claude_haiku_hard_gt_easy", "gpt4o_mini_slope_ne_0",
             "gpt4o_mini_hard_gt_easy", "gemini_flash_slope_ne_0", "gemini_flash_hard_gt_easy"]
    ps = [7.763811614482804e-05, 0.0, 1.0428718045729258e-56, 0.0, 3.6313433450033663e-22, 0.0]
    df = spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(zip(names, ps))],
                               "test string, p_raw double, input_ord int")
    out = {r.test: r for r in INF.holm(df).collect()}
    assert [out[n].rank for n in ["claude_haiku_hard_gt_easy", "gpt4o_mini_hard_gt_easy",
                                  "gemini_flash_hard_gt_easy"]] == [1, 2, 3]  # ties keep input order
    assert out["gpt4o_mini_slope_ne_0"].p_holm == pytest.approx(3.128615413718777e-56)
    assert out["gemini_flash_slope_ne_0"].p_holm == pytest.approx(7.262686690006733e-22)
    assert out["claude_haiku_slope_ne_0"].p_holm == pytest.approx(7.763811614482804e-05)
    # NaN sorts as 1.0, stays NULL, counts in m; adjusted p capped at 1 before the running max
    df2 = spark.createDataFrame([("a", 0.3, 0), ("b", float("nan"), 1), ("c", 0.01, 2), ("d", 0.4, 3)],
                                "test string, p_raw double, input_ord int")
    o2 = {r.test: r for r in INF.holm(df2).collect()}
    assert o2["c"].p_holm == pytest.approx(0.04) and o2["c"].rank == 1
    assert o2["a"].p_holm == pytest.approx(0.9)
    assert o2["d"].p_holm == pytest.approx(0.9)      # 0.4*2 = 0.8 < running max 0.9
    assert o2["b"].p_holm is None and o2["b"].rank == 4
    for r in o2.values():
        if r.p_holm is not None:
            assert r.p_holm >= r.p_raw


def _boot_feat(spark):
    rng = np.random.default_rng(11)
    rows = []
    for m, acc in (("m1", 0.8), ("m2", 0.6)):
        for i in range(400):
            d = ["easy", "medium", "hard"][i % 3]
            c = int(rng.integers(40, 101))
            rows.append((m, f"q{i}", 0, d, c, c / 100.0, float(rng.random() < acc)))
    return spark.createDataFrame(rows, "model_id string, question_id string, trial_index int, difficulty string, "
                                       "confidence int, confidence_norm double, correct double")


def test_multinomial_bootstrap_is_partition_invariant_and_covers_point(spark):
    f = _boot_feat(spark)
    a = {(r.model_id, r.metric): r for r in INF.bootstrap_cells(f, n_boot=400).collect()}
    b = {(r.model_id, r.metric): r for r in INF.bootstrap_cells(f.repartition(7), n_boot=400).collect()}
    assert a.keys() == b.keys() and len(a) == 8
    for k in a:
        assert a[k].ci_lo == pytest.approx(b[k].ci_lo) and a[k].ci_hi == pytest.approx(b[k].ci_hi)
        if a[k].metric != "hard_minus_easy_gap":
            assert a[k].ci_lo <= a[k].point <= a[k].ci_hi
    # accuracy interval width ~ 2 * 1.96 * sqrt(p(1-p)/n)
    acc = a[("m1", "accuracy")]
    p = acc.point
    assert acc.ci_hi - acc.ci_lo == pytest.approx(2 * 1.96 * math.sqrt(p * (1 - p) / 400), rel=0.25)


def test_bootstrap_resamples_the_score_it_is_given(spark):
    from pyspark.sql import functions as F
    f = _boot_feat(spark).withColumn("other", F.lit(0.5))
    point, lo, hi = ({r.model_id: r[k] for r in INF.bootstrap_cells(f, n_boot=200, score="other")
                      .filter("metric = 'overconfidence_gap'").collect()} for k in ("point", "ci_lo", "ci_hi"))
    want = {r.model_id: 0.5 - r.a for r in f.groupBy("model_id").agg(F.avg("correct").alias("a")).collect()}
    assert point == pytest.approx(want)
    assert all(lo[m] < want[m] < hi[m] for m in want)


def test_one_sided_bootstrap_p_can_be_zero(spark):
    """No +1 correction - a clear hard > easy effect gives p = 0.0 exactly."""
    rows = [("m", f"q{i}", 0, "easy", 90, 0.9, 1.0) for i in range(300)] + \
           [("m", f"h{i}", 0, "hard", 90, 0.9, float(i % 10 == 0)) for i in range(300)]
    f = spark.createDataFrame(rows, "model_id string, question_id string, trial_index int, difficulty string, "
                                    "confidence int, confidence_norm double, correct double")
    r = INF.bootstrap_cells(f, n_boot=500).filter("metric = 'hard_minus_easy_gap'").first()
    assert r.p_le_0 == 0.0 and r.point == pytest.approx(0.9)


def test_jvm_tails_match_reference_functions(spark):
    from pyspark.sql import functions as F
    rows = [(3.9576683114406555, 2698.0, 23.5738, 2), (1.5, 3.0, 3.0, 5), (0.2, 1.0, 10.0, 3), (4.0, 10.0, 100.0, 4)]
    df = spark.createDataFrame(rows, "t double, d double, x double, k int")
    out = ST.with_t_tests(df, "t", "d", p_out="p", q=0.975, q_out="q").select(
        "t", "d", "x", "k", "p", "q", ST.chi2_sf_col("x", "k").alias("c")).collect()
    for r in out:
        assert r.p == pytest.approx(ST.t_two_sided_p(r.t, r.d), rel=1e-10)
        assert r.q == pytest.approx(ST.t_quantile(0.975, r.d), rel=1e-10)
        assert r.c == pytest.approx(ST.chi2_sf(r.x, r.k), rel=1e-10)


def test_holm_large_equals_window_version(spark):
    rng = np.random.default_rng(9)
    ps = rng.random(5000) ** 3
    ps[::7] = 0.0                    # ties
    ps[::97] = float("nan")          # NaN sorts as 1.0, stays NULL
    rows = [(f"t{i}", float(p), i) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "test string, p_raw double, input_ord int").repartition(7)
    a = {r.test: (r.rank, r.p_holm) for r in INF.holm(df).collect()}
    b = {r.test: (r.rank, r.p_holm) for r in INF.holm_large(df).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        if a[k][1] is None:
            assert b[k][1] is None
        else:
            assert b[k][1] == pytest.approx(a[k][1], rel=1e-12)
