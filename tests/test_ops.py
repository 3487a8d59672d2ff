"""Operations: plan/resume partition, pricing fallbacks, spend cap (T10), retries, merge."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from calibra.operators import ops as OPS


def test_plan_is_done_plus_remaining(spark):
    bank = spark.createDataFrame([(f"q{i}",) for i in range(20)], "question_id string")
    plan = OPS.collection_plan(bank, ["m1", "m2"], 3)
    done = spark.createDataFrame(
        [("q1", "m1", 0), ("q1", "m1", 0), ("q2", "m2", 2), (None, "m1", 1), ("q9", "m3", 0)],
        "question_id string, model_id string, trial_index int")
    rem = OPS.remaining_work(plan, done)
    assert plan.count() == 120
    assert rem.count() == 118
    assert rem.join(done.dropna(), ["question_id", "model_id", "trial_index"]).count() == 0


def test_pricing_fallbacks(spark):
    calls = spark.createDataFrame(
        [("openai", "gpt-4o-mini", 1_000_000, 1_000_000), ("gemini", "nope", 1_000_000, 0),
         ("ACME", "x", 1_000_000, 1_000_000), ("ollama", "llama3.1", 5, 5)],
        "provider string, model string, input_tokens long, output_tokens long")
    got = [r.cost_usd for r in OPS.call_cost(calls).collect()]
    assert got == pytest.approx([0.15 + 0.60, 0.25, 1.0 + 5.0, 0.0])


def test_spend_cap_equality_allowed_then_halt(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    rows = [(1, i, t0 + dt.timedelta(minutes=30 * i), c) for i, c in enumerate([0.25, 0.25, 0.5, 0.01, 0.0])]
    rows += [(2, 10, t0, 0.2)]
    df = spark.createDataFrame(rows, "run_id long, call_id long, ts timestamp, cost_usd double")
    kept = OPS.spend_cap(df, 1.0).orderBy("run_id", "call_id").collect()
    assert [(r.run_id, r.call_id) for r in kept] == [(1, 0), (1, 1), (1, 2), (2, 10)]
    assert kept[2].run_cost_usd == pytest.approx(1.0)


def test_running_spend_matches_plain_window(spark):
    import random
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(r, i, t0 + dt.timedelta(minutes=rnd.randint(0, 600)), rnd.random()) for r in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id long, call_id long, ts timestamp, cost_usd double")
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    plain = {(r.run_id, r.call_id): r.x for r in df.select("run_id", "call_id", F.sum("cost_usd").over(w).alias("x")).collect()}
    seg = {(r.run_id, r.call_id): r.run_cost_usd for r in OPS.running_spend(df).collect()}
    assert seg.keys() == plain.keys()
    for k in seg:
        assert seg[k] == pytest.approx(plain[k])


def test_retry_collapse(spark):
    rows = [(1, 1, None, None, False, 100, 10, 0.5, None), (1, 2, "B", 70, True, 100, 10, 0.25, None),
            (1, 3, "C", 60, True, 100, 10, 4.0, None),
            (2, 1, None, None, False, 50, 5, None, "note"), (2, 2, None, None, False, 50, 5, 1.0, "note2"),
            # five attempts: the fourth is beyond the protocol, parsed or not
            *[(3, k, "D" if k == 4 else None, 50 if k == 4 else None, k == 4, 10, 1, 1.0, None) for k in range(1, 6)]]
    df = spark.createDataFrame(rows, "cell_id long, attempt int, predicted_letter string, confidence int, parse_ok boolean, "
                                     "input_tokens long, output_tokens long, call_cost_usd double, internal_prob_note string")
    collapsed = OPS.retry_collapse(df)
    assert "Window" not in collapsed._jdf.queryExecution().toString()
    out = {r.cell_id: r for r in collapsed.collect()}
    assert (out[1].attempts_used, out[1].predicted_letter, out[1].input_tokens, out[1].call_cost_usd) == (2, "B", 200, 0.75)
    assert out[1].internal_prob_note == "parse_attempts=2/3"
    assert (out[2].attempts_used, out[2].parse_ok, out[2].output_tokens, out[2].call_cost_usd) == (2, False, 10, 1.0)
    assert out[2].internal_prob_note == "note2 | parse_attempts=2/3"
    assert (out[3].attempts_used, out[3].parse_ok, out[3].input_tokens, out[3].internal_prob_note) == (3, False, 30, "parse_attempts=3/3")


def test_merge_existing_wins(spark):
    e = spark.createDataFrame([("k1", "old"), ("k2", "old")], "k string, v string")
    n = spark.createDataFrame([("k2", "new"), ("k3", "new")], "k string, v string")
    got = sorted((r.k, r.v) for r in OPS.merge_results(e, n, ["k"]).collect())
    assert got == [("k1", "old"), ("k2", "old"), ("k3", "new")]


def test_dry_run_total_row(spark):
    bank = spark.createDataFrame([(f"q{i}",) for i in range(540)], "question_id string")
    plan = OPS.collection_plan(bank, ["claude_haiku", "gpt4o_mini", "gemini_flash"], 5)
    out = {r.model_id: r for r in OPS.dry_run_estimate(plan).collect()}
    assert out["TOTAL"].calls == 8100
    assert out["gpt4o_mini"].est_cost_usd == pytest.approx(2700 * (350 * 0.15 + 80 * 0.60) / 1e6)
    assert out["claude_haiku"].est_hours == pytest.approx(2700 * 3.5 / 3600)
    assert out["TOTAL"].est_hours == pytest.approx(2700 * (3.5 + 2.0 + 5.5) / 3600)


def test_dry_run_reproduces_published_estimate(spark):
    """540 items x 5 trials x 3 models: ~$2.86 and ~8.25 h (2.62 / 1.50 / 4.12 h)."""
    bank = spark.createDataFrame([(f"q{i}",) for i in range(540)], "question_id string")
    plan = OPS.collection_plan(bank, ["claude_haiku", "gpt4o_mini", "gemini_flash"], 5)
    out = {r.model_id: r for r in OPS.dry_run_estimate(plan).collect()}
    assert round(out["TOTAL"].est_cost_usd, 2) == 2.86
    assert out["TOTAL"].est_hours == pytest.approx(8.25)
    assert [round(out[m].est_hours, 2) for m in ("claude_haiku", "gpt4o_mini", "gemini_flash")] == [2.62, 1.5, 4.12]


def test_error_rows_count_as_done(spark):
    """A done row carrying an error is not re-planned."""
    bank = spark.createDataFrame([("q1",), ("q2",)], "question_id string")
    plan = OPS.collection_plan(bank, ["m"], 1)
    done = spark.createDataFrame([("q1", "m", 0, "TimeoutError: x")],
                                 "question_id string, model_id string, trial_index int, error string")
    assert [r.question_id for r in OPS.remaining_work(plan, done).collect()] == ["q2"]


def test_segmented_row_number_equals_plain_window_on_hot_key(spark):
    from pyspark.sql import Window

    from calibra.functions.windows import segmented_row_number
    rows = [("hot", k, k % 3) for k in range(3000)] + [(f"c{k % 50}", k, 0) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, k long, t long").repartition(6)
    w = Window.partitionBy("g").orderBy("k", "t")
    plain = {(r.g, r.k): r.rn for r in df.select("g", "k", F.row_number().over(w).alias("rn")).collect()}
    seg = {(r.g, r.k): r.rn for r in segmented_row_number(df, ["g"], ["k", "t"], F.floor(F.col("k") / 250), "rn")
           .collect()}
    assert seg == plain
