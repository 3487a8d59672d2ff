"""Answer-token probability (T12), format comparison, trial consistency vs brute force."""
import itertools
import math

import numpy as np
import pytest

from calibra.operators import diagnostics as DG
from calibra.schemas import TOKEN_LOGPROBS_TYPE

SCHEMA = f"letter string, tokens {TOKEN_LOGPROBS_TYPE.simpleString()}"


def tok(t, lp, top=()):
    return {"token": t, "logprob": lp, "top_logprobs": [{"token": a, "logprob": b} for a, b in top]}


def _run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return DG.answer_token_prob(df, "tokens", "letter").collect()


def test_token_matching_rules(spark):
    rows = [
        ("A", [tok("ANSWER", -0.1), tok(":", -0.01), tok(" A", -0.2, [(" A", -0.2), (" B", -1.0)])]),
        ("A", [tok("ANSWER", -0.1), tok("An", -0.5, []), tok(" A", -0.2)]),       # two-letter token first
        ("B", [tok("ANSWER", -0.1), tok(" maybe", -0.2)]),                        # no match
        ("C", [tok(" C", None, [(" C", -0.1)])]),                                 # missing logprob
        ("D", [tok(" D", -0.3, [(" D", -0.3), (" A", -2.0), (" D", -0.9)])]),     # duplicate alt: last wins
        ("A", [tok(" A", -0.3, [])]),                                            # empty alternatives
        (None, [tok(" A", -0.3)]),
        ("A", []),
    ]
    out = _run(spark, rows)
    assert out[0].internal_prob_answer == pytest.approx(math.exp(-0.2))
    assert out[0].internal_prob_alternatives == pytest.approx({" A": math.exp(-0.2), " B": math.exp(-1.0)})
    assert out[0].internal_prob_note is None
    assert out[1].internal_prob_answer == pytest.approx(math.exp(-0.5))
    assert out[1].internal_prob_note == ("logprob extraction ambiguous: 2 tokens match 'A' at indices [1, 2]; "
                                         "using first match")
    assert out[2].internal_prob_answer is None
    assert out[2].internal_prob_note == ("logprob extraction ambiguous/failed: no token matching answer letter "
                                         "'B' among 2 tokens")
    assert out[3].internal_prob_answer is None and out[3].internal_prob_note == "matched token missing logprob"
    assert out[4].internal_prob_alternatives == pytest.approx({" D": math.exp(-0.9), " A": math.exp(-2.0)})
    assert out[5].internal_prob_answer == pytest.approx(math.exp(-0.3))
    assert out[5].internal_prob_alternatives is None
    assert out[6].internal_prob_note == "no answer letter or empty logprobs"
    assert out[7].internal_prob_note == "no answer letter or empty logprobs"


def test_format_scoring(spark):
    df = spark.createDataFrame([
        ("ANSWER: B\nCONFIDENCE: 9", "FINAL_ANSWER: b", "B", "m"),
        ("ANSWER: C\nCONFIDENCE: 9", "It is a hard one.", "B", "m"),
        ("nothing", "my pick is B.", "B", "m")],
        "raw_response string, freeform_reply string, correct_letter string, model_id string")
    sc = DG.score_formats(df)
    d = DG.format_discordance(sc).first()
    assert (d.n_pairs, d.both_correct, d.constrained_only, d.unconstrained_only, d.neither) == (3, 1, 0, 1, 1)
    p = DG.format_comparison(sc).first()
    assert p.constrained == pytest.approx(1 / 3) and p.unconstrained == pytest.approx(2 / 3)


def test_trial_consistency_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for q in range(40):
        base = int(rng.integers(30, 90))
        for t in range(int(rng.integers(1, 6))):
            rows.append(("m", f"q{q}", t, int(np.clip(base + rng.integers(-10, 11), 0, 100))))
    df = spark.createDataFrame(rows, "model_id string, question_id string, trial_index int, confidence int")
    got = DG.trial_consistency(df).first()
    by_q = {}
    for _, q, _, c in rows:
        by_q.setdefault(q, []).append(c)
    xs, ys, diffs = [], [], []
    for vals in by_q.values():
        for a, b in itertools.combinations(vals, 2):
            xs += [a, b]
            ys += [b, a]
            diffs.append(abs(a - b))
    assert got.n_pairs == len(diffs)
    assert got.mean_abs_delta == pytest.approx(np.mean(diffs))
    assert got.pair_corr == pytest.approx(np.corrcoef(xs, ys)[0, 1])


def test_token_matches_and_replies_are_worked_out_once(spark):
    from calibra.sources import fixtures as FX
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = spark.createDataFrame([("A", [("A", -0.5, [("A", -0.5), ("B", -1.0)])])],
                               "letter string, toks array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>")
    out = DG.answer_token_prob(df, "toks", "letter")
    assert out.columns == ["letter", "toks", "internal_prob_answer", "internal_prob_alternatives", "internal_prob_note"]
    assert plan(out).count("sequence(") <= 1
    assert plan(FX.token_logprobs(spark, "/root/testdata/sf0.001")).count("ANSWER:\\s") <= 1
