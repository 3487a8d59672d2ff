"""Published result goldens recomputed by the Spark operators.

Reliability bins of the three v2 models (bin mean confidence, accuracy,
count) are expanded to rows; the published ECE must come back exactly and
the published bootstrap intervals within Monte-Carlo tolerance.
"""
import pytest
from pyspark.sql import functions as F

from calibra.operators import calibration as C
from calibra.operators import inference as INF

# Published reliability bins (accuracy, mean confidence, count) per model.
BINS = {
    "claude_haiku": [
        (0.0, 0.05, 5), (0.45454545454545453, 0.14999999999999997, 11), (0.3333333333333333, 0.25, 15),
        (0.5, 0.34999999999999987, 22), (0.5813953488372093, 0.4472093023255815, 43), (0.5, 0.575, 4),
        (0.5, 0.6435714285714287, 14), (0.7023255813953488, 0.7462325581395348, 430),
        (0.9300291545189504, 0.8431778425655975, 343), (0.9597352454495311, 0.9467015995587423, 1813)],
    "gpt4o_mini": [
        (0.0, 0.6, 5), (0.8181818181818182, 0.75, 22), (0.649316851008458, 0.8472674040338318, 1537),
        (0.8045774647887324, 0.906029929577465, 1136)],
    "gemini_flash": [(1.0, 0.85, 10), (0.8758364312267658, 0.9922490706319703, 2690)],
}
# Published ECE, accuracy and their 95% bootstrap intervals.
PUBLISHED = {
    "claude_haiku": dict(ece=0.03278888888888895, ece_lo=0.023395740740740932, ece_hi=0.043733796296296375,
                         acc=0.8948148148148148, acc_lo=0.8833240740740741, acc_hi=0.9066666666666666),
    "gpt4o_mini": dict(ece=0.15703703703703692, ece_lo=0.14108703703703698, ece_hi=0.1751856481481481,
                       acc=0.7148148148148148, acc_lo=0.6974074074074074, acc_hi=0.7311203703703704),
    "gemini_flash": dict(ece=0.1165370370370371, ece_lo=0.10396296296296303, ece_hi=0.12941018518518504,
                         acc=0.8762962962962964, acc_lo=0.8633333333333333, acc_hi=0.8885185185185185),
}


def _rows():
    rows = []
    for m, bins in BINS.items():
        for acc, conf, n in bins:
            k = round(acc * n)
            rows += [(m, "easy", conf, 1.0)] * k + [(m, "easy", conf, 0.0)] * (n - k)
    return rows


@pytest.fixture(scope="module")
def feat(spark):
    return spark.createDataFrame(_rows(), "model_id string, difficulty string, confidence_norm double, correct double")


def test_published_ece_and_accuracy(feat):
    out = {r.model_id: r for r in C.ece_by_model(feat).collect()}
    acc = {r.model_id: r.accuracy for r in C.capability_vs_ece(feat).collect()}
    for m, p in PUBLISHED.items():
        assert out[m].n == 2700
        assert out[m].ece == pytest.approx(p["ece"], abs=1e-12)
        assert acc[m] == pytest.approx(p["acc"], abs=1e-12)


def test_published_bootstrap_intervals(feat):
    ci = {(r.model_id, r.metric): r for r in INF.bootstrap_cells(feat, n_boot=2000).collect()}
    for m, p in PUBLISHED.items():
        a, e = ci[(m, "accuracy")], ci[(m, "ece")]
        assert a.ci_lo == pytest.approx(p["acc_lo"], abs=0.003)
        assert a.ci_hi == pytest.approx(p["acc_hi"], abs=0.003)
        assert e.ci_lo == pytest.approx(p["ece_lo"], abs=0.003)
        assert e.ci_hi == pytest.approx(p["ece_hi"], abs=0.003)


# The study's 9-record smoke file (model, raw reply, stored letter, correct letter,
# stored confidence).
SMOKE = [
    ("gemini_flash", "ANSWER: A\nCONFIDENCE: 100", "A", "B", 100),
    ("llama3.1", "ANSWER: A\nCONFIDENCE: 90", "A", "B", 90),
    ("mistral", " ANSWER: A\nCONFIDENCE: 95", "A", "B", 95),
    ("gemini_flash", "ANSWER: A\nCONFIDENCE: 95", "A", "B", 95),
    ("llama3.1", "ANSWER: B\nCONFIDENCE: 90", "B", "B", 90),
    ("mistral", " ANSWER: A\nCONFIDENCE: 95", "A", "B", 95),
    ("gemini_flash", "ANSWER: B\nCONFIDENCE: 100", "B", "B", 100),
    ("llama3.1", "ANSWER: A\nCONFIDENCE: 80", "A", "B", 80),
    ("mistral", " ANSWER: A\nCONFIDENCE: 100", "A", "B", 100),
]


def test_smoke_file_reparses_and_scores(spark):
    from calibra.operators.scoring import response_features, score_responses
    df = spark.createDataFrame([(m, r, p, c, k) for m, r, p, c, k in SMOKE],
                               "model_id string, raw_response string, stored_letter string, "
                               "correct_letter string, stored_conf int")
    scored = score_responses(df).collect()
    for row in scored:
        assert row.predicted_letter == row.stored_letter and row.confidence == row.stored_conf
        assert row.parse_ok
    acc = {r.model_id: r.accuracy for r in C.capability_vs_ece(response_features(score_responses(df))).collect()}
    assert acc == pytest.approx({"gemini_flash": 1 / 3, "llama3.1": 1 / 3, "mistral": 0.0})
