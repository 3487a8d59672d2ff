"""Reply parsing traps."""
from pyspark.sql import functions as F

from calibra.functions import parsing as P
from calibra.operators.scoring import score_responses


def _parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", *[c.alias(k) for k, c in P.parse_reply("t").items()]).orderBy("i").collect()
    return [(r.predicted_letter, r.confidence, r.parse_ok) for r in out]


def test_parser_traps(spark):
    got = _parse(spark, [
        "ANSWER: B\nCONFIDENCE: 70",
        "answer:c confidence:55",
        "ANSWER: Because\nCONFIDENCE: 80",      # no word boundary: B
        "CONFIDENCE: 1000\nANSWER: A",          # first three digits: 100, accepted
        "ANSWER: A\nCONFIDENCE: 150",           # out of range: NULL
        "ANSWER: A\nCONFIDENCE: -5",            # no match
        "ANSWER: D\nCONFIDENCE: 85.5",          # 85
        "ANSWER: [A/B/C/D]\nCONFIDENCE: [integer 0-100]",
        "FINAL_ANSWER: c\nCONFIDENCE: 10",      # FINAL_ANSWER contains ANSWER
        "ANSWER: A\nANSWER: B\nCONFIDENCE: 5\nCONFIDENCE: 6",
        "",
        "   \n  ",
        None,
        "CONFIDENCE: 101 then CONFIDENCE: 40\nANSWER: a",  # first match wins even if invalid
    ])
    assert got == [
        ("B", 70, True), ("C", 55, True), ("B", 80, True), ("A", 100, True),
        ("A", None, False), ("A", None, False), ("D", 85, True), (None, None, False),
        ("C", 10, True), ("A", 5, True), (None, None, False), (None, None, False),
        (None, None, False), ("A", None, False),
    ]


def test_score_unparsed_is_false_and_error_rows_kept(spark):
    df = spark.createDataFrame(
        [("ANSWER: B\nCONFIDENCE: 9", 1, None), ("ANSWER: C\nCONFIDENCE: 9", 1, None),
         (None, 1, "TimeoutError: x"), ("nothing", 2, None)],
        "raw_response string, answer_index int, error string")
    rows = score_responses(df).select("is_correct", "parse_ok", "error").collect()
    assert [r.is_correct for r in rows] == [True, False, False, False]
    assert [r.parse_ok for r in rows] == [True, True, False, False]
    assert rows[2].error == "TimeoutError: x"


def test_final_letter_fallback(spark):
    df = spark.createDataFrame([(t,) for t in [
        "FINAL_ANSWER: c", "final_answer: d", "It is a hard question.", "No idea.",
        "FINAL_ANSWER: B\nActually maybe C", "pick C or D"]], "t string")
    got = [r[0] for r in df.select(P.final_letter("t")).collect()]
    # lower-case label falls back to the last standalone letter of the upper-cased text,
    # and the article "a" counts as A
    assert got == ["C", "D", "A", None, "B", "D"]


def test_truthy_and_numeric(spark):
    df = spark.createDataFrame([(v,) for v in ["1", "TRUE", "Yes", "no", "False", "0", None, "y"]],
                               "v string")
    assert [r[0] for r in df.select(P.truthy("v")).collect()] == [
        True, True, True, False, False, False, False, False]
    df2 = spark.createDataFrame([(v,) for v in ["85", " 85.5 ", "abc", "", None, "64%"]], "v string")
    assert [r[0] for r in df2.select(P.numeric("v")).collect()] == [85.0, 85.5, None, None, None, None]


def test_letters_and_keys(spark):
    df = spark.createDataFrame([("a", 0, "S", "  q \n"), ("E", 3, "S", "q"), (None, 9, None, "x")],
                               "l string, i int, s string, q string")
    r = df.select(P.letter_to_index("l"), P.index_to_letter("i"), P.content_key("s", "q"),
                  P.truncate_reply(F.lit(None).cast("string"))).collect()
    assert [tuple(x) for x in r] == [(0, "A", "S||q", ""), (None, "D", "S||q", ""), (None, None, None, "")]
