"""Row-level operators on response tables.

Pure projections and filters: narrow transformations that Catalyst fuses
into the scan stage; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.functions import parsing
from calibra.schemas import DIFFICULTY_NUMERIC

SLIM_DROP = ["raw_response", "internal_prob_alternatives", "error"]


def parse_responses(df: DataFrame, text_col: str = "raw_response") -> DataFrame:
    """Add predicted_letter, confidence, parse_ok parsed from the reply.

    The two regex matches come out of a one-row generator (``inline``):
    Catalyst cannot push a filter on generator output below the generator,
    so later filters on the parse (e.g. the analysis filter) read the parsed
    values instead of re-running both regexes in a pushed-down copy.
    """
    p = parsing.parse_reply(text_col)
    keep = [c for c in df.columns if c not in ("predicted_letter", "confidence", "parse_ok")]
    parsed = df.select(*keep, F.inline(F.array(F.struct(
        p["predicted_letter"].alias("predicted_letter"), p["confidence"].alias("confidence")))))
    return parsed.withColumn("parse_ok", F.col("predicted_letter").isNotNull() & F.col("confidence").isNotNull())


def score_responses(df: DataFrame, text_col: str = "raw_response",
                    answer_col: str = "answer_index") -> DataFrame:
    """P6 + P8 + P18: parse the reply and decide correctness.

    Error records (reply NULL, error set) keep their row: parse_ok False,
    is_correct False.
    """
    if answer_col not in df.columns and "correct_letter" in df.columns:
        df = df.withColumn(answer_col, parsing.letter_to_index("correct_letter"))
    parsed = parse_responses(df, text_col)
    return parsed.withColumn("is_correct",
                             parsing.is_correct("predicted_letter", answer_col))


def analysis_rows(df: DataFrame) -> DataFrame:
    """Rows usable for calibration: parsed and with a confidence."""
    return df.filter(F.col("parse_ok") & F.col("confidence").isNotNull())


def difficulty_numeric(col="difficulty"):
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in DIFFICULTY_NUMERIC.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.cast("int")


def response_features(df: DataFrame) -> DataFrame:
    """P3 + P4: analysis filter and derived columns.

    confidence_norm = confidence / 100, difficulty_numeric 1..3,
    correct = is_correct as 0/1, overconfidence_gap_row = norm - correct.
    """
    a = analysis_rows(df)
    cols = {"confidence_norm": F.col("confidence").cast("double") / 100.0,
            "correct": F.col("is_correct").cast("double")}
    if "difficulty" in df.columns:
        cols["difficulty_numeric"] = difficulty_numeric("difficulty")
    return a.withColumns(cols).withColumn("overconfidence_gap_row", F.col("confidence_norm") - F.col("correct"))


def primary_models(df: DataFrame, models: list[str], model_col: str = "model_id") -> DataFrame:
    """P5: keep configured models and attach their configured ordinal.

    The model list is a handful of names: the ordinal is a literal CASE,
    evaluated in the scan stage (no join, no shuffle).
    """
    ordinal = None
    for i, m in enumerate(models):
        ordinal = F.when(F.col(model_col) == m, F.lit(i + 1)) if ordinal is None \
            else ordinal.when(F.col(model_col) == m, F.lit(i + 1))
    return df.filter(F.col(model_col).isin(models)).withColumn("model_ord", ordinal.cast("int"))


def drop_model(df: DataFrame, model_id: str, model_col: str = "model_id") -> DataFrame:
    """Every row except those of one model (NULL-safe)."""
    return df.filter(~F.col(model_col).eqNullSafe(F.lit(model_id)))


def slim_export(df: DataFrame) -> DataFrame:
    """Every column except the bulky text / map columns."""
    return df.drop(*[c for c in SLIM_DROP if c in df.columns])
