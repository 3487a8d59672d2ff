"""Diagnostic jobs.

Answer-token probabilities use higher-order array functions on each row's
token array (no Python); the format comparison scores both reply formats
on the same row; trial consistency uses algebraic pair sums so that no
pairs are ever materialised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions import metrics as M
from calibra.functions import parsing

# Note texts of the answer-token extraction (format strings).
NO_TOKENS_NOTE = "no answer letter or empty logprobs"
MISSING_LOGPROB_NOTE = "matched token missing logprob"
AMBIGUOUS_NOTE = "logprob extraction ambiguous: %d tokens match '%s' at indices [%s]; using first match"
NO_MATCH_NOTE = "logprob extraction ambiguous/failed: no token matching answer letter '%s' among %d tokens"


# ASCII whitespace stripped from tokens (space, tab, newline, CR, VT, FF).
_WS = " \t\n\r\x0b\x0c"


def _strip(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(_WS))


def answer_token_prob(df: DataFrame, tokens_col: str = "tokens",
                      letter_col: str = "predicted_letter") -> DataFrame:
    """Probability of the answer-letter token and its alternatives.

    A token matches when, stripped, it is 1-2 characters long and starts with
    the letter (so "An" matches A, "ANSWER" does not).  The first match wins;
    several matches add a note; a matched token without a logprob gives NULL
    and a note.  Alternatives become a token -> probability map in which a
    repeated token keeps its last value (deduplicated in the array, so no
    session setting is needed); an empty map becomes NULL.
    """
    # a column a step: each is worked out once a row, not once for every use
    toks, n, letter, idx, entry, usable, dedup = (F.col(c) for c in (
        tokens_col, "_p13_n", "_p13_letter", "_p13_idx", "_p13_entry", "_p13_usable", "_p13_dedup"))
    heads = F.transform(toks, lambda t: _strip(t["token"]))
    df = df.withColumns({"_p13_n": F.size(F.coalesce(toks, F.array())), "_p13_letter": F.upper(F.col(letter_col)), "_p13_heads": heads})
    found = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (
        F.length(F.col("_p13_heads")[i]).between(1, 2) & (F.upper(F.substring(F.col("_p13_heads")[i], 1, 1)) == letter)))
    df = df.withColumn("_p13_idx", F.when(n > 0, found).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_p13_entry", F.get(toks, F.get(idx, 0)))
    df = df.withColumn("_p13_usable", F.filter(
        F.coalesce(entry["top_logprobs"], F.array()),
        lambda a: (F.coalesce(a["token"], F.lit("")) != "") & a["logprob"].isNotNull()))
    df = df.withColumn("_p13_dedup", F.filter(usable, lambda a, i: ~F.exists(
        F.slice(usable, i + 2, F.greatest(F.size(usable), F.lit(1))), lambda b: b["token"] == a["token"])))
    lp = entry["logprob"]
    alts = F.map_from_entries(F.transform(dedup, lambda a: F.struct(
        a["token"].alias("key"), F.exp(a["logprob"]).alias("value"))))
    no_input = letter.isNull() | (n == 0)
    n_match = F.size(idx)
    ambiguous = F.format_string(AMBIGUOUS_NOTE, n_match, letter,
                                F.array_join(F.transform(idx, lambda i: i.cast("string")), ", "))
    failed = F.format_string(NO_MATCH_NOTE, letter, n)
    note = (F.when(no_input, F.lit(NO_TOKENS_NOTE))
            .when(n_match == 0, failed)
            .when(lp.isNull(), F.lit(MISSING_LOGPROB_NOTE))
            .when(n_match > 1, ambiguous))
    ok = ~no_input & (n_match > 0) & lp.isNotNull()
    return df.withColumns({
        "internal_prob_answer": F.when(ok, F.exp(lp)),
        "internal_prob_alternatives": F.when(ok & (F.size(dedup) > 0), alts),
        "internal_prob_note": note,
    }).drop(*[f"_p13_{c}" for c in ("n", "letter", "heads", "idx", "entry", "usable", "dedup")])


FORMATS = ["constrained", "unconstrained"]


def score_formats(df: DataFrame, constrained_col: str = "raw_response",
                  freeform_col: str = "freeform_reply", correct_col: str = "correct_letter") -> DataFrame:
    """Both reply formats of one cell scored side by side.

    Constrained replies use the ANSWER/CONFIDENCE parser, free-form replies
    the FINAL_ANSWER / last-letter parser; unparsed counts as incorrect.
    """
    c_pred = parsing.answer_letter(constrained_col)
    u_pred = parsing.final_letter(freeform_col)
    corr = F.col(correct_col)
    return df.withColumns({
        "pred_constrained": c_pred,
        "pred_unconstrained": u_pred,
        "correct_constrained": F.coalesce(c_pred == corr, F.lit(False)),
        "correct_unconstrained": F.coalesce(u_pred == corr, F.lit(False)),
    })


def format_long(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell and format (explode of the two formats)."""
    pairs = F.array(
        F.struct(F.lit("constrained").alias("format"), F.col("pred_constrained").alias("predicted"),
                 F.col("correct_constrained").alias("is_correct")),
        F.struct(F.lit("unconstrained").alias("format"), F.col("pred_unconstrained").alias("predicted"),
                 F.col("correct_unconstrained").alias("is_correct")))
    return scored.select(*keys, F.explode(pairs).alias("f")).select(
        *keys, "f.format", "f.predicted", "f.is_correct",
        F.col("f.predicted").isNotNull().alias("parse_ok"))


def format_comparison(scored: DataFrame) -> DataFrame:
    """Accuracy pivot model x format."""
    long = format_long(scored, ["model_id"])
    return long.groupBy("model_id").pivot("format", FORMATS).agg(
        F.avg(F.col("is_correct").cast("double")))


def format_discordance(scored: DataFrame) -> DataFrame:
    """Paired outcome counts per model (both, only one, neither correct)."""
    c, u = F.col("correct_constrained"), F.col("correct_unconstrained")
    return scored.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count(F.when(c & u, 1)).alias("both_correct"),
        F.count(F.when(c & ~u, 1)).alias("constrained_only"),
        F.count(F.when(~c & u, 1)).alias("unconstrained_only"),
        F.count(F.when(~c & ~u, 1)).alias("neither"))


def trial_consistency(feat: DataFrame, item_col: str = "question_id",
                      value_col: str = "confidence") -> DataFrame:
    """Agreement of confidence across trials of the same item.

    Over all unordered trial pairs of an item (counted both ways), the pair
    correlation needs only the item's count, sum and sum of squares:
      pairs = n(n-1), Sx = Sy = (n-1)S, Sxx = Syy = (n-1)Q, Sxy = S^2 - Q.
    The mean absolute difference uses distinct values with multiplicities:
      sum_{a<b} cnt_a cnt_b (b - a) = sum_b cnt_b (b C_<b - S_<b),
    a running sum over the (at most 101) distinct confidences of an item.
    No pair is ever materialised, and a hot item is reduced map-side.
    """
    v = F.col(value_col).cast("double")
    # one scan: distinct values per item with multiplicities feed both parts
    cells = M.drop_null_groups(feat.groupBy("model_id", item_col, v.alias("c")).agg(
        F.count(F.lit(1)).cast("double").alias("cnt")), ["c"], "cnt")
    c, cnt = F.col("c"), F.col("cnt")
    per_item = cells.groupBy("model_id", item_col).agg(
        F.sum(cnt).alias("n"), F.sum(cnt * c).alias("s"), F.sum(cnt * c * c).alias("q"))
    per_item = per_item.filter(F.col("n") >= 2)
    pair_terms = per_item.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("np"),
        F.sum((F.col("n") - 1) * F.col("s")).alias("sx"),
        F.sum((F.col("n") - 1) * F.col("q")).alias("sxx"),
        F.sum(F.col("s") * F.col("s") - F.col("q")).alias("sxy"))
    np_, sx, sxx, sxy = F.col("np"), F.col("sx"), F.col("sxx"), F.col("sxy")
    r = F.try_divide(np_ * sxy - sx * sx, np_ * sxx - sx * sx)

    w = Window.partitionBy("model_id", item_col).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    below = cells.withColumns({"c_lt": F.coalesce(F.sum("cnt").over(w), F.lit(0.0)),
                               "s_lt": F.coalesce(F.sum(F.col("cnt") * F.col("c")).over(w), F.lit(0.0))})
    absdiff = below.groupBy("model_id").agg(
        F.sum(F.col("cnt") * (F.col("c") * F.col("c_lt") - F.col("s_lt"))).alias("sum_abs"))
    out = pair_terms.join(absdiff, "model_id", "left")
    return out.select("model_id", "n_items", (np_ / 2).cast("bigint").alias("n_pairs"),
                      r.alias("pair_corr"),
                      F.try_divide(F.col("sum_abs"), np_ / 2).alias("mean_abs_delta"))
