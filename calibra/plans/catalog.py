"""Registry of named queries: Spark DataFrames and their DuckDB oracles.

Every query reads the driver tables (through the fixture views) in full.
Computed doubles are rounded to 9 digits so that two engines summing in a
different order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions.metrics import bin_edges
from calibra.operators import calibration as C
from calibra.operators import resampling as RS
from calibra.operators import scoring as S
from calibra.plans import oracles as O
from calibra.sources import fixtures as FX

R = O.R
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    """Round every double column (two engines sum in different orders)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.response_features(FX.responses(spark, sf_dir))


# ---------------------------------------------------------------------------
# Minimum slice
# ---------------------------------------------------------------------------

@register("overall_by_model", O.with_ctes(f"""
SELECT model_id, count(*) AS n,
  {O.rnd('avg(correct)')} AS accuracy,
  {O.rnd('avg(confidence_norm)')} AS mean_confidence,
  {O.rnd('avg(confidence_norm) - avg(correct)')} AS overconfidence_gap,
  {O.rnd(O.ece_sql())} AS ece,
  {O.rnd('stddev_samp(CAST(confidence AS DOUBLE))')} AS conf_sd,
  {O.rnd('avg(CASE WHEN confidence >= 95 THEN 1.0 ELSE 0.0 END)')} AS pct_conf_ge_95
FROM feat GROUP BY model_id
""", "f1"))
def q_overall_by_model(spark, sf_dir):
    return rounded(C.overall_by_model(feat(spark, sf_dir), FX.FIXTURE_MODELS))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.responses(spark, sf_dir)


_CORE_SQL = f"""count(*) AS n,
  {O.rnd('avg(correct)')} AS accuracy,
  {O.rnd('avg(confidence_norm)')} AS mean_confidence,
  {O.rnd('avg(confidence_norm) - avg(correct)')} AS overconfidence_gap,
  {O.rnd(O.ece_sql())} AS ece"""


# ---------------------------------------------------------------------------
# Grouped calibration tables
# ---------------------------------------------------------------------------

@register("parse_rates", O.with_ctes(f"""
SELECT model_id, count(*) AS n, {O.rnd('avg(CAST(parse_ok AS DOUBLE))')} AS parse_ok_rate
FROM responses GROUP BY model_id""", "f1"))
def q_parse_rates(spark, sf_dir):
    return rounded(C.parse_rates(raw(spark, sf_dir), FX.FIXTURE_MODELS))


@register("summary_by_difficulty", O.with_ctes(f"""
SELECT model_id, difficulty, {_CORE_SQL}
FROM feat GROUP BY model_id, difficulty""", "f1"))
def q_summary_by_difficulty(spark, sf_dir):
    return rounded(C.summary_by_difficulty(feat(spark, sf_dir), FX.FIXTURE_MODELS))


@register("ece_by_model", O.with_ctes(f"""
SELECT model_id, count(*) AS n, {O.rnd(O.ece_sql())} AS ece FROM feat GROUP BY model_id""", "f1"))
def q_ece_by_model(spark, sf_dir):
    return rounded(C.ece_by_model(feat(spark, sf_dir)))


@register("reliability_bins", O.with_ctes(f"""
SELECT model_id, bin,
  {O.rnd(f'list_extract({O.edge_list()}, bin + 1)')} AS bin_lo,
  {O.rnd(f'list_extract({O.edge_list()}, bin + 2)')} AS bin_hi,
  {O.rnd(f'(list_extract({O.edge_list()}, bin + 1) + list_extract({O.edge_list()}, bin + 2)) / 2')} AS bin_center,
  {O.rnd('avg(correct)')} AS accuracy, {O.rnd('avg(confidence_norm)')} AS confidence,
  count(*) AS count
FROM (SELECT *, {O.bin_case('confidence_norm')} AS bin FROM feat) b
WHERE bin IS NOT NULL GROUP BY model_id, bin""", "f1"))
def q_reliability_bins(spark, sf_dir):
    return rounded(C.reliability_bins(feat(spark, sf_dir)))


@register("ece_by_domain", O.with_ctes(f"""
SELECT model_id, domain, {O.rnd(O.ece_sql())} AS ece, count(*) AS n
FROM feat GROUP BY model_id, domain""", "f1"))
def q_ece_by_domain(spark, sf_dir):
    return rounded(C.ece_by_domain(feat(spark, sf_dir)))


_USABLE = "internal_prob_answer IS NOT NULL"
_VVI_SQL = f"""
SELECT model_id,
  CASE WHEN n_raw >= 30 THEN n_usable ELSE n_raw END AS n_with_internal,
  CASE WHEN n_raw < 30 THEN 'insufficient / unavailable internal probs' END AS note,
  CASE WHEN n_raw >= 30 THEN {O.rnd('r')} END AS pearson_r_verbal_internal,
  CASE WHEN n_raw >= 30 THEN {O.rnd('ece_v')} END AS ece_verbal,
  CASE WHEN n_raw >= 30 THEN {O.rnd('ece_i')} END AS ece_internal
FROM (
  SELECT model_id,
    count(internal_prob_answer) AS n_raw,
    count(CAST(internal_prob_answer AS DOUBLE)) AS n_usable,
    corr(CASE WHEN {_USABLE} THEN confidence_norm END, internal_prob_answer) AS r,
    {O.ece_sql(f'(CASE WHEN {_USABLE} THEN confidence_norm END)', 'correct',
               f'(CASE WHEN {_USABLE} THEN 1.0 ELSE 0.0 END)')} AS ece_v,
    {O.ece_sql('internal_prob_answer', 'correct', f'(CASE WHEN {_USABLE} THEN 1.0 ELSE 0.0 END)')} AS ece_i
  FROM feat GROUP BY model_id) g"""


@register("verbal_vs_internal", O.with_ctes(_VVI_SQL, "f1"))
def q_verbal_vs_internal(spark, sf_dir):
    return rounded(C.verbal_vs_internal(feat(spark, sf_dir)))


@register("hard_minus_easy", O.with_ctes(f"""
SELECT model_id, {O.rnd('easy_gap')} AS easy_gap, {O.rnd('hard_gap')} AS hard_gap,
  {O.rnd('hard_gap - easy_gap')} AS hard_minus_easy_gap,
  CASE WHEN hard_gap - easy_gap IS NULL THEN 'INCOMPLETE' WHEN hard_gap - easy_gap > 0 THEN 'YES' ELSE 'NO' END
    AS hard_gt_easy
FROM (SELECT model_id,
  avg(CASE WHEN difficulty = 'easy' THEN confidence_norm END) - avg(CASE WHEN difficulty = 'easy' THEN correct END) AS easy_gap,
  avg(CASE WHEN difficulty = 'hard' THEN confidence_norm END) - avg(CASE WHEN difficulty = 'hard' THEN correct END) AS hard_gap
  FROM feat GROUP BY model_id) g""", "f1"))
def q_hard_minus_easy(spark, sf_dir):
    return rounded(C.hard_minus_easy(feat(spark, sf_dir)))


@register("robustness_slices", O.with_ctes(f"""
SELECT bank, model_id, {_CORE_SQL} FROM (
  SELECT 'original_180' AS bank, * FROM feat WHERE bank_source = 'original_180'
  UNION ALL SELECT 'full_540' AS bank, * FROM feat) s
GROUP BY bank, model_id""", "f1"))
def q_robustness_slices(spark, sf_dir):
    return rounded(C.robustness_slices(feat(spark, sf_dir)))


_DISP_SQL = f"""count(*) AS n,
  {O.rnd('avg(CAST(confidence AS DOUBLE))')} AS mean_confidence_0_100,
  {O.rnd('stddev_samp(CAST(confidence AS DOUBLE))')} AS sd_confidence,
  {O.rnd('avg(CASE WHEN confidence >= 95 THEN 1.0 ELSE 0.0 END)')} AS pct_confidence_ge_95"""


@register("confidence_dispersion", O.with_ctes(
    f"SELECT model_id, {_DISP_SQL} FROM feat GROUP BY model_id", "f1"))
def q_confidence_dispersion(spark, sf_dir):
    return rounded(C.confidence_dispersion(feat(spark, sf_dir)))


@register("confidence_dispersion_by_difficulty", O.with_ctes(
    f"SELECT model_id, difficulty, {_DISP_SQL} FROM feat GROUP BY model_id, difficulty", "f1"))
def q_confidence_dispersion_by_difficulty(spark, sf_dir):
    return rounded(C.confidence_dispersion(feat(spark, sf_dir), by_difficulty=True))


@register("verification_counts", O.with_ctes(f"""
SELECT model_id, difficulty, count(*) AS n_rows,
  count(CASE WHEN parse_ok AND confidence IS NOT NULL THEN 1 END) AS n_analyzed,
  {O.rnd('avg(CAST(parse_ok AS DOUBLE))')} AS parse_ok_rate,
  {O.rnd('avg(CASE WHEN parse_ok AND confidence IS NOT NULL THEN CAST(is_correct AS DOUBLE) END)')} AS accuracy,
  {O.rnd('avg(CASE WHEN parse_ok AND confidence IS NOT NULL THEN CAST(confidence AS DOUBLE) END)')}
    AS mean_confidence_0_100
FROM responses GROUP BY model_id, difficulty""", "f1"))
def q_verification_counts(spark, sf_dir):
    return rounded(C.verification_counts(raw(spark, sf_dir)))


@register("capability_vs_ece", O.with_ctes(f"""
SELECT model_id, {O.rnd('avg(correct)')} AS accuracy, {O.rnd(O.ece_sql())} AS ece
FROM feat GROUP BY model_id""", "f1"))
def q_capability_vs_ece(spark, sf_dir):
    return rounded(C.capability_vs_ece(feat(spark, sf_dir)))


@register("ece_heatmap", O.with_ctes(f"""
SELECT model_id,
  {O.rnd("max(CASE WHEN domain = 'STEM' THEN ece END)")} AS "STEM",
  {O.rnd("max(CASE WHEN domain = 'Social_Science' THEN ece END)")} AS "Social_Science",
  {O.rnd("max(CASE WHEN domain = 'Humanities' THEN ece END)")} AS "Humanities"
FROM (SELECT model_id, domain, {O.ece_sql()} AS ece FROM feat GROUP BY model_id, domain) c
GROUP BY model_id""", "f1"))
def q_ece_heatmap(spark, sf_dir):
    return rounded(C.ece_heatmap(feat(spark, sf_dir)))


def _pivot_cols(metric_sql: dict[str, str]) -> str:
    cols = []
    for d in ["easy", "medium", "hard"]:
        for name, expr in metric_sql.items():
            cols.append(f"{O.rnd(f'max(CASE WHEN difficulty = {chr(39)}{d}{chr(39)} THEN {expr} END)')} AS {d}_{name}")
    return ",\n  ".join(cols)


@register("difficulty_pivots", O.with_ctes(f"""
SELECT model_id,
  {_pivot_cols({'accuracy': 'acc', 'confidence': 'conf', 'gap': 'gap'})}
FROM (SELECT model_id, difficulty, avg(correct) AS acc, avg(CAST(confidence AS DOUBLE)) AS conf,
        avg(confidence_norm) - avg(correct) AS gap FROM feat GROUP BY model_id, difficulty) c
GROUP BY model_id""", "f1"))
def q_difficulty_pivots(spark, sf_dir):
    return rounded(C.difficulty_pivots(feat(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Row-level operators
# ---------------------------------------------------------------------------

_KEYS = ["model_id", "question_id", "trial_index"]


@register("parse_responses", O.with_ctes("""
SELECT model_id, question_id, trial_index, predicted_letter, confidence, parse_ok FROM responses""", "f1"))
def q_parse_responses(spark, sf_dir):
    r = S.parse_responses(FX.raw_responses(spark, sf_dir))
    return r.select(*_KEYS, "predicted_letter", "confidence", "parse_ok")


@register("score_responses", O.with_ctes("""
SELECT model_id, question_id, trial_index, answer_index, predicted_letter, is_correct, parse_ok
FROM responses""", "f1"))
def q_score_responses(spark, sf_dir):
    return raw(spark, sf_dir).select(*_KEYS, "answer_index", "predicted_letter", "is_correct", "parse_ok")


@register("response_features", O.with_ctes(f"""
SELECT model_id, question_id, trial_index, {O.rnd('confidence_norm')} AS confidence_norm,
  difficulty_numeric, {O.rnd('correct')} AS correct, {O.rnd('overconfidence_gap_row')} AS overconfidence_gap_row
FROM feat""", "f1"))
def q_response_features(spark, sf_dir):
    return rounded(feat(spark, sf_dir).select(
        *_KEYS, "confidence_norm", "difficulty_numeric", "correct", "overconfidence_gap_row"))


@register("primary_models", O.with_ctes("""
SELECT model_id, question_id, trial_index,
  CAST(CASE model_id WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS INTEGER) AS model_ord
FROM responses WHERE model_id IN ('R', 'A')""", "f1"))
def q_primary_models(spark, sf_dir):
    return S.primary_models(raw(spark, sf_dir), ["R", "A"]).select(*_KEYS, "model_ord")


@register("drop_model", O.with_ctes("""
SELECT model_id, question_id, trial_index, parse_ok FROM responses
WHERE model_id IS DISTINCT FROM 'N'""", "f1"))
def q_drop_model(spark, sf_dir):
    return S.drop_model(raw(spark, sf_dir), "N").select(*_KEYS, "parse_ok")


@register("slim_export", O.with_ctes("""
SELECT * EXCLUDE (raw_response, error) FROM responses""", "f1"))
def q_slim_export(spark, sf_dir):
    return S.slim_export(raw(spark, sf_dir))


@register("truthy_flags", """
SELECT flag_text, coalesce(lower(flag_text) IN ('1', 'true', 'yes'), false) AS flag, count(*) AS n
FROM (SELECT CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'Yes' WHEN 4 THEN 'no'
             WHEN 5 THEN 'False' WHEN 6 THEN '0' END AS flag_text FROM lineitem) t
GROUP BY flag_text""")
def q_truthy_flags(spark, sf_dir):
    from calibra.functions import parsing as P
    li = FX.table(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    txt = (F.when(ln == 1, "1").when(ln == 2, "TRUE").when(ln == 3, "Yes").when(ln == 4, "no")
           .when(ln == 5, "False").when(ln == 6, "0"))
    t = li.select(txt.alias("flag_text"))
    return t.groupBy("flag_text", P.truthy("flag_text").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@register("numeric_coerce", O.with_ctes(r"""
SELECT conf_text, TRY_CAST(trim(conf_text) AS DOUBLE) AS value, count(*) AS n
FROM (SELECT regexp_extract(raw_response, '(?i)CONFIDENCE:\s*(\S*)', 1) AS conf_text FROM raw_responses) t
GROUP BY conf_text""", "f1_raw"))
def q_numeric_coerce(spark, sf_dir):
    from calibra.functions import parsing as P
    t = FX.raw_responses(spark, sf_dir).select(
        F.regexp_extract("raw_response", r"(?i)CONFIDENCE:\s*(\S*)", 1).alias("conf_text"))
    return t.groupBy("conf_text", P.numeric("conf_text").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@register("final_letter", O.with_ctes(f"""
SELECT model_id, question_id, trial_index, {O.FINAL_LETTER_SQL.format(t='freeform_reply')} AS final_letter
FROM freeform""", "freeform"))
def q_final_letter(spark, sf_dir):
    from calibra.functions import parsing as P
    return FX.freeform_replies(spark, sf_dir).select(
        *_KEYS, P.final_letter("freeform_reply").alias("final_letter"))


_FREE_TEXT_SQL = r"""
SELECT {keys}, nullif(upper(regexp_extract(text, '(?i)ANSWER:\s*([A-D])', 1)), '') AS predicted_letter,
  CASE WHEN TRY_CAST(nullif(regexp_extract(text, '(?i)CONFIDENCE:\s*(\d{{1,3}})', 1), '') AS INTEGER) <= 100
       THEN TRY_CAST(nullif(regexp_extract(text, '(?i)CONFIDENCE:\s*(\d{{1,3}})', 1), '') AS INTEGER) END AS confidence,
  coalesce(nullif(upper(regexp_extract(text, 'FINAL_ANSWER:\s*([A-Da-d])', 1)), ''),
           list_filter(regexp_split_to_array(upper(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w IN ('A', 'B', 'C', 'D'))[-1]) AS final_letter
FROM {table}"""


def _free_text(df: DataFrame, *keys: str) -> DataFrame:
    from calibra.functions import parsing as P
    p = P.parse_reply("text")
    return df.select(*keys, p["predicted_letter"].alias("predicted_letter"), p["confidence"].alias("confidence"),
                     P.final_letter("text").alias("final_letter"))


@register("parse_conversations", _FREE_TEXT_SQL.format(keys="conv_id, turn, role", table="conversations"))
def q_parse_conversations(spark, sf_dir):
    """P6, P9 over every turn of the conversations table."""
    return _free_text(FX.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@register("parse_documents", _FREE_TEXT_SQL.format(keys="doc_id", table="documents"))
def q_parse_documents(spark, sf_dir):
    """P6, P9 over every document: text of several scripts, up to book length."""
    return _free_text(FX.table(spark, sf_dir, "documents"), "doc_id")


@register("run_metadata", O.with_ctes(f"""
SELECT count(*) AS n_raw,
  count(CASE WHEN parse_ok AND confidence IS NOT NULL THEN 1 END) AS n_analyzed,
  count(DISTINCT model_id) AS n_models,
  array_to_string(list_sort(list(DISTINCT model_id)), ',') AS models,
  CAST(max(trial_index) + 1 AS INTEGER) AS trials_per_question,
  max(temperature) AS temperature,
  max(max_output_tokens) AS max_output_tokens,
  2000 AS n_bootstrap
FROM responses""", "f1"))
def q_run_metadata(spark, sf_dir):
    from calibra.sources.sinks import run_metadata
    return run_metadata(raw(spark, sf_dir), n_bootstrap=2000)


# ---------------------------------------------------------------------------
# Inference
# ---------------------------------------------------------------------------

from calibra.operators import inference as INF  # noqa: E402


@register("difficulty_regression", O.with_ctes(f"""
SELECT model_id, CAST(regr_count(overconfidence_gap_row, difficulty_numeric) AS BIGINT) AS n,
  {O.rnd('regr_slope(overconfidence_gap_row, difficulty_numeric)')} AS slope,
  {O.rnd('''sqrt(greatest(regr_syy(overconfidence_gap_row, difficulty_numeric)
      - regr_slope(overconfidence_gap_row, difficulty_numeric) * regr_sxy(overconfidence_gap_row, difficulty_numeric), 0)
      / (regr_count(overconfidence_gap_row, difficulty_numeric) - 2)
      / regr_sxx(overconfidence_gap_row, difficulty_numeric))''')} AS se,
  {O.rnd('regr_r2(overconfidence_gap_row, difficulty_numeric)')} AS r_squared
FROM feat GROUP BY model_id""", "f1"))
def q_difficulty_regression(spark, sf_dir):
    return rounded(INF.regression_sums(feat(spark, sf_dir)))


@register("difficulty_regression_tests")
def q_difficulty_regression_tests(spark, sf_dir):
    """Full regression table: OLS with t-based CI and p, Spearman with p,
    hard-minus-easy gap (p-values via t tails on one row per model)."""
    f = feat(spark, sf_dir)
    reg = INF.difficulty_regression(f)
    sp = INF.spearman_with_p(f).drop("n")
    hme = C.hard_minus_easy(f).select("model_id", "hard_minus_easy_gap")
    return rounded(reg.join(sp, "model_id").join(hme, "model_id"))


_MIDRANK = "(rank() OVER (PARTITION BY model_id ORDER BY {c}) + (count(*) OVER (PARTITION BY model_id, {c}) - 1) / 2.0)"


@register("spearman_gap_difficulty", O.with_ctes(f"""
SELECT model_id, count(*) AS n,
  {O.rnd('CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END')} AS spearman_rho
FROM (SELECT model_id, {_MIDRANK.format(c='difficulty_numeric')} AS rx,
             {_MIDRANK.format(c='overconfidence_gap_row')} AS ry FROM feat) r
GROUP BY model_id""", "f1"))
def q_spearman_gap_difficulty(spark, sf_dir):
    return rounded(INF.spearman(feat(spark, sf_dir)))


@register("spearman_internal_prob", O.with_ctes(f"""
SELECT model_id, count(*) AS n,
  {O.rnd('CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END')} AS spearman_rho
FROM (SELECT model_id, {_MIDRANK.format(c='confidence_norm')} AS rx, {_MIDRANK.format(c='ip')} AS ry
      FROM (SELECT *, CAST(internal_prob_answer AS DOUBLE) AS ip FROM feat)
      WHERE ip IS NOT NULL AND confidence_norm IS NOT NULL) r
GROUP BY model_id""", "f1"))
def q_spearman_internal_prob(spark, sf_dir):
    """I2 of a continuous score: ranks over range partitions."""
    f = feat(spark, sf_dir).select("model_id", "confidence_norm", F.col("internal_prob_answer").cast("double").alias("ip"))
    return rounded(INF.spearman_ranged(f, x="confidence_norm", y="ip"))


@register("verbal_vs_internal_tests")
def q_verbal_vs_internal_tests(spark, sf_dir):
    """A7 with Pearson's p (t tail on one row per model)."""
    f = feat(spark, sf_dir)
    v = C.verbal_vs_internal(f)
    v = INF.add_correlation_p(v, "pearson_r_verbal_internal", "n_with_internal", out="pearson_p")
    return rounded(v)


_CHI2_SQL = """
cells AS (SELECT {keys}, CAST(parse_ok AS VARCHAR) AS parsed, difficulty, count(*)::DOUBLE AS o
          FROM responses GROUP BY ALL),
full_t AS (
  SELECT r.*, d.difficulty, coalesce(c.o, 0.0) AS o
  FROM (SELECT DISTINCT {keys}, CAST(parse_ok AS VARCHAR) AS parsed FROM responses) r
  JOIN (SELECT DISTINCT {keys}, difficulty FROM responses) d USING ({keys})
  LEFT JOIN cells c USING ({keys}, parsed, difficulty)),
marg AS (
  SELECT *, sum(o) OVER (PARTITION BY {keys}, parsed) AS rt, sum(o) OVER (PARTITION BY {keys}, difficulty) AS ct,
         sum(o) OVER (PARTITION BY {keys}) AS nt FROM full_t),
chi AS (
  SELECT {keys}, CAST(sum(o) AS BIGINT) AS n,
    CASE WHEN count(CASE WHEN rt * ct / nt <= 0 THEN 1 END) = 0
         THEN sum((o - rt * ct / nt) * (o - rt * ct / nt) / (rt * ct / nt)) END AS chi2,
    CAST((count(DISTINCT parsed) - 1) * (count(DISTINCT difficulty) - 1) AS INTEGER) AS dof
  FROM marg GROUP BY {keys})"""


def _chi2_sql(keys: str) -> str:
    return _CHI2_SQL.format(keys=keys)


@register("parse_missingness_chi2", O.with_ctes(f""",
{_chi2_sql('model_id').strip()}
SELECT model_id, n, {O.rnd('chi2')} AS chi2, dof,
  {O.rnd('CASE WHEN chi2 IS NOT NULL THEN exp(-chi2 / 2) END')} AS p_value
FROM chi""", "f1"))
def q_parse_missingness_chi2(spark, sf_dir):
    return rounded(INF.parse_missingness_chi2(raw(spark, sf_dir)))


def holm_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named p-values derived from the data: parse-failure x difficulty
    independence per model x domain (chi-square, 2 degrees of freedom)."""
    r = raw(spark, sf_dir)
    t = INF.parse_missingness_chi2(r, keys=("model_id", "domain"))
    model_ord = F.when(F.col("model_id") == "R", 1).when(F.col("model_id") == "A", 2).otherwise(3)
    dom_ord = F.when(F.col("domain") == "STEM", 1).when(F.col("domain") == "Social_Science", 2).otherwise(3)
    return t.select(F.concat_ws("_", "model_id", "domain").alias("test"),
                    F.col("p_value").alias("p_raw"), (model_ord * 10 + dom_ord).alias("input_ord"))


@register("holm_correction", O.with_ctes(f""",
{_chi2_sql('model_id, domain').strip()},
pv AS (SELECT model_id || '_' || domain AS test,
         CASE WHEN chi2 IS NOT NULL THEN exp(-chi2 / 2) END AS p_raw,
         (CASE model_id WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) * 10
         + (CASE domain WHEN 'STEM' THEN 1 WHEN 'Social_Science' THEN 2 ELSE 3 END) AS input_ord
       FROM chi),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY coalesce(p_raw, 1.0), input_ord, test) AS INTEGER) AS rank,
              count(*) OVER () AS m FROM pv)
SELECT test, {O.rnd('p_raw')} AS p_raw,
  {O.rnd('CASE WHEN p_raw IS NOT NULL THEN max(least(1.0, p_raw * (m - rank + 1))) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END')} AS p_holm,
  rank
FROM rk""", "f1"))
def q_holm_correction(spark, sf_dir):
    return rounded(INF.holm(holm_input(spark, sf_dir)))


N_BOOT = 2000


def _hash_words_sql(text: str) -> str:
    return ", ".join(f"CAST('0x' || substr(md5({text}), {at}, 8) AS UBIGINT) AS h{i}" for i, at in enumerate((1, 9)))


def _mix_sql(name: str, source: str) -> str:
    """CTEs that put column x of ``source`` through the 32-bit finaliser, a step each; the last is ``name``."""
    steps = ["xor(x, x >> 16)", "(x * 2246822507::UBIGINT) & 4294967295", "xor(x, x >> 13)",
             "(x * 3266489909::UBIGINT) & 4294967295", "xor(x, x >> 16)"]
    out = []
    for k, step in enumerate(steps):
        to = name if k == len(steps) - 1 else f"{name}_{k}"
        out.append(f"{to} AS (SELECT * REPLACE ({step} AS x) FROM {source})")
        source = to
    return ",\n".join(out)


def _uniform_sql(source: str) -> str:
    """CTE ``drawn``: every row of ``source`` (h0, h1, ...) with replicate and u."""
    return f"""
start AS (SELECT *, xor(h0, (replicate * 2654435761::UBIGINT) & 4294967295) AS x
          FROM {source}, (SELECT CAST(range AS UBIGINT) AS replicate FROM range({N_BOOT}))),
{_mix_sql("once", "start")},
again AS (SELECT * REPLACE (xor(x, h1) AS x) FROM once),
{_mix_sql("twice", "again")},
drawn AS (SELECT *, (x + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM twice)"""


_HARD_EASY = """(sum(CASE WHEN difficulty = 'hard' THEN w * confidence_norm END) / sum(CASE WHEN difficulty = 'hard' THEN w END)
  - sum(CASE WHEN difficulty = 'hard' THEN w * correct END) / sum(CASE WHEN difficulty = 'hard' THEN w END))
  - (sum(CASE WHEN difficulty = 'easy' THEN w * confidence_norm END) / sum(CASE WHEN difficulty = 'easy' THEN w END)
  - sum(CASE WHEN difficulty = 'easy' THEN w * correct END) / sum(CASE WHEN difficulty = 'easy' THEN w END))"""
_METRIC_SQL = {
    "accuracy": "sum(w * correct) / sum(w)",
    "overconfidence_gap": "sum(w * confidence_norm) / sum(w) - sum(w * correct) / sum(w)",
    "ece": O.ece_sql("confidence_norm", "correct", "w"),
    "hard_minus_easy_gap": _HARD_EASY,
}


def _interval_sql(metrics: dict[str, str], weighted: str) -> str:
    """CTE ``ci`` from ``weighted`` (model_id, replicate, w, rows' inputs) and the points from ``feat``."""
    union = " UNION ALL ".join(f"SELECT model_id, '{m}' AS metric, {m} AS value FROM rm" for m in metrics)
    points = " UNION ALL ".join(f"SELECT model_id, '{m}' AS metric, {m} AS point FROM pts" for m in metrics)
    values = ", ".join(f"{sql} AS {m}" for m, sql in metrics.items())
    return f"""
rm AS (SELECT model_id, replicate, {values} FROM {weighted} WHERE w > 0 GROUP BY model_id, replicate),
pts AS (SELECT model_id, {values} FROM (SELECT *, 1.0::DOUBLE AS w FROM feat) GROUP BY model_id),
ci AS (SELECT model_id, metric, point, quantile_cont(value, 0.025) AS ci_lo, quantile_cont(value, 0.975) AS ci_hi,
         avg(CASE WHEN metric = 'hard_minus_easy_gap' THEN coalesce(CAST(value <= 0 AS DOUBLE), 0.0) END) AS p_le_0
       FROM ({union}) JOIN ({points}) USING (model_id, metric) GROUP BY model_id, metric, point)"""


def _cells_sql(metrics: dict[str, str], inputs: tuple[str, ...] = ("confidence_norm", "correct", "difficulty")) -> str:
    """Poisson(n) weights of the cells of equal inputs."""
    tables = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in RS.poisson_cdf(k)) + "]" for k in range(1, RS.EXACT_BELOW)) + "]"
    text = {"difficulty": "difficulty"}
    parts = " || '|' || ".join(f"coalesce({text.get(c, f'CAST(CAST(round(CAST({c} AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR)')}, '~')" for c in inputs)
    return f""",
cells AS (SELECT *, {_hash_words_sql(f"'42|' || model_id || '|' || {parts}")} FROM (
            SELECT model_id, {", ".join(inputs)}, count(*) AS n FROM feat GROUP BY ALL)),
{_uniform_sql("cells").strip()},
normal AS (SELECT *, CAST(n AS DOUBLE) AS nd, {RS.normal_quantile_sql("u")} AS z FROM drawn),
weighted AS (SELECT *, CASE WHEN n < {RS.EXACT_BELOW} THEN len(list_filter({tables}[least(n, {RS.EXACT_BELOW - 1})], lambda t: t <= u))
                            ELSE {RS.poisson_quantile_sql("nd", "z")} END AS w FROM normal),
{_interval_sql(metrics, "weighted").strip()}"""


def _clusters_sql() -> str:
    """Poisson(1) weights of whole questions, applied to sums a question."""
    below = " + ".join(f"CAST(u >= {t!r}::DOUBLE AS INTEGER)" for t in RS.poisson_cdf(1))
    edges = [f"{e!r}::DOUBLE" for e in bin_edges()]
    inside = lambda i: f"confidence_norm >= {edges[i]} AND confidence_norm {'<=' if i == 9 else '<'} {edges[i + 1]}"
    bins = ", ".join(f"coalesce(sum(CASE WHEN {inside(i)} THEN correct - confidence_norm END), 0) AS b{i}" for i in range(10))
    tiers = ", ".join(f"sum(CASE WHEN difficulty = '{t}' THEN {c} ELSE 0 END) AS {t}_{a}"
                      for t in ("hard", "easy") for c, a in (("confidence_norm", "s"), ("correct", "c"), ("1", "n")))
    sums = ["n", "s", "c", *[f"b{i}" for i in range(10)], *[f"{t}_{a}" for t in ("hard", "easy") for a in "scn"]]
    hme = "(hard_s - hard_c) / nullif(hard_n, 0) - (easy_s - easy_c) / nullif(easy_n, 0)"
    values = {"accuracy": "c / n", "overconfidence_gap": "s / n - c / n", "ece": "(" + " + ".join(f"abs(b{i})" for i in range(10)) + ") / n",
              "hard_minus_easy_gap": hme}
    union = " UNION ALL ".join(f"SELECT model_id, replicate, '{m}' AS metric, {v} AS value FROM rs" for m, v in values.items())
    points = " UNION ALL ".join(f"SELECT model_id, '{m}' AS metric, {v} AS point FROM ps" for m, v in values.items())
    return f""",
vec AS (SELECT *, {_hash_words_sql("'42|' || model_id || '|' || question_id")} FROM (
          SELECT model_id, question_id, CAST(count(*) AS DOUBLE) AS n, sum(confidence_norm) AS s, sum(CAST(correct AS DOUBLE)) AS c, {bins}, {tiers}
          FROM feat GROUP BY model_id, question_id)),
ps AS (SELECT model_id, {", ".join(f"sum({x}) AS {x}" for x in sums)} FROM vec GROUP BY model_id),
{_uniform_sql("vec").strip()},
rs AS (SELECT model_id, replicate, {", ".join(f"sum(w * {x}) AS {x}" for x in sums)} FROM (SELECT *, {below} AS w FROM drawn) GROUP BY model_id, replicate),
ci AS (SELECT model_id, metric, point, quantile_cont(value, 0.025) AS ci_lo, quantile_cont(value, 0.975) AS ci_hi,
         avg(CASE WHEN metric = 'hard_minus_easy_gap' THEN coalesce(CAST(value <= 0 AS DOUBLE), 0.0) END) AS p_le_0
       FROM ({union}) JOIN ({points}) USING (model_id, metric) GROUP BY model_id, metric, point)"""


def _rows_sql() -> str:
    """Poisson(1) weights of single rows; undefined differences (no weight drawn) count as not at or below 0."""
    below = " + ".join(f"CAST(u >= {t!r}::DOUBLE AS INTEGER)" for t in RS.poisson_cdf(1))
    text = "'42|' || coalesce(model_id, '~') || '|' || coalesce(question_id, '~') || '|' || coalesce(CAST(CAST(trial_index AS BIGINT) * 1000000 AS VARCHAR), '~')"
    return f""",
single AS (SELECT model_id, difficulty, confidence_norm, correct, {_hash_words_sql(text)} FROM feat),
{_uniform_sql("single").strip()},
rm AS (SELECT model_id, replicate, {_HARD_EASY} AS value FROM (SELECT *, {below} AS w FROM drawn) GROUP BY model_id, replicate),
ci AS (SELECT model_id, avg(coalesce(CAST(value <= 0 AS DOUBLE), 0.0)) AS p_le_0 FROM rm GROUP BY model_id)
"""


_CI_SQL = f"SELECT model_id, metric, {O.rnd('point')} AS point, {O.rnd('ci_lo')} AS ci_lo, {O.rnd('ci_hi')} AS ci_hi, {O.rnd('p_le_0')} AS p_le_0 FROM ci"


@register("bootstrap_ci_poisson", O.with_ctes(_cells_sql(_METRIC_SQL) + _CI_SQL, "f1"))
def q_bootstrap_ci_poisson(spark, sf_dir):
    """I4(a): 2000 Poisson replicates, drawn a cell."""
    return rounded(RS.bootstrap_cells_poisson(feat(spark, sf_dir), RS.standard_metrics(), n_boot=N_BOOT))


@register("hard_gt_easy_boot_p", O.with_ctes(_rows_sql() + f"SELECT model_id, {O.rnd('p_le_0')} AS hard_gt_easy_p_boot FROM ci", "f1"))
def q_hard_gt_easy_boot_p(spark, sf_dir):
    """One-sided share of 2000 replicates of single rows in which hard is not above easy."""
    b = RS.bootstrap_rows(feat(spark, sf_dir), [RS.hard_minus_easy()], ("question_id", "trial_index"), n_boot=N_BOOT)
    return rounded(b.select("model_id", F.col("p_le_0").alias("hard_gt_easy_p_boot")))


def brier() -> RS.Metric:
    """A caller's own metric: mean squared distance of confidence and outcome."""
    error = lambda: F.col("confidence_norm") - F.col("correct").cast("double")
    return RS.Metric("brier", ("confidence_norm", "correct"), lambda: {"e": error() * error(), "n": F.lit(1.0)},
                     lambda s: F.try_divide(s["e"], s["n"]))


@register("custom_metric_ci", O.with_ctes(_cells_sql(
    {"brier": "sum(w * (confidence_norm - correct) * (confidence_norm - correct)) / sum(w)"}, ("confidence_norm", "correct")) + _CI_SQL, "f1"))
def q_custom_metric_ci(spark, sf_dir):
    """Metric API: a metric that the library does not know, with its interval."""
    return rounded(RS.bootstrap_cells_poisson(feat(spark, sf_dir), [brier()], n_boot=N_BOOT))


@register("bootstrap_ci")
def q_bootstrap_ci(spark, sf_dir):
    """I4(b): 2000-replicate multinomial bootstrap over compressed cells."""
    return rounded(INF.bootstrap_cells(feat(spark, sf_dir), n_boot=2000))


# ---------------------------------------------------------------------------
# Question bank
# ---------------------------------------------------------------------------

from calibra.operators import bank as B  # noqa: E402

PER_CELL, SUPP_SEED = 40, 43


def classified(spark, sf_dir):
    return B.classify_pool(FX.pool(spark, sf_dir))


def original(spark, sf_dir):
    return FX.original_bank(spark, sf_dir)


def supplement(spark, sf_dir):
    return B.build_supplement(FX.pool(spark, sf_dir), original(spark, sf_dir), PER_CELL, SUPP_SEED)


def bank_full(spark, sf_dir):
    return B.full_bank(original(spark, sf_dir), supplement(spark, sf_dir))


@register("classify_pool", O.with_ctes("""
SELECT doc_id, subject, domain, difficulty FROM classified_pool""", "f4"))
def q_classify_pool(spark, sf_dir):
    return classified(spark, sf_dir).select("doc_id", "subject", "domain", "difficulty")


@register("flatten_choices", O.with_ctes("""
SELECT doc_id, choices[1] AS choice_A, choices[2] AS choice_B, choices[3] AS choice_C, choices[4] AS choice_D,
  answer AS answer_index, ['A','B','C','D'][answer + 1] AS answer_letter FROM pool_base""", "f4"))
def q_flatten_choices(spark, sf_dir):
    base = FX._pool_base(spark, sf_dir)
    return B.flatten_choices(base).select("doc_id", "choice_A", "choice_B", "choice_C", "choice_D",
                                          "answer_index", "answer_letter")


@register("content_disjoint_pool", O.with_ctes("""
SELECT doc_id, domain, difficulty FROM disjoint_pool""", "f4"))
def q_content_disjoint_pool(spark, sf_dir):
    return B.content_disjoint(classified(spark, sf_dir), original(spark, sf_dir)).select(
        "doc_id", "domain", "difficulty")


@register("bank_overlap", O.with_ctes("""
SELECT sha256(o.content_key) AS key_sha256, o.n_a, p.n_b FROM
  (SELECT content_key, count(*) AS n_a FROM original GROUP BY content_key) o
  JOIN (SELECT content_key, count(*) AS n_b FROM classified_pool GROUP BY content_key) p USING (content_key)""", "f4"))
def q_bank_overlap(spark, sf_dir):
    ov = B.overlap_keys(original(spark, sf_dir), classified(spark, sf_dir))
    return ov.select(F.sha2("content_key", 256).alias("key_sha256"), "n_a", "n_b")


@register("stratified_sample", O.with_ctes("""
SELECT doc_id, domain, difficulty, CAST(sample_rank AS INTEGER) AS sample_rank FROM supp_sample""", "f4"))
def q_stratified_sample(spark, sf_dir):
    d = B.content_disjoint(classified(spark, sf_dir), original(spark, sf_dir))
    s = B.stratified_sample(d, ["domain", "difficulty"], PER_CELL, SUPP_SEED, "doc_id")
    return s.select("doc_id", "domain", "difficulty", "sample_rank")


@register("sampling_shortfall", O.with_ctes(f"""
SELECT s.domain, s.difficulty, coalesce(a.available, 0) AS available, CAST({PER_CELL} AS BIGINT) AS target,
  least(coalesce(a.available, 0), {PER_CELL}) AS sampled,
  CAST({PER_CELL} - least(coalesce(a.available, 0), {PER_CELL}) AS BIGINT) AS short_by,
  CASE WHEN coalesce(a.available, 0) = 0 THEN 'EMPTY' WHEN a.available < {PER_CELL} THEN 'SHORTFALL' ELSE 'OK' END
    AS status
FROM (SELECT * FROM (VALUES ('STEM'), ('Social_Science'), ('Humanities')) d(domain),
                    (VALUES ('easy'), ('medium'), ('hard')) t(difficulty)) s
LEFT JOIN (SELECT domain, difficulty, count(*) AS available FROM disjoint_pool GROUP BY ALL) a
  USING (domain, difficulty)""", "f4"))
def q_sampling_shortfall(spark, sf_dir):
    d = B.content_disjoint(classified(spark, sf_dir), original(spark, sf_dir))
    return B.sampling_shortfall(d, PER_CELL)


@register("bank_ids", O.with_ctes("SELECT question_id, doc_id FROM supplement", "f4"))
def q_bank_ids(spark, sf_dir):
    return supplement(spark, sf_dir).select("question_id", "doc_id")


@register("full_bank", O.with_ctes("SELECT * FROM full_bank", "f4"))
def q_full_bank(spark, sf_dir):
    return bank_full(spark, sf_dir)


@register("bank_coverage", O.with_ctes("""
SELECT s.domain, s.difficulty, s.bank_source, coalesce(c.n, 0) AS n
FROM (SELECT * FROM (VALUES ('STEM'), ('Social_Science'), ('Humanities')) d(domain),
                    (VALUES ('easy'), ('medium'), ('hard')) t(difficulty),
                    (VALUES ('original_180'), ('supplement_v2')) b(bank_source)) s
LEFT JOIN (SELECT domain, difficulty, bank_source, count(*) AS n FROM full_bank GROUP BY ALL) c
  USING (domain, difficulty, bank_source)""", "f4"))
def q_bank_coverage(spark, sf_dir):
    return B.bank_coverage(bank_full(spark, sf_dir), ["original_180", "supplement_v2"])


@register("bank_grid", O.with_ctes("""
SELECT domain, count(CASE WHEN difficulty = 'easy' THEN 1 END) AS easy,
  count(CASE WHEN difficulty = 'medium' THEN 1 END) AS medium,
  count(CASE WHEN difficulty = 'hard' THEN 1 END) AS hard
FROM full_bank GROUP BY domain""", "f4"))
def q_bank_grid(spark, sf_dir):
    return B.bank_grid(bank_full(spark, sf_dir))


@register("duplicate_items", O.with_ctes("""
SELECT * FROM (
  SELECT 'id' AS kind, CAST(doc_id AS VARCHAR) AS key, count(*) AS n, CAST(min(doc_id) AS VARCHAR) AS first_id,
         CAST(max(doc_id) AS VARCHAR) AS last_id FROM pool_keyed GROUP BY doc_id
  UNION ALL
  SELECT 'content_key', sha256(content_key), count(*), CAST(min(doc_id) AS VARCHAR), CAST(max(doc_id) AS VARCHAR)
  FROM pool_keyed GROUP BY content_key) d WHERE n > 1""", "f4"))
def q_duplicate_items(spark, sf_dir):
    return B.duplicate_items(B.with_content_key(FX._pool_base(spark, sf_dir)), "doc_id")


@register("independent_items", O.with_ctes("""
SELECT sha256(content_key) AS key_sha256, min(doc_id) AS doc_id FROM pool_keyed GROUP BY content_key""", "f4"))
def q_independent_items(spark, sf_dir):
    ind = B.independent_items(B.with_content_key(FX._pool_base(spark, sf_dir)), "doc_id")
    return ind.select(F.sha2("content_key", 256).alias("key_sha256"), "doc_id")


@register("diagnostic_sample", O.with_ctes("""
SELECT question_id, difficulty, CAST(sample_rank AS INTEGER) AS sample_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY md5('7|' || question_id), question_id) AS sample_rank
  FROM full_bank) s
WHERE sample_rank <= 2
ORDER BY CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 4 END, sample_rank
LIMIT 6""", "f4"))
def q_diagnostic_sample(spark, sf_dir):
    return B.diagnostic_sample(bank_full(spark, sf_dir)).select("question_id", "difficulty", "sample_rank")


@register("spot_check", O.with_ctes("""
SELECT question_id, domain, difficulty, subject, answer_letter FROM supplement
ORDER BY md5('7|' || question_id), question_id LIMIT 3""", "f4"))
def q_spot_check(spark, sf_dir):
    return B.spot_check(supplement(spark, sf_dir)).select(
        "question_id", "domain", "difficulty", "subject", "answer_letter")


@register("limit_questions", O.with_ctes("""
SELECT question_id, domain, difficulty FROM full_bank ORDER BY question_id LIMIT 10""", "f4"))
def q_limit_questions(spark, sf_dir):
    return B.limit_questions(bank_full(spark, sf_dir), 10).select("question_id", "domain", "difficulty")


@register("pick_first_per_tier", O.with_ctes("""
SELECT question_id, domain, difficulty FROM (
  SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY question_id) AS rn FROM original
  WHERE domain = (SELECT CASE WHEN bool_or(domain = 'STEM') THEN 'STEM' ELSE arg_min(domain, question_id) END
                  FROM original)) s
WHERE rn = 1""", "f4"))
def q_pick_first_per_tier(spark, sf_dir):
    return B.pick_first_per_tier(original(spark, sf_dir)).select("question_id", "domain", "difficulty")


def _prompt_sql(template: str) -> str:
    before, rest = template.split("{question}")
    middle, after = rest.split("{choices}")
    lit = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    block = ("concat_ws(chr(10), 'A. ' || choice_A, 'B. ' || choice_B, 'C. ' || choice_C, 'D. ' || choice_D)")
    return f"{lit(before)} || question || {lit(middle)} || {block} || {lit(after)}"


def _prompt_oracle() -> str:
    from calibra.schemas import CONSTRAINED_PROMPT, FREEFORM_PROMPT, REPAIR_SUFFIX
    lit = "'" + REPAIR_SUFFIX.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return O.with_ctes(f"""
SELECT question_id, {_prompt_sql(CONSTRAINED_PROMPT)} AS prompt_constrained,
  {_prompt_sql(FREEFORM_PROMPT)} AS prompt_freeform,
  {_prompt_sql(CONSTRAINED_PROMPT)} || {lit} AS prompt_repair
FROM full_bank
WHERE choice_A IS NOT NULL AND choice_B IS NOT NULL AND choice_C IS NOT NULL AND choice_D IS NOT NULL""", "f4")


@register("prompt_table", _prompt_oracle())
def q_prompt_table(spark, sf_dir):
    return B.prompt_table(bank_full(spark, sf_dir))


@register("empirical_difficulty", O.with_ctes(f"""
SELECT question_id, n, {O.rnd('accuracy')} AS accuracy,
  CASE WHEN accuracy <= q1 THEN 'hard' WHEN accuracy <= q2 THEN 'medium' ELSE 'easy' END AS empirical_difficulty
FROM (SELECT question_id, count(*) AS n, avg(correct) AS accuracy FROM feat GROUP BY question_id) i,
     (SELECT quantile_cont(accuracy, 1.0 / 3.0) AS q1, quantile_cont(accuracy, 2.0 / 3.0) AS q2
      FROM (SELECT question_id, avg(correct) AS accuracy FROM feat GROUP BY question_id) x) c""", "f1"))
def q_empirical_difficulty(spark, sf_dir):
    return rounded(B.empirical_difficulty(feat(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Collection operations
# ---------------------------------------------------------------------------

from calibra.operators import ops as OPS  # noqa: E402

DRY_MODELS = ["claude_haiku", "gpt4o_mini", "gemini_flash"]
TRIALS = 5
SPEND_CAP = 0.012
GATE_CAP = 25.0


def _plan_values(models, trials) -> str:
    return ", ".join(f"('{m}', {t})" for m in models for t in range(trials))


@register("collection_plan", O.with_ctes(f"""
SELECT b.question_id, p.model_id, CAST(p.trial_index AS INTEGER) AS trial_index
FROM full_bank b, (VALUES {_plan_values(DRY_MODELS, TRIALS)}) p(model_id, trial_index)""", "f4"))
def q_collection_plan(spark, sf_dir):
    return OPS.collection_plan(bank_full(spark, sf_dir), DRY_MODELS, TRIALS)


@register("remaining_work", O.with_ctes(f"""
SELECT q.question_id, p.model_id, CAST(p.trial_index AS INTEGER) AS trial_index
FROM (SELECT DISTINCT question_id FROM responses) q,
     (VALUES {_plan_values(FX.FIXTURE_MODELS, TRIALS)}) p(model_id, trial_index)
WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.question_id = q.question_id AND r.model_id = p.model_id
                  AND r.trial_index = p.trial_index)""", "f1"))
def q_remaining_work(spark, sf_dir):
    r = raw(spark, sf_dir)
    plan = OPS.collection_plan(r.select("question_id").distinct(), FX.FIXTURE_MODELS, TRIALS)
    return OPS.remaining_work(plan, r)


def _dry_sql() -> str:
    from calibra.schemas import DEFAULT_WALL_SEC, DRY_IN_TOKENS, DRY_OUT_TOKENS, WALL_SEC
    reg = ", ".join(f"('{m}', '{p}', '{pm}', {float(WALL_SEC.get(m, DEFAULT_WALL_SEC))!r})"
                    for m, (p, pm) in OPS.MODEL_REGISTRY.items())
    return O.with_ctes(f""",
reg AS (SELECT * FROM (VALUES {reg}) t(model_id, provider, model, wall_sec)),
per AS (
  SELECT c.model_id, c.calls,
    (c.calls * {DRY_IN_TOKENS} / 1000000.0) * coalesce(p1.in_rate, p2.in_rate, 1.0)
      + (c.calls * {DRY_OUT_TOKENS} / 1000000.0) * coalesce(p1.out_rate, p2.out_rate, 5.0) AS est_cost_usd,
    c.calls * coalesce(r.wall_sec, {DEFAULT_WALL_SEC}) / 3600.0 AS est_hours
  FROM (SELECT p.model_id, count(*) AS calls FROM full_bank b,
          (VALUES {_plan_values(DRY_MODELS, TRIALS)}) p(model_id, trial_index) GROUP BY p.model_id) c
  LEFT JOIN reg r USING (model_id)
  LEFT JOIN pricing p1 ON lower(r.provider) = p1.provider AND r.model = p1.model
  LEFT JOIN pricing p2 ON lower(r.provider) = p2.provider AND p2.model = 'default')
SELECT coalesce(model_id, 'TOTAL') AS model_id, CAST(sum(calls) AS BIGINT) AS calls,
  {O.rnd('sum(est_cost_usd)')} AS est_cost_usd, {O.rnd('sum(est_hours)')} AS est_hours
FROM per GROUP BY ROLLUP (model_id)""", "f4", "f2")


@register("dry_run_estimate", _dry_sql())
def q_dry_run_estimate(spark, sf_dir):
    plan = OPS.collection_plan(bank_full(spark, sf_dir), DRY_MODELS, TRIALS)
    return rounded(OPS.dry_run_estimate(plan))


def costed_calls(spark, sf_dir):
    return OPS.call_cost(FX.calls(spark, sf_dir))


@register("call_cost", O.with_ctes(f"""
SELECT run_id, call_id, provider, model, input_tokens, output_tokens, {O.rnd('cost_usd', 12)} AS cost_usd
FROM costed""", "f2"))
def q_call_cost(spark, sf_dir):
    return rounded(costed_calls(spark, sf_dir).select(
        "run_id", "call_id", "provider", "model", "input_tokens", "output_tokens", "cost_usd"), 12)


@register("cost_by_provider", O.with_ctes(f"""
SELECT lower(provider) AS provider, count(*) AS n_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {O.rnd('sum(cost_usd)', 12)} AS cost_usd
FROM costed GROUP BY lower(provider)""", "f2"))
def q_cost_by_provider(spark, sf_dir):
    return rounded(OPS.cost_by_provider(costed_calls(spark, sf_dir)), 12)


@register("spend_cap", O.with_ctes(f"""
SELECT run_id, call_id, ts, {O.rnd('cost_usd', 12)} AS cost_usd, {O.rnd('run_cost_usd', 12)} AS run_cost_usd FROM (
  SELECT *, sum(cost_usd) OVER (PARTITION BY run_id ORDER BY ts, call_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_cost_usd
  FROM costed) s
WHERE run_cost_usd <= {SPEND_CAP!r}""", "f2"))
def q_spend_cap(spark, sf_dir):
    kept = OPS.spend_cap(costed_calls(spark, sf_dir), SPEND_CAP)
    return rounded(kept.select("run_id", "call_id", "ts", "cost_usd", "run_cost_usd"), 12)


@register("retry_collapse", O.with_ctes("""
SELECT a.cell_id, a.attempt AS attempts_used, a.predicted_letter, a.confidence, a.parse_ok,
  s.input_tokens, s.output_tokens, s.call_cost_usd,
  concat_ws(' | ', a.internal_prob_note, 'parse_attempts=' || CAST(a.attempt AS VARCHAR) || '/3') AS internal_prob_note
FROM attempts_3 a
JOIN (SELECT cell_id, coalesce(min(CASE WHEN parse_ok THEN attempt END), max(attempt)) AS chosen
      FROM attempts_3 GROUP BY cell_id) c ON a.cell_id = c.cell_id AND a.attempt = c.chosen
JOIN (SELECT p.cell_id, CAST(sum(p.input_tokens) AS BIGINT) AS input_tokens,
             CAST(sum(p.output_tokens) AS BIGINT) AS output_tokens,
             round(sum(p.call_cost_usd), 12) AS call_cost_usd
      FROM attempts_3 p JOIN (SELECT cell_id, coalesce(min(CASE WHEN parse_ok THEN attempt END), max(attempt)) AS chosen
                              FROM attempts_3 GROUP BY cell_id) c2
        ON p.cell_id = c2.cell_id AND p.attempt <= c2.chosen
      GROUP BY p.cell_id) s ON s.cell_id = a.cell_id""", "f3"))
def q_retry_collapse(spark, sf_dir):
    return rounded(OPS.retry_collapse(FX.attempts(spark, sf_dir)), 12)


@register("integrity_check", O.with_ctes(f"""
SELECT model_id, count(*) AS n,
  {O.rnd('avg(CAST(coalesce(parse_ok, false) AS DOUBLE))')} AS parse_ok_rate,
  count(CASE WHEN config_version IS DISTINCT FROM 'v2' THEN 1 END) AS bad_config_version,
  count(CASE WHEN coalesce(max_output_tokens, 0) <> 1024 THEN 1 END) AS bad_max_tokens,
  CAST((SELECT count(*) FROM part) * {TRIALS} AS BIGINT) AS expected
FROM responses GROUP BY model_id""", "f1"))
def q_integrity_check(spark, sf_dir):
    r = raw(spark, sf_dir)
    expected = FX.table(spark, sf_dir, "part").count() * TRIALS  # the bank: a question that no model answered counts too
    return rounded(OPS.integrity_check(r, expected))


@register("run_gate", O.with_ctes(f""",
rc AS (
  SELECT r.*, (coalesce(input_tokens, 0) / 1000000.0) * coalesce(p1.in_rate, p2.in_rate, 1.0)
            + (coalesce(output_tokens, 0) / 1000000.0) * coalesce(p1.out_rate, p2.out_rate, 5.0) AS cost
  FROM responses r
  LEFT JOIN pricing p1 ON lower(r.backend) = p1.provider AND r.model_name = p1.model
  LEFT JOIN pricing p2 ON lower(r.backend) = p2.provider AND p2.model = 'default'),
per AS (
  SELECT model_id, count(*) AS n, count(CASE WHEN parse_ok THEN 1 END) AS n_ok,
    bool_or(internal_prob_answer IS NOT NULL) AS has_internal_prob, sum(cost) AS cost_usd,
    count(CASE WHEN error IS NOT NULL THEN 1 END) AS errors
  FROM rc GROUP BY model_id)
SELECT model_id, n, n_ok, has_internal_prob, {O.rnd('cost_usd')} AS cost_usd, errors,
  (sum(n_ok) OVER () = sum(n) OVER ()) AND (sum(cost_usd) OVER () <= {GATE_CAP!r}) AS gate_pass
FROM per""", "f1", "f2"))
def q_run_gate(spark, sf_dir):
    return rounded(OPS.run_gate(raw(spark, sf_dir), GATE_CAP))


_MERGE_COLS = ["model_id", "question_id", "trial_index", "parse_ok", "confidence"]


@register("merge_results", O.with_ctes("""
SELECT model_id, question_id, trial_index, parse_ok, confidence, source FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id, question_id, trial_index ORDER BY prio) AS rn FROM (
    SELECT model_id, question_id, trial_index, parse_ok, confidence, 'existing' AS source, 0 AS prio
    FROM responses WHERE trial_index < 3
    UNION ALL
    SELECT model_id, question_id, trial_index, parse_ok, confidence, 'new' AS source, 1 AS prio
    FROM responses WHERE trial_index >= 2) u) r
WHERE rn = 1""", "f1"))
def q_merge_results(spark, sf_dir):
    r = raw(spark, sf_dir).select(*_MERGE_COLS)
    existing = r.filter(F.col("trial_index") < 3).withColumn("source", F.lit("existing"))
    new = r.filter(F.col("trial_index") >= 2).withColumn("source", F.lit("new"))
    return OPS.merge_results(existing, new, ["model_id", "question_id", "trial_index"])


# ---------------------------------------------------------------------------
# Diagnostics
# ---------------------------------------------------------------------------

from calibra.operators import diagnostics as DG  # noqa: E402

_STRIP = r"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"
_TOK = "tokens[i + 1].token"
_MATCH = (f"length({_STRIP.format(x=_TOK)}) BETWEEN 1 AND 2 "
          f"AND upper(substr({_STRIP.format(x=_TOK)}, 1, 1)) = upper(predicted_letter)")


@register("answer_token_prob", O.with_ctes(rf""",
m AS (
  SELECT *, coalesce(len(tokens), 0) AS n,
    CASE WHEN coalesce(len(tokens), 0) > 0
         THEN list_filter(range(0, len(tokens)), lambda i: {_MATCH}) ELSE [] END AS idx
  FROM token_logprobs),
e AS (SELECT *, CASE WHEN len(idx) > 0 THEN tokens[idx[1] + 1] END AS entry FROM m),
a AS (
  SELECT *, list_filter(coalesce(entry.top_logprobs, []), lambda x: coalesce(x.token, '') <> '' AND x.logprob IS NOT NULL) AS usable
  FROM e),
d AS (
  SELECT *, list_filter(usable, lambda x, j: NOT list_contains(list_transform(usable[j + 1:], lambda y: y.token), x.token)) AS dedup
  FROM a),
o AS (
  SELECT *, (predicted_letter IS NULL OR n = 0) AS no_input FROM d)
SELECT model_id, question_id, trial_index,
  {O.rnd("CASE WHEN NOT no_input AND len(idx) > 0 AND entry.logprob IS NOT NULL THEN exp(entry.logprob) END")}
    AS internal_prob_answer,
  CASE WHEN no_input THEN 'no answer letter or empty logprobs'
       WHEN len(idx) = 0 THEN 'logprob extraction ambiguous/failed: no token matching answer letter '''
         || upper(predicted_letter) || ''' among ' || CAST(n AS VARCHAR) || ' tokens'
       WHEN entry.logprob IS NULL THEN 'matched token missing logprob'
       WHEN len(idx) > 1 THEN 'logprob extraction ambiguous: ' || CAST(len(idx) AS VARCHAR) || ' tokens match '''
         || upper(predicted_letter) || ''' at indices [' || array_to_string(idx, ', ') || ']; using first match'
  END AS internal_prob_note,
  CASE WHEN NOT no_input AND len(idx) > 0 AND entry.logprob IS NOT NULL AND len(dedup) > 0
       THEN CAST(len(dedup) AS INTEGER) END AS n_alternatives,
  CASE WHEN NOT no_input AND len(idx) > 0 AND entry.logprob IS NOT NULL AND len(dedup) > 0
       THEN array_to_string(list_sort(list_transform(dedup, lambda x: x.token)), '|') END AS alt_tokens,
  {O.rnd("CASE WHEN NOT no_input AND len(idx) > 0 AND entry.logprob IS NOT NULL AND len(dedup) > 0 THEN list_sum(list_transform(dedup, lambda x: exp(x.logprob))) END")}
    AS alt_prob_sum
FROM o""", "f5"))
def q_answer_token_prob(spark, sf_dir):
    t = DG.answer_token_prob(FX.token_logprobs(spark, sf_dir))
    alts = F.col("internal_prob_alternatives")
    return rounded(t.select(
        "model_id", "question_id", "trial_index", "internal_prob_answer", "internal_prob_note",
        F.when(alts.isNotNull(), F.size(alts)).cast("int").alias("n_alternatives"),
        F.array_join(F.array_sort(F.map_keys(alts)), "|").alias("alt_tokens"),
        F.aggregate(F.map_values(alts), F.lit(0.0), lambda acc, x: acc + x).alias("alt_prob_sum")))


def _formats(spark, sf_dir):
    return DG.score_formats(FX.freeform_replies(spark, sf_dir))


_FMT_SQL = f""",
fs AS (
  SELECT model_id, question_id, trial_index, correct_letter,
    coalesce(nullif(upper(regexp_extract(raw_response, '(?i)ANSWER:\\s*([A-D])', 1)), '') = correct_letter, false)
      AS correct_constrained,
    coalesce({O.FINAL_LETTER_SQL.format(t='freeform_reply')} = correct_letter, false) AS correct_unconstrained
  FROM freeform)"""


@register("format_comparison", O.with_ctes(_FMT_SQL + f"""
SELECT model_id, {O.rnd('avg(CAST(correct_constrained AS DOUBLE))')} AS constrained,
  {O.rnd('avg(CAST(correct_unconstrained AS DOUBLE))')} AS unconstrained
FROM fs GROUP BY model_id""", "freeform"))
def q_format_comparison(spark, sf_dir):
    return rounded(DG.format_comparison(_formats(spark, sf_dir)))


@register("format_discordance", O.with_ctes(_FMT_SQL + """
SELECT model_id, count(*) AS n_pairs,
  count(CASE WHEN correct_constrained AND correct_unconstrained THEN 1 END) AS both_correct,
  count(CASE WHEN correct_constrained AND NOT correct_unconstrained THEN 1 END) AS constrained_only,
  count(CASE WHEN NOT correct_constrained AND correct_unconstrained THEN 1 END) AS unconstrained_only,
  count(CASE WHEN NOT correct_constrained AND NOT correct_unconstrained THEN 1 END) AS neither
FROM fs GROUP BY model_id""", "freeform"))
def q_format_discordance(spark, sf_dir):
    return DG.format_discordance(_formats(spark, sf_dir))


@register("trial_consistency", O.with_ctes(f""",
pairs AS (
  SELECT a.model_id, a.question_id, CAST(a.confidence AS DOUBLE) AS x, CAST(b.confidence AS DOUBLE) AS y
  FROM feat a JOIN feat b ON a.model_id = b.model_id AND a.question_id = b.question_id
   AND a.trial_index < b.trial_index),
both_ways AS (SELECT model_id, x, y FROM pairs UNION ALL SELECT model_id, y, x FROM pairs)
SELECT p.model_id, p.n_items, p.n_pairs, {O.rnd('b.r')} AS pair_corr, {O.rnd('p.mad')} AS mean_abs_delta
FROM (SELECT model_id, count(DISTINCT question_id) AS n_items, count(*) AS n_pairs, avg(abs(x - y)) AS mad
      FROM pairs GROUP BY model_id) p
JOIN (SELECT model_id, corr(x, y) AS r FROM both_ways GROUP BY model_id) b USING (model_id)""",
    "f1"))
def q_trial_consistency(spark, sf_dir):
    return rounded(DG.trial_consistency(feat(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Stream monitors, batch form (ST2-ST4); the streaming runs are in tests
# ---------------------------------------------------------------------------

from calibra.streaming import monitors as STM  # noqa: E402

DRIFT_WINDOW = "30 days"


@register("drift_windows", O.with_ctes(f"""
SELECT time_bucket(INTERVAL '30 days', collection_timestamp, TIMESTAMP '1970-01-01 00:00:00') AS window_start,
  time_bucket(INTERVAL '30 days', collection_timestamp, TIMESTAMP '1970-01-01 00:00:00') + INTERVAL '30 days'
    AS window_end,
  model_id, count(*) AS n, {O.rnd('avg(correct)')} AS accuracy,
  {O.rnd('avg(confidence_norm) - avg(correct)')} AS overconfidence_gap, {O.rnd(O.ece_sql())} AS ece
FROM feat GROUP BY ALL""", "f1"))
def q_drift_windows(spark, sf_dir):
    return rounded(STM.drift_frame(raw(spark, sf_dir), window=DRIFT_WINDOW))


@register("progress_by_model", O.with_ctes(f""",
rc AS (
  SELECT r.*, (coalesce(input_tokens, 0) / 1000000.0) * coalesce(p1.in_rate, p2.in_rate, 1.0)
            + (coalesce(output_tokens, 0) / 1000000.0) * coalesce(p1.out_rate, p2.out_rate, 5.0) AS cost
  FROM responses r
  LEFT JOIN pricing p1 ON lower(r.backend) = p1.provider AND r.model_name = p1.model
  LEFT JOIN pricing p2 ON lower(r.backend) = p2.provider AND p2.model = 'default')
SELECT model_id, count(*) AS n, {O.rnd('avg(CAST(parse_ok AS DOUBLE))')} AS parse_ok_rate,
  {O.rnd('sum(cost)')} AS cost_usd
FROM rc GROUP BY model_id""", "f1", "f2"))
def q_progress_by_model(spark, sf_dir):
    return rounded(STM.progress_frame(raw(spark, sf_dir)))


ALERT_CAP = 0.02


@register("spend_alerts", O.with_ctes(f"""
SELECT run_id, {O.rnd('sum(cost_usd)', 12)} AS run_cost_usd, count(*) AS n_calls
FROM costed GROUP BY run_id HAVING sum(cost_usd) > {ALERT_CAP!r}""", "f2"))
def q_spend_alerts(spark, sf_dir):
    return rounded(STM.spend_alert_frame(costed_calls(spark, sf_dir), ALERT_CAP), 12)


# ---------------------------------------------------------------------------
# Near duplicates
# ---------------------------------------------------------------------------

from calibra.operators import neardup as ND  # noqa: E402


@register("near_duplicates", rf"""
WITH toks AS (
  SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'),
                                           lambda x: x <> '')) AS tokens
  FROM documents),
sets AS (
  SELECT sha256(array_to_string(list_sort(tokens), ' ')) AS set_id, min(doc_id) AS rep_id,
         count(*) AS n_members, any_value(tokens) AS tokens, len(any_value(tokens)) AS L
  FROM toks WHERE len(tokens) > 0 GROUP BY 1),
pairs AS (
  SELECT a.rep_id AS rep_a, b.rep_id AS rep_b, a.n_members AS n_a, b.n_members AS n_b,
         len(list_intersect(a.tokens, b.tokens)) AS inter, a.L AS la, b.L AS lb
  FROM sets a JOIN sets b ON a.set_id < b.set_id AND b.L >= a.L * 0.9 AND a.L >= b.L * 0.9)
SELECT least(rep_a, rep_b) AS doc_a, greatest(rep_a, rep_b) AS doc_b,
  CASE WHEN rep_a < rep_b THEN n_a ELSE n_b END AS members_a,
  CASE WHEN rep_a < rep_b THEN n_b ELSE n_a END AS members_b,
  CAST(inter AS INTEGER) AS inter, CAST(la + lb - inter AS INTEGER) AS union_size,
  {O.rnd('inter / (la + lb - inter)')} AS jaccard
FROM pairs WHERE inter / (la + lb - inter) >= 0.9""")
def q_near_duplicates(spark, sf_dir):
    return rounded(ND.near_duplicates(FX.table(spark, sf_dir, "documents"), "doc_id", "text", 0.9))


@register("near_duplicate_groups")
def q_near_duplicate_groups(spark, sf_dir):
    """D2 with one row a document; tested against the pairs of ``near_duplicates``."""
    return ND.near_duplicate_groups(FX.table(spark, sf_dir, "documents"), "doc_id", "text", 0.9)


# ---------------------------------------------------------------------------
# Provider payloads
# ---------------------------------------------------------------------------

from calibra.functions import payloads as PL  # noqa: E402


@register("payload_text", O.with_ctes(r"""
SELECT model_id, question_id, trial_index, provider,
  CASE WHEN line = 2 THEN ''
       WHEN provider IN ('anthropic', 'gemini') THEN regexp_replace(raw_response, '^\s+|\s+$', '', 'g')
       ELSE '  ' || raw_response || ' ' || chr(10) END AS text,
  CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
  CASE WHEN provider IN ('anthropic', 'gemini') AND line = 2 THEN provider || ': no text in the reply' END AS error
FROM payloads""", "f1_raw", "f6"))
def q_payload_text(spark, sf_dir):
    p = PL.payload_text(FX.provider_payloads(spark, sf_dir))
    return p.select("model_id", "question_id", "trial_index", "provider", "text", "input_tokens",
                    "output_tokens", "error")


@register("normalize_logprobs", O.with_ctes(rf"""
SELECT model_id, question_id, trial_index, provider,
  CASE WHEN provider = 'openai' OR (provider = 'ollama' AND line <> 5) OR (provider = 'gemini' AND line <> 7)
       THEN CAST(len(tokens) AS INTEGER) END AS n_tokens,
  CASE WHEN provider = 'openai' OR (provider = 'ollama' AND line <> 5)
         THEN CAST(list_sum(list_transform(tokens, lambda x: len(x.top_logprobs))) AS INTEGER)
       WHEN provider = 'gemini' AND line = 3
         THEN CAST(list_sum(list_transform(tokens, lambda x: 1 + len(x.top_logprobs))) AS INTEGER)
       WHEN provider = 'gemini' AND line <> 7 THEN 0
  END AS n_top,
  CASE WHEN provider = 'gemini' AND line = 3 THEN '?'
       WHEN provider = 'openai' OR (provider = 'ollama' AND line <> 5) OR (provider = 'gemini' AND line <> 7)
       THEN tokens[-1].token END AS last_token,
  CASE WHEN provider = 'gemini' AND line = 3 THEN -0.05
       WHEN provider = 'openai' OR (provider = 'ollama' AND line <> 5) OR (provider = 'gemini' AND line <> 7)
       THEN {O.rnd('tokens[-1].logprob + CAST(0 AS DOUBLE)')} END AS last_logprob,
  (provider = 'gemini' AND line = 7) AS only_avg,
  CASE WHEN provider = 'gemini' AND line = 7
         THEN 'not available at per-token granularity for this model/API version (avgLogprobs=-0.25)'
       WHEN provider = 'ollama' AND line = 5
         THEN 'Ollama logprobs requested but not returned (null/absent). internal_prob_answer set to None.'
  END AS logprob_note
FROM payloads""", "f1_raw", "f6"))
def q_normalize_logprobs(spark, sf_dir):
    n = PL.normalize_logprobs(FX.provider_payloads(spark, sf_dir))
    last = F.element_at("tokens", -1)
    return rounded(n.select(
        "model_id", "question_id", "trial_index", "provider",
        F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"),
        F.aggregate(F.col("tokens"), F.lit(0), lambda acc, x: acc + F.size(x["top_logprobs"])).alias("n_top"),
        last["token"].alias("last_token"), (last["logprob"] + F.lit(0.0)).alias("last_logprob"), "only_avg", "logprob_note"))


# ---------------------------------------------------------------------------
# Reference-layout result tables (p-values / bootstrap: rows-only check)
# ---------------------------------------------------------------------------

from calibra.plans import audit as AUD  # noqa: E402


@register("overall_by_model_ci")
def q_overall_by_model_ci(spark, sf_dir):
    """A2 with 2000-replicate bootstrap intervals of accuracy, gap and ECE."""
    return rounded(AUD.overall_with_ci(feat(spark, sf_dir), FX.FIXTURE_MODELS))


@register("holm_model_tests")
def q_holm_model_tests(spark, sf_dir):
    """I6 over per-model slope t-tests and hard > easy bootstrap p-values."""
    reg = AUD.regression_table(feat(spark, sf_dir))
    return rounded(AUD.holm_tests(reg, FX.FIXTURE_MODELS))


@register("bootstrap_ci_cluster", O.with_ctes(_clusters_sql() + _CI_SQL, "f1"))
def q_bootstrap_ci_cluster(spark, sf_dir):
    """I8: 2000 Poisson replicates of whole questions, from one vector of sums a question."""
    return rounded(RS.bootstrap_clusters(feat(spark, sf_dir), RS.standard_metrics(), "question_id", n_boot=N_BOOT))


@register("holm_correction_large", ORACLES["holm_correction"])
def q_holm_correction_large(spark, sf_dir):
    """I6 through the range-partitioned form (same result as holm_correction)."""
    return rounded(INF.holm_large(holm_input(spark, sf_dir)))
