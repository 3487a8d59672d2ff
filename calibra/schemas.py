"""Explicit schemas and small dimension tables.

Nothing here is inferred: every reader takes one of these StructTypes.  The
dimension tables are tiny and of fixed size (tens of rows), so operators may
broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the audited study's configuration for results
# to agree.  Stated plainly, in their natural order.
# ---------------------------------------------------------------------------

# Domain -> subjects (first domain listing a subject wins).
DOMAIN_SUBJECTS = {
    "STEM": [
        "abstract_algebra", "astronomy", "college_biology", "college_chemistry",
        "college_mathematics", "college_physics", "computer_security",
        "conceptual_physics", "electrical_engineering", "elementary_mathematics",
        "high_school_biology", "high_school_chemistry", "high_school_mathematics",
        "high_school_physics", "high_school_statistics", "machine_learning",
    ],
    "Social_Science": [
        "econometrics", "high_school_geography",
        "high_school_government_and_politics", "high_school_macroeconomics",
        "high_school_microeconomics", "high_school_psychology",
        "professional_psychology", "sociology", "security_studies",
        "us_foreign_policy",
    ],
    "Humanities": [
        "formal_logic", "high_school_european_history", "high_school_us_history",
        "high_school_world_history", "international_law", "jurisprudence",
        "logical_fallacies", "moral_disputes", "moral_scenarios", "philosophy",
        "prehistory", "world_religions",
    ],
}

# Difficulty tier -> subjects (the last tier listing a subject wins).
TIER_SUBJECTS = {
    "easy": [
        "sociology", "high_school_us_history", "high_school_world_history",
        "high_school_european_history", "high_school_geography",
        "high_school_government_and_politics", "high_school_psychology",
        "world_religions", "prehistory", "elementary_mathematics",
        "conceptual_physics", "high_school_biology",
    ],
    "medium": [
        "college_biology", "high_school_chemistry", "high_school_physics",
        "high_school_statistics", "high_school_macroeconomics",
        "high_school_microeconomics", "professional_psychology", "philosophy",
        "moral_disputes", "jurisprudence", "logical_fallacies",
        "us_foreign_policy", "security_studies", "international_law",
        "astronomy", "computer_security",
    ],
    "hard": [
        "abstract_algebra", "college_mathematics", "college_physics",
        "college_chemistry", "formal_logic", "econometrics", "machine_learning",
        "electrical_engineering", "moral_scenarios", "high_school_mathematics",
    ],
}

DIFFICULTY_ORDER = ["easy", "medium", "hard"]
DIFFICULTY_NUMERIC = {"easy": 1, "medium": 2, "hard": 3}
DOMAIN_ORDER = ["STEM", "Social_Science", "Humanities"]
LETTERS = ["A", "B", "C", "D"]

# USD per 1M tokens: provider -> model -> (input, output); "default" rows are
# the per-provider fallback, unknown providers cost 1.0 / 5.0.
PRICING_PER_1M = {
    "openai": {"gpt-4o-mini": (0.15, 0.60), "default": (0.15, 0.60)},
    "gemini": {
        "gemini-3.1-flash-lite": (0.25, 1.50),
        "gemini-2.5-flash": (0.30, 2.50),
        "gemini-flash-latest": (0.30, 2.50),
        "default": (0.25, 1.50),
    },
    "anthropic": {"default": (1.00, 5.00)},
    "ollama": {"default": (0.0, 0.0)},
}
UNKNOWN_PROVIDER_RATES = (1.0, 5.0)

# Dry-run assumptions: tokens per call and wall seconds per call by model.
DRY_IN_TOKENS = 350
DRY_OUT_TOKENS = 80
WALL_SEC = {
    "claude_haiku": 3.5,
    "gpt4o_mini": 2.0,
    "gemini_flash": 5.5,
    "llama3.1": 4.0,
    "mistral": 3.5,
}
DEFAULT_WALL_SEC = 3.0

# Collection run settings checked by the integrity report.
CONFIG_VERSION = "v2"
MAX_OUTPUT_TOKENS = 1024

# Bin count of the calibration error and minimum usable internal probabilities.
N_BINS = 10
MIN_INTERNAL_ROWS = 30

# Prompt texts (constrained, free-form, repair suffix).
CONSTRAINED_PROMPT = (
    "Answer the following multiple-choice question. Then rate your confidence.\n"
    "\n"
    "Question: {question}\n"
    "\n"
    "{choices}\n"
    "\n"
    "Respond in EXACTLY this format with no other text:\n"
    "ANSWER: [A/B/C/D]\n"
    "CONFIDENCE: [integer 0-100]\n"
    "\n"
    "Example of a valid reply:\n"
    "ANSWER: B\n"
    "CONFIDENCE: 70\n"
)
FREEFORM_PROMPT = (
    "Answer the following multiple-choice question. Think through it step by "
    "step, then give your final answer.\n"
    "\n"
    "Question: {question}\n"
    "\n"
    "{choices}\n"
    "\n"
    "Show brief reasoning, then end with exactly one line:\n"
    "FINAL_ANSWER: [A/B/C/D]\n"
)
REPAIR_SUFFIX = (
    "\n\nCRITICAL FORMAT REPAIR: Your previous reply was invalid or incomplete.\n"
    "Reply with EXACTLY two lines and no other text (no reasoning, no refusal):\n"
    "ANSWER: [A/B/C/D]\n"
    "CONFIDENCE: [integer 0-100]\n"
    "You must choose one of A, B, C, or D even if unsure.\n"
)

# ---------------------------------------------------------------------------
# Row schemas
# ---------------------------------------------------------------------------

BANK_SCHEMA = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("choice_A", T.StringType()),
    T.StructField("choice_B", T.StringType()),
    T.StructField("choice_C", T.StringType()),
    T.StructField("choice_D", T.StringType()),
    T.StructField("answer_index", T.IntegerType()),
    T.StructField("answer_letter", T.StringType()),
    T.StructField("bank_source", T.StringType()),
])

POOL_SCHEMA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("answer", T.IntegerType()),
])

RESPONSE_V1_SCHEMA = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("trial", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("predicted_letter", T.StringType()),
    T.StructField("correct_letter", T.StringType()),
    T.StructField("is_correct", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("parse_ok", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()),
])

RESPONSE_V2_SCHEMA = T.StructType([
    T.StructField("config_version", T.StringType()),
    T.StructField("max_output_tokens", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("bank_source", T.StringType()),
    T.StructField("question_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("trial_index", T.IntegerType()),
    T.StructField("collection_timestamp", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("predicted_letter", T.StringType()),
    T.StructField("correct_letter", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("confidence", T.IntegerType()),
    T.StructField("parse_ok", T.BooleanType()),
    T.StructField("internal_prob_answer", T.DoubleType()),
    T.StructField("internal_prob_alternatives", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("internal_prob_note", T.StringType()),
    T.StructField("call_cost_usd", T.DoubleType()),
    T.StructField("input_tokens", T.IntegerType()),
    T.StructField("output_tokens", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

TOKEN_STRUCT = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("logprob", T.DoubleType()),
])
TOKEN_LOGPROBS_TYPE = T.ArrayType(T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("logprob", T.DoubleType()),
    T.StructField("top_logprobs", T.ArrayType(TOKEN_STRUCT)),
]))

CALLS_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("run_cost_usd", T.DoubleType()),
    T.StructField("note", T.StringType()),
])


# ---------------------------------------------------------------------------
# Dimension tables (fixed, tiny: safe to broadcast)
# ---------------------------------------------------------------------------

def subject_dim(spark: SparkSession, domains: dict | None = None, tiers: dict | None = None) -> DataFrame:
    """subject -> domain, difficulty with ordinals.

    ``domains`` / ``tiers`` are {key: [subjects]} maps as found in the
    study's configuration files (defaults: the fixed maps above).  First
    domain listing a subject wins; for tiers the last tier wins.  The
    priorities are carried as columns and resolved with one ``groupBy``.
    """
    from pyspark.sql import functions as F

    domains = DOMAIN_SUBJECTS if domains is None else domains
    tiers = TIER_SUBJECTS if tiers is None else tiers
    dom_rows = [(s, d, di, si) for di, (d, subs) in enumerate(domains.items())
                for si, s in enumerate(subs)]
    tier_rows = [(s, t, ti) for ti, (t, subs) in enumerate(tiers.items()) for s in subs]
    dom = spark.createDataFrame(dom_rows, "subject string, domain string, domain_prio int, pos int")
    tier = spark.createDataFrame(tier_rows, "subject string, difficulty string, tier_prio int")
    dom1 = dom.groupBy("subject").agg(
        F.min_by("domain", "domain_prio").alias("domain"),
        F.min("domain_prio").alias("domain_ord"))
    tier1 = tier.groupBy("subject").agg(
        F.max_by("difficulty", "tier_prio").alias("difficulty"))
    out = dom1.join(tier1, "subject", "full_outer")
    return out.select(
        "subject", "domain", "difficulty",
        (F.col("domain_ord") + 1).cast("int").alias("domain_ord"),
        F.when(F.col("difficulty") == "easy", 1).when(F.col("difficulty") == "medium", 2)
        .when(F.col("difficulty") == "hard", 3).cast("int").alias("difficulty_ord"),
    )


def pricing_dim(spark: SparkSession) -> DataFrame:
    rows = [(p, m, float(r[0]), float(r[1])) for p, ms in PRICING_PER_1M.items() for m, r in ms.items()]
    return spark.createDataFrame(rows, "provider string, model string, in_rate double, out_rate double")


def model_dim(spark: SparkSession, models: list[str]) -> DataFrame:
    """Configured model order as an ordinal (1-based)."""
    return spark.createDataFrame([(m, i + 1) for i, m in enumerate(models)],
                                 "model_id string, model_ord int")
