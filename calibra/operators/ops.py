"""Collection operations.

The reference drives collection with loops, sets and a locked counter; here
each step is a table operation: the plan is a generator over a fixed
(model, trial) list, resume is an anti-join, pricing is a broadcast lookup
with fallbacks, the spend cap is a segmented running sum, and retries
collapse with partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.ranges import running_sums
from calibra.schemas import (CONFIG_VERSION, DEFAULT_WALL_SEC, DRY_IN_TOKENS, DRY_OUT_TOKENS,
                             MAX_OUTPUT_TOKENS, UNKNOWN_PROVIDER_RATES, WALL_SEC, pricing_dim)

# Model registry, model id -> (provider, pricing model), used for dry runs.
MODEL_REGISTRY = {
    "claude_haiku": ("anthropic", "default"),
    "gpt4o_mini": ("openai", "gpt-4o-mini"),
    "gemini_flash": ("gemini", "gemini-3.1-flash-lite"),
    "llama3.1": ("ollama", "default"),
    "mistral": ("ollama", "default"),
}


def collection_plan(bank: DataFrame, models: list[str], trials: int,
                    id_col: str = "question_id") -> DataFrame:
    """Every bank item x configured model x trial (0-based).

    The (model, trial) list is configuration of fixed size, so it is a
    generator (explode of a literal array) on each bank row: no join, no
    shuffle, fan-out bounded by len(models) x trials.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(t).alias("trial_index"))
                      for m in models for t in range(trials)])
    return bank.select(F.col(id_col).alias("question_id"), F.explode(pairs).alias("_p")).select(
        "question_id", "_p.model_id", "_p.trial_index")


def remaining_work(plan: DataFrame, done: DataFrame,
                   keys=("question_id", "model_id", "trial_index")) -> DataFrame:
    """Planned cells not yet done (rows with errors count as done).

    Done records missing a key are skipped; duplicates are removed before
    the anti-join so only distinct keys are shuffled.
    """
    keys = list(keys)
    d = done.select(*keys).dropna().distinct()
    return plan.join(d, keys, "left_anti")


def rates(df: DataFrame, provider_col: str = "provider", model_col: str = "model") -> DataFrame:
    """(provider, model) -> rates, else (provider, default), else 1.0 / 5.0.

    The pricing table has a fixed handful of rows: two broadcast lookups.
    """
    spark = df.sparkSession
    p = pricing_dim(spark)
    exact = p.select(F.col("provider").alias("_p1"), F.col("model").alias("_m1"),
                     F.col("in_rate").alias("_in1"), F.col("out_rate").alias("_out1"))
    dflt = p.filter(F.col("model") == "default").select(
        F.col("provider").alias("_p2"), F.col("in_rate").alias("_in2"), F.col("out_rate").alias("_out2"))
    prov = F.lower(F.col(provider_col))
    j = (df.join(F.broadcast(exact), (prov == F.col("_p1")) & (F.col(model_col) == F.col("_m1")), "left")
         .join(F.broadcast(dflt), prov == F.col("_p2"), "left"))
    return j.withColumns({
        "in_rate": F.coalesce("_in1", "_in2", F.lit(UNKNOWN_PROVIDER_RATES[0])),
        "out_rate": F.coalesce("_out1", "_out2", F.lit(UNKNOWN_PROVIDER_RATES[1])),
    }).drop("_p1", "_m1", "_in1", "_out1", "_p2", "_in2", "_out2")


def cost_expr(in_tokens="input_tokens", out_tokens="output_tokens") -> Column:
    i = F.coalesce(F.col(in_tokens), F.lit(0)).cast("double")
    o = F.coalesce(F.col(out_tokens), F.lit(0)).cast("double")
    return (i / 1_000_000.0) * F.col("in_rate") + (o / 1_000_000.0) * F.col("out_rate")


def call_cost(calls: DataFrame, provider_col: str = "provider", model_col: str = "model") -> DataFrame:
    """J6 + A14: cost of each call from its token counts."""
    return rates(calls, provider_col, model_col).withColumn("cost_usd", cost_expr()).drop(
        "in_rate", "out_rate")


def cost_by_provider(costed: DataFrame) -> DataFrame:
    """Calls, tokens and cost per provider."""
    return costed.groupBy(F.lower("provider").alias("provider")).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"))


def running_spend(costed: DataFrame, run_col: str = "run_id", ts_col: str = "ts",
                  id_col: str = "call_id", cost_col: str = "cost_usd") -> DataFrame:
    """Running cost per run in (ts, call id) order, over range partitions.

    Partitions are cut by the number of calls, not by the clock: a run with a
    third of all calls is spread over many tasks, also if they all fall into
    one hour or one instant.
    """
    sums = running_sums(costed, [run_col], [ts_col, id_col], F.coalesce(F.col(cost_col), F.lit(0.0)), "_before")
    return sums.withColumn("run_cost_usd", F.col("_before") + F.coalesce(F.col(cost_col), F.lit(0.0))).drop("_before")


def spend_cap(costed: DataFrame, cap: float, **kw) -> DataFrame:
    """Calls recorded before a run's cap is crossed (equality allowed).

    The call that would cross the cap is refused and not recorded; the run
    halts there, so every later call of the run is dropped too.  Costs are
    non-negative, so this is exactly ``running <= cap``.
    """
    return running_spend(costed, **kw).filter(F.col("run_cost_usd") <= F.lit(cap))


def spend_alerts(costed: DataFrame, cap: float, run_col: str = "run_id") -> DataFrame:
    """Runs whose total spend exceeds the cap (batch form of the streaming alert)."""
    return costed.groupBy(run_col).agg(F.sum("cost_usd").alias("run_cost_usd"),
                                       F.count(F.lit(1)).alias("n_calls")).filter(
        F.col("run_cost_usd") > cap)


def dry_run_estimate(plan: DataFrame, registry: dict | None = None) -> DataFrame:
    """Calls, USD and hours per model, plus a TOTAL row (rollup)."""
    registry = registry or MODEL_REGISTRY
    spark = plan.sparkSession
    reg = spark.createDataFrame(
        [(m, p, pm, float(WALL_SEC.get(m, DEFAULT_WALL_SEC))) for m, (p, pm) in registry.items()],
        "model_id string, provider string, model string, wall_sec double")
    calls = plan.groupBy("model_id").agg(F.count(F.lit(1)).alias("calls"))
    j = rates(calls.join(F.broadcast(reg), "model_id", "left"))
    per = j.select("model_id", "calls",
                   ((F.col("calls") * DRY_IN_TOKENS / 1_000_000.0) * F.col("in_rate")
                    + (F.col("calls") * DRY_OUT_TOKENS / 1_000_000.0) * F.col("out_rate")).alias("est_cost_usd"),
                   (F.col("calls") * F.coalesce("wall_sec", F.lit(DEFAULT_WALL_SEC)) / 3600.0).alias("est_hours"))
    out = per.rollup("model_id").agg(F.sum("calls").alias("calls"), F.sum("est_cost_usd").alias("est_cost_usd"),
                                     F.sum("est_hours").alias("est_hours"))
    return out.withColumn("model_id", F.coalesce("model_id", F.lit("TOTAL")))


def retry_collapse(attempts: DataFrame, max_attempts: int = 3, cell_col: str = "cell_id") -> DataFrame:
    """Attempts 1..n of one cell -> the first parsed attempt, else the last.

    Attempts beyond ``max_attempts`` are not part of the protocol and don't
    count.  Tokens and cost are summed over the attempts made up to the
    chosen one and the note gets ``parse_attempts=k/n`` appended with " | ".
    One partial aggregate: each task keeps a few sums and one struct a cell
    and attempt number, however many rows a cell has.
    """
    within = F.col("attempt").between(1, max_attempts)
    reply = F.struct("predicted_letter", "confidence", "parse_ok", "internal_prob_note")
    sums = ("input_tokens", "output_tokens", "call_cost_usd")
    per: list[Column] = []
    for k in range(1, max_attempts + 1):
        here = F.col("attempt") == k
        per.append(F.max(F.when(here, reply)).alias(f"_r{k}"))
        per += [F.sum(F.when(here, F.col(c))).alias(f"_{c}{k}") for c in sums]
    wide = attempts.filter(within).groupBy(cell_col).agg(
        F.coalesce(F.min(F.when(F.col("parse_ok"), F.col("attempt"))), F.max("attempt")).alias("k"), *per)

    def upto(c: str) -> Column:
        total = F.lit(0)
        for k in range(1, max_attempts + 1):
            total = total + F.when(F.col("k") >= k, F.coalesce(F.col(f"_{c}{k}"), F.lit(0))).otherwise(0)
        return total

    chosen = F.element_at(F.array(*[F.col(f"_r{k}") for k in range(1, max_attempts + 1)]), F.col("k"))
    out = wide.select(cell_col, "k", chosen.alias("c"), *[upto(c).alias(c) for c in sums])
    note = F.concat_ws(" | ", F.col("c.internal_prob_note"), F.format_string(f"parse_attempts=%d/{max_attempts}", F.col("k")))
    return out.select(cell_col, F.col("k").alias("attempts_used"), "c.predicted_letter", "c.confidence", "c.parse_ok",
                      *sums, note.alias("internal_prob_note"))


def integrity_check(responses: DataFrame, expected: Column | int,
                    config_version: str = CONFIG_VERSION,
                    max_tokens: int = MAX_OUTPUT_TOKENS) -> DataFrame:
    """Per model: rows, expected rows, parse rate, bad config / token settings."""
    agg = responses.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col("parse_ok"), F.lit(False)).cast("double")).alias("parse_ok_rate"),
        F.count(F.when(~F.col("config_version").eqNullSafe(F.lit(config_version)), 1)).alias("bad_config_version"),
        F.count(F.when(F.coalesce(F.col("max_output_tokens"), F.lit(0)) != max_tokens, 1)).alias("bad_max_tokens"))
    exp = F.lit(expected) if isinstance(expected, int) else expected
    return agg.withColumn("expected", exp.cast("bigint"))


def run_gate(responses: DataFrame, cap: float) -> DataFrame:
    """Per model: parsed, internal probability present, cost, errors; gate.

    The gate (every row parsed and total cost within the cap) is computed
    over the per-model rows, a table of one row per model.
    """
    costed = rates(responses, "backend", "model_name").withColumn("_cost", cost_expr())
    per = costed.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("parse_ok"), 1)).alias("n_ok"),
        F.bool_or(F.col("internal_prob_answer").isNotNull()).alias("has_internal_prob"),
        F.sum("_cost").alias("cost_usd"),
        F.count(F.when(F.col("error").isNotNull(), 1)).alias("errors"))
    allw = Window.partitionBy()
    return per.withColumn(
        "gate_pass",
        (F.sum("n_ok").over(allw) == F.sum("n").over(allw)) & (F.sum("cost_usd").over(allw) <= cap))


def merge_results(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of existing and new rows; on a key clash the existing row wins.

    Among several existing (else new) rows of a key the smallest by their
    remaining columns wins, so that reruns agree.  ``min`` is a partial
    aggregate: a hot key is reduced in every task before the shuffle.
    """
    cols = existing.columns
    rest = [c for c in cols if c not in keys]
    u = existing.select(*cols, F.lit(0).alias("_prio")).unionByName(
        new.select(*cols, F.lit(1).alias("_prio")))
    best = u.groupBy(*keys).agg(F.min(F.struct("_prio", *rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
