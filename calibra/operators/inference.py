"""Statistical inference over groups.

Everything row-level is an aggregate or a window over *distinct values*:
regression from ``regr_*`` sums, Spearman from mid-ranks of distinct values
with multiplicities, chi-square from a contingency ``groupBy``.  p-values are
built-in expressions on the aggregated rows; Python runs only on compressed
cells (multinomial bootstrap), never per data row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.functions import metrics as M
from calibra.functions import stats as ST
from calibra.operators import resampling as RS
from calibra.operators.ranges import running_sums
from calibra.session import ensure_checkpoint_dir

X, Y = "difficulty_numeric", "overconfidence_gap_row"


# ---------------------------------------------------------------------------
# OLS of the row gap on ordinal difficulty (with intercept)
# ---------------------------------------------------------------------------

def regression_sums(feat: DataFrame, keys=("model_id",), x: str = X, y: str = Y) -> DataFrame:
    """n, slope, se, r_squared per group from one pass of ``regr_*`` sums.

    se = sqrt((Syy - slope * Sxy) / (n - 2) / Sxx); a constant x gives NULLs.
    """
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    agg = feat.groupBy(*keys).agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_sxx(yc, xc).alias("sxx"),
        F.regr_sxy(yc, xc).alias("sxy"),
        F.regr_syy(yc, xc).alias("syy"),
        F.regr_r2(yc, xc).alias("r_squared"))
    dfree = F.col("n") - 2
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(F.try_divide(F.try_divide(sse, dfree.cast("double")), F.col("sxx")))
    return agg.select(*keys, "n", "slope", F.when(F.col("slope").isNotNull(), se).alias("se"),
                      F.when(F.col("slope").isNotNull(), F.col("r_squared")).alias("r_squared"))


def difficulty_regression(feat: DataFrame, keys=("model_id",), level: float = 0.95) -> DataFrame:
    """I1 with p-value and confidence interval (t tails on one row per group)."""
    base = regression_sums(feat, keys).withColumns({
        "_df": (F.col("n") - 2).cast("double"),
        "_t": F.try_divide(F.col("slope"), F.col("se"))})
    # critical value and p-value are evaluated once each, in their own projection
    tested = ST.with_t_tests(base, "_t", "_df", p_out="_p", q=0.5 + level / 2.0, q_out="_crit")
    crit = F.col("_crit")
    return tested.select(
        *keys, "n", "slope", "se",
        (F.col("slope") - crit * F.col("se")).alias("ci_lo"),
        (F.col("slope") + crit * F.col("se")).alias("ci_hi"),
        F.when(F.col("se").isNotNull(), F.col("_p")).alias("p_value"),
        "r_squared")


# ---------------------------------------------------------------------------
# Spearman rank correlation with average ranks
# ---------------------------------------------------------------------------

def _midrank(keys: list[str], col: str) -> F.Column:
    """Average rank of a distinct value from windows over the cells table.

    cumulative weight through the value (RANGE frame: ties included) minus
    half of the value's own weight less one.
    """
    upto = Window.partitionBy(*keys).orderBy(col).rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*keys, col)
    return F.sum("w").over(upto) - (F.sum("w").over(same) - 1) / 2.0


def spearman(feat: DataFrame, keys=("model_id",), x: str = X, y: str = Y) -> DataFrame:
    """Spearman rho (and n) per group.

    Rows are compressed to distinct (x, y) cells with multiplicities (map-side
    partial aggregation), each cell gets the mid-ranks of its x and y from
    windows over the cells of its group, and rho is the weighted Pearson
    correlation of the ranks.  One scan, no joins; window cost is set by
    the number of distinct values, not rows; ``spearman_ranged`` is for
    continuous scores with a huge number of distinct values per group.
    """
    keys = list(keys)
    cells = M.drop_null_groups(
        feat.groupBy(*keys, x, y).agg(F.count(F.lit(1)).cast("double").alias("w")), [x, y], "w")
    ranked = cells.withColumn("rx", _midrank(keys, x)).withColumn("ry", _midrank(keys, y))
    return _weighted_rho(ranked, keys)


def midranks(values: DataFrame, keys: list[str], value: str, weight: str = "w") -> DataFrame:
    """``values`` (one row per key and value, with a multiplicity) with the average rank ``rank`` of its rows.

    Ranks are running sums over range partitions (``ranges``).  Ties are one
    row, so none straddles two partitions, and no task holds more of a group
    than its range.
    """
    sums = running_sums(values, keys, [value], F.col(weight), "_before")
    return sums.select(*values.columns, (F.col("_before") + (F.col(weight) + 1) / 2.0).alias("rank"))


def spearman_ranged(feat: DataFrame, keys=("model_id",), x: str = X, y: str = Y) -> DataFrame:
    """I2 for scores with any number of distinct values: as ``spearman``, with ranks from range partitions."""
    keys = list(keys)
    ensure_checkpoint_dir(feat.sparkSession)
    cells = M.drop_null_groups(
        feat.groupBy(*keys, x, y).agg(F.count(F.lit(1)).cast("double").alias("w")), [x, y], "w").checkpoint()
    ranked = cells
    for c, out in ((x, "rx"), (y, "ry")):
        ranks = midranks(cells.groupBy(*keys, c).agg(F.sum("w").alias("w")), keys, c)
        ranks = ranks.select(*[F.col(k).alias(f"_{out}_{i}") for i, k in enumerate(keys)], F.col(c).alias(f"_{out}"), F.col("rank").alias(out))
        same = F.col(c) == F.col(f"_{out}")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_{out}_{i}"))
        ranked = ranked.join(ranks, same).select(*ranked.columns, out)
    return _weighted_rho(ranked, keys)


def _weighted_rho(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """n and the correlation of the ranks rx and ry, weighted by w."""
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    agg = ranked.groupBy(*keys).agg(
        F.sum(w).alias("sw"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    n = F.col("sw")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    rho = F.try_divide(cov, F.sqrt(va * vb))
    return agg.select(*keys, n.cast("bigint").alias("n"),
                      F.when((va > 0) & (vb > 0), rho).alias("spearman_rho"))


def add_correlation_p(df: DataFrame, r_col: str, n_col: str = "n", out: str | None = None) -> DataFrame:
    """I3/I2 p-value: t = r sqrt((n-2)/(1-r^2)), two-sided, df = n - 2."""
    r, n = F.col(r_col), F.col(n_col).cast("double")
    tmp = df.withColumns({"_t": r * F.sqrt(F.try_divide(n - 2, F.lit(1.0) - r * r)), "_df": n - 2})
    tmp = ST.with_t_tests(tmp, "_t", "_df", p_out="_p")
    p = F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(F.col("_p"))
    return tmp.withColumn(out or f"{r_col}_p", F.when(r.isNotNull() & (n > 2), p)).drop("_t", "_df", "_p")


def spearman_with_p(feat: DataFrame, keys=("model_id",)) -> DataFrame:
    return add_correlation_p(spearman(feat, keys), "spearman_rho", out="spearman_p")


# ---------------------------------------------------------------------------
# Holm-Bonferroni over a table of named p-values
# ---------------------------------------------------------------------------

def holm(pvals: DataFrame, test_col: str = "test", p_col: str = "p_raw",
         order_col: str | None = "input_ord") -> DataFrame:
    """Holm step-down adjustment.

    NULL/NaN p sorts as 1.0, stays NULL and still counts in m; ties keep the
    input order; each adjusted p is capped at 1 before the running maximum.
    The input is a small table of tests (one row per test), so a window
    without partitioning is fine here.
    """
    p = F.col(p_col)
    clean = F.when(~F.isnan(p), p)
    sort_key = F.coalesce(clean, F.lit(1.0))
    order = [sort_key] + ([F.col(order_col)] if order_col else []) + [F.col(test_col)]
    ranked = pvals.withColumn("_clean", clean).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    adj = F.least(F.lit(1.0), F.col("_clean") * (m - F.col("rank") + 1))
    run = F.max(adj).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select(F.col(test_col).alias("test"), p.alias("p_raw"),
                         F.when(F.col("_clean").isNotNull(), run).alias("p_holm"), "rank")


def holm_large(pvals: DataFrame, test_col: str = "test", p_col: str = "p_raw",
               order_col: str = "input_ord") -> DataFrame:
    """Holm step-down for a very large table of tests, without a single-task window.

    The tests are range-partitioned and sorted by (p, input order, name);
    ``monotonically_increasing_id`` then encodes (partition, position).  A
    per-partition summary (row count and the largest capped adjusted p, one
    row per partition) gives each partition its rank offset and the running
    maximum carried in from earlier partitions; everything else is a window
    inside one range partition.  Same result as ``holm``.
    """
    p = F.col(p_col)
    clean = F.when(~F.isnan(p), p)
    ordered = pvals.withColumn("_clean", clean).orderBy(
        F.coalesce(F.col("_clean"), F.lit(1.0)), F.col(order_col), F.col(test_col))
    ided = ordered.withColumn("_id", F.monotonically_increasing_id())
    ided = ided.withColumns({"_part": F.shiftright(F.col("_id"), 33),
                             "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ided.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    m = counts.agg(F.sum("_cnt")).scalar()
    ranked = ided.join(F.broadcast(offsets.select("_part", "_off")), "_part").withColumn(
        "rank", (F.col("_off") + F.row_number().over(Window.partitionBy("_part").orderBy("_pos"))).cast("int"))
    adj = F.least(F.lit(1.0), F.col("_clean") * (m - F.col("rank") + 1))
    local = Window.partitionBy("_part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_adj", adj).withColumn("_run", F.max("_adj").over(local))
    part_max = ranked.groupBy("_part").agg(F.max("_adj").alias("_pmax"))
    carried = part_max.withColumn("_carry", F.max("_pmax").over(before)).select("_part", "_carry")
    out = ranked.join(F.broadcast(carried), "_part")
    holm_p = F.greatest(F.col("_run"), F.coalesce(F.col("_carry"), F.col("_run")))
    return out.select(F.col(test_col).alias("test"), p.alias("p_raw"),
                      F.when(F.col("_clean").isNotNull(), holm_p).alias("p_holm"), "rank")


# ---------------------------------------------------------------------------
# Chi-square independence test of parse failure vs difficulty
# ---------------------------------------------------------------------------

def chi2_independence(df: DataFrame, keys: list[str], row_col: str, col_col: str) -> DataFrame:
    """Pearson chi-square statistic of a contingency table per group.

    Cell counts come from one groupBy; margins from windows over the (tiny)
    cell table.  A zero expected count makes the statistic NULL.  Degrees of
    freedom are (rows - 1) * (cols - 1) of the observed levels.
    """
    cells = df.groupBy(*keys, row_col, col_col).agg(F.count(F.lit(1)).alias("o"))
    # observed levels come from the (small) cell table: the data is read once
    rows_lv = cells.select(*keys, row_col).distinct()
    cols_lv = cells.select(*keys, col_col).distinct()
    full = rows_lv.join(cols_lv, keys).join(cells, keys + [row_col, col_col], "left") \
        .withColumn("o", F.coalesce("o", F.lit(0)).cast("double"))
    g = Window.partitionBy(*keys)
    full = full.withColumns({
        "rt": F.sum("o").over(Window.partitionBy(*keys, row_col)),
        "ct": F.sum("o").over(Window.partitionBy(*keys, col_col)),
        "nt": F.sum("o").over(g)})
    e = F.col("rt") * F.col("ct") / F.col("nt")
    contrib = F.when(e > 0, (F.col("o") - e) * (F.col("o") - e) / e)
    agg = full.groupBy(*keys).agg(
        F.sum("o").cast("bigint").alias("n"),
        F.when(F.count(F.when(e <= 0, 1)) == 0, F.sum(contrib)).alias("chi2"),
        ((F.countDistinct(row_col) - 1) * (F.countDistinct(col_col) - 1)).cast("int").alias("dof"))
    return agg


def chi2_df2_p(chi2_col: str = "chi2") -> F.Column:
    """Closed-form upper tail for 2 degrees of freedom: exp(-x/2)."""
    return F.exp(-F.col(chi2_col) / 2.0)


def parse_missingness_chi2(raw: DataFrame, keys=("model_id",)) -> DataFrame:
    """Parse failure x difficulty independence per group, with p."""
    t = chi2_independence(raw.withColumn("parsed", F.col("parse_ok").cast("string")),
                          list(keys), "parsed", "difficulty")
    p = F.when(F.col("dof") == 2, chi2_df2_p()).otherwise(
        ST.chi2_sf_col("chi2", "dof"))
    return t.withColumn("p_value", F.when(F.col("chi2").isNotNull(), p))


# ---------------------------------------------------------------------------
# bootstrap
# ---------------------------------------------------------------------------

METRICS = ["accuracy", "overconfidence_gap", "ece", "hard_minus_easy_gap"]


def bootstrap_cells(feat: DataFrame, keys=("model_id",), n_boot: int = 2000, level: float = 0.95,
                    seed: int = 42, block_size: int = 100, score: str = "confidence_norm") -> DataFrame:
    """I4(b)/I5: the multinomial bootstrap of the four standard metrics (see ``resampling``)."""
    return RS.bootstrap_cells_multinomial(feat, RS.standard_metrics(score), keys, n_boot=n_boot, level=level,
                                          seed=seed, block=block_size)
