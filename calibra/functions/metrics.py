"""Calibration metrics as weighted aggregate Column builders (A2-A10, A4).

Every builder is an ordinary aggregate expression, so one ``groupBy().agg``
computes any mix of them in a single pass with map-side partial aggregation,
and the same expressions run unchanged inside a streaming aggregation.  The
optional ``weight`` column turns each metric into its bootstrap-replicate
form (Poisson or multinomial weights), so one bootstrap serves all metrics.

Expected calibration error uses the algebraic single-pass form

    ECE = sum_b |sum_{i in b} w_i (correct_i - score_i)| / sum_i w_i

which equals sum_b (n_b / N) |acc_b - conf_b| over equal-width bins,
empty bins contributing nothing and N counting every row (also the ones
whose score falls outside [0, 1]).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibra.schemas import N_BINS


def bin_edges(n_bins: int = N_BINS) -> list[float]:
    """Edges equal to ``linspace(0, 1, n+1)``: ``i * (1/n)`` and exactly 1.0 last.

    For 10 bins this gives 0.30000000000000004, 0.6000000000000001 and
    0.7000000000000001, so confidences 30, 60 and 70 land in the lower bin.
    """
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bin_index(score, n_bins: int = N_BINS) -> Column:
    """0-based bin of a score; bins are [lo, hi) except the last, [lo, 1].

    Counted as the number of inner edges at or below the score, which is the
    same bin as the interval test and keeps the generated code small.
    Scores outside [0, 1], NaN and NULL get NULL (not binned).
    """
    s = _c(score)
    e = bin_edges(n_bins)
    count = None
    for b in range(1, n_bins):
        term = (s >= F.lit(e[b])).cast("int")
        count = term if count is None else count + term
    return F.when((s >= F.lit(e[0])) & (s <= F.lit(e[n_bins])), count)


def bin_bound(index, which: str = "lo", n_bins: int = N_BINS) -> Column:
    e = bin_edges(n_bins)
    arr = F.array(*[F.lit(x) for x in e])
    off = 1 if which == "lo" else 2
    return F.element_at(arr, _c(index) + off)


def _w(weight) -> Column:
    return F.lit(1.0) if weight is None else _c(weight).cast("double")


def total_weight(weight=None) -> Column:
    """N (row count, or the replicate's total weight)."""
    return F.count(F.lit(1)).cast("double") if weight is None else F.sum(_w(weight))


def weighted_mean(x, weight=None) -> Column:
    if weight is None:
        return F.avg(_c(x).cast("double"))
    w = _w(weight)
    return F.try_divide(F.sum(w * _c(x).cast("double")), F.sum(F.when(_c(x).isNotNull(), w)))


def accuracy(correct, weight=None) -> Column:
    return weighted_mean(correct, weight)


def mean_score(score, weight=None) -> Column:
    return weighted_mean(score, weight)


def gap(score, correct, weight=None) -> Column:
    """Overconfidence gap = mean score - accuracy."""
    return mean_score(score, weight) - accuracy(correct, weight)


def ece(score, correct, weight=None, n_bins: int = N_BINS) -> Column:
    """Expected calibration error in one aggregate expression."""
    s, c, w = _c(score).cast("double"), _c(correct).cast("double"), _w(weight)
    b = bin_index(s, n_bins)
    per_bin = [F.abs(F.coalesce(F.sum(F.when(b == i, w * (c - s))), F.lit(0.0)))
               for i in range(n_bins)]
    total = per_bin[0]
    for p in per_bin[1:]:
        total = total + p
    # An empty group has no non-empty bin: its ECE is 0.
    return F.coalesce(F.try_divide(total, total_weight(weight)), F.lit(0.0))


def share_at_least(x, threshold: float, weight=None) -> Column:
    """Share of rows with x >= threshold (confidence collapse)."""
    return weighted_mean(F.when(_c(x).isNotNull(), (_c(x) >= threshold).cast("double")), weight)


def conditional_gap(score, correct, cond: Column, weight=None) -> Column:
    """Gap restricted to rows where ``cond`` holds; NULL when none do."""
    return (weighted_mean(F.when(cond, _c(score)), weight)
            - weighted_mean(F.when(cond, _c(correct)), weight))


def hard_minus_easy(score, correct, difficulty, weight=None) -> Column:
    """gap(hard) - gap(easy); NULL when either tier is empty."""
    d = _c(difficulty)
    return (conditional_gap(score, correct, d == "hard", weight)
            - conditional_gap(score, correct, d == "easy", weight))


def drop_null_groups(agg, key_cols: list[str], count_col: str):
    """Drop groups whose key has a NULL, *after* an aggregation.

    The predicate also reads the aggregated count so that Catalyst cannot
    push it below the aggregate (a pushed key filter would re-evaluate the
    key expression, e.g. a parsed score, once more per input row).
    """
    any_null = None
    for k in key_cols:
        cond = F.col(k).isNull()
        any_null = cond if any_null is None else (any_null | cond)
    return agg.filter(F.col(count_col) > F.when(any_null, F.col(count_col)).otherwise(F.lit(0)))


def safe_corr(x, y) -> Column:
    """Pearson correlation over rows where both are present; NULL (not an
    ANSI division error) when either side is constant."""
    xc, yc = _c(x).cast("double"), _c(y).cast("double")
    both = xc.isNotNull() & yc.isNotNull()
    xs, ys = F.when(both, xc), F.when(both, yc)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))
