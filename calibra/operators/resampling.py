"""Bootstrap intervals of any metric, from cells or clusters (I4, I5, I8, metric API).

A ``Metric`` is a set of row-level contributions that are summed, and a
formula of the sums.  The same object is a Spark aggregate (``aggregate``,
batch or streaming), a weighted aggregate, and a bootstrap statistic: every
bootstrap here only ever weights and adds contributions, so a caller's own
metric needs no change to this module.

*Cells* (``bootstrap_cells_poisson``): rows with equal metric inputs form a
cell of n rows.  A Poisson bootstrap gives every row an independent
Poisson(1) weight, so a cell's total weight is Poisson(n): one draw a (cell,
replicate) instead of one a (row, replicate).  The draw is a built-in
expression: a hash of (cell, replicate) to a uniform number, and that through
the inverse distribution.

*Clusters* (``bootstrap_clusters``): all rows of a cluster share one
Poisson(1) weight, so a cluster is one vector of sums.  Weights are drawn for
blocks of clusters at once and applied as a matrix product; each task returns
partial sums a replicate.

*Rows* (``bootstrap_rows``): every row draws a Poisson(1) weight of its own in
every replicate, where it lies.

Draws depend on (seed, group, cell, cluster or row, replicate) alone: neither
partitioning nor row order changes them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibra.functions import metrics as M
from calibra.schemas import N_BINS
from calibra.session import ship_package

# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------


class Metric(NamedTuple):
    """A statistic of sums.

    inputs: the columns that ``sums`` reads; sums: name -> contribution of a
    row (null counts as nothing); finish: the value from the summed columns.
    A ``one_sided`` metric also gets the share of replicates at or below 0.
    """
    name: str
    inputs: tuple[str, ...]
    sums: Callable[[], dict[str, Column]]
    finish: Callable[[dict[str, Column]], Column]
    one_sided: bool = False


def aggregate(metric: Metric, weight: str | None = None) -> Column:
    """The metric as an aggregate expression, for ``groupBy().agg()``, batch or streaming."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return metric.finish({k: F.coalesce(F.sum(w * c.cast("double")), F.lit(0.0)) for k, c in metric.sums().items()}).alias(metric.name)


def _mean_sums(prefix: str, x: Column) -> dict[str, Column]:
    return {prefix: x.cast("double"), f"{prefix}_n": x.isNotNull().cast("double")}


def mean_of(name: str, column: str) -> Metric:
    return Metric(name, (column,), lambda: _mean_sums("x", F.col(column)), lambda s: F.try_divide(s["x"], s["x_n"]))


def accuracy(correct: str = "correct") -> Metric:
    return mean_of("accuracy", correct)


def gap(score: str = "confidence_norm", correct: str = "correct") -> Metric:
    return Metric("overconfidence_gap", (score, correct),
                  lambda: _mean_sums("s", F.col(score)) | _mean_sums("c", F.col(correct)),
                  lambda s: F.try_divide(s["s"], s["s_n"]) - F.try_divide(s["c"], s["c_n"]))


def ece(score: str = "confidence_norm", correct: str = "correct", n_bins: int = N_BINS) -> Metric:
    def sums() -> dict[str, Column]:
        s, c = F.col(score).cast("double"), F.col(correct).cast("double")
        b = M.bin_index(s, n_bins)
        return {f"b{i}": F.when(b == i, c - s) for i in range(n_bins)} | {"n": F.lit(1.0)}

    def finish(s: dict[str, Column]) -> Column:
        total = F.abs(s["b0"])
        for i in range(1, n_bins):
            total = total + F.abs(s[f"b{i}"])
        return F.coalesce(F.try_divide(total, s["n"]), F.lit(0.0))
    return Metric("ece", (score, correct), sums, finish)


def hard_minus_easy(score: str = "confidence_norm", correct: str = "correct", difficulty: str = "difficulty") -> Metric:
    def sums() -> dict[str, Column]:
        out = {}
        for tier in ("hard", "easy"):
            on = F.col(difficulty) == tier
            out |= _mean_sums(f"{tier}_s", F.when(on, F.col(score))) | _mean_sums(f"{tier}_c", F.when(on, F.col(correct)))
        return out

    def finish(s: dict[str, Column]) -> Column:
        mean = lambda k: F.try_divide(s[k], s[f"{k}_n"])
        return (mean("hard_s") - mean("hard_c")) - (mean("easy_s") - mean("easy_c"))
    return Metric("hard_minus_easy_gap", (score, correct, difficulty), sums, finish, one_sided=True)


def standard_metrics(score: str = "confidence_norm") -> list[Metric]:
    return [accuracy(), gap(score), ece(score), hard_minus_easy(score)]


def _contributions(metrics: list[Metric]) -> dict[str, Column]:
    """All metrics' contributions under names of their own; nothing for null."""
    return {f"_s{i}_{k}": F.coalesce(c.cast("double"), F.lit(0.0))
            for i, m in enumerate(metrics) for k, c in m.sums().items()}


# ---------------------------------------------------------------------------
# Draws: hash -> uniform -> Poisson
# ---------------------------------------------------------------------------

WORD = (1 << 32) - 1
STEP = 0x9E3779B1
# fixed values: multipliers of a published 32-bit finaliser
MIX = (0x85EBCA6B, 0xC2B2AE35)
# fixed values: coefficients of a published rational approximation of the normal quantile
Z_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
       1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
Z_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
       6.680131188771972e+01, -1.328068155288572e+01, 1.0)
Z_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
       -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
Z_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
Z_LOW = 0.02425
EXACT_BELOW = 10  # smaller means use the exact table


def poisson_cdf(mean: int) -> list[float]:
    """Distribution of Poisson(mean) at 0, 1, ... until it is 1 to within 32 bits."""
    p, out = math.exp(-mean), []
    total, k = 0.0, 0
    while total < 1 - 2.0 ** -34:
        total += p
        out.append(total)
        k += 1
        p *= mean / k
    return out


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]:.16e}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c:.16e})"
    return out


def normal_quantile_sql(u: str) -> str:
    """Normal quantile of column ``u`` as SQL (both tails and the middle)."""
    low, high = f"sqrt(-2e0 * ln({u}))", f"sqrt(-2e0 * ln(1e0 - {u}))"
    mid = f"(({u} - 5e-1) * ({u} - 5e-1))"
    return (f"CASE WHEN {u} < {Z_LOW:e} THEN {_horner(Z_C, low)} / {_horner(Z_D, low)} "
            f"WHEN {u} > 1e0 - {Z_LOW:e} THEN -({_horner(Z_C, high)}) / {_horner(Z_D, high)} "
            f"ELSE ({u} - 5e-1) * {_horner(Z_A, mid)} / {_horner(Z_B, mid)} END")


def poisson_quantile_sql(n: str, z: str) -> str:
    """Inverse Poisson distribution at a normal quantile, by its published expansion to order 1/n."""
    return (f"greatest(0e0, floor({n} + sqrt({n}) * {z} + (1e0 / 3e0 + {z} * {z} / 6e0) "
            f"- ({z} / 36e0 + {z} * {z} * {z} / 72e0) / sqrt({n}) "
            f"+ (-8e0 / 405e0 + 7e0 * {z} * {z} / 810e0 + {z} * {z} * {z} * {z} / 270e0) / {n}))")


def _times(x: Column, by: int) -> Column:
    """x * by modulo 2**32 without a 64-bit overflow."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (low * by + F.shiftleft((high * by).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))


def _mixed(df: DataFrame, x: str) -> DataFrame:
    """Column ``x`` through the 32-bit finaliser; a column a step, so that none is evaluated twice."""
    for shift, by in ((16, MIX[0]), (13, MIX[1]), (16, None)):
        df = df.withColumn(x, F.col(x).bitwiseXOR(F.shiftright(x, shift)))
        if by:
            df = df.withColumn(x, _times(F.col(x), by))
    return df


def _key_words(seed: int, parts: list[Column]) -> dict[str, Column]:
    """64 bits of the md5 of the seed and the parts, as two words."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return {f"_h{i}": F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in (0, 1)}


def _part(df: DataFrame, name: str) -> Column:
    """A column as text that is the same everywhere: numbers in millionths, null as ~."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        number = F.col(name).cast("int" if isinstance(kind, T.BooleanType) else kind).cast("double")
        text = F.round(number * 1e6).cast("bigint").cast("string")
    else:
        text = F.col(name).cast("string")
    return F.coalesce(text, F.lit("~"))


def _with_uniform(df: DataFrame) -> DataFrame:
    """_u in (0, 1) from _h0, _h1 and replicate."""
    df = _mixed(df.withColumn("_x", F.col("_h0").bitwiseXOR(_times(F.col("replicate"), STEP))), "_x")
    df = _mixed(df.withColumn("_x", F.col("_x").bitwiseXOR(F.col("_h1"))), "_x")
    return df.withColumn("_u", (F.col("_x") + 0.5) / float(1 << 32))


def _with_poisson(df: DataFrame, n: str) -> DataFrame:
    """_w: Poisson(n) from _u."""
    tables = F.array(*[F.array(*[F.lit(x) for x in poisson_cdf(k)]) for k in range(1, EXACT_BELOW)])
    small = F.size(F.filter(F.element_at(tables, F.least(F.col(n), F.lit(EXACT_BELOW - 1)).cast("int")), lambda t: t <= F.col("_u")))
    df = df.withColumn("_n", F.col(n).cast("double")).withColumn("_z", F.expr(normal_quantile_sql("_u")))
    return df.withColumn("_w", F.when(F.col(n) < EXACT_BELOW, small.cast("double")).otherwise(F.expr(poisson_quantile_sql("_n", "_z"))))


def _words(h0: np.ndarray, h1: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The mixed 32 bits in numpy, one row a key and one column a replicate."""
    def mix(x: np.ndarray) -> np.ndarray:
        for shift, by in ((16, MIX[0]), (13, MIX[1]), (16, None)):
            x ^= x >> np.uint32(shift)
            if by:
                x *= np.uint32(by)
        return x
    r = replicates.astype(np.uint32) * np.uint32(STEP)
    x = mix(h0.astype(np.uint32)[:, None] ^ r[None, :])
    x ^= h1.astype(np.uint32)[:, None]
    return mix(x)


def uniforms(h0: np.ndarray, h1: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The same numbers in numpy, one row a key and one column a replicate."""
    return (_words(h0, h1, replicates) + 0.5) / float(1 << 32)


def poisson1_weights(h0: np.ndarray, h1: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) of ``uniforms``, told from the 32 bits alone: u reaches a threshold where they reach its first word."""
    x = _words(h0, h1, replicates)
    out = np.zeros(x.shape, np.uint8)
    for first in (math.ceil(t * (1 << 32) - 0.5) for t in poisson_cdf(1)):
        if first <= WORD:
            out += x >= np.uint32(first)
    return out


# ---------------------------------------------------------------------------
# Replicates
# ---------------------------------------------------------------------------

POINT = -1  # the replicate in which every row counts once


def _finished(sums: DataFrame, metrics: list[Metric], keys: list[str], level: float) -> DataFrame:
    """keys, metric, point, ci_lo, ci_hi, p_le_0 from the sums of every replicate."""
    alpha = (1.0 - level) / 2.0
    values = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.lit(m.one_sided).alias("one_sided"),
                                m.finish({k: F.col(f"_s{i}_{k}") for k in m.sums()}).cast("double").alias("value"))
                       for i, m in enumerate(metrics)])
    long = sums.select(*keys, "replicate", F.explode(values).alias("v")).select(*keys, "replicate", "v.*")
    drawn = F.when(F.col("replicate") != POINT, F.col("value"))
    below = F.when(F.col("one_sided") & (F.col("replicate") != POINT), F.coalesce((F.col("value") <= 0).cast("double"), F.lit(0.0)))
    return long.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col("replicate") == POINT, F.col("value"))).alias("point"),
        F.percentile(drawn, F.lit(alpha)).alias("ci_lo"), F.percentile(drawn, F.lit(1.0 - alpha)).alias("ci_hi"),
        F.avg(below).alias("p_le_0"))


def _cells(rows: DataFrame, metrics: list[Metric], keys: list[str], seed: int, more: tuple[str, ...] = ()) -> DataFrame:
    """keys, more, _cell_n, the hash words and the contributions of the rows with equal inputs."""
    inputs = sorted({c for m in metrics for c in m.inputs} - set(keys))
    cells = rows.groupBy(*keys, *more, *inputs).agg(F.count(F.lit(1)).alias("_cell_n"))
    return cells.withColumns(_key_words(seed, [_part(cells, c) for c in [*keys, *more, *inputs]])) \
        .select(*keys, *more, "_cell_n", "_h0", "_h1", *[c.alias(k) for k, c in _contributions(metrics).items()])


def bootstrap_cells_poisson(rows: DataFrame, metrics: list[Metric], keys=("model_id",), *, n_boot: int = 2000,
                            level: float = 0.95, seed: int = 42, block: int = 50) -> DataFrame:
    """Percentile intervals by a Poisson bootstrap of the rows; cost is cells x replicates.

    The number of cells follows the distinct values of the metrics' inputs,
    not the rows (integer confidences: at most 606 a model).  Replicates are
    dealt to tasks in blocks, so the cells' few rows do not meet in one task.
    A group without rows has no result; replicates whose metric is undefined
    (no weight drawn) are left out of the interval.
    """
    keys = list(keys)
    cells = _cells(rows, metrics, keys, seed)
    blocks = -(-n_boot // block)
    dealt = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "_block")
    first = F.when(F.col("_block") == 0, F.lit(POINT)).otherwise(F.col("_block") * block)
    last = F.least((F.col("_block") + 1) * block, F.lit(n_boot)) - 1
    reps = dealt.withColumn("_r", F.explode(F.sequence(first, last).cast("array<bigint>"))) \
        .withColumn("replicate", F.greatest("_r", F.lit(0).cast("bigint")))
    drawn = _with_poisson(_with_uniform(reps), "_cell_n")
    w = F.when(F.col("_r") == POINT, F.col("_cell_n")).otherwise(F.col("_w"))
    sums = drawn.withColumn("_w", w).withColumn("replicate", F.col("_r")).groupBy(*keys, "replicate") \
        .agg(*[F.sum(F.col("_w") * F.col(k)).alias(k) for k in _contributions(metrics)])
    return _finished(sums, metrics, keys, level)


def bootstrap_cells_multinomial(rows: DataFrame, metrics: list[Metric], keys=("model_id",), *, n_boot: int = 2000,
                                level: float = 0.95, seed: int = 42, block: int = 100) -> DataFrame:
    """Percentile intervals by resampling N of the N rows, drawn as multinomial(N, cell shares).

    A block of replicates of a group is one task's draw over the group's
    cells, so this form is for inputs with few distinct values (integer
    confidences: at most 606 cells a model); ``bootstrap_subsets`` is for
    continuous ones.
    """
    ship_package(rows.sparkSession)
    keys = list(keys)
    names = list(_contributions(metrics))
    cells = _cells(rows, metrics, keys, seed)
    blocks = -(-n_boot // block)
    dealt = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("replicate", T.LongType()),
                           *[T.StructField(k, T.DoubleType()) for k in names]])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        # cells arrive in any order: fix it before drawing
        part = part.sort_values(["_h0", "_h1"], kind="mergesort")
        at = int(part["_block"].iloc[0])
        n = part["_cell_n"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, at, zlib.crc32("|".join(str(part[k].iloc[0]) for k in keys).encode())])
        draws = rng.multinomial(int(n.sum()), n / n.sum(), size=min(block, n_boot - at * block)).astype(np.float64)
        replicates = at * block + np.arange(len(draws))
        if at == 0:  # and the rows as they are
            draws, replicates = np.vstack([n.astype(np.float64), draws]), np.append(POINT, replicates)
        out = pd.DataFrame(draws @ part[names].to_numpy(np.float64), columns=names)
        out.insert(0, "replicate", replicates)
        for i, k in enumerate(keys):
            out.insert(i, k, part[k].iloc[0])
        return out

    return _finished(dealt.groupBy(*keys, "_block").applyInPandas(run, schema), metrics, keys, level)


def bootstrap_subsets(rows: DataFrame, metrics: list[Metric], keys=("model_id",), *, subsets: int = 20, n_boot: int = 100,
                      level: float = 0.95, seed: int = 42) -> DataFrame:
    """Bag of little bootstraps: intervals for inputs with any number of distinct values.

    The cells of equal inputs are dealt by their hash into ``subsets`` disjoint subsets;
    in each, replicates weight a cell of n rows by Poisson(n * subsets), so
    that a subset stands for all rows; a group's interval is the mean of its
    subsets' intervals.  No task holds a group's cells: they stay where they
    are, and each returns partial sums a (subset, replicate).  The point is
    that of all rows.  The interval's own error falls with the size of a
    subset; use ``bootstrap_cells_poisson`` where cells are few.
    """
    keys = list(keys)
    cells = _cells(rows, metrics, keys, seed).withColumn("_subset", F.pmod(F.col("_h0").bitwiseXOR(F.col("_h1")), F.lit(subsets)).cast("int"))
    names = list(_contributions(metrics))
    reps = cells.withColumn("_up", F.col("_cell_n") * subsets) \
        .withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)).cast("array<bigint>")))
    drawn = _with_poisson(_with_uniform(reps), "_up")
    sums = drawn.groupBy(*keys, "_subset", "replicate").agg(*[F.sum(F.col("_w") * F.col(k)).alias(k) for k in names])
    each = _finished(sums, metrics, [*keys, "_subset"], level)
    inside = each.groupBy(*keys, "metric").agg(*[F.avg(c).alias(c) for c in ("ci_lo", "ci_hi", "p_le_0")])
    points = rows.groupBy(*keys).agg(*[aggregate(m) for m in metrics])
    long = points.select(*keys, F.explode(F.array(*[F.struct(F.lit(m.name).alias("metric"), F.col(m.name).cast("double").alias("point"))
                                                    for m in metrics])).alias("p")).select(*keys, "p.*")
    return long.join(inside, [*keys, "metric"], "left")


def bootstrap_clusters(rows: DataFrame, metrics: list[Metric], cluster: str, keys=("model_id",), *, n_boot: int = 2000,
                       level: float = 0.95, seed: int = 42, block: int = 512) -> DataFrame:
    """Percentile intervals by a Poisson bootstrap of whole clusters; cost is clusters x replicates.

    Rows are first summed to one vector a cluster (merged map-side, so a
    cluster with a third of all rows is one vector like any other).  A task
    holds the partial sums of 64 groups at most, then hands them on.  A null
    cluster is one cluster.
    """
    ship_package(rows.sparkSession)
    keys = list(keys)
    names = list(_contributions(metrics))
    vectors = rows.groupBy(*keys, cluster).agg(*[F.sum(c).alias(k) for k, c in _contributions(metrics).items()])
    vectors = vectors.withColumns(_key_words(seed, [_part(vectors, c) for c in [*keys, cluster]])).select(*keys, "_h0", "_h1", *names)
    return _finished(_replicate_sums(vectors, keys, names, n_boot, block), metrics, keys, level)


def bootstrap_rows(rows: DataFrame, metrics: list[Metric], row: tuple[str, ...], keys=("model_id",), *, n_boot: int = 2000,
                   level: float = 0.95, seed: int = 42, block: int = 32) -> DataFrame:
    """Percentile intervals by a Poisson bootstrap of single rows; cost is rows x replicates.

    ``row`` names the columns that tell a row of a group from the others
    (rows that agree in them share their weights).  Every row draws a weight
    for every replicate where it lies; a task holds the partial sums of 64
    groups at most, then hands them on.
    """
    ship_package(rows.sparkSession)
    keys = list(keys)
    contributions = _contributions(metrics)
    vectors = rows.withColumns(_key_words(seed, [_part(rows, c) for c in [*keys, *row]])) \
        .select(*keys, "_h0", "_h1", *[c.alias(k) for k, c in contributions.items()])
    return _finished(_replicate_sums(vectors, keys, list(contributions), n_boot, block), metrics, keys, level)


def _replicate_sums(vectors: DataFrame, keys: list[str], names: list[str], n_boot: int, block: int) -> DataFrame:
    """keys, replicate and the sums of ``names`` under the Poisson(1) weights of every vector (_h0, _h1)."""
    schema = T.StructType([*[vectors.schema[k] for k in keys], T.StructField("replicate", T.LongType()),
                           *[T.StructField(k, T.DoubleType()) for k in names]])
    replicates = np.arange(n_boot)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for group, sums in held.items():
                part = pd.DataFrame(sums, columns=names)
                part.insert(0, "replicate", np.arange(POINT, n_boot))
                for i, (k, v) in enumerate(zip(keys, group)):
                    part.insert(i, k, pd.Series([v] * len(part), dtype=object))
                yield part
            held.clear()

        for frame in frames:
            frame = frame.astype({k: object for k in keys})
            for group, part in frame.groupby(keys, dropna=False, sort=False):
                group = tuple(None if v is None or v != v else v for v in group)
                total = held.setdefault(group, np.zeros((n_boot + 1, len(names))))
                for at in range(0, len(part), block):
                    some = part.iloc[at:at + block]
                    s = some[names].to_numpy(np.float64)
                    w = poisson1_weights(some["_h0"].to_numpy(), some["_h1"].to_numpy(), replicates)
                    total[0] += s.sum(axis=0)
                    total[1:] += w.astype(np.float64).T @ s
                if len(held) >= 64:
                    yield from out()
        yield from out()

    return vectors.mapInPandas(run, schema).groupBy(*keys, "replicate").agg(*[F.sum(k).alias(k) for k in names])
