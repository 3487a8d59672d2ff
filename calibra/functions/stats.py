"""Distribution tails for tests on aggregated rows.

SciPy is not available, so the Student-t and chi-square tails come from the
regularised incomplete beta / gamma functions (continued fractions, as in
standard numerical references).  The ``*_col`` functions build the same
computation from built-in expressions (``aggregate`` over a fixed sequence),
so p-values run in the JVM on the aggregated rows, with no Python worker.
The plain-Python versions are the reference the tests compare against.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from calibra.functions import large

_EPS = 1e-300
_TOL = 1e-16


def _betacf(a: float, b: float, x: float, max_iter: int = 500) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _EPS if abs(d) < _EPS else d
    d = 1.0 / d
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _EPS if abs(d) < _EPS else d
        c = 1.0 + aa / c
        c = _EPS if abs(c) < _EPS else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _EPS if abs(d) < _EPS else d
        c = 1.0 + aa / c
        c = _EPS if abs(c) < _EPS else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _TOL:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or not np.isfinite(t) or df <= 0 or np.isnan(df):
        if t is not None and df is not None and df > 0 and np.isinf(t):
            return 0.0
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(q: float, df: float) -> float:
    """Inverse CDF of Student's t (q in (0, 1)) by bisection on the tail."""
    if df is None or df <= 0 or np.isnan(df):
        return float("nan")
    if q == 0.5:
        return 0.0
    upper = q > 0.5
    tail = 2.0 * (1.0 - q) if upper else 2.0 * q  # two-sided tail mass
    lo, hi = 0.0, 1.0
    while t_two_sided_p(hi, df) > tail:
        hi *= 2.0
        if hi > 1e12:
            break
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_two_sided_p(mid, df) > tail:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(1.0, hi):
            break
    t = 0.5 * (lo + hi)
    return t if upper else -t


def _gammainc_q(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if x <= 0:
        return 1.0
    if x < s + 1.0:
        term = 1.0 / s
        total = term
        ap = s
        for _ in range(1000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _TOL:
                break
        return 1.0 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    b = x + 1.0 - s
    c = 1.0 / _EPS
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = _EPS if abs(d) < _EPS else d
        c = b + an / c
        c = _EPS if abs(c) < _EPS else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _TOL:
            break
    return math.exp(-x + s * math.log(x) - math.lgamma(s)) * h


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution (dof = 2 is exp(-x/2))."""
    if x is None or dof is None or np.isnan(x) or dof <= 0:
        return float("nan")
    return _gammainc_q(dof / 2.0, x / 2.0)


# ---------------------------------------------------------------------------
# The same tails as built-in SQL expressions (JVM side, no Python worker).
# Lanczos log-gamma and the continued fractions of the incomplete beta /
# gamma run as ``aggregate`` over a fixed sequence.  The expression is built
# as SQL text and handed to the JVM in one ``expr`` call (building it from
# Column objects would cost thousands of driver round trips).  Arguments are
# column names; meant for aggregated rows.
# ---------------------------------------------------------------------------

# Lanczos approximation, g = 7, nine coefficients.
LANCZOS_G = 7
LANCZOS_COEF = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
    1.5056327351493116e-7,
]
_CF_STEPS = 200        # half-steps of the beta continued fraction (100 full terms)
_GAMMA_ITERS = 300
_NEWTON_ITERS = 8


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _g(v: str) -> str:
    return f"(CASE WHEN abs({v}) < {_d(_EPS)} THEN {_d(_EPS)} ELSE {v} END)"


def lgamma_sql(z: str) -> str:
    """log Gamma(z) for z >= 0.5 (Lanczos)."""
    zz = f"(({z}) - 1D)"
    series = " + ".join([_d(LANCZOS_COEF[0])] + [f"{_d(c)} / ({zz} + {i}D)"
                                                 for i, c in enumerate(LANCZOS_COEF[1:], start=1)])
    t = f"({zz} + {_d(LANCZOS_G + 0.5)})"
    return f"({_d(0.5 * math.log(2 * math.pi))} + ({zz} + 0.5D) * ln({t}) - {t} + ln({series}))"


def _betacf_sql(a: str, b: str, x: str) -> str:
    qab, qap, qam = f"({a} + {b})", f"({a} + 1D)", f"({a} - 1D)"
    d0 = f"(1D / {_g(f'1D - {qab} * {x} / {qap}')})"
    m = "CAST((cf_k + 1) DIV 2 AS DOUBLE)"
    aa = (f"(CASE WHEN cf_k % 2 = 1 THEN {m} * ({b} - {m}) * {x} / (({qam} + 2D * {m}) * ({a} + 2D * {m})) "
          f"ELSE -({a} + {m}) * ({qab} + {m}) * {x} / (({a} + 2D * {m}) * ({qap} + 2D * {m})) END)")
    dn = f"(1D / {_g(f'1D + {aa} * cf.d')})"
    cn = _g(f"1D + {aa} / cf.c")
    # h is carried one factor behind (h_k = h * d * c of the state), so each
    # step's coefficient appears only twice in the lambda body
    return (f"aggregate(sequence(1, {_CF_STEPS}), named_struct('c', 1D, 'd', {d0}, 'h', 1D), "
            f"(cf, cf_k) -> named_struct('c', {cn}, 'd', {dn}, 'h', cf.h * cf.d * cf.c), "
            f"cf -> cf.h * cf.d * cf.c)")


def betainc_sql(a: str, b: str, x: str, log_beta: str | None = None) -> str:
    """Regularised incomplete beta I_x(a, b) as SQL text.

    ``log_beta`` may name a column holding lgamma(a+b) - lgamma(a) - lgamma(b)
    computed beforehand (keeps lambda bodies small and fast to analyse).
    """
    a, b, x = f"({a})", f"({b})", f"({x})"
    lb = log_beta or f"({lgamma_sql(f'{a} + {b}')} - {lgamma_sql(a)} - {lgamma_sql(b)})"
    front = f"exp({lb} + {a} * ln({x}) + {b} * log1p(-{x}))"
    return (f"(CASE WHEN {x} <= 0D THEN 0D WHEN {x} >= 1D THEN 1D "
            f"WHEN {x} < ({a} + 1D) / ({a} + {b} + 2D) THEN {front} * {_betacf_sql(a, b, x)} / {a} "
            f"ELSE 1D - {front} * {_betacf_sql(b, a, f'(1D - {x})')} / {b} END)")


def _many(df: str) -> str:
    return f"{df} >= {_d(large.LEAST_DF)}"


def t_log_beta_sql(df: str) -> str:
    """lgamma(df/2 + 1/2) - lgamma(df/2) - lgamma(1/2) for a df column."""
    d = f"CAST(`{df}` AS DOUBLE)"
    few = f"({lgamma_sql(f'{d} / 2D + 0.5D')} - {lgamma_sql(f'{d} / 2D')})"
    return f"((CASE WHEN {_many(d)} THEN {large.log_gamma_ratio_sql(d)} ELSE {few} END) - {_d(math.lgamma(0.5))})"


def t_p_value_sql(t: str, df: str, log_beta: str | None = None) -> str:
    """Two-sided Student-t p-value; NULL for NULL/NaN t or non-positive df."""
    t, d = f"CAST(`{t}` AS DOUBLE)", f"CAST(`{df}` AS DOUBLE)"
    lb = f"`{log_beta}`" if log_beta else None
    return (f"(CASE WHEN {t} IS NULL OR {d} IS NULL OR {d} <= 0D OR isnan({t}) THEN NULL "
            f"WHEN abs({t}) = CAST('Infinity' AS DOUBLE) THEN 0D "
            f"WHEN {_many(d)} THEN {large.t_tail_sql(t, d)} "
            f"ELSE {betainc_sql(f'{d} / 2D', '0.5D', f'{d} / ({d} + {t} * {t})', lb)} END)")


def t_quantile_sql(q: float, df: str, log_beta: str) -> str:
    """Student-t quantile (q > 0.5): Newton steps on the two-sided tail from a
    series start (normal quantile with 1/df and 1/df^2 terms).  ``log_beta``
    names the column of ``t_log_beta_sql(df)``."""
    d = f"CAST(`{df}` AS DOUBLE)"
    lb = f"`{log_beta}`"
    z = _normal_quantile(q)
    start = f"({_d(z)} + {_d(z ** 3 + z)} / (4D * {d}) + {_d(5 * z ** 5 + 16 * z ** 3 + 3 * z)} / (96D * {d} * {d}))"
    # t density: exp(log_beta - ln(df)/2 - (df+1)/2 log1p(t^2/df)) (log_beta includes -lgamma(1/2))
    few = betainc_sql(f"{d} / 2D", "0.5D", f"{d} / ({d} + nt * nt)", lb)
    p2 = f"(CASE WHEN {_many(d)} THEN {large.t_tail_sql('nt', d)} ELSE {few} END)"
    dens = f"exp({lb} - ln({d}) / 2D - ({d} + 1D) / 2D * log1p(nt * nt / {d}))"
    step = f"greatest(nt + ({p2} - {_d(2.0 * (1.0 - q))}) / (2D * {dens}), nt / 4D)"
    return (f"(CASE WHEN {d} > 0D THEN aggregate(sequence(1, {_NEWTON_ITERS}), {start}, "
            f"(nt, n_i) -> {step}) END)")


def with_t_tests(df, t: str, dof: str, p_out: str | None = None, q: float | None = None,
                 q_out: str | None = None):
    """Add a two-sided t p-value and/or a t quantile for the rows of a (small,
    aggregated) table; the log-beta term is computed once in its own column."""
    out = df.withColumn("_tlb", F.expr(t_log_beta_sql(dof)))
    if q_out:
        out = out.withColumn(q_out, F.expr(t_quantile_sql(q, dof, "_tlb")))
    if p_out:
        out = out.withColumn(p_out, F.expr(t_p_value_sql(t, dof, "_tlb")))
    return out.drop("_tlb")


def chi2_sf_sql(x: str, dof: str) -> str:
    """Chi-square upper tail Q(dof/2, x/2): series below s+1, continued fraction above."""
    s, y = f"(CAST(`{dof}` AS DOUBLE) / 2D)", f"(CAST(`{x}` AS DOUBLE) / 2D)"
    front = f"exp(-{y} + {s} * ln(greatest({y}, {_d(1e-300)})) - {lgamma_sql(s)})"
    series = (f"aggregate(sequence(1, {_GAMMA_ITERS}), named_struct('ap', {s}, 'term', 1D / {s}, 'total', 1D / {s}), "
              f"(gs, gi) -> named_struct('ap', gs.ap + 1D, 'term', gs.term * {y} / (gs.ap + 1D), "
              f"'total', gs.total + gs.term * {y} / (gs.ap + 1D))).total")
    an = f"(-CAST(gk AS DOUBLE) * (CAST(gk AS DOUBLE) - {s}))"
    bn = "(gc.b + 2D)"
    dn = f"(1D / {_g(f'{an} * gc.d + {bn}')})"
    cn = _g(f"{bn} + {an} / gc.c")
    b0 = f"({y} + 1D - {s})"
    cf = (f"aggregate(sequence(1, {_GAMMA_ITERS}), named_struct('b', {b0}, 'c', {_d(1.0 / _EPS)}, "
          f"'d', 1D / {b0}, 'h', {_d(_EPS)}), (gc, gk) -> named_struct('b', {bn}, 'c', {cn}, 'd', {dn}, "
          f"'h', gc.h * gc.d * gc.c), gc -> gc.h * gc.d * gc.c)")
    xv = f"CAST(`{x}` AS DOUBLE)"
    return (f"(CASE WHEN {xv} IS NULL OR isnan({xv}) OR `{dof}` IS NULL OR `{dof}` <= 0 THEN NULL "
            f"WHEN {y} <= 0D THEN 1D WHEN {_many(f'CAST(`{dof}` AS DOUBLE)')} THEN {large.gamma_tail_sql(s, y)} "
            f"WHEN {y} < {s} + 1D THEN 1D - {series} * {front} "
            f"ELSE {front} * {cf} END)")


def t_p_value_col(t: str, df: str):
    return F.expr(t_p_value_sql(t, df))


def chi2_sf_col(x: str, dof: str):
    return F.expr(chi2_sf_sql(x, dof))


def _normal_quantile(q: float) -> float:
    """Standard normal quantile (a driver-side constant, bisection on erfc)."""
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(mid / math.sqrt(2)) > 1 - q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
