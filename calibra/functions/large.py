"""Tails of Student's t and chi-square for many degrees of freedom.

From ``LEAST_DF`` on the continued fractions of ``stats`` need ever more
steps and lose digits in x = df / (df + t^2).  Here the tails come from
expansions in inverse powers of the degrees of freedom that hold over the
whole range:

- the incomplete beta I_x(a, 1/2) for large a, as a sum of incomplete gammas
  in u = -(a - 1/4) ln x (DiDonato and Morris);
- the incomplete gamma Q(s, x) for large s, as an error function of the
  signed square root eta of 2 (x/s - 1 - ln(x/s)), and a correction in powers
  of eta and 1/s (Temme).  The correction's coefficients follow from a
  recurrence and are worked out at import.

Both rest on erfc(sqrt(u)) = Q(1/2, u).  All forms are SQL text of built-in
functions; a caller gives column names or expressions.
"""

from __future__ import annotations

import math
from fractions import Fraction

LEAST_DF = 1e4
_STEPS = 200
_ETA_POWERS = 24
_S_POWERS = 4
_LOG_TERMS = 16  # of mu - ln(1 + mu) where |mu| < _NEAR
_NEAR = 0.1


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _horner(coefficients: list[float], x: str) -> str:
    out = _d(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({_d(c)} + {x} * {out})"
    return out


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def erfc_sqrt_sql(u: str) -> str:
    """erfc(sqrt(u)) for u >= 0: a series below 1.5, a continued fraction above."""
    def body(v: str) -> str:
        term = f"es.term * {v} / (CAST(ek AS DOUBLE) + 0.5D)"
        series = (f"aggregate(sequence(1, 60), named_struct('term', 2D, 'total', 2D), "
                  f"(es, ek) -> named_struct('term', {term}, 'total', es.total + {term}), es -> es.total)")
        # the fraction is even: step k adds -k (k - 1/2) over b_k = v + 2k + 1/2
        an = "(-CAST(ck AS DOUBLE) * (CAST(ck AS DOUBLE) - 0.5D))"
        bn = f"({v} + 2D * CAST(ck AS DOUBLE) + 0.5D)"
        dn, cn = f"(1D / ({an} * ec.d + {bn}))", f"({bn} + {an} / ec.c)"
        fraction = (f"aggregate(sequence(1, {_STEPS}), named_struct('c', 1e300D, 'd', 1D / ({v} + 0.5D), 'h', 1D / ({v} + 0.5D)), "
                    f"(ec, ck) -> named_struct('c', {cn}, 'd', {dn}, 'h', ec.h * {cn} * {dn}), ec -> ec.h)")
        front = f"exp(-{v}) * sqrt({v}) / {_d(math.sqrt(math.pi))}"
        return f"(CASE WHEN {v} <= 0D THEN 1D WHEN {v} < 1.5D THEN 1D - {front} * {series} ELSE {front} * {fraction} END)"
    return _let("ev", u, body("ev"))


def log_gamma_ratio_sql(df: str) -> str:
    """ln of Gamma(df/2 + 1/2) / Gamma(df/2)."""
    nu = f"({df} / 2D - 0.25D)"
    return f"(ln({nu}) / 2D + log1p(1D / (64D * {nu} * {nu})))"


def t_tail_sql(t: str, df: str) -> str:
    """P(|T| >= |t|)."""
    # fixed values: the expansion's p_1 and p_2 for b = 1/2
    p1, p2 = -1 / 12, 0.00625
    nu = f"({df} / 2D - 0.25D)"
    ln_x = f"log1p({t} * {t} / {df})"
    u = "tz.u"
    h = f"(exp(-{u}) * sqrt({u}) / {_d(math.sqrt(math.pi))})"
    j1 = f"((0.75D * tz.q + ({u} + 1.5D) * {h}) / (4D * {nu} * {nu}))"
    j2 = f"((8.75D * {j1} + ({u} + 3.5D) * tz.l * tz.l / 4D * {h}) / (4D * {nu} * {nu}))"
    scale = f"(1D + 1D / (64D * {nu} * {nu}))"
    tail = f"{scale} * (tz.q + {_d(p1)} * {j1} + {_d(p2)} * {j2})"
    # far out, where nothing is left of exp(-u), the tail is 0
    values = _let("tl", ln_x, f"named_struct('l', tl, 'u', least({nu} * tl, 800D), 'q', {erfc_sqrt_sql(f'least({nu} * tl, 800D)')})")
    return _let("tz", values, f"(CASE WHEN {u} <= 0D THEN 1D WHEN {u} >= 800D THEN 0D ELSE least(1D, {tail}) END)")


def _correction() -> list[list[float]]:
    """c[k][m]: coefficients of eta^m / s^k."""
    n = _ETA_POWERS + 2 * _S_POWERS + 3
    alpha = [Fraction(0), Fraction(1)]  # x/s - 1 in powers of eta
    for k in range(2, n + 1):
        inner = sum((j * alpha[j] * alpha[k - j + 1] for j in range(2, k)), Fraction(0))
        alpha.append((alpha[k - 1] - inner) / (k + 1))
    base = [Fraction(-1, 3)] + [(m + 2) * alpha[m + 2] for m in range(1, n - 2)]
    # Stirling's series from the same expansion: 1 * 3 * ... * (2k + 1) * alpha_(2k+1)
    gamma, odd = [], 1
    for k in range(_S_POWERS):
        odd *= 2 * k + 1
        gamma.append(odd * alpha[2 * k + 1])
    rows = [base]
    for k in range(1, _S_POWERS):
        last = rows[-1]
        rows.append([(-1) ** k * gamma[k] * base[m] + (m + 2) * last[m + 2] for m in range(len(last) - 2)])
    return [[float(c) for c in r[:_ETA_POWERS]] for r in rows]


CORRECTION = _correction()


def gamma_tail_sql(s: str, x: str) -> str:
    """Q(s, x), for s of ``LEAST_DF`` / 2 or more."""
    near = f"(gm * gm * {_horner([(-1) ** k / (k + 2) for k in range(_LOG_TERMS)], 'gm')})"
    half_square = f"(CASE WHEN abs(gm) < {_d(_NEAR)} THEN {near} WHEN gm <= -1D THEN 4D ELSE least(gm - log1p(gm), 4D) END)"
    eta = "(signum(ge.m) * sqrt(2D * ge.e))"
    powers = [_horner(c, "gn") for c in CORRECTION]
    sums = powers[-1]
    for p in reversed(powers[:-1]):
        sums = f"({p} + {sums} / {s})"
    correction = f"(exp(-{s} * ge.e) / sqrt({_d(2 * math.pi)} * {s}) * {_let('gn', eta, sums)})"
    half = f"({erfc_sqrt_sql(f'{s} * ge.e')} / 2D)"
    upper = f"(CASE WHEN ge.m >= 0D THEN {half} ELSE 1D - {half} END + {correction})"
    values = _let("gm", f"(({x} - {s}) / {s})", f"named_struct('m', gm, 'e', {half_square})")
    return _let("ge", values, f"greatest(0D, least(1D, {upper}))")
