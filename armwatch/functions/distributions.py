"""Beta and Student-t quantile columns.

Spark has no inverse incomplete beta. ``beta_quantile`` and ``t_quantile`` are column expressions:
a bracketed Halley iteration folded over a fixed sequence, so they run in the JVM beside the
aggregate that feeds them. The numbers passed in are aggregates (a row per stratum, period or
sample size). The shortest interval (``beta_hdi``) solves for two quantiles at once and stays with
a few numpy lines per Arrow batch. A search that doesn't meet its stop test gives null, never its
last iterate.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers inside the UDF, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)
#: Both parameters above this: the tail is integrated, below it is a continued fraction.
PEAKED = 3000
#: Most terms of the fraction and most steps of a column; both end by their stop tests.
TERMS, STEPS = 400, 200


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x.ravel()), float, x.size).reshape(x.shape)


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log(n!) minus Stirling's formula; the series keeps precision where log-gamma is huge."""
    small = np.minimum(n, 16.0)
    direct = _log_gamma(small + 1) - (small + .5) * np.log(small) + small - _LOG_SQRT_2PI
    m = np.maximum(n, 16.0)
    m2 = m * m
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m2) / m2) / m2) / m2) / m
    return np.where(n < 16, direct, series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x/mean) + mean - x without cancellation near x = mean."""
    d = (x - mean) / mean
    near = np.abs(d) < 0.05
    s = np.where(near, d, 0.0)
    # x log1p(d) - mean d with x = mean (1 + d): series of (1 + d) log1p(d) - d
    series, power = np.zeros_like(s), s * s
    for k in range(2, 16):
        series += (-1) ** k * power / (k * (k - 1))
        power = power * s
    plain = x * np.log(np.where(near, 1.0, x / mean)) + mean - x
    return np.where(near, mean * series, plain)


def _log_front(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of x^a (1-x)^b / B(a, b), by saddle-point terms."""
    n = a + b
    log_mass = (_stirling_error(n) - _stirling_error(a) - _stirling_error(b)
                - _deviance(a, n * x) - _deviance(b, n * (1 - x))
                + .5 * np.log(n / (2 * math.pi * a * b)))
    return log_mass + np.log(a * b / n)


def _tail_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for x below the mean."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    settled = np.zeros(x.shape, bool)
    for m in range(1, int(200 + 20 * math.sqrt(float(np.max(a + b))))):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        settled = np.abs(c * d - 1) < 2e-15
        if np.all(settled):
            break
    return np.where(settled, h, np.nan)


def _tail_integral(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower tail by quadrature of the density, for narrow peaks (both parameters large)."""
    n = a + b
    sd = np.sqrt(a * b / (n * n * (n + 1)))
    start = np.maximum(0.0, np.minimum(a / n - 12 * sd, x - 6 * sd))
    nodes, weights = np.polynomial.legendre.leggauss(80)
    t = start[:, None] + (x - start)[:, None] * (nodes + 1) / 2
    t = np.maximum(t, 1e-300)
    density = np.exp(_log_front(t, a[:, None], b[:, None])) / (t * (1 - t))
    return (x - start) / 2 * (density @ weights)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, .5)
    flip = y > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - y, y)
    peaked = np.minimum(a, b) > PEAKED
    part = np.empty_like(y)
    part[peaked] = _tail_integral(z[peaked], p[peaked], q[peaked])
    wide = ~peaked
    if wide.any():
        z, p, q = z[wide], p[wide], q[wide]
        part[wide] = np.exp(_log_front(z, p, q)) * _tail_fraction(z, p, q) / p
    return np.where(inside, np.where(flip, 1 - part, part), np.where(x >= 1, 1.0, 0.0))


def beta_ppf(prob: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inverse of ``beta_cdf``: Newton steps kept inside a shrinking bracket."""
    prob, a, b = (v.astype(float).copy() for v in np.broadcast_arrays(
        *(np.asarray(v, float) for v in (prob, a, b))))
    valid = (a > 0) & (b > 0) & (prob >= 0) & (prob <= 1)
    out = np.where(valid, np.where(prob >= 1, 1.0, 0.0), np.nan)   # prob 0 or 1, or undefined
    todo = np.flatnonzero(valid & (prob > 0) & (prob < 1))
    if todo.size == 0:
        return out
    q, a, b = prob[todo], a[todo], b[todo]
    low, high = np.zeros_like(q), np.ones_like(q)
    x = a / (a + b)
    for _ in range(200):
        error = beta_cdf(x, a, b) - q
        open_ = np.abs(error) > 1e-14 * q + 5e-16
        low, high = np.where(error < 0, x, low), np.where(error >= 0, x, high)
        density = np.exp(np.clip(_log_front(x, a, b), -700, 700)) / (x * (1 - x))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = x - error / density
        middle = np.where((low == 0) & (high < 1e-2), high / 16, (low + high) / 2)
        new = np.where((step > low) & (step < high), step, middle)
        open_ &= (np.abs(new - x) > 1e-15 * x) & (high - low > 1e-15 * high)
        out[todo] = np.where(open_, new, x)
        if not open_.any():
            break
        todo, q, a, b, low, high, x = (v[open_] for v in (todo, q, a, b, low, high, new))
    else:
        out[todo] = np.nan
    return out


def t_ppf(prob: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student quantile through Beta(1/2, df/2) of t^2 / (df + t^2)."""
    prob, df = np.broadcast_arrays(np.asarray(prob, float), np.asarray(df, float))
    y = beta_ppf(np.abs(2 * prob - 1), np.full(prob.shape, .5), df / 2)
    return np.sign(prob - .5) * np.sqrt(df * y / (1 - y))


def hdi_bounds(mass: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest interval holding ``mass`` under Beta(a, b).

    The width shrinks while the density at the lower end is below that at the upper end, so the
    best lower tail is the root of their log ratio, found by bracketed Newton steps.
    """
    mass, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (mass, a, b)))
    # A density without an inner peak puts the interval at its border.
    falling, rising = a <= 1, (b <= 1) & (a > 1)
    left, right = np.where(rising, 1 - mass, 0.0), np.where(falling, 0.0, 1 - mass)
    tail = (left + right) / 2

    def log_shape(x: np.ndarray) -> np.ndarray:
        return (np.where(a == 1, 0.0, (a - 1) * np.log(x))
                + np.where(b == 1, 0.0, (b - 1) * np.log1p(-x)))

    def slope(x: np.ndarray) -> np.ndarray:
        density = np.exp(_log_front(x, a, b)) / (x * (1 - x))
        return ((a - 1) / x - (b - 1) / (1 - x)) / density

    for _ in range(60):
        low, high = beta_ppf(tail, a, b), beta_ppf(np.minimum(tail + mass, 1.0), a, b)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = log_shape(low) - log_shape(high)
            step = tail - gap / (slope(low) - slope(high))
        inner = ~(falling | rising)
        left = np.where(inner & (gap < 0), tail, left)
        right = np.where(inner & ~(gap < 0), tail, right)
        new = np.where((step > left) & (step < right), step, (left + right) / 2)
        settled = (np.abs(new - tail) <= 1e-12) | (right - left <= 1e-12)
        tail = new
        if np.all(settled):
            break
    tail = np.where(settled, tail, np.nan)
    return beta_ppf(tail, a, b), beta_ppf(np.minimum(tail + mass, 1.0), a, b)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()),
                            T.StructField("high", T.DoubleType())]))
def _beta_hdi(mass: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    low, high = hdi_bounds(mass.to_numpy(float), a.to_numpy(float), b.to_numpy(float))
    return pd.DataFrame({"low": low, "high": high})


def _number(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("double")


# The column form is SQL text with named lambda variables: one expression to parse, where building
# it from a thousand Column calls takes seconds on the driver.

def _let(name: str, value: str, body: str) -> str:
    """``body`` of a value that is computed once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _series_sql(n: str) -> str:
    """The tail of Stirling's formula for n of 16 and more."""
    return (f"((1D/12 - (1D/360 - (1D/1260 - (1D/1680 - 1D/1188 / ({n}*{n})) / ({n}*{n})) "
            f"/ ({n}*{n})) / ({n}*{n})) / {n})")


def _stirling_sql(n: str) -> str:
    """As ``_stirling_error``; small numbers are moved up by 17 through the factorial's product."""
    product = " * ".join(f"(m + {k})" for k in range(1, 17))
    moved = (f"((m + 16.5D) * ln(m + 17) - 17 + {_series_sql('(m + 17)')} - ln({product}) "
             "- (m + 0.5D) * ln(m))")
    return _let("m", n, f"CASE WHEN m < 16 THEN {moved} ELSE {_series_sql('m')} END")


def _deviance_sql(x: str, mean: str) -> str:
    return _let("g", f"named_struct('x', {x}, 'm', {mean})", _let(
        "d", "(g.x - g.m) / g.m", "CASE WHEN abs(d) < 0.05D THEN g.x * log1p(d) - g.m * d "
                                  "ELSE g.x * ln(g.x / g.m) + g.m - g.x END"))


def _front_sql(x: str, a: str, b: str) -> str:
    """As ``_log_front``; ``v.mass`` is the part that doesn't depend on x."""
    return (f"(v.mass - {_deviance_sql(a, f'({a} + {b}) * {x}')} "
            f"- {_deviance_sql(b, f'({a} + {b}) * (1 - {x})')})")


def _away(value: str) -> str:
    return f"CASE WHEN abs({value}) < 1e-300D THEN 1e-300D ELSE {value} END"


def _fraction_sql() -> str:
    """As ``_tail_fraction`` for a smaller parameter up to ``PEAKED``; null if not settled."""
    def half(f: str, step: str, body: str) -> str:
        state = ("named_struct('c', c, 'd', d, 'h', {0}.h * c * d, "
                 "'done', abs(c * d - 1) < 2e-15D)").format(f)
        return _let("w", step, _let("d", "1 / (" + _away(f"(1 + w * {f}.d)") + ")", _let(
            "c", _away(f"(1 + w / {f}.c)"), body.format(state))))

    even = "k * (z.q - k) * z.x / ((z.p + 2 * k - 1) * (z.p + 2 * k))"
    odd = "-(z.p + k) * (z.p + z.q + k) * z.x / ((z.p + 2 * k) * (z.p + 2 * k + 1))"
    both = _let("f2", half("f", even, "{}"), half("f2", odd, "{}"))
    start = _let("d", "1 / (" + _away("(1 - (z.p + z.q) * z.x / (z.p + 1))") + ")",
                 "named_struct('c', 1D, 'd', d, 'h', d, 'done', false)")
    return (f"aggregate(transform(sequence(1, {TERMS}), k -> double(k)), {start}, "
            f"(f, k) -> CASE WHEN f.done THEN f ELSE {both} END, "
            "f -> CASE WHEN f.done THEN f.h END)")


def _integral_sql() -> str:
    """As ``_tail_integral``."""
    nodes = ", ".join(f"named_struct('at', {float(at)!r}D, 'weight', {float(weight)!r}D)"
                      for at, weight in zip(*np.polynomial.legendre.leggauss(80)))
    sd = "sqrt(z.p * z.q / ((z.p + z.q) * (z.p + z.q) * (z.p + z.q + 1)))"
    start = f"greatest(0D, least(z.p / (z.p + z.q) - 12 * {sd}, z.x - 6 * {sd}))"
    density = _let("t", "greatest(r + (z.x - r) * (node.at + 1) / 2, 1e-300D)",
                   f"exp({_front_sql('t', 'z.p', 'z.q')}) / (t * (1 - t))")
    return _let("r", start, f"(z.x - r) / 2 * aggregate(array({nodes}), 0D, "
                            f"(total, node) -> total + node.weight * {density})")


def _cdf_sql() -> str:
    """Incomplete beta function at s.x inside (0, 1); null where its series doesn't settle."""
    sides = ("CASE WHEN s.x > (v.a + 1) / (v.a + v.b + 2) "
             "THEN named_struct('x', 1 - s.x, 'p', v.b, 'q', v.a, 'flip', true) "
             "ELSE named_struct('x', s.x, 'p', v.a, 'q', v.b, 'flip', false) END")
    lower = (f"CASE WHEN least(z.p, z.q) > {PEAKED} THEN {_integral_sql()} "
             f"ELSE exp({_front_sql('z.x', 'z.p', 'z.q')}) * {_fraction_sql()} / z.p END")
    return _let("z", sides, _let(
        "part", lower, "CASE WHEN z.flip THEN 1 - part ELSE part END"))


def _guess_sql() -> str:
    """The normal approximation of the quantile (Abramowitz and Stegun 26.2.22, 26.5.22), or the
    powers that hold at the borders if a parameter is below 1."""
    normal = _let("t", "sqrt(-2 * ln(least(v.q, 1 - v.q)))", _let(
        "size", "t - (2.30753D + 0.27061D * t) / (1 + t * (0.99229D + 0.04481D * t))",
        "CASE WHEN v.q < 0.5D THEN size ELSE -size END"))
    wide = "named_struct('a', 1 / (2 * v.a - 1), 'b', 1 / (2 * v.b - 1))"
    inner = _let("y", normal, _let("e", wide, _let(
        "n", "named_struct('curve', (y * y - 3) / 6, 'mean', 2 / (e.a + e.b))",
        "v.a / (v.a + v.b * exp(least(600D, 2 * ("
        "y * sqrt(greatest(n.curve + n.mean, 0D)) / n.mean "
        "- (e.b - e.a) * (n.curve + 5D/6 - 2 / (3 * n.mean))))))")))
    parts = ("named_struct('low', exp(v.a * ln(v.a / (v.a + v.b))) / v.a, "
             "'high', exp(v.b * ln(v.b / (v.a + v.b))) / v.b)")
    border = _let("e", parts, "CASE WHEN v.q < e.low / (e.low + e.high) "
                  "THEN power(v.a * (e.low + e.high) * v.q, 1 / v.a) "
                  "ELSE 1 - power(v.b * (e.low + e.high) * (1 - v.q), 1 / v.b) END")
    return _let("x", f"CASE WHEN v.a >= 1 AND v.b >= 1 THEN {inner} ELSE {border} END",
                "CASE WHEN x > 1e-290D AND x < 1 THEN x ELSE v.a / (v.a + v.b) END")


def _search_sql() -> str:
    """Steps of the search for the record ``v`` of q, a, b, mass and start."""
    def state(low: str, high: str, x: str, done: str) -> str:
        return f"named_struct('low', {low}, 'high', {high}, 'x', {x}, 'done', {done})"

    density = f"exp(least(greatest({_front_sql('s.x', 'v.a', 'v.b')}, -700D), 700D))"
    plain = f"try_divide(error * s.x * (1 - s.x), {density})"
    bent = _let("u", plain, "s.x - u / (1 - 0.5D * least(1D, "
                            "u * ((v.a - 1) / s.x - (v.b - 1) / (1 - s.x))))")
    sides = ("named_struct('low', CASE WHEN error < 0 THEN s.x ELSE s.low END, "
             f"'high', CASE WHEN error < 0 THEN s.high ELSE s.x END, 'step', {bent})")
    inside = ("CASE WHEN t.step > t.low AND t.step < t.high THEN t.step "
              "WHEN t.low = 0 AND t.high < 1e-2D THEN t.high / 16 ELSE (t.low + t.high) / 2 END")
    moved = _let("t", sides, (
        "CASE WHEN abs(t.step - s.x) <= 1e-7D * least(s.x, 1 - s.x) THEN "
        + state("t.low", "t.high", "least(greatest(t.step, t.low), t.high)", "true")
        + " ELSE " + state("t.low", "t.high", inside, "t.high - t.low <= 1e-15D * t.high")
        + " END"))
    unknown = state("s.low", "s.high", "CASE WHEN error = 0 THEN s.x END", "true")
    judged = _let("error", f"{_cdf_sql()} - v.q",
                  f"CASE WHEN error IS NULL OR error = 0 THEN {unknown} ELSE {moved} END")
    return (f"aggregate(sequence(1, {STEPS}), {state('0D', '1D', 'v.start', 'false')}, "
            f"(s, i) -> CASE WHEN s.done THEN s ELSE {judged} END, "
            "s -> CASE WHEN s.done THEN s.x END)")


def _beta_quantile_sql() -> str:
    """Quantile of the record ``o`` of q, a and b."""
    mass = (f"{_stirling_sql('o.a + o.b')} - {_stirling_sql('o.a')} - {_stirling_sql('o.b')} "
            f"+ 0.5D * ln(o.a * (o.b / (o.a + o.b))) - {_LOG_SQRT_2PI!r}D")
    found = _let("v", f"named_struct('q', o.q, 'a', o.a, 'b', o.b, 'mass', {mass})", _let(
        "v", "named_struct('q', v.q, 'a', v.a, 'b', v.b, 'mass', v.mass, "
             f"'start', {_guess_sql()})", _search_sql()))
    return ("CASE WHEN o.a > 0 AND o.b > 0 AND o.q >= 0 AND o.q <= 1 AND NOT isnan(o.a) "
            f"AND NOT isnan(o.b) THEN CASE WHEN o.q IN (0D, 1D) THEN o.q ELSE {found} END END")


def _of_record(name: str, record: Column, body: str) -> Column:
    return F.call_function("transform", F.array(record), F.expr(f"{name} -> {body}"))[0]


def beta_quantile(prob: Column | float, a: Column, b: Column) -> Column:
    """Inverse incomplete beta function: Halley steps kept inside a shrinking bracket.

    A step changes x by the cube of what is missing, so the search ends with the first step below
    1e-7 of the distance to the nearer border. Null for parameters or probabilities out of range,
    nulls, NaN, and a search of ``STEPS`` steps that doesn't meet its stop test.
    """
    record = F.struct(_number(prob).alias("q"), _number(a).alias("a"), _number(b).alias("b"))
    return _of_record("o", record, _beta_quantile_sql())


def t_quantile(prob: Column | float, df: Column) -> Column:
    """Student quantile through Beta(1/2, df/2) of t^2 / (df + t^2).

    Far from the middle the complement is solved for, which is small and keeps its digits.
    """
    record = F.struct(_number(prob).alias("prob"), _number(df).alias("df"))
    far = "abs(2 * w.prob - 1) > 0.5D"
    asked = (f"CASE WHEN {far} "
             "THEN named_struct('q', 1 - abs(2 * w.prob - 1), 'a', w.df / 2, 'b', 0.5D) "
             "ELSE named_struct('q', abs(2 * w.prob - 1), 'a', 0.5D, 'b', w.df / 2) END")
    return _of_record("w", record, _let("o", asked, _let(
        "y", _beta_quantile_sql(),
        f"signum(w.prob - 0.5D) * sqrt(w.df * CASE WHEN {far} THEN try_divide(1 - y, y) "
        "ELSE try_divide(y, 1 - y) END)")))


def beta_hdi(mass: Column | float, a: Column, b: Column) -> Column:
    """Struct ``(low, high)``."""
    return _beta_hdi(_number(mass), _number(a), _number(b))
