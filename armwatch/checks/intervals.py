"""Confidence intervals over real strata, and the safety reports built on them.

The SQL side has its own formulas: normal quantiles as literals, beta quantiles by bisection of
a power series, the t quantile by its expansion in 1/df.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from armwatch.checks.base import counted, over_collections, quoted, register
from armwatch.columns import cols, flag
from armwatch.functions import intervals as ci
from armwatch.plans import safety
from armwatch.sources.collections import collections, safety_view

CONF = .9
STRATA = ["site", "gender", "group"]


def z_of(conf: float, two_sided: bool = True) -> str:
    return repr(NormalDist().inv_cdf((1 + conf) / 2 if two_sided else conf))


# ------------------------------------------------------------------ SQL side

def _wilson(p_low: str, p_high: str, n: str, z: str) -> tuple[str, str]:
    def end(p: str, sign: str) -> str:
        w = f"({z}*{z}/{n})"
        half = f"{z}*sqrt(({p}*(1-{p})+{w}/4)/{n})"
        inner = f"{p}+{w}/2{sign}{half}"
        clipped = f"greatest({inner}, 0)" if sign == "-" else f"least({inner}, 1)"
        return f"({clipped})/(1+{w})"
    return end(p_low, "-"), end(p_high, "+")


def rate_sql(method: str, z: str, x: str = "x", n: str = "n") -> tuple[str, str]:
    x, n = f"CAST({x} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    p = f"({x}/{n})"
    if method in ("wilson", "wilson_cc"):
        shift = f"1/{n}" if method.endswith("cc") else "0"
        return _wilson(f"greatest({p}-{shift}, 0)", f"least({p}+{shift}, 1)", n, z)
    if method == "agresti_coull":
        big = f"({n}+{z}*{z})"
        p, n = f"(({x}+{z}*{z}/2)/{big})", big
    slack = f"1/(2*{n})" if method == "wald_cc" else "0"
    half = f"({z}*sqrt({p}*(1-{p})/{n})+{slack})"
    return f"greatest({p}-{half}, 0)", f"least({p}+{half}, 1)"


def diff_sql(method: str, conf: float, two_sided: bool = True) -> tuple[str, str]:
    z = z_of(conf, two_sided)
    x1, n1, x0, n0 = (f"CAST({c} AS DOUBLE)" for c in ("x1", "n1", "x0", "n0"))
    p1, p0, total = f"({x1}/{n1})", f"({x0}/{n0})", f"({n1}+{n0})"
    d = f"({p1}-{p0})"

    def var(p: str, n: str) -> str:
        return f"{p}*(1-{p})/({n})"

    def normal(center: str, variance: str, slack: str = "0") -> tuple[str, str]:
        half = f"({z}*sqrt({variance})+{slack})"
        return f"greatest({center}-{half}, -1)", f"least({center}+{half}, 1)"

    def bayes(kappa: float, hybrid: bool) -> tuple[str, str]:
        q1, q0 = f"(({x1}+{kappa/2})/({n1}+{kappa}))", f"(({x0}+{kappa/2})/({n0}+{kappa}))"
        more = "0" if hybrid else f"{kappa+1}"
        return normal(f"({q1}-{q0})", f"{var(q1, f'{n1}+{more}')}+{var(q0, f'{n0}+{more}')}")

    def beal(alpha: float, corrected: bool) -> tuple[str, str]:
        k = alpha + 1
        tau = f"(({x1}+{k})/({n1}+{2*k})+({x0}+{k})/({n0}+{2*k}))"
        a, b = f"({z}*{z}*(1/{n1}+1/{n0})/4)", f"({z}*{z}*(1/{n1}-1/{n0})/4)"
        u, v = f"(1+{a})", f"({d}+{b}*(1-{tau}))"
        w = f"({d}*{d}+{a}*{tau}*({tau}-2))"

        def end(sign: str) -> str:
            vv, ww = v, w
            if corrected:
                vv = f"({v}{sign}1/(2*{total}))"
                ww = f"({w}+1/(4*{total}*{total}){sign}{d}/{total})"
            root = f"sqrt(CASE WHEN {vv}*{vv}-{u}*{ww} >= 0 THEN {vv}*{vv}-{u}*{ww} END)"
            return f"({vv}{sign}{root})/{u}"
        return (f"CASE WHEN {end('-')} < -1 THEN -1 ELSE {end('-')} END",
                f"CASE WHEN {end('+')} > 1 THEN 1 ELSE {end('+')} END")

    def newcombe(corrected: bool) -> tuple[str, str]:
        name = "wilson_cc" if corrected else "wilson"
        (l1, u1), (l0, u0) = rate_sql(name, z, "x1", "n1"), rate_sql(name, z, "x0", "n0")
        return (f"{d}-sqrt(({p1}-{l1})*({p1}-{l1})+({u0}-{p0})*({u0}-{p0}))",
                f"{d}+sqrt(({u1}-{p1})*({u1}-{p1})+({p0}-{l0})*({p0}-{l0}))")

    def brown_li() -> tuple[str, str]:
        df = f"({total}-2)"
        z3, z5, z7 = f"pow({z},3)", f"pow({z},5)", f"pow({z},7)"
        t = (f"({z}+({z3}+{z})/(4*{df})+(5*{z5}+16*{z3}+3*{z})/(96*{df}*{df})"
             f"+(3*{z7}+19*{z5}+17*{z3}-15*{z})/(384*{df}*{df}*{df}))")
        w = f"(1+{t}*{t}/{total})"
        p = (f"least(greatest(({p0}/{n0}+{p1}/{n1})/(1/{n0}+1/{n1}), {d}*{n0}/{total}), "
             f"1-{d}*{n1}/{total})")
        inside = f"{w}*{p}*(1-{p})*(1/{n0}+1/{n1})-{d}*{d}/{total}"
        root = f"sqrt(CASE WHEN {inside} >= 0 THEN {inside} END)"
        return f"({d}-{t}*{root})/{w}", f"({d}+{t}*{root})/{w}"

    plain = f"{var(p1, n1)}+{var(p0, n0)}"
    pooled = f"(({x1}+{x0})/{total})"
    swapped = f"(({n0}*{p1}+{n1}*{p0})/{total})"
    c1, c0 = f"(({x1}+1)/({n1}+2))", f"(({x0}+1)/({n0}+2))"
    return {
        "wald": lambda: normal(d, plain),
        "wald_cc": lambda: normal(d, plain, f"(1/{n1}+1/{n0})/2"),
        "anderson_hauck": lambda: normal(d, f"{var(p1, f'{n1}-1')}+{var(p0, f'{n0}-1')}",
                                         f"1/(2*least({n1}, {n0}))"),
        "yule": lambda: normal(d, f"{var(pooled, n1)}+{var(pooled, n0)}"),
        "yule_mod": lambda: normal(d, f"{var(swapped, n1)}+{var(swapped, n0)}"),
        "agresti_caffo": lambda: normal(f"({c1}-{c0})",
                                        f"{var(c1, f'{n1}+2')}+{var(c0, f'{n0}+2')}"),
        "jeffreys": lambda: bayes(1, False), "jeffreys_hybrid": lambda: bayes(1, True),
        "uniform": lambda: bayes(2, False), "uniform_hybrid": lambda: bayes(2, True),
        "pseudo_bayes": lambda: bayes(3, False),
        "haldane": lambda: beal(-1, False), "haldane_cc": lambda: beal(-1, True),
        "jeffreys_perks": lambda: beal(-.5, False), "jeffreys_perks_cc": lambda: beal(-.5, True),
        "beal": lambda: beal(-.25, True),
        "newcombe": lambda: newcombe(False), "newcombe_cc": lambda: newcombe(True),
        "brown_li": brown_li,
    }[method]()


def beta_sql(bounds: dict[str, tuple[float, str, str]], keys: list[str],
             source: str = "strata") -> str:
    """CTE ``solved``: one row per key and named bound with the beta quantile.

    Bisection over a bracket around the mean; the distribution function is the power series
    x^a (1-x)^b / (a B(a,b)) * sum of prod (a+b+i)/(a+1+i) x^n.
    """
    names = ", ".join(quoted(k) for k in keys)
    rows = " UNION ALL ".join(
        f"""SELECT {names}, '{name}' AS bound, CAST({q!r} AS DOUBLE) AS q,
            CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM {source}"""
        for name, (q, a, b) in bounds.items())
    return f"""
asked AS ({rows}),
start AS (
  SELECT *, a/(a+b) AS mean, sqrt(a*b/((a+b)*(a+b)*(a+b+1))) AS sd FROM asked WHERE a > 0 AND b > 0),
bisect AS (
  SELECT {names}, bound, q, a, b, greatest(0.0, mean-12*sd) AS lo, least(1.0, mean+14*sd) AS hi,
         0 AS step FROM start
  UNION ALL
  SELECT {names}, bound, q, a, b, CASE WHEN f < q THEN mid ELSE lo END,
         CASE WHEN f < q THEN hi ELSE mid END, step + 1
  FROM (SELECT *, exp(a*ln(mid) + b*ln(1-mid) + lgamma(a+b) - lgamma(a+1) - lgamma(b))
               * list_sum(list_transform(range(0, 3000), lambda i:
                   exp(lgamma(a+b+i) - lgamma(a+b) - lgamma(a+1+i) + lgamma(a+1) + i*ln(mid)))) AS f
        FROM (SELECT *, (lo+hi)/2 AS mid FROM bisect WHERE step < 46))),
solved AS (SELECT {names}, bound, (lo+hi)/2 AS value FROM bisect WHERE step = 46)"""


_COUNTS = """
strata AS (
  SELECT site, gender, "group", count(DISTINCT col_id) AS n, {x} AS x
  FROM collections GROUP BY site, gender, "group")"""
STRATA_SQL = _COUNTS.format(x=counted("sig_hyp"))

PAIRS_SQL = f"""
pairs AS (
  SELECT site, gender, max(CASE WHEN "group" = 'B' THEN x END) AS x1,
         max(CASE WHEN "group" = 'B' THEN n END) AS n1,
         max(CASE WHEN "group" = 'A' THEN x END) AS x0,
         max(CASE WHEN "group" = 'A' THEN n END) AS n0
  FROM strata GROUP BY site, gender)"""


# ---------------------------------------------------------------- Spark side

def strata_counts(spark, sf_dir):
    """Distinct collections and significant events per site, gender and arm."""
    return collections(spark, sf_dir).groupBy(*cols(STRATA)).agg(
        F.count_distinct("col_id").alias("n"), F.sum(flag("sig_hyp")).alias("x"))


def arm_pairs(spark, sf_dir):
    """The two arms side by side per site and gender."""
    return strata_counts(spark, sf_dir).groupBy("site", "gender").agg(*(
        F.max(F.when(F.col("group") == arm, F.col(m))).alias(f"{m}{i}")
        for i, arm in ((1, "B"), (0, "A")) for m in ("x", "n")))


def _rate(method: str, limits: str = "both", **params):
    return lambda s, d: ci.with_rate_ci(strata_counts(s, d), method=method, limits=limits,
                                        conf=CONF, **params)


def _diff(method: str, limits: str = "both", **params):
    return lambda s, d: ci.with_rate_diff_ci(arm_pairs(s, d), method=method, limits=limits,
                                             conf=CONF, **params)


CLOSED_RATES = ("wald", "wald_cc", "agresti_coull", "wilson", "wilson_cc")
_TAIL = 1 - CONF
# Quantiles behind each beta method, and the two bounds made of them.
_EXACT = {"lo": (_TAIL, "x", "n-x+1"), "hi": (CONF, "x+1", "n-x")}
_EXACT_MORE = {"lo2": (_TAIL, "x+1", "n-x"), "hi2": (CONF, "x", "n-x+1")}
BETA_RATES = {
    "clopper_pearson": (_EXACT, "coalesce(lo, 0)", "coalesce(hi, 1)"),
    "clopper_pearson_cc": (_EXACT | _EXACT_MORE, "(coalesce(lo, 0) + coalesce(lo2, 1)) / 2",
                           "(coalesce(hi, 1) + coalesce(hi2, 0)) / 2"),
    "jeffreys": ({"lo": (_TAIL, "x+0.5", "n-x+0.5"), "hi": (CONF, "x+0.5", "n-x+0.5")}, "lo", "hi"),
    "uniform": ({"lo": (_TAIL, "x+1", "n-x+1"), "hi": (CONF, "x+1", "n-x+1")}, "lo", "hi"),
}


def _beta_rate_sql(method: str) -> str:
    bounds, low, high = BETA_RATES[method]
    wide = ", ".join(f"max(CASE WHEN bound = '{b}' THEN value END) AS {b}" for b in bounds)
    body = f"""
SELECT site, gender, "group", n, x, round({low}, 6) AS LL, round({high}, 6) AS UL
FROM strata LEFT JOIN (SELECT site, gender, "group", {wide} FROM solved
                       GROUP BY site, gender, "group") USING (site, gender, "group")"""
    return over_collections(body, STRATA_SQL, beta_sql(bounds, STRATA), recursive=True)


def _rate_select(method: str) -> str:
    low, high = rate_sql(method, z_of(CONF))
    return f"round({low}, 6) AS LL, round({high}, 6) AS UL"


for _m in CLOSED_RATES:
    register(f"rate_ci_{_m}", _rate(_m), over_collections(
        f'SELECT site, gender, "group", n, x, {_rate_select(_m)} FROM strata', STRATA_SQL))
for _m in BETA_RATES:
    register(f"rate_ci_{_m}", _rate(_m), _beta_rate_sql(_m))
register("rate_ci_bayes_hdi", _rate("bayes_hdi"))
register("rate_ci_upper_wilson", _rate("wilson", "upper"), over_collections(
    f"""SELECT site, gender, "group", n, x,
        round({rate_sql('wilson', z_of(CONF, False))[1]}, 6) AS UL FROM strata""", STRATA_SQL))


def _rate_summary_sql() -> str:
    shared = _EXACT | _EXACT_MORE | {
        "jlo": BETA_RATES["jeffreys"][0]["lo"], "jhi": BETA_RATES["jeffreys"][0]["hi"],
        "ulo": BETA_RATES["uniform"][0]["lo"], "uhi": BETA_RATES["uniform"][0]["hi"]}
    ends = {"clopper_pearson": BETA_RATES["clopper_pearson"][1:],
            "clopper_pearson_cc": BETA_RATES["clopper_pearson_cc"][1:],
            "jeffreys": ("jlo", "jhi"), "uniform": ("ulo", "uhi"),
            **{m: rate_sql(m, z_of(CONF)) for m in CLOSED_RATES}}
    wide = ", ".join(f"max(CASE WHEN bound = '{b}' THEN value END) AS {b}" for b in shared)
    picked = ", ".join(f"round({ends[m][0]}, 6) AS {m}_LL, round({ends[m][1]}, 6) AS {m}_UL"
                       for m in ci.RATE_METHODS)
    body = f"""
SELECT site, gender, "group", n, x, {picked}
FROM strata LEFT JOIN (SELECT site, gender, "group", {wide} FROM solved
                       GROUP BY site, gender, "group") USING (site, gender, "group")"""
    return over_collections(body, STRATA_SQL, beta_sql(shared, STRATA), recursive=True)


register("rate_ci_summary",
         lambda s, d: ci.rate_ci_summary(strata_counts(s, d), conf=CONF), _rate_summary_sql())

_DIFF_PARAMS = {"beal": {"alpha": -.25, "cont_corr": True}, "pseudo_bayes": {"kappa": 3}}
for _m in (*ci.DIFF_METHODS, "beal", "pseudo_bayes"):
    _low, _high = diff_sql(_m, CONF)
    register(f"rate_diff_ci_{_m}", _diff(_m, **_DIFF_PARAMS.get(_m, {})), over_collections(
        f"""SELECT site, gender, x1, n1, x0, n0, round({_low}, 6) AS LL, round({_high}, 6) AS UL
        FROM pairs""", STRATA_SQL, PAIRS_SQL))
register("rate_diff_ci_lower_newcombe", _diff("newcombe", "lower"), over_collections(
    f"""SELECT site, gender, x1, n1, x0, n0,
        round({diff_sql('newcombe', CONF, False)[0]}, 6) AS LL FROM pairs""",
    STRATA_SQL, PAIRS_SQL))
register("rate_diff_ci_summary",
         lambda s, d: ci.rate_diff_ci_summary(arm_pairs(s, d), conf=CONF),
         over_collections("SELECT site, gender, x1, n1, x0, n0, " + ", ".join(
             "round({}, 6) AS {m}_LL, round({}, 6) AS {m}_UL".format(*diff_sql(m, CONF), m=m)
             for m in ci.DIFF_METHODS) + " FROM pairs", STRATA_SQL, PAIRS_SQL))


# ------------------------------------------------- reports built on intervals

_ARMS_SQL = f"""
pairs AS (
  SELECT {counted('"group" = ' + "'B' AND sig_hyp")} AS x1,
         count(DISTINCT CASE WHEN "group" = 'B' THEN col_id END) AS n1,
         {counted('"group" = ' + "'A' AND sig_hyp")} AS x0,
         count(DISTINCT CASE WHEN "group" = 'A' THEN col_id END) AS n0
  FROM collections WHERE mitt)"""


def _calc_sql(limits: str) -> str:
    ends = {"both": (("LL", 0), ("UL", 1)), "upper": (("UL", 1),), "lower": (("LL", 0),)}[limits]
    return over_collections(" UNION ALL ".join(
        f"""SELECT '{m}' AS method, """ + ", ".join(
            f"round(100 * ({diff_sql(m, .95, limits == 'both')[i]}), 6) AS {end}"
            for end, i in ends) + """,
        round(100.0 * x1 / n1 - 100.0 * x0 / n0, 6) AS risk_diff, CAST(0.15 AS DOUBLE) AS margin
        FROM pairs""" for m in ci.DIFF_METHODS), _ARMS_SQL)


for _limits in ("both", "upper"):
    register(f"safety_calc_ci_{_limits}",
             lambda s, d, limits=_limits: safety.calc_ci(
                 safety_view(collections(s, d)), "sig_hyp", "mitt", limits, .95),
             _calc_sql(_limits))


def _longitudinal_sql(method: str, period: str, where: str) -> str:
    counts = f"""
periods AS (
  SELECT CAST(date_trunc('{period}', col_date) AS DATE) AS period, "group",
         count(DISTINCT col_id) AS n, {counted('non_hyp')} AS x
  FROM collections WHERE {where} GROUP BY ALL),
seen AS (SELECT DISTINCT period FROM periods),
arms AS (SELECT s.period, a.sample, coalesce(p.n, 0) AS n, coalesce(p.x, 0) AS x
         FROM seen s CROSS JOIN (VALUES ('A'), ('B')) a(sample)
         LEFT JOIN periods p ON p.period = s.period AND p."group" = a.sample),
samples AS (SELECT * FROM arms UNION ALL
            SELECT period, 'pulled', sum(n), sum(x) FROM arms GROUP BY period)"""
    low, high = rate_sql(method, z_of(.95), "x", "nullif(n, 0)")
    low, high = (f"CASE WHEN n > 0 THEN {end} END" for end in (low, high))
    values = {"n": "n", "x": "x", "rate": "x / nullif(n, 0)", "LL": low, "UL": high}
    rows = " UNION ALL ".join(
        f"""SELECT period, sample, '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM samples"""
        for m, v in values.items())
    return over_collections(f"""SELECT CAST(period AS VARCHAR) AS period, sample, metric,
        round(value, 6) AS value FROM ({rows}) WHERE value IS NOT NULL""", counts)


register("safety_longitudinal_week", lambda s, d: safety.summary_longitudinal(
    safety_view(collections(s, d)), "wilson", "non_hyp", "itt", "w", .95, start="1996-02-01"),
    _longitudinal_sql("wilson", "week", "col_date >= DATE '1996-02-01'"))
register("safety_longitudinal_month", lambda s, d: safety.summary_longitudinal(
    safety_view(collections(s, d)), "agresti_coull", "non_hyp", "pp", "m", .95),
    _longitudinal_sql("agresti_coull", "month", "pp"))
register("safety_longitudinal_day", lambda s, d: safety.summary_longitudinal(
    safety_view(collections(s, d)), "wald_cc", "non_hyp", "mitt", "d", .95),
    _longitudinal_sql("wald_cc", "day", "mitt"))
register("safety_longitudinal_exact", lambda s, d: safety.summary_longitudinal(
    safety_view(collections(s, d)), "clopper_pearson", "non_hyp", "itt", "m", .95))
