"""Enrolment rates, projections and charts."""

from armwatch.checks.base import ENROLMENT, over, register
from armwatch.operators.shape import complete_grid
from armwatch.plans import enrolment
from armwatch.sources.collections import enrolment_view

BOTH = ["SITE", "STRATA1"]


def _data(spark, sf_dir):
    return enrolment.load(enrolment_view(spark, sf_dir))


def _sql(body: str, *more: str) -> str:
    return over(body, ENROLMENT, *more)


def _working(donor_level: bool) -> str:
    count = "count(DISTINCT subject_id)" if donor_level else "count(subject_id)"
    return f"""
working AS (SELECT site, strata1, week, {count} AS value FROM enrolment GROUP BY ALL)"""


for _donor in (True, False):
    register(f"enrolment_working_data_{'donors' if _donor else 'donations'}",
             lambda s, d, donor=_donor: enrolment.working_data(_data(s, d), BOTH, donor),
             _sql("""SELECT site AS "SITE", strata1 AS "STRATA1", CAST(week AS VARCHAR) AS week,
                  value FROM working""", _working(_donor)))

_METRICS_SQL = """
rates AS (
  SELECT site, strata1, CAST(min(value) AS BIGINT) AS lowest, CAST(max(value) AS BIGINT) AS highest,
         avg(value) AS mean, quantile_cont(value, 0.5) AS median,
         quantile_cont(CAST(value AS DOUBLE), 0.25) AS p_25,
         quantile_cont(CAST(value AS DOUBLE), 0.75) AS p_75
  FROM working GROUP BY site, strata1),
counts AS (SELECT site, strata1, count(*) AS donations, count(DISTINCT subject_id) AS donors
           FROM enrolment GROUP BY site, strata1),
sites AS (SELECT site, count(*) AS site_donations, count(DISTINCT subject_id) AS site_donors,
                 CAST(CAST(min(enr_date) AS DATE) AS VARCHAR) AS activation_date
          FROM enrolment GROUP BY site)"""
_SHARES = """
  round(CAST(donations AS DOUBLE) / site_donations, 6) AS donation_percentage,
  donations AS donation_count,
  round(CAST(donors AS DOUBLE) / site_donors, 6) AS donor_percentage, donors AS donor_count"""

register("enrolment_rate_metrics", lambda s, d: enrolment.rate_metrics(
    _data(s, d), "SITE", ["STRATA1"], True, list(enrolment.METRICS)), _sql(f"""
SELECT site AS "SITE", strata1 AS "STRATA1", lowest AS min, highest AS max,
       round(mean, 6) AS mean, round(median, 6) AS median, round(p_25, 6) AS p_25,
       round(p_75, 6) AS p_75, {_SHARES}
FROM rates JOIN counts USING (site, strata1) JOIN sites USING (site)""",
    _working(True), _METRICS_SQL))
register("enrolment_site_metrics", lambda s, d: enrolment.site_metrics(
    _data(s, d), "SITE", ["STRATA1"], False, ["p_25", "min"]), _sql(f"""
SELECT site AS "SITE", strata1 AS "STRATA1", lowest AS min, round(p_25, 6) AS p_25, {_SHARES},
       activation_date
FROM rates JOIN counts USING (site, strata1) JOIN sites USING (site)""",
    _working(False), _METRICS_SQL))
register("enrolment_activation_date", lambda s, d: enrolment.activation_date(_data(s, d), "SITE"),
         _sql("""SELECT site AS "SITE", CAST(CAST(min(enr_date) AS DATE) AS VARCHAR)
              AS activation_date FROM enrolment GROUP BY site"""))



def _project(spark, sf_dir, rule="total", ahead=1.1, max_weeks=50):
    data = _data(spark, sf_dir)
    rates = enrolment.rate_metrics(data, "SITE", ["STRATA1"], False, ["p_25"])
    steps = enrolment.projection_steps(rates, BOTH, "p_25")
    return enrolment.projections(data, BOTH, False, steps, max_weeks, data.count() * ahead, rule)


def _projection_sql(rule: str = "total", ahead: float = 1.1, max_weeks: int = 50) -> str:
    total = "sum(value)" if rule == "total" else "sum(sum(value)) OVER (ORDER BY k)"
    return f"""
weeks AS (SELECT DISTINCT week FROM working),
strata AS (SELECT DISTINCT site, strata1 FROM working),
history AS (
  SELECT s.site, s.strata1, w.week,
         CAST(sum(coalesce(x.value, 0)) OVER (PARTITION BY s.site, s.strata1 ORDER BY w.week)
              AS DOUBLE) AS value
  FROM strata s CROSS JOIN weeks w
  LEFT JOIN working x ON x.site = s.site AND x.strata1 = s.strata1 AND x.week = w.week),
steps AS (SELECT site, strata1, quantile_cont(CAST(value AS DOUBLE), 0.25) AS step
          FROM working GROUP BY ALL),
ahead AS (
  SELECT h.site, h.strata1, k, h.week + CAST(7 * k AS INTEGER) AS week, h.value + k * step AS value
  FROM history h JOIN steps USING (site, strata1), range(0, {max_weeks + 1}) r(k)
  WHERE h.week = (SELECT max(week) FROM weeks)),
reached AS (SELECT k, {total} AS total FROM ahead GROUP BY k),
stop AS (SELECT coalesce(min(k), {max_weeks}) AS k FROM reached
         WHERE total >= (SELECT count(*) FROM enrolment) * CAST({ahead} AS DOUBLE)),
projected AS (
  SELECT site, strata1, week, value FROM history
  UNION ALL SELECT site, strata1, week, value FROM ahead WHERE k > 0
    AND k <= (SELECT k FROM stop))"""


_SHOW = """SELECT CAST(week AS VARCHAR) AS week, site AS "SITE", strata1 AS "STRATA1",
           round(value, 6) AS value FROM projected"""
register("enrolment_projections", _project,
         _sql(_SHOW, _working(False), _projection_sql()))
register("enrolment_projections_compounded",
         lambda s, d: _project(s, d, "compounded", 3.0),
         _sql(_SHOW, _working(False), _projection_sql("compounded", 3.0)))
register("enrolment_projections_week_limit", lambda s, d: _project(s, d, "total", 100.0, 12),
         _sql(_SHOW, _working(False), _projection_sql("total", 100.0, 12)))
register("enrolment_projection_marginals",
         lambda s, d: enrolment.projection_marginals(_project(s, d), BOTH),
         _sql("""
SELECT 'SITE' AS stratum, site AS level, CAST(week AS VARCHAR) AS week,
       round(sum(value), 6) AS value FROM projected GROUP BY site, week
UNION ALL
SELECT 'STRATA1', strata1, CAST(week AS VARCHAR), round(sum(value), 6) FROM projected
GROUP BY strata1, week""", _working(False), _projection_sql()))


def _chart_sql(period: str, donors: bool, source: str = "enrolment") -> str:
    count = "count(DISTINCT subject_id)" if donors else "count(subject_id)"
    return f"""
bars AS (SELECT CAST(date_trunc('{period}', enr_date) AS DATE) AS period, strata1,
                {count} AS absolute FROM {source} GROUP BY ALL),
chart AS (
  SELECT period, strata1, absolute,
         CAST(sum(absolute) OVER (PARTITION BY strata1 ORDER BY period) AS BIGINT) AS cumsum,
         100.0 * absolute / sum(absolute) OVER (PARTITION BY period) AS percentage FROM bars)"""


def _chart_rows(period: str) -> str:
    return f"""SELECT CAST(period AS VARCHAR) AS {period}, strata1 AS "STRATA1", absolute, cumsum,
               round(percentage, 6) AS percentage FROM chart"""


_FIRST = """
firsts AS (SELECT * EXCLUDE (place) FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY enr_date, site, strata1) AS place
  FROM enrolment) WHERE place = 1)"""
register("enrolment_bar_chart_week", lambda s, d: enrolment.bar_chart(
    _data(s, d), "week", True, ["STRATA1"]), _sql(_chart_rows("week"), _chart_sql("week", True)))
register("enrolment_bar_chart_day", lambda s, d: enrolment.bar_chart(
    _data(s, d), "day", False, ["STRATA1"]), _sql(_chart_rows("day"), _chart_sql("day", False)))
register("enrolment_bar_chart_new_donors", lambda s, d: enrolment.bar_chart(
    _data(s, d), "week", True, ["STRATA1"], only_new_donors=True),
    _sql(_chart_rows("week"), _FIRST, _chart_sql("week", True, "firsts")))
register("enrolment_exact_duplicates_removed", lambda s, d: _data(s, d).dropDuplicates().groupBy(
    "SITE").count(), _sql("""SELECT site AS "SITE", count(*) AS count
    FROM (SELECT DISTINCT enr_date, subject_id, site, strata1 FROM enrolment) GROUP BY site"""))


def _dense_sql(period: str, donors: bool, source: str = "enrolment") -> str:
    step = "7" if period == "week" else "1"
    return _chart_sql(period, donors, source) + f""",
calendar AS (SELECT (SELECT min(period) FROM bars) + CAST(i AS INTEGER) AS period
             FROM range(0, (SELECT max(period) - min(period) + 1 FROM bars), {step}) r(i)),
full_chart AS (
  SELECT c.period, s.strata1, coalesce(absolute, 0) AS absolute,
         sum(coalesce(absolute, 0)) OVER (PARTITION BY s.strata1 ORDER BY c.period) AS cumsum,
         coalesce(percentage, 0) AS percentage
  FROM calendar c CROSS JOIN (SELECT DISTINCT strata1 FROM bars) s
  LEFT JOIN chart h ON h.period = c.period AND h.strata1 = s.strata1)"""


def _dense_rows(period: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST(period AS VARCHAR) AS {period}, strata1 AS "STRATA1", '{m}' AS metric,
        round(CAST({m} AS DOUBLE), 6) AS value FROM full_chart"""
        for m in ("absolute", "cumsum", "percentage"))


register("enrolment_dense_bar_chart_week", lambda s, d: enrolment.dense_bar_chart(
    _data(s, d), "week", False, ["STRATA1"]), _sql(_dense_rows("week"), _dense_sql("week", False)))
register("enrolment_dense_bar_chart_day", lambda s, d: enrolment.dense_bar_chart(
    _data(s, d), "day", True, ["STRATA1"], only_new_donors=True),
    _sql(_dense_rows("day"), _FIRST, _dense_sql("day", True, "firsts")))


def _model(spark, sf_dir, trend):
    data = _data(spark, sf_dir)
    return enrolment.model_projections(data, BOTH, False, 60, data.count() * 1.05, trend)


register("enrolment_model_projections_linear", lambda s, d: _model(s, d, "linear"), _sql("""
SELECT CAST(day AS VARCHAR) AS day, round(yhat - 1.2815515655446004 * sd, 6) AS yhat_lower,
       round(yhat + 1.2815515655446004 * sd, 6) AS yhat_upper, round(yhat, 6) AS yhat,
       site AS "SITE", strata1 AS "STRATA1" FROM fitted
WHERE day <= (SELECT coalesce(min(day), DATE '9999-12-31') FROM (
                SELECT day FROM fitted GROUP BY day
                HAVING sum(yhat) >= (SELECT count(*) FROM enrolment) * CAST(1.05 AS DOUBLE)))""",
    """
daily AS (SELECT site, strata1, CAST(enr_date AS DATE) AS day, count(*) AS c
          FROM enrolment GROUP BY ALL),
totals AS (SELECT site, strata1, day, day - DATE '1992-01-01' AS x,
                  CAST(sum(c) OVER (PARTITION BY site, strata1 ORDER BY day) AS DOUBLE) AS y
           FROM daily),
line AS (SELECT site, strata1, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base,
                max(day) AS last, count(*) AS n FROM totals GROUP BY ALL),
spread AS (SELECT site, strata1, sqrt(sum(pow(y - base - slope * x, 2)) / greatest(max(n) - 2, 1))
                  AS sd FROM totals JOIN line USING (site, strata1) GROUP BY ALL),
days AS (SELECT site, strata1, day FROM totals UNION ALL
         SELECT site, strata1, last + CAST(k AS INTEGER) FROM line, range(1, 61) r(k)),
fitted AS (SELECT site, strata1, day, base + slope * (day - DATE '1992-01-01') AS yhat, sd
           FROM days JOIN line USING (site, strata1) JOIN spread USING (site, strata1))"""))

# The same segmentation with the errors of all stretches taken by regression over their rows.
_LEVELS = 6
_SEGMENTED = (
    """
daily AS (SELECT site, strata1, CAST(enr_date AS DATE) AS day, count(*) AS c
          FROM enrolment GROUP BY ALL),
totals AS (SELECT site, strata1, day,
                  CAST(day - min(day) OVER (PARTITION BY site, strata1) AS DOUBLE) AS x,
                  CAST(sum(c) OVER (PARTITION BY site, strata1 ORDER BY day) AS DOUBLE) AS y,
                  row_number() OVER (PARTITION BY site, strata1 ORDER BY day) AS r,
                  count(*) OVER (PARTITION BY site, strata1) AS n FROM daily),
marks AS (SELECT DISTINCT site, strata1, n,
                 CASE WHEN i = 26 THEN n
                      ELSE CAST(floor(CAST(0.8 AS DOUBLE) * i / 25 * n) AS BIGINT) END AS r
          FROM (SELECT DISTINCT site, strata1, n FROM totals), range(0, 27) g(i)),
pieces AS (
  SELECT a.site, a.strata1, a.r AS a, b.r AS b, a.n,
         coalesce(regr_slope(t.y, t.x), 0) AS slope, avg(t.x) AS mean_x, avg(t.y) AS mean_y,
         greatest(coalesce(regr_syy(t.y, t.x) - coalesce(regr_slope(t.y, t.x), 0)
                           * regr_sxy(t.y, t.x), 0), 0) AS sse
  FROM marks a JOIN marks b ON a.site = b.site AND a.strata1 = b.strata1
    AND (b.r >= a.r + 2 OR (a.r = 0 AND b.r = a.n))
  JOIN totals t ON t.site = a.site AND t.strata1 = a.strata1 AND t.r > a.r AND t.r <= b.r
  GROUP BY ALL),
best1 AS (SELECT site, strata1, n, b, sse, [a] AS path FROM pieces WHERE a = 0)""",
    *(f"""
best{k} AS (SELECT site, strata1, n, b, sse, path FROM (
  SELECT p.site, p.strata1, p.n, p.b, h.sse + p.sse AS sse, list_append(h.path, p.a) AS path,
         row_number() OVER (PARTITION BY p.site, p.strata1, p.b
                            ORDER BY h.sse + p.sse, list_append(h.path, p.a)) AS place
  FROM best{k - 1} h JOIN pieces p ON p.site = h.site AND p.strata1 = h.strata1 AND p.a = h.b)
  WHERE place = 1)""" for k in range(2, _LEVELS + 1)),
    f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, strata1 ORDER BY
             n * ln(greatest(sse / n, 1e-9)) + (3 * k - 1) * ln(n), k, path) AS place
           FROM ({" UNION ALL ".join(f"SELECT *, {k} AS k FROM best{k}"
                                     for k in range(1, _LEVELS + 1))}) WHERE b = n),
edges AS (SELECT site, strata1, sse AS total, k, unnest(path) AS a,
                 unnest(list_append(path[2:], n)) AS b FROM ranked WHERE place = 1),
lines AS (SELECT p.*, total, k, sqrt(total / greatest(n - 2 * k, 1)) AS sd
          FROM pieces p JOIN edges e USING (site, strata1, a, b)),
days AS (SELECT site, strata1, day, x, r FROM totals UNION ALL
         SELECT site, strata1, day + CAST(k AS INTEGER), x + k, n
         FROM totals, range(1, 61) g(k) WHERE r = n),
fitted AS (SELECT d.site, d.strata1, d.day, mean_y + slope * (x - mean_x) AS yhat, sd
           FROM days d JOIN lines l ON d.site = l.site AND d.strata1 = l.strata1
             AND d.r > l.a AND d.r <= l.b)""")

register("enrolment_model_projections_changepoint",
         lambda s, d: _model(s, d, "changepoint"), _sql("""
SELECT CAST(day AS VARCHAR) AS day, round(yhat - 1.2815515655446004 * sd, 6) AS yhat_lower,
       round(yhat + 1.2815515655446004 * sd, 6) AS yhat_upper, round(yhat, 6) AS yhat,
       site AS "SITE", strata1 AS "STRATA1" FROM fitted
WHERE day <= (SELECT coalesce(min(day), DATE '9999-12-31') FROM (
                SELECT day FROM fitted GROUP BY day
                HAVING sum(yhat) >= (SELECT count(*) FROM enrolment) * CAST(1.05 AS DOUBLE)))""",
                                                            *_SEGMENTED))
register("enrolment_trend_breaks", lambda s, d: enrolment.trend_breaks(_data(s, d), BOTH, False),
         _sql("""
SELECT l.site AS "SITE", l.strata1 AS "STRATA1", CAST(f.day AS VARCHAR) AS first_day,
       CAST(t.day AS VARCHAR) AS last_day, l.b - l.a AS days, round(slope, 6) AS rate,
       round(mean_y + slope * (t.x - mean_x), 6) AS reached
FROM lines l JOIN totals f ON f.site = l.site AND f.strata1 = l.strata1 AND f.r = l.a + 1
JOIN totals t ON t.site = l.site AND t.strata1 = l.strata1 AND t.r = l.b""", *_SEGMENTED))

register("enrolment_level_grid", lambda s, d: complete_grid(
    enrolment.working_data(_data(s, d), BOTH, True), [*BOTH, "week"], ["value"]),
    _sql("""
SELECT s.site AS "SITE", t.strata1 AS "STRATA1", CAST(w.week AS VARCHAR) AS week,
       coalesce(x.value, 0) AS value
FROM (SELECT DISTINCT site FROM working) s CROSS JOIN (SELECT DISTINCT strata1 FROM working) t
CROSS JOIN (SELECT DISTINCT week FROM working) w
LEFT JOIN working x ON x.site = s.site AND x.strata1 = t.strata1 AND x.week = w.week""",
         _working(True)))
