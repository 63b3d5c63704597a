"""Dashboard tables."""

from pyspark.sql import functions as F

from armwatch.checks.base import COLLECTIONS, DASHBOARD, over, register
from armwatch.plans import dashboard
from armwatch.sources.collections import collections, dashboard_view


def _data(spark, sf_dir):
    return dashboard_view(collections(spark, sf_dir, quartiles=True))


def _sql(body: str, *more: str) -> str:
    return over(body, COLLECTIONS, DASHBOARD, *more)


def _digits(metric: str) -> int:
    """Volume totals carry the noise of the summation order; the yield of all rows at sf0.01 has
    exactly seven decimals, so six would be a rounding tie."""
    return 3 if metric.endswith("_volume") else 7


def _transposed(source: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric,
        round(max(CASE WHEN trt_group = 'A' THEN "{m}" END), {_digits(m)}) AS "group_A",
        round(max(CASE WHEN trt_group = 'B' THEN "{m}" END), {_digits(m)}) AS "group_B",
        round(max(CASE WHEN trt_group = 'grand_total' THEN "{m}" END), {_digits(m)}) AS total
        FROM {source}""" for m in metrics)


register("dashboard_donations", lambda s, d: dashboard.summary_donation(_data(s, d)), _sql(
    _transposed("rated", ["n_donors", "n_donations", "n_withdrawals", "repeat_don_rate"]), """
arms AS (SELECT trt_group, CAST(count(DISTINCT donor_id) AS DOUBLE) AS n_donors,
                CAST(count(donor_id) AS DOUBLE) AS n_donations,
                CAST(sum(wd_fl) AS DOUBLE) AS n_withdrawals FROM dashboard GROUP BY trt_group),
rated AS (SELECT *, n_donations / n_donors AS repeat_don_rate FROM (
            SELECT * FROM arms UNION ALL
            SELECT 'grand_total', sum(n_donors), sum(n_donations), sum(n_withdrawals) FROM arms))
"""), digits=7)

_COLUMNS = dashboard.GROUPINGS


def _count(donor_level: bool) -> str:
    return "count(DISTINCT donor_id)" if donor_level else "count(donor_id)"


def _site(donor_level: bool) -> str:
    return f"SELECT site AS level, {_count(donor_level)} AS value FROM dashboard GROUP BY site"


def _within(by: str, donor_level: bool) -> str:
    count, column = _count(donor_level), _COLUMNS[by]
    return f"""
SELECT concat(trt_group, '_', lower({column})) AS level,
       round(CAST({count} AS DOUBLE) / max(t), 6) AS value
FROM dashboard JOIN (SELECT trt_group, {count} AS t FROM dashboard GROUP BY trt_group)
  USING (trt_group) GROUP BY trt_group, {column}"""


def _across(by: str, donor_level: bool) -> str:
    column = _COLUMNS[by]
    return f"""
SELECT level, round(a / (a + b), 6) AS "A", round(b / (a + b), 6) AS "B", a + b AS grand_total
FROM (SELECT lower({column}) AS level,
             coalesce(sum(CASE WHEN trt_group = 'A' THEN n END), 0.0) AS a,
             coalesce(sum(CASE WHEN trt_group = 'B' THEN n END), 0.0) AS b
      FROM (SELECT {column}, trt_group, CAST({_count(donor_level)} AS DOUBLE) AS n
            FROM dashboard WHERE {column} IS NOT NULL GROUP BY ALL) GROUP BY 1)"""


for _by in _COLUMNS:
    for _level in (True, False):
        _make = _site if _by == "SITE" else _within if _by in ("GENDER", "STATUS") else _across
        register(f"dashboard_{_by.lower()}_{'donors' if _level else 'donations'}",
                 lambda s, d, by=_by, level=_level: dashboard.summary_demographic(
                     _data(s, d), by, level),
                 _sql(_site(_level) if _by == "SITE" else _make(_by, _level)))

_ALL = [f"""SELECT 'site' AS grouping, level, 'value' AS series, CAST(value AS DOUBLE) AS value
        FROM ({_site(True)})"""]
_ALL += [f"SELECT '{by.lower()}', level, 'value', value FROM ({_within(by, True)})"
         for by in ("GENDER", "STATUS")]
_ALL += [f"""SELECT '{by.lower()}', level, '{series}', "{series}" FROM ({_across(by, True)})"""
         for by in ("AGE", "WEIGHT", "BMI", "HEMO") for series in ("A", "B", "grand_total")]
register("dashboard_all_demographics", lambda s, d: dashboard.all_demographics(_data(s, d)),
         _sql(" UNION ALL ".join(_ALL)))

_METRICS = ["target_volume", "actual_volume", "n_overdraws", "n_underdraws", "n_underdraws_0.25",
            "n_underdraws_0.5", "n_underdraws_0.75"]
_SUMS = ", ".join(f'sum("{m}") AS "{m}"' for m in [*_METRICS, "yield", "n"])


def _metrics(spark, sf_dir):
    table = dashboard.summary_metric(_data(spark, sf_dir))
    arms = ("group_A", "group_B", "total")
    return table.select("metric", *(
        F.when(F.col("metric").endswith("_volume"), F.round(arm, 3)).otherwise(F.round(arm, 7))
        .alias(arm) for arm in arms))


register("dashboard_metrics", _metrics, _sql(
    _transposed("averaged", [*_METRICS, "average_actual", "average_target", "average_yield"]),
    f"""
flags AS (
  SELECT *, CAST(1 AS DOUBLE) AS n,
         CAST(target_volume > actual_volume AS DOUBLE) AS n_overdraws,
         CAST(target_volume < actual_volume AS DOUBLE) AS n_underdraws,
         CAST(0.25 * actual_volume > target_volume AS DOUBLE) AS "n_underdraws_0.25",
         CAST(0.5 * actual_volume > target_volume AS DOUBLE) AS "n_underdraws_0.5",
         CAST(0.75 * actual_volume > target_volume AS DOUBLE) AS "n_underdraws_0.75"
  FROM dashboard),
arms AS (SELECT trt_group, {_SUMS} FROM flags GROUP BY trt_group
         UNION ALL SELECT 'grand_total', {_SUMS} FROM flags),
averaged AS (SELECT *, actual_volume / n AS average_actual, target_volume / n AS average_target,
                    yield / n AS average_yield FROM arms)"""), digits=7)
