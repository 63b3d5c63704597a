"""Plasma volume under the two nomograms."""

from pyspark.sql import functions as F

from armwatch.checks.base import over_collections, register
from armwatch.plans import volume
from armwatch.sources.collections import collections, volume_view


def _data(spark, sf_dir):
    return volume_view(collections(spark, sf_dir, quartiles=True))


def _target(share: float) -> str:
    return f"""least(CAST(1000 AS DOUBLE), 70 / sqrt((weight_num * CAST(0.453592 AS DOUBLE))
      / ((height * CAST(0.0254 AS DOUBLE)) * (height * CAST(0.0254 AS DOUBLE))) / 22)
      * (weight_num * CAST(0.453592 AS DOUBLE)) * (1 - hct / 100) * CAST({share} AS DOUBLE))"""


_VOLUME = f"""
volumes AS (
  SELECT *, {_target(.285)} AS persona_1, {_target(.305)} AS persona_2, col_date AS day,
         CAST(date_trunc('month', col_date) AS DATE) AS month
  FROM collections WHERE "group" = 'A')"""

_KEEP = ("col_id", "col_date", "day", "week", "month", "persona_1", "persona_2")
register("volume_nomograms",
         lambda s, d: volume.with_nomograms(_data(s, d)).select(*_KEEP), over_collections("""
SELECT col_id, CAST(col_date AS VARCHAR) AS col_date, CAST(day AS VARCHAR) AS day,
       CAST(week AS VARCHAR) AS week, CAST(month AS VARCHAR) AS month,
       round(persona_1, 6) AS persona_1, round(persona_2, 6) AS persona_2 FROM volumes""", _VOLUME))

register("volume_collection_summary", lambda s, d: volume.collection_summary(_data(s, d)).withColumn(
    "total_plasma_collected", F.round("total_plasma_collected", 3)),
         over_collections("""
SELECT "group", round(avg(yield), 6) AS average_yield,
       round(sum(actual_vol), 3) AS total_plasma_collected,
       round(avg(target_vol), 6) AS average_target_volume,
       round(avg(actual_vol), 6) AS average_collected_volume
FROM collections GROUP BY "group" """))

# Student quantile of 0.975 by its expansion in 1/df around the normal one.
_T = """(1.959963984540054 + (pow(1.959963984540054,3)+1.959963984540054)/(4*df)
  + (5*pow(1.959963984540054,5)+16*pow(1.959963984540054,3)+3*1.959963984540054)/(96*df*df)
  + (3*pow(1.959963984540054,7)+19*pow(1.959963984540054,5)+17*pow(1.959963984540054,3)
     -15*1.959963984540054)/(384*df*df*df))"""
for _stratum, _pop in (("gender", "mitt"), ("site", "itt"), ("weight_cat", "pp")):
    register(f"volume_comparative_gain_{_stratum}",
             lambda s, d, k=_stratum, p=_pop: volume.comparative_gain(_data(s, d), p, k),
             over_collections(f"""
SELECT {_stratum}, round(gain - {_T} * sqrt(v1 + v2), 6) AS "left",
       round(gain + {_T} * sqrt(v1 + v2), 6) AS "right", round(gain, 6) AS mean
FROM (SELECT *, (v1 + v2) * (v1 + v2) / (v1 * v1 / (n - 1) + v2 * v2 / (n - 1)) AS df
      FROM (SELECT {_stratum}, avg(persona_2) - avg(persona_1) AS gain, count(*) AS n,
                   var_samp(persona_1) / count(*) AS v1, var_samp(persona_2) / count(*) AS v2
            FROM (SELECT {_stratum}, persona_1, persona_2 FROM volumes WHERE {_pop}
                  UNION ALL SELECT 'overall', persona_1, persona_2 FROM volumes WHERE {_pop})
            GROUP BY 1))""", _VOLUME))

for _period in ("day", "week", "month"):
    register(f"volume_longitudinal_{_period}",
             lambda s, d, p=_period: volume.longitudinal_stat(_data(s, d), "mitt", p),
             over_collections(f"""
SELECT CAST({_period} AS VARCHAR) AS {_period}, round(avg(persona_1), 6) AS persona_1,
       round(avg(persona_2), 6) AS persona_2,
       round(avg(persona_2) - avg(persona_1), 6) AS delta
FROM volumes WHERE mitt GROUP BY {_period}""", _VOLUME))
