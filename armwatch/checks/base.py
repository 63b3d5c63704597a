"""Registry of the queries over the star-schema files, each with the same query in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwatch.columns import col

DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Comparable values: rounded doubles, dates and timestamps as text, whole numbers as bigint."""
    def shown(field: T.StructField):
        value = col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value, digits)
        elif isinstance(field.dataType, T.DateType):
            value = value.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            value = value.cast("bigint")
        return value.alias(field.name)

    return df.select(*(shown(field) for field in df.schema.fields))


def register(name: str, query: Query, sql: str | None = None, digits: int = DIGITS) -> None:
    if name in QUERIES:
        raise KeyError(f"Query {name} is registered twice.")
    QUERIES[name] = lambda spark, sf_dir: present(query(spark, sf_dir), digits)
    if sql is not None:
        SQL[name] = sql


# The analysis tables of armwatch.sources.collections, written in SQL.
COLLECTIONS = """
base AS (
  SELECT CAST(o_custkey AS VARCHAR) AS don_id,
         CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS col_id,
         CAST(l_suppkey % 40 AS VARCHAR) AS dev_id,
         CAST(l_shipdate AS DATE) AS col_date,
         CAST(l_shipdate AS DATE) + to_hours(7 + l_linenumber) AS proc_start,
         30 + l_quantity AS duration_minutes,
         concat('S', CAST(c_nationkey % 6 AS VARCHAR)) AS site,
         CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS "group",
         CASE WHEN o_custkey % 3 = 0 THEN 'female' ELSE 'male' END AS gender,
         CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'experienced' END AS status,
         CAST(18 + (o_custkey * 7) % 60 AS DOUBLE) AS age_num,
         CAST(60 + (o_custkey * 5) % 17 AS DOUBLE) AS height,
         CAST(110 + (o_custkey * 13) % 190 + (l_orderkey * 7) % 9 AS DOUBLE) AS weight_num,
         CAST(38 + (l_orderkey * 3 + l_linenumber) % 14 AS DOUBLE) AS hct,
         CAST(690 + 10 * ((o_custkey * 13) % 20) AS DOUBLE) AS target_vol,
         CAST(690 + 10 * ((o_custkey * 13) % 20) AS DOUBLE)
           * (CAST(1.05 AS DOUBLE) - l_discount) AS actual_vol,
         TRUE AS itt,
         o_orderpriority <> '4-NOT SPECIFIED' AS mitt,
         o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS pp,
         (l_orderkey * 13 + l_linenumber * 7) % 100 < 6 AS "1.1",
         (l_orderkey * 17 + l_linenumber * 11) % 400
           < CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 3 END AS "1.2",
         (l_orderkey * 19 + l_linenumber * 3) % 200 < 5 AS "2.1",
         (l_orderkey * 23 + l_linenumber * 5) % 500 < 4 AS "3.1",
         CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS wd_fl,
         l_orderkey % 50 = 0 AS volume_lost
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey),
flagged AS (
  SELECT *, weight_num * 703 / (height * height) AS bmi_num,
         proc_start + to_minutes(CAST(duration_minutes AS BIGINT)) AS proc_end,
         actual_vol / duration_minutes AS speed,
         actual_vol / target_vol AS yield,
         1 - actual_vol / target_vol AS yield_resid,
         CAST(date_trunc('week', col_date) AS DATE) AS week,
         "1.1" OR "1.2" AS hyp, "1.2" AS sig_hyp, "2.1" OR "3.1" AS non_hyp,
         "1.1" OR "1.2" OR "2.1" OR "3.1" AS all_ae,
         "1.1" AND NOT "1.2" AS "only_1.1"
  FROM base),
edges AS (
  SELECT quantile_cont(weight_num, 0.25) AS e1, quantile_cont(weight_num, 0.5) AS e2,
         quantile_cont(weight_num, 0.75) AS e3 FROM flagged),
collections AS (
  SELECT flagged.*,
         CASE WHEN age_num >= 18 AND age_num < 25 THEN '18-24' WHEN age_num < 40 THEN '25-39'
              WHEN age_num < 65 THEN '40-64' WHEN age_num < 1000 THEN '65+' END AS age,
         CASE WHEN bmi_num >= 0 AND bmi_num < 18.5 THEN 'underweight'
              WHEN bmi_num < 25 THEN 'normal' WHEN bmi_num < 30 THEN 'overweight'
              WHEN bmi_num < 1000 THEN 'obese' END AS bmi,
         CASE WHEN weight_num <= e1 THEN 'q1' WHEN weight_num <= e2 THEN 'q2'
              WHEN weight_num <= e3 THEN 'q3' ELSE 'q4' END AS weight_cat
  FROM flagged, edges)"""

ENROLMENT = """
enrolment AS (
  SELECT o_orderdate AS enr_date, CAST(o_custkey AS VARCHAR) AS subject_id,
         concat('S', CAST(c_nationkey % 6 AS VARCHAR)) AS site,
         CASE WHEN o_custkey % 3 = 0 THEN 'female' ELSE 'male' END AS strata1,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS week
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

DASHBOARD = """
dashboard AS (
  SELECT don_id AS donor_id, wd_fl, "group" AS trt_group, site, gender, status AS donor_status,
         age AS age_cat, weight_cat, bmi AS bmi_cat,
         CASE WHEN hct >= 0 AND hct < 36 THEN '0-36' WHEN hct < 40 THEN '36-40'
              WHEN hct < 45 THEN '41-45' WHEN hct < 50 THEN '46-50'
              WHEN hct < 100 THEN '50+' END AS hct_cat,
         target_vol AS target_volume, actual_vol AS actual_volume, yield
  FROM collections)"""


def over(body: str, *ctes: str, recursive: bool = False) -> str:
    """Statement over the named analysis tables."""
    word = "WITH RECURSIVE" if recursive else "WITH"
    return f"{word} {','.join(ctes)}\n{body}"


def over_collections(body: str, *more: str, recursive: bool = False) -> str:
    return over(body, COLLECTIONS, *more, recursive=recursive)


def counted(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def quoted(name: str) -> str:
    return f'"{name}"'
