"""Donor profiles."""

from pyspark.sql import functions as F

from armwatch.checks.base import counted, over_collections, register
from armwatch.plans import profile
from armwatch.sources.collections import collections, profile_view
from armwatch.sources.tables import by_key


def _data(spark, sf_dir):
    return profile_view(collections(spark, sf_dir))


def _donors_with_events(spark, sf_dir):
    """Donors with a significant event, as a table for the semi join."""
    return _data(spark, sf_dir).where("sig_hyp").select("don_id").distinct()


def _bucketed(spark, sf_dir):
    return by_key(_data(spark, sf_dir), "don_id", ("col_date",), buckets=8)


def _demographics_sql(where: str) -> str:
    return over_collections(f"""
SELECT don_id AS donor_id, site, "group", status, gender, round(age_num, 6) AS age,
       round(weight_num, 6) AS first_weight, round(bmi_num, 6) AS first_bmi,
       round(hct, 6) AS first_hct
FROM (SELECT *, row_number() OVER (PARTITION BY don_id
        ORDER BY col_date, proc_start, col_id, hct, weight_num) AS place
      FROM collections WHERE {where}) WHERE place = 1""")


register("profile_demographics", lambda s, d: profile.summary_dem(_data(s, d)),
         _demographics_sql("TRUE"))
register("profile_demographics_donor_list",
         lambda s, d: profile.summary_dem(_data(s, d), [str(i) for i in range(10, 60)]),
         _demographics_sql(f"don_id IN ({', '.join(repr(str(i)) for i in range(10, 60))})"))
register("profile_demographics_donor_table",
         lambda s, d: profile.summary_dem(_data(s, d), _donors_with_events(s, d)),
         _demographics_sql("don_id IN (SELECT don_id FROM collections WHERE sig_hyp)"))

_COLLECTIONS_SQL = over_collections(f"""
SELECT don_id AS donor_id, count(DISTINCT col_id) AS n_collections,
       {counted('sig_hyp')} AS n_sig_hyp, {counted('all_ae')} AS n_all_ae,
       round(avg(duration_minutes), 6) AS mean_duration_minutes,
       round(avg(speed), 6) AS mean_speed,
       round(max(weight_num) - min(weight_num), 6) AS diff_weight,
       round(max(bmi_num) - min(bmi_num), 6) AS diff_bmi,
       round(max(hct) - min(hct), 6) AS diff_hct
FROM collections GROUP BY don_id""")
register("profile_collections", lambda s, d: profile.summary_col(_data(s, d)), _COLLECTIONS_SQL)
register("profile_collections_bucketed", lambda s, d: profile.summary_col(_bucketed(s, d)),
         _COLLECTIONS_SQL)
register("profile_demographics_bucketed", lambda s, d: profile.summary_dem(_bucketed(s, d)),
         _demographics_sql("TRUE"))


def _chronology_sql(where: str) -> str:
    return over_collections(f"""
SELECT don_id AS donor_id, col_id AS collection_id, dev_id AS device_id,
       CAST(col_date AS VARCHAR) AS collection_date,
       strftime(proc_start, '%Y-%m-%d %H:%M:%S') AS procedure_start,
       strftime(proc_end, '%Y-%m-%d %H:%M:%S') AS procedure_end,
       round(duration_minutes, 6) AS duration_minutes, round(speed, 6) AS speed,
       round(yield, 6) AS yield, round(target_vol, 6) AS target_volume,
       round(actual_vol, 6) AS actual_volume, round(weight_num, 6) AS weight,
       round(bmi_num, 6) AS bmi, round(hct, 6) AS hct,
       CAST(date_diff('day', first_value(col_date) OVER w, col_date) AS BIGINT) AS days_total,
       CAST(coalesce(date_diff('day', lag(col_date) OVER w, col_date), 0) AS BIGINT) AS days_lag,
       concat_ws(', ', CASE WHEN "1.1" THEN '1.1' END, CASE WHEN "1.2" THEN '1.2' END,
                 CASE WHEN "2.1" THEN '2.1' END, CASE WHEN "3.1" THEN '3.1' END) AS event_type
FROM collections WHERE {where}
WINDOW w AS (PARTITION BY don_id ORDER BY col_date, proc_start, col_id, dev_id, proc_end,
             duration_minutes, speed)""")


register("profile_chronology", lambda s, d: profile.chronology(_data(s, d)),
         _chronology_sql("TRUE"))
register("profile_chronology_donor_list",
         lambda s, d: profile.chronology(_data(s, d), ["10", "11", "12", "13"]),
         _chronology_sql("don_id IN ('10', '11', '12', '13')"))
register("profile_chronology_repeated_rows",
         lambda s, d: profile.chronology(_data(s, d).unionByName(_data(s, d))).groupBy(
             "donor_id").agg(F.sum("days_lag").alias("days_lag"),
                             F.max("days_total").alias("days_total"), F.count("*").alias("rows")),
         over_collections("""
SELECT don_id AS donor_id, CAST(max(col_date) - min(col_date) AS BIGINT) AS days_lag,
       CAST(max(col_date) - min(col_date) AS BIGINT) AS days_total, 2 * count(*) AS rows
FROM collections GROUP BY don_id"""))
register("profile_events_by_type",
         lambda s, d: profile.chronology(_data(s, d)).groupBy("event_type").agg(
             F.count(F.lit(1)).alias("n")),
         over_collections("""
SELECT concat_ws(', ', CASE WHEN "1.1" THEN '1.1' END, CASE WHEN "1.2" THEN '1.2' END,
                 CASE WHEN "2.1" THEN '2.1' END, CASE WHEN "3.1" THEN '3.1' END) AS event_type,
       count(*) AS n FROM collections GROUP BY 1"""))
