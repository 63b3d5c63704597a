"""Sources, sinks, preparation and filters over the collections written as a study export."""

from __future__ import annotations

from pyspark.sql import functions as F

from armwatch.checks.base import counted, over_collections, quoted, register
from armwatch.columns import col
from armwatch.operators import filters, ledger, prepare, quantiles, shape
from armwatch.session import scratch_dir, stored
from armwatch.sources import tables
from armwatch.sources.collections import (
    collections, dashboard_view, enrolment_view, profile_view, raw_view, safety_view, volume_view)
from armwatch.sources.contract import (
    AGE_BINS, AGE_LABELS, DASHBOARD, ENROLMENT, PLASMA, POWER, PROFILE, QUARTILES,
    RAW_PROFILE, RAW_SAFETY, SAFETY, VOLUMES)

FLAGS = ("itt", "mitt", "pp", "all_ae", "non_hyp", "hyp", "sig_hyp", "only_1.1")
CODES = ("1.1", "1.2", "2.1", "3.1")


def _scratch(spark) -> str:
    """A new folder per call under the shared scratch folder."""
    return f"{scratch_dir(spark)}/table"


def _raw(spark, sf_dir):
    return raw_view(collections(spark, sf_dir))


def _export(spark, sf_dir):
    """The study export as a table, for preparations that read it twice (quartiles, then rows)."""
    return stored(_raw(spark, sf_dir))


# ------------------------------------------------------------- SQL of the raw pipeline

# Text dates carry no seconds and flags come back as booleans, so apart from the lost volumes the
# preparation gives the analysis columns again.
_KEPT = """
lost AS (SELECT *, CASE WHEN volume_lost THEN 0.0 ELSE actual_vol END AS recorded FROM collections),
kept AS (SELECT * FROM lost WHERE recorded <> 0),
kept_edges AS (SELECT quantile_cont(weight_num, 0.25) AS k1, quantile_cont(weight_num, 0.5) AS k2,
                      quantile_cont(weight_num, 0.75) AS k3 FROM kept),
kept_binned AS (SELECT kept.*, CASE WHEN weight_num <= k1 THEN 'q1' WHEN weight_num <= k2 THEN 'q2'
                  WHEN weight_num <= k3 THEN 'q3' ELSE 'q4' END AS weight_q FROM kept, kept_edges)"""

_IDS = "don_id, col_id, CAST(col_date AS VARCHAR) AS col_date"
_TIMES = """dev_id, strftime(proc_start, '%Y-%m-%d %H:%M:%S') AS proc_start,
  strftime(proc_end, '%Y-%m-%d %H:%M:%S') AS proc_end"""
_SPLIT = """site, status, "group", gender"""
_VOLUMES = """round(target_vol, 6) AS target_vol, round(actual_vol, 6) AS actual_vol,
  round(duration_minutes, 6) AS duration_minutes, round(speed, 6) AS speed,
  round(yield, 6) AS yield, round(yield_resid, 6) AS yield_resid"""


def _names(names) -> str:
    return ", ".join(quoted(name) for name in names)


register("prepare_safety", lambda s, d: prepare.prepare_safety(_raw(s, d)).data,
         over_collections(f"""
SELECT {_IDS}, {_SPLIT}, age, bmi, weight_q AS weight, {_names(FLAGS)}, {_names(CODES)}
FROM (SELECT collections.*, CASE WHEN weight_num <= e1 THEN 'q1' WHEN weight_num <= e2 THEN 'q2'
             WHEN weight_num <= e3 THEN 'q3' ELSE 'q4' END AS weight_q
      FROM collections, edges)"""))
register("prepare_plasma", lambda s, d: prepare.prepare_plasma(_export(s, d)).data,
         over_collections(f"""
SELECT {_IDS}, {_TIMES}, {_VOLUMES}, CAST(week AS VARCHAR) AS week, {_SPLIT}, age, bmi,
       weight_q AS weight_cat, {_names(FLAGS)} FROM kept_binned""", _KEPT))
_PROFILE_FLAGS = ("itt", "mitt", "pp", "all_ae", "sig_hyp")
register("prepare_profile", lambda s, d: prepare.prepare_profile(_export(s, d)).data,
         over_collections(f"""
SELECT {_IDS}, {_TIMES}, {_VOLUMES}, {_SPLIT}, round(hct, 6) AS hct, round(age_num, 6) AS age,
       round(bmi_num, 6) AS bmi, round(weight_num, 6) AS weight, age AS age_cat, bmi AS bmi_cat,
       weight_q AS weight_cat, {_names(_PROFILE_FLAGS)}, {_names(CODES)} FROM kept_binned""",
                          _KEPT))
register("prepare_rejected_rows",
         lambda s, d: prepare.prepare_plasma(_raw(s, d)).missing.select(
             "don_id", "col_id", "col_date", "target_vol", "actual_vol", "gender"),
         over_collections(f"""
SELECT {_IDS}, round(target_vol, 6) AS target_vol, CAST(NULL AS DOUBLE) AS actual_vol, gender
FROM lost WHERE recorded = 0""", _KEPT))
register("prepare_split_is_complete",
         lambda s, d: _split_counts(prepare.prepare_profile(_raw(s, d))),
         over_collections("""
SELECT recorded <> 0 AS kept, count(*) AS rows FROM lost GROUP BY 1""", _KEPT))


def _split_counts(split):
    kept = split.data.select(F.lit(True).alias("kept"))
    return kept.unionByName(split.missing.select(F.lit(False).alias("kept"))).groupBy("kept").agg(
        F.count(F.lit(1)).alias("rows"))


register("prepare_fixed_bins", lambda s, d: collections(s, d).groupBy(
    prepare.fixed_bins(col("age_num"), AGE_BINS, AGE_LABELS).alias("age")).agg(
        F.min("age_num").alias("low"), F.max("age_num").alias("high"), F.count("*").alias("n")),
    over_collections("""SELECT age, min(age_num) AS low, max(age_num) AS high, count(*) AS n
                     FROM collections GROUP BY age"""))
register("prepare_quantile_bins", lambda s, d: prepare.quantile_bins(
    collections(s, d), "speed", QUARTILES, "bin").groupBy("bin").agg(F.count("*").alias("n")),
    over_collections("""
SELECT CASE WHEN speed <= s1 THEN 'q1' WHEN speed <= s2 THEN 'q2' WHEN speed <= s3 THEN 'q3'
            ELSE 'q4' END AS bin, count(*) AS n
FROM collections, (SELECT quantile_cont(speed, 0.25) AS s1, quantile_cont(speed, 0.5) AS s2,
                          quantile_cont(speed, 0.75) AS s3 FROM collections) GROUP BY 1"""))
register("prepare_exact_quantiles", lambda s, d: quantiles.exact_quantiles(
    collections(s, d), ["site"], ["speed", "actual_vol"], [0, .1, .5, .999, 1]),
    over_collections(" UNION ALL ".join(
        f"""SELECT site, '{m}' AS variable, CAST({p} AS DOUBLE) AS prob,
        round(quantile_cont({m}, {p}), 6) AS value FROM collections GROUP BY site"""
        for m in ("speed", "actual_vol") for p in (0, .1, .5, .999, 1))))
register("prepare_period_start", lambda s, d: collections(s, d).groupBy(*(
    prepare.period_start(col("col_date"), p).alias(p) for p in ("day", "week", "month"))).agg(
        F.count("*").alias("n")),
    over_collections("""
SELECT CAST(col_date AS VARCHAR) AS day, CAST(week AS VARCHAR) AS week,
       CAST(CAST(date_trunc('month', col_date) AS DATE) AS VARCHAR) AS month, count(*) AS n
FROM collections GROUP BY ALL"""))
_LEVELS = ("site", "status", "group", "gender", "age", "bmi")
register("prepare_category_levels", lambda s, d: filters.level_table(collections(s, d), _LEVELS),
         over_collections(" UNION ".join(
             f"SELECT '{c}' AS variable, {quoted(c)} AS level FROM collections" for c in _LEVELS)))


# ----------------------------------------------------------------------------- sources, sinks

_COUNT_SQL = over_collections(f"""
SELECT "group", count(*) AS rows, {counted('sig_hyp')} AS sig_hyp,
       CAST(min(col_date) AS VARCHAR) AS first_day FROM collections GROUP BY "group" """)


def _by_group(df):
    return df.groupBy(col("group")).agg(
        F.count("*").alias("rows"), F.sum(col("sig_hyp").cast("int")).alias("sig_hyp"),
        F.min("col_date").alias("first_day"))


def _raw_csv(spark, sf_dir):
    path = _scratch(spark)
    tables.save_rows(_raw(spark, sf_dir), path, "csv")
    return tables.read_csv(spark, path, RAW_SAFETY, raw=True)


def _processed(spark, sf_dir, contract, view, file_format, month_of=None):
    path = _scratch(spark)
    table = view(collections(spark, sf_dir, quartiles=True))
    keep = [c for c in contract.selected(table.columns) if c in table.columns]
    tables.save_rows(table.select(*(col(c) for c in keep)), path, file_format, month_of=month_of)
    return path


_ENROLLED = """
SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "ENR_DATE",
       CAST(o_custkey AS VARCHAR) AS "SUBJECT_ID",
       concat('S', CAST(c_nationkey % 6 AS VARCHAR)) AS "SITE",
       CASE WHEN o_custkey % 3 = 0 THEN 'female' ELSE 'male' END AS "STRATA1"
FROM orders JOIN customer ON o_custkey = c_custkey"""


def _enrolment_back(spark, sf_dir, file_format):
    path = _scratch(spark)
    table = enrolment_view(spark, sf_dir)
    tables.save_rows(table.withColumn("ENR_DATE", col("ENR_DATE").cast("timestamp_ntz")), path,
                     file_format)
    reader = tables.read_csv if file_format == "csv" else tables.read_parquet
    return reader(spark, path, ENROLMENT)


def _csv_back(spark, sf_dir, contract, view):
    return tables.read_csv(spark, _processed(spark, sf_dir, contract, view, "csv"), contract)


register("source_raw_csv", lambda s, d: _by_group(prepare.prepare_safety(_raw_csv(s, d)).data),
         _COUNT_SQL)
register("source_safety_csv", lambda s, d: _csv_back(s, d, SAFETY, safety_view),
         over_collections(f"""SELECT {_IDS}, {_SPLIT}, age, bmi, weight_cat AS weight,
                          {_names(FLAGS)}, {_names(CODES)} FROM collections"""))
register("source_power_csv", lambda s, d: _by_group(_csv_back(s, d, POWER, safety_view)),
         _COUNT_SQL)
register("source_plasma_csv", lambda s, d: _csv_back(s, d, PLASMA, lambda t: t).select(
    "don_id", "col_id", "col_date", "dev_id", "proc_start", "proc_end", "target_vol", "actual_vol",
    "duration_minutes", "speed", "yield", "yield_resid", "age", "bmi", "itt", "sig_hyp"),
    over_collections(f"""SELECT {_IDS}, {_TIMES}, {_VOLUMES}, age, bmi, itt, sig_hyp
                     FROM collections"""))
register("source_profile_csv", lambda s, d: _by_group(_csv_back(s, d, PROFILE, profile_view)),
         _COUNT_SQL)
register("source_volume_csv", lambda s, d: _csv_back(s, d, VOLUMES, volume_view).groupBy(
    "weight_cat").agg(F.count("*").alias("rows"), F.avg("hematocrit").alias("hematocrit")),
    over_collections("""SELECT weight_cat, count(*) AS rows, round(avg(hct), 6) AS hematocrit
                     FROM collections GROUP BY weight_cat"""))
register("source_enrolment_parquet", lambda s, d: _enrolment_back(s, d, "parquet"),
         _ENROLLED)
register("source_enrolment_csv", lambda s, d: _enrolment_back(s, d, "csv"), _ENROLLED)
register("source_dashboard_parquet", lambda s, d: tables.read_parquet(
    s, _processed(s, d, DASHBOARD, dashboard_view, "parquet"), DASHBOARD)
    .groupBy("trt_group").agg(F.count("donor_id").alias("rows"), F.sum("wd_fl").cast("bigint")
                              .alias("wd_fl")),
    over_collections("""SELECT "group" AS trt_group, count(*) AS rows,
                     CAST(sum(wd_fl) AS BIGINT) AS wd_fl FROM collections GROUP BY 1"""))
register("source_refreshed_by_month", lambda s, d: _by_group(_refreshed(s, d)), _COUNT_SQL)
register("sink_rejected_rows", lambda s, d: _rejected(s, d), over_collections("""
SELECT gender, count(*) AS rows FROM collections WHERE volume_lost GROUP BY gender"""))
register("source_raw_data", lambda s, d: tables.raw_data(safety_view(collections(s, d, True)), SAFETY),
         over_collections(f"""SELECT {_IDS}, {_SPLIT}, age, bmi, weight_cat AS weight,
                          {_names(FLAGS)}, {_names(CODES)} FROM collections"""))


def _in_range_by_month(spark, sf_dir):
    path = _processed(spark, sf_dir, SAFETY, safety_view, "parquet", month_of="col_date")
    table = tables.read_parquet(spark, path, SAFETY, month_of="col_date")
    rows = filters.filter_rows(table, SAFETY, "1996-01-31", "1996-04-02")
    return rows.groupBy("month").agg(F.count("*").alias("rows"), F.min("col_date").alias("first"),
                                     F.max("col_date").alias("last"))


register("source_date_range_by_month", _in_range_by_month, over_collections("""
SELECT strftime(col_date, '%Y-%m') AS month, count(*) AS rows,
       CAST(min(col_date) AS VARCHAR) AS first, CAST(max(col_date) AS VARCHAR) AS last
FROM collections WHERE col_date BETWEEN DATE '1996-01-31' AND DATE '1996-04-02' GROUP BY 1"""))


def _refreshed(spark, sf_dir):
    path = _processed(spark, sf_dir, SAFETY, safety_view, "parquet", month_of="col_date")
    old = tables.read_parquet(spark, path, SAFETY)
    return tables.refresh(spark, path, SAFETY, old)


def _with_faults(spark, sf_dir):
    """The export with procedures that end as they start, and donors without a gender."""
    raw = _raw(spark, sf_dir)
    number = col("COLLECTION_NUMBER").cast("bigint")
    return raw.withColumns({
        "PROCEDURE_END": F.when(number % 89 == 0, col("PROCEDURE_START"))
        .otherwise(col("PROCEDURE_END")),
        "GENDER": F.when(number % 83 != 0, col("GENDER"))})


def _ledger(spark, sf_dir):
    saved = ledger.save_with_ledger(_with_faults(spark, sf_dir), RAW_PROFILE, _scratch(spark))
    return ledger.as_table(spark, saved)


def _reasons(spark, sf_dir):
    path = _scratch(spark)
    ledger.save_with_ledger(_with_faults(spark, sf_dir), RAW_PROFILE, path)
    return ledger.reasons_by(ledger.rejected_rows(spark, path), ["site"])


_FAULTS = """
faults AS (SELECT *, volume_lost AS a, CAST(col_id AS BIGINT) % 89 = 0 AS b,
                  CAST(col_id AS BIGINT) % 83 = 0 AS c FROM collections)"""
register("sink_quality_ledger", _ledger, over_collections("""
SELECT entry, rows FROM (
  SELECT 'read' AS entry, count(*) AS rows FROM faults
  UNION ALL SELECT 'kept', count(*) FROM faults WHERE NOT (a OR b OR c)
  UNION ALL SELECT 'rejected', count(*) FROM faults WHERE a OR b OR c
  UNION ALL SELECT 'no actual_vol', count(*) FROM faults WHERE a
  UNION ALL SELECT 'proc_end not after proc_start', count(*) FROM faults WHERE b
  UNION ALL SELECT 'no gender', count(*) FROM faults WHERE c) WHERE rows > 0""", _FAULTS))
register("sink_rejection_reasons", _reasons, over_collections("""
SELECT site, reason, count(*) AS rows FROM (
  SELECT site, 'no actual_vol' AS reason FROM faults WHERE a
  UNION ALL SELECT site, 'proc_end not after proc_start' FROM faults WHERE b
  UNION ALL SELECT site, 'no gender' FROM faults WHERE c) GROUP BY ALL""", _FAULTS))


def _rejected(spark, sf_dir):
    path = _scratch(spark)
    tables.save_missing(prepare.prepare_profile(_raw(spark, sf_dir)).missing, path)
    return spark.read.parquet(path).groupBy("gender").agg(F.count("*").alias("rows"))


# ------------------------------------------------------------------------------------ filters

def _keys(df):
    return df.select("col_id", "don_id", "col_date")


def _filter_sql(where: str) -> str:
    return over_collections(
        f"""SELECT col_id, don_id, CAST(col_date AS VARCHAR) AS col_date FROM collections
        WHERE {where}""")


register("filter_date_range", lambda s, d: _keys(filters.filter_rows(
    collections(s, d), SAFETY, "1996-01-31", "1997-02-28")),
    _filter_sql("col_date BETWEEN DATE '1996-01-31' AND DATE '1997-02-28'"))
register("filter_date_range_clamped", lambda s, d: _keys(filters.filter_rows(
    collections(s, d), SAFETY, "1900-01-01", "1997-02-28", strict=False)),
    _filter_sql("col_date <= DATE '1997-02-28'"))
register("filter_category_and_flags", lambda s, d: _keys(filters.filter_rows(
    collections(s, d), SAFETY, query={"gender": "male", "site": "S2", "POP": "pp",
                                      "SEV": "only_1.1"})),
    _filter_sql("""gender = 'male' AND site = 'S2' AND pp AND "only_1.1" """))
register("filter_donor_list", lambda s, d: _keys(filters.of_donors(
    collections(s, d), ["20", "21", "22"])), _filter_sql("don_id IN ('20', '21', '22')"))
register("filter_experimental_population", lambda s, d: _keys(filters.in_population(
    filters.experimental_arm(collections(s, d)), "mitt")), _filter_sql('"group" = \'A\' AND mitt'))


# ------------------------------------------------------------------------------ result shapes

register("shape_split_and_overall", lambda s, d: shape.split_and_overall(
    collections(s, d), ["site"], [F.avg("speed").alias("speed"), F.count("*").alias("rows")]),
    over_collections("""
SELECT site, round(avg(speed), 6) AS speed, count(*) AS rows FROM collections GROUP BY site
UNION ALL SELECT 'overall', round(avg(speed), 6), count(*) FROM collections"""))
register("shape_wide_metrics", lambda s, d: shape.wide_metrics(shape.long_metrics(
    collections(s, d).groupBy("site").agg(F.min("hct").alias("a"), F.max("hct").alias("b")),
    ["site"], {("hct", "min"): col("a"), ("hct", "max"): col("b")}), ["site"],
    [("hct", "min"), ("hct", "max")]), over_collections("""
SELECT site, min(hct) AS hct_min, max(hct) AS hct_max FROM collections GROUP BY site"""))
register("shape_enrolment_calendar", lambda s, d: shape.calendar(
    enrolment_view(s, d).select("SITE", prepare.period_start(F.col("ENR_DATE"), "month")
                                .alias("month")), ["SITE"], "month", "1 MONTH"), """
WITH enrolment AS (
  SELECT concat('S', CAST(c_nationkey % 6 AS VARCHAR)) AS site,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month
  FROM orders JOIN customer ON o_custkey = c_custkey),
months AS (SELECT unnest(generate_series((SELECT min(month) FROM enrolment),
                                         (SELECT max(month) FROM enrolment),
                                         INTERVAL 1 MONTH)) AS month)
SELECT site AS "SITE", CAST(CAST(months.month AS DATE) AS VARCHAR) AS month
FROM months CROSS JOIN (SELECT DISTINCT site FROM enrolment)""")
