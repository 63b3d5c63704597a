"""Analysis tables derived from the star-schema Parquet files (one row per line item).

The mapping is plain column arithmetic, so the same tables can be written in SQL. Unused
columns (and the quantile behind ``weight_cat``) are pruned by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armwatch.columns import col
from armwatch.operators.prepare import fixed_bins, quantile_bins, with_measures
from armwatch.sources.contract import (
    AGE_BINS, AGE_LABELS, BMI_BINS, BMI_LABELS, HCT_BINS, HCT_LABELS, QUARTILES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Every expression is integer or double arithmetic on the source columns. What depends on the order
# and its donor only is computed once per order, before line items are joined.
_PER_ORDER = {
    "don_id": "CAST(o_custkey AS STRING)",
    "site": "concat('S', CAST(c_nationkey % 6 AS STRING))",
    "group": "IF(o_custkey % 2 = 0, 'A', 'B')",
    "gender": "IF(o_custkey % 3 = 0, 'female', 'male')",
    "status": "IF(o_orderstatus = 'P', 'new', 'experienced')",
    "age_num": "CAST(18 + (o_custkey * 7) % 60 AS DOUBLE)",
    "height": "CAST(60 + (o_custkey * 5) % 17 AS DOUBLE)",
    "weight_num": "CAST(110 + (o_custkey * 13) % 190 + (o_orderkey * 7) % 9 AS DOUBLE)",
    "target_vol": "CAST(690 + 10 * ((o_custkey * 13) % 20) AS DOUBLE)",
    "mitt": "o_orderpriority <> '4-NOT SPECIFIED'",
    "pp": "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "wd_fl": "IF(o_orderkey % 97 = 0, 1, 0)",
    "volume_lost": "o_orderkey % 50 = 0",
}
# One row per line item.
_BASE = {
    "don_id": "don_id",
    "col_id": "CAST(l_orderkey * 10 + l_linenumber AS STRING)",
    "dev_id": "CAST(l_suppkey % 40 AS STRING)",
    "col_date": "CAST(l_shipdate AS DATE)",
    "proc_start": "CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP_NTZ)"
                  " + make_dt_interval(0, 7 + l_linenumber)",
    "minutes": "CAST(30 + l_quantity AS INT)",
    "site": "`site`",
    "group": "`group`",
    "gender": "`gender`",
    "status": "`status`",
    "age_num": "`age_num`",
    "height": "`height`",
    "weight_num": "`weight_num`",
    "hct": "CAST(38 + (l_orderkey * 3 + l_linenumber) % 14 AS DOUBLE)",
    "target_vol": "`target_vol`",
    "discount": "l_discount",
    "itt": "TRUE",
    "mitt": "`mitt`",
    "pp": "`pp`",
    "1.1": "(l_orderkey * 13 + l_linenumber * 7) % 100 < 6",
    "1.2": "(l_orderkey * 17 + l_linenumber * 11) % 400 < IF(o_custkey % 2 = 0, 2, 3)",
    "2.1": "(l_orderkey * 19 + l_linenumber * 3) % 200 < 5",
    "3.1": "(l_orderkey * 23 + l_linenumber * 5) % 500 < 4",
    "wd_fl": "`wd_fl`",
    "volume_lost": "`volume_lost`",
}
_DERIVED = {
    "bmi_num": "weight_num * 703 / (height * height)",
    "actual_vol": "target_vol * (CAST(1.05 AS DOUBLE) - discount)",
    "proc_end": "proc_start + make_dt_interval(0, 0, minutes)",
    "hyp": "`1.1` OR `1.2`",
    "sig_hyp": "`1.2`",
    "non_hyp": "`2.1` OR `3.1`",
    "all_ae": "`1.1` OR `1.2` OR `2.1` OR `3.1`",
    "only_1.1": "`1.1` AND NOT `1.2`",
}


def _named(expressions: dict[str, str]) -> list[str]:
    return [f"{expression} AS `{name}`" for name, expression in expressions.items()]


def collections(spark: SparkSession, sf_dir: str, quartiles: bool = False) -> DataFrame:
    """One row per collection with ids, dates, strata, measures, populations and event flags.

    ``quartiles`` adds ``weight_cat``, which takes one more pass for the exact quartiles.
    """
    orders = _table(spark, sf_dir, "orders").join(
        _table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
            "o_orderkey", "o_custkey", *_named(_PER_ORDER))
    joined = _table(spark, sf_dir, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey"))
    base = joined.selectExpr(*_named(_BASE)).selectExpr("*", *_named(_DERIVED))
    derived = with_measures(base.drop("discount", "minutes")).withColumns({
        "age": fixed_bins(col("age_num"), AGE_BINS, AGE_LABELS),
        "bmi": fixed_bins(col("bmi_num"), BMI_BINS, BMI_LABELS),
    })
    if not quartiles:
        return derived
    return quantile_bins(derived, "weight_num", QUARTILES, "weight_cat")


def safety_view(data: DataFrame) -> DataFrame:
    """Safety contract: weight is its quartile, where that was asked for."""
    return data.withColumnRenamed("weight_cat", "weight")


def profile_view(data: DataFrame) -> DataFrame:
    """Profile contract: demographics as numbers."""
    return data.withColumns({name: col(f"{name}_num") for name in ("age", "bmi", "weight")})


def volume_view(data: DataFrame) -> DataFrame:
    """Volume contract: weight in pounds, hematocrit in percent, binned demographics apart."""
    return data.withColumns({"weight": col("weight_num"), "hematocrit": col("hct"),
                             "age_cat": col("age"), "bmi_cat": col("bmi")})


def dashboard_view(data: DataFrame) -> DataFrame:
    return data.select(
        col("don_id").alias("donor_id"), "wd_fl", col("group").alias("trt_group"), "site",
        "gender", col("status").alias("donor_status"), col("age").alias("age_cat"),
        "weight_cat", col("bmi").alias("bmi_cat"),
        fixed_bins(col("hct"), HCT_BINS, HCT_LABELS).alias("hct_cat"),
        col("target_vol").alias("target_volume"), col("actual_vol").alias("actual_volume"), "yield")


def enrolment_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: enrolment date, subject, site, stratum."""
    donor = F.col("o_custkey")
    joined = _table(spark, sf_dir, "orders").join(
        _table(spark, sf_dir, "customer"), donor == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderdate").alias("ENR_DATE"), donor.cast("string").alias("SUBJECT_ID"),
        F.concat(F.lit("S"), (F.col("c_nationkey") % 6).cast("string")).alias("SITE"),
        F.when(donor % 3 == 0, "female").otherwise("male").alias("STRATA1"))


def raw_view(data: DataFrame) -> DataFrame:
    """The collections as a study export: raw headers, Yes/No flags, M/d/yyyy text dates, and
    0 in place of volumes that were not recorded."""
    renamed = {
        "DONOR_NUMBER": "don_id", "COLLECTION_NUMBER": "col_id", "DEVICE_ID": "dev_id",
        "SITE_ID": "site", "DONOR_SITE_STATUS": "status", "GROUP": "group", "GENDER": "gender",
        "AGE": "age_num", "BMI_CALC": "bmi_num", "WEIGHT": "weight_num", "HEMATOCRIT": "hct",
        "TARGET_VOLUME": "target_vol",
    }
    flags = {
        "ITT": "itt", "MITT": "mitt", "PP": "pp", "ALL_AE_FL": "all_ae", "NON_HYP_FL": "non_hyp",
        "HYP_FL": "hyp", "SIG_HYP_FL": "sig_hyp", "ONLY_1.1_FL": "only_1.1",
        **{code: code for code in ("1.1", "1.2", "2.1", "3.1")},
    }
    stamps = {"DONATION_DATE": ("col_date", "M/d/yyyy"), "PROCEDURE_START":
              ("proc_start", "M/d/yyyy H:mm"), "PROCEDURE_END": ("proc_end", "M/d/yyyy H:mm")}
    return data.select(
        *(col(var).alias(name) for name, var in renamed.items()),
        F.when(col("volume_lost"), 0.0).otherwise(col("actual_vol")).alias("ACTUAL_VOLUME"),
        *(F.date_format(col(var), fmt).alias(name) for name, (var, fmt) in stamps.items()),
        *(F.when(col(var), "Yes").otherwise("No").alias(name) for name, var in flags.items()))
