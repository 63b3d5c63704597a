"""Plasma volume of the experimental arm under two nomograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwatch.columns import col, cols, need_columns, need_member
from armwatch.functions.distributions import t_quantile
from armwatch.operators.filters import experimental_arm, in_population
from armwatch.operators.prepare import period_start
from armwatch.operators.shape import split_and_overall
from armwatch.sources.contract import POPULATION, VOLUMES

# Fixed values of the volume nomogram.
KG_PER_POUND = 0.453592
METRES_PER_INCH = 0.0254
BLOOD_ML_PER_KG = 70
REFERENCE_BMI = 22
PLASMA_SHARE = {"persona_1": 0.285, "persona_2": 0.305}
MOST_ML = 1000.0


def nomogram_target(pounds: Column, inches: Column, hematocrit: Column, share: float) -> Column:
    """Target volume in ml: blood volume scaled by BMI, times plasma part, at most 1000."""
    kg = pounds * KG_PER_POUND
    metres = inches * METRES_PER_INCH
    blood = BLOOD_ML_PER_KG / F.sqrt(kg / (metres * metres) / REFERENCE_BMI) * kg
    return F.least(F.lit(MOST_ML), blood * (1 - hematocrit / 100) * share)


def with_nomograms(data: DataFrame, experimental: str = "A") -> DataFrame:
    """Experimental arm with both targets and the start of each period."""
    need_columns(data, VOLUMES.names())
    return experimental_arm(data, experimental).withColumns({
        **{name: nomogram_target(col("weight"), col("height"), col("hematocrit"), share)
           for name, share in PLASMA_SHARE.items()},
        **{period: period_start(col("col_date"), period) for period in ("day", "week", "month")}})


def collection_summary(data: DataFrame) -> DataFrame:
    return data.groupBy(col("group")).agg(
        F.avg(col("yield")).alias("average_yield"),
        F.sum("actual_vol").alias("total_plasma_collected"),
        F.avg("target_vol").alias("average_target_volume"),
        F.avg("actual_vol").alias("average_collected_volume"))


def comparative_gain(data: DataFrame, population: str, stratify_by: str,
                     experimental: str = "A", conf: float = .95) -> DataFrame:
    """Mean gain of the second nomogram over the first with its Welch interval, per stratum and
    overall, from one aggregate."""
    need_member(population, VOLUMES.names(POPULATION), "Population")
    chosen = in_population(with_nomograms(data, experimental), population)
    aggregates = [agg(col(name)).alias(f"{label}_{name}")
                  for name in PLASMA_SHARE
                  for label, agg in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))]
    table = split_and_overall(chosen, [stratify_by], aggregates)
    parts = {name: col(f"var_{name}") / col(f"n_{name}") for name in PLASMA_SHARE}
    spread = parts["persona_1"] + parts["persona_2"]
    freedom = spread * spread / sum(
        part * part / (col(f"n_{name}") - 1) for name, part in parts.items())
    enough = (col("n_persona_1") > 1) & (spread > 0)
    gain = col("mean_persona_2") - col("mean_persona_1")
    moments = table.select(col(stratify_by), gain.alias("mean"), F.sqrt(spread).alias("err"),
                           F.when(enough, freedom).alias("df"))
    half = t_quantile((1 + conf) / 2, col("df")) * col("err")
    return moments.withColumn("half", half).select(
        col(stratify_by), (col("mean") - col("half")).alias("left"),
        (col("mean") + col("half")).alias("right"), "mean")


def longitudinal_stat(data: DataFrame, population: str, show_by: str,
                      experimental: str = "A") -> DataFrame:
    """Mean targets and their difference per day, week or month."""
    need_member(show_by, ("day", "week", "month"), "'show_by'")
    need_member(population, VOLUMES.names(POPULATION), "Population")
    chosen = in_population(with_nomograms(data, experimental), population)
    means = chosen.groupBy(show_by).agg(*(F.avg(name).alias(name) for name in PLASMA_SHARE))
    return means.select(*cols([show_by, *PLASMA_SHARE]),
                        (col("persona_2") - col("persona_1")).alias("delta"))
