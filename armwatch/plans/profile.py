"""Donor profiles: first demographics, collection summary and chronology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.columns import col, cols, flag
from armwatch.operators.filters import of_donors
from armwatch.sources.contract import PROFILE, Contract

Donors = Sequence[str] | DataFrame | None

_FIRST = {"site": "site", "group": "group", "status": "status", "gender": "gender", "age": "age",
          "weight": "first_weight", "bmi": "first_bmi", "hct": "first_hct"}
# Output names of the chronology.
_CHRONOLOGY = {
    "don_id": "donor_id", "col_id": "collection_id", "dev_id": "device_id",
    "col_date": "collection_date", "proc_start": "procedure_start", "proc_end": "procedure_end",
    "duration_minutes": "duration_minutes", "speed": "speed", "yield": "yield",
    "target_vol": "target_volume", "actual_vol": "actual_volume", "weight": "weight",
    "bmi": "bmi", "hct": "hct",
}


def summary_dem(data: DataFrame, donors: Donors = None) -> DataFrame:
    """First record of each donor in order of date, procedure start and collection id.

    ``min_by`` keeps one candidate per task, so a donor with very many rows costs nothing extra.
    """
    order = F.struct(*cols(("col_date", "proc_start", "col_id", "hct", "weight")))
    first = F.min_by(F.struct(*(col(name) for name in _FIRST)), order).alias("first")
    return (of_donors(data, donors).groupBy("don_id").agg(first)
            .select(col("don_id").alias("donor_id"),
                    *(F.col("first")[name].alias(out) for name, out in _FIRST.items())))


def summary_col(data: DataFrame, donors: Donors = None) -> DataFrame:
    """Per donor: collections, event counts, mean duration and speed, ranges of weight, BMI, hct."""
    def spread(name: str):
        return (F.max(col(name)) - F.min(col(name))).alias(f"diff_{name}")

    return of_donors(data, donors).groupBy("don_id").agg(
        F.count_distinct("col_id").alias("n_collections"),
        F.sum(flag("sig_hyp")).alias("n_sig_hyp"), F.sum(flag("all_ae")).alias("n_all_ae"),
        F.avg("duration_minutes").alias("mean_duration_minutes"),
        F.avg("speed").alias("mean_speed"),
        spread("weight"), spread("bmi"), spread("hct")
    ).withColumnRenamed("don_id", "donor_id")


def event_names(names: Sequence[str]):
    """Names of the true flags, joined by a comma."""
    return F.array_join(F.array_compact(F.array(*(
        F.when(col(name), F.lit(name)) for name in names))), ", ")


def chronology(data: DataFrame, donors: Donors = None, contract: Contract = PROFILE) -> DataFrame:
    """Every collection with days since the donor's first and since the previous one.

    Lags are whole days, so only a donor's distinct days matter: they are at most one row per
    calendar day, which keeps the window small even for a donor holding a third of all rows.
    The gap to the previous day belongs to the first collection of the day; later ones, exact
    repeats included, have 0. Without a donor or a date both figures are null.
    """
    chosen = of_donors(data, donors)
    codes = contract.event_codes("all_ae", data.columns)
    days = (chosen.where(col("don_id").isNotNull() & col("col_date").isNotNull())
            .select("don_id", "col_date").distinct())
    by_donor = W.partitionBy("don_id").orderBy("col_date")
    days = days.withColumns({
        "days_total": F.date_diff("col_date", F.first("col_date").over(by_donor)),
        "gap": F.coalesce(F.date_diff("col_date", F.lag("col_date").over(by_donor)), F.lit(0))})
    first = ["proc_start", "col_id", "dev_id"]
    order = first + [name for name in _CHRONOLOGY if name not in (*first, "don_id", "col_date")]
    # Window and join share these keys, so rows are shuffled and sorted once.
    keys = ["don_id", "col_date", "spread"]
    unknown = col("don_id").isNull() | col("col_date").isNull()
    days = days.withColumn("spread", F.when(unknown, F.xxhash64(*cols(keys[:2]))).otherwise(0))
    donor_day = W.partitionBy(*keys).orderBy(*cols(order), "event_type")
    rows = chosen.select(*cols(_CHRONOLOGY), event_names(codes).alias("event_type")).withColumn(
        "spread", F.when(unknown, F.xxhash64(*cols(first))).otherwise(0)).withColumn(
        "place", F.row_number().over(donor_day))
    return rows.join(days, on=keys, how="left").select(
        *(col(name).alias(out) for name, out in _CHRONOLOGY.items()), "days_total",
        F.when(col("place") == 1, col("gap")).when(col("gap").isNotNull(), 0).alias("days_lag"),
        "event_type")
