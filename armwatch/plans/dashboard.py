"""Dashboard tables: donations, demographics and volume metrics by arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwatch.columns import col, cols, need_member, ratio
from armwatch.operators.shape import GRAND_TOTAL, with_subtotals
from armwatch.session import settled

GROUPINGS = {"SITE": "site", "GENDER": "gender", "STATUS": "donor_status", "AGE": "age_cat",
             "WEIGHT": "weight_cat", "BMI": "bmi_cat", "HEMO": "hct_cat"}
THRESHOLDS = (0.25, 0.5, 0.75)      # fixed values of the underdraw flags
_ARMS = {"A": "group_A", "B": "group_B", GRAND_TOTAL: "total"}


def _arms_as_columns(table: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric, one column per arm plus the total."""
    long = table.unpivot(col("trt_group"), [col(m).cast("double").alias(m) for m in metrics],
                         "metric", "value")
    wide = long.groupBy("metric").pivot("trt_group", list(_ARMS)).agg(F.first("value"))
    return wide.withColumnsRenamed(_ARMS)


def summary_donation(data: DataFrame) -> DataFrame:
    """Donors, donations, withdrawals and donations per donor."""
    arms = data.groupBy("trt_group").agg(
        F.count_distinct("donor_id").alias("n_donors"),
        F.count("donor_id").alias("n_donations"), F.sum("wd_fl").alias("n_withdrawals"))
    measures = ["n_donors", "n_donations", "n_withdrawals"]
    table = with_subtotals(arms, ["trt_group"], measures).withColumn(
        "repeat_don_rate", ratio(col("n_donations"), col("n_donors")))
    return _arms_as_columns(table, [*measures, "repeat_don_rate"])


_ANY = "*"      # stands for all levels, or for both arms together


def _counts(data: DataFrame, by: list[str], donor_level: bool) -> DataFrame:
    """Donors or donations per ``(grouping, level, arm)`` for all groupings in one scan.

    Rows are first collapsed to distinct combinations, then spread over the groupings. Sites are
    counted over both arms; grouping ``ARM`` holds the arm totals.
    """
    combos = data.groupBy("trt_group", "donor_id", *cols(GROUPINGS[name] for name in by)).agg(
        F.count("donor_id").alias("donations"))
    arm = col("trt_group")
    targets = [("ARM", F.lit(_ANY), arm)] + [
        (name, col(GROUPINGS[name]), F.lit(_ANY) if name == "SITE" else arm) for name in by]
    long = combos.select("donor_id", "donations", F.inline(F.array(*(
        F.struct(F.lit(name).alias("grouping"), level.alias("level"), side.alias("trt_group"))
        for name, level, side in targets))))
    measure = F.count_distinct("donor_id") if donor_level else F.sum("donations")
    return settled(long.where(col("level").isNotNull())
                   .groupBy("grouping", "level", "trt_group").agg(measure.alias("n")))


def _of(counts: DataFrame, *groupings: str) -> DataFrame:
    return counts.where(col("grouping").isin(*groupings))


def _site_counts(counts: DataFrame) -> DataFrame:
    return _of(counts, "SITE").select("level", col("n").alias("value"))


def _shares_in_arm(counts: DataFrame, *groupings: str) -> DataFrame:
    """Share of the arm, labelled ``A_male``."""
    totals = _of(counts, "ARM").select("trt_group", col("n").alias("arm_total"))
    label = F.concat_ws("_", col("trt_group"), F.lower("level"))
    return _of(counts, *groupings).join(totals, on="trt_group").select(
        "grouping", label.alias("level"), ratio(col("n"), col("arm_total")).alias("value"))


def _arms_per_level(counts: DataFrame) -> DataFrame:
    """A and B as shares of the level's total, and that total; missing arms count 0."""
    table = (counts.groupBy("grouping", F.lower("level").alias("level"))
             .pivot("trt_group", ["A", "B"]).agg(F.sum("n")).fillna(0, ["A", "B"]))
    total = col("A") + col("B")
    return table.select("grouping", "level", ratio(col("A"), total).alias("A"),
                        ratio(col("B"), total).alias("B"), total.cast("double").alias(GRAND_TOTAL))


def summary_demographic(data: DataFrame, by: str, donor_level: bool = True) -> DataFrame:
    """Donors or donations by one grouping: counts per site, shares within the arm for gender and
    status, arm shares per level for the binned demographics."""
    need_member(by, GROUPINGS, "Grouping")
    counts = _counts(data, [by], donor_level)
    if by == "SITE":
        return _site_counts(counts)
    if by in ("GENDER", "STATUS"):
        return _shares_in_arm(counts, by).drop("grouping")
    return _arms_per_level(_of(counts, by)).drop("grouping")


def all_demographics(data: DataFrame, donor_level: bool = True) -> DataFrame:
    """Every grouping in one table ``(grouping, level, series, value)`` from one scan.

    ``series`` is the arm (or ``grand_total``) for the binned demographics, else ``value``.
    """
    counts = _counts(data, list(GROUPINGS), donor_level)
    site = _site_counts(counts).select(
        F.lit("SITE").alias("grouping"), "level", F.lit("value").alias("series"),
        col("value").cast("double").alias("value"))
    within = _shares_in_arm(counts, "GENDER", "STATUS").withColumn("series", F.lit("value"))
    across = _arms_per_level(_of(counts, "AGE", "WEIGHT", "BMI", "HEMO")).unpivot(
        [col("grouping"), col("level")], [col("A"), col("B"), col(GRAND_TOTAL)], "series", "value")
    out = site.unionByName(within).unionByName(across)
    return out.withColumn("grouping", F.lower("grouping"))


def summary_metric(data: DataFrame) -> DataFrame:
    """Sums of volumes and of draw flags, and averages, by arm and in total.

    ``n_overdraws`` counts target > actual and ``n_underdraws`` target < actual (the names are
    those of the study's dashboard); ``n_underdraws_t`` counts t * actual > target.
    """
    target, actual = col("target_volume"), col("actual_volume")
    flags = {"n_overdraws": target > actual, "n_underdraws": target < actual,
             **{f"n_underdraws_{t}": t * actual > target for t in THRESHOLDS}}
    arms = data.groupBy("trt_group").agg(
        F.sum(target).alias("target_volume"), F.sum(actual).alias("actual_volume"),
        F.sum(col("yield")).alias("yield"), F.count("donor_id").alias("rows"),
        *(F.sum(test.cast("int")).alias(name) for name, test in flags.items()))
    measures = ["target_volume", "actual_volume", *flags]
    table = with_subtotals(arms, ["trt_group"], [*measures, "yield", "rows"]).withColumns({
        "average_actual": ratio(actual, col("rows")), "average_target": ratio(target, col("rows")),
        "average_yield": ratio(col("yield"), col("rows"))})
    return _arms_as_columns(table, [*measures, "average_actual", "average_target",
                                    "average_yield"])
