"""Enrolment rates, projections and bar charts.

Every window here runs over a table with one row per stratum and calendar period, whose size is
bounded by the length of the trial, never over the enrolment rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.columns import col, cols, need_columns, need_member, percent, ratio
from armwatch.operators import trend as trends
from armwatch.operators.prepare import period_start
from armwatch.operators.shape import calendar, carried_forward, running_total
from armwatch.session import settled

DATE, SUBJECT = "ENR_DATE", "SUBJECT_ID"

# Over a stratum's weekly counts: a few hundred numbers at most, so the built-in exact
# percentile is bounded by the calendar.
METRICS: dict[str, Callable[[Column], Column]] = {
    "min": F.min, "max": F.max, "mean": F.avg, "median": F.median,
    "p_25": lambda c: F.percentile(c, 0.25), "p_75": lambda c: F.percentile(c, 0.75),
}


def load(data: DataFrame, date: str = DATE, subject: str = SUBJECT) -> DataFrame:
    """Complete cases with the Monday of the enrolment week."""
    need_columns(data, [date, subject])
    return data.dropna("any").withColumn("week", week_of(col(date)))


def week_of(date: Column) -> Column:
    return period_start(date, "week")


def _count(donor_level: bool, subject: str) -> Column:
    return F.count_distinct(col(subject)) if donor_level else F.count(col(subject))


def working_data(data: DataFrame, strata: Sequence[str], donor_level: bool,
                 subject: str = SUBJECT) -> DataFrame:
    """Weekly distinct subjects (or rows) per stratum."""
    return data.groupBy(*cols([*strata, "week"])).agg(_count(donor_level, subject).alias("value"))


def _rated(data: DataFrame, site: str, strata: Sequence[str], donor_level: bool,
           metrics: Sequence[str], subject: str, extra: Sequence[Column] = (),
           first: Sequence[Column] = ()) -> DataFrame:
    """Rates, counts and the site's totals from one read of the rows.

    Rows collapse to (site, strata, week, subject) once. Those rows serve three levels (weeks of a
    stratum, subjects of a stratum, subjects of a site), told apart by ``__level`` and grouped
    together; a window over the few rows of a site's strata then hands out the site's totals.
    ``first`` are aggregates over the source rows, ``extra`` the same ones over their results.
    """
    keys = [site, *strata]
    base = data.groupBy(*cols(keys), col("week").alias("__week"),
                        col(subject).alias("__subject")).agg(
        F.count(col(subject)).alias("__rows"), *first)
    week, stratum, whole = range(3)
    level = col("__level")
    spread = base.withColumn("__level", F.explode(F.array(*map(F.lit, (week, stratum, whole)))))
    grouped = spread.groupBy(
        level, col(site), *(F.when(level < whole, col(name)).alias(name) for name in strata),
        F.when(level == week, col("__week")).alias("__week"),
        F.when(level > week, col("__subject")).alias("__subject")).agg(
            F.sum("__rows").alias("__rows"), F.count("__subject").alias("__subjects"), *extra)
    weekly = F.when(level == week, col("__subjects" if donor_level else "__rows"))
    at_site = (level == whole).alias("__site")
    counts = grouped.groupBy(at_site, *cols(keys)).agg(
        *(METRICS[name](weekly).alias(name) for name in METRICS if name in metrics),
        F.sum(F.when(level > week, col("__rows"))).alias("donation_count"),
        F.count(F.when(level > week, col("__subject"))).alias("donor_count"), *extra)
    of_site = W.partitionBy(col(site))      # one row per stratum of the site
    names = [name for name in counts.columns if name not in (*keys, *METRICS, "__site")]
    return counts.withColumns({
        f"__whole_{name}": F.max(F.when(col("__site"), col(name))).over(of_site)
        for name in names}).where(~col("__site")).dropna("any", subset=keys)


def _shares(rated: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> list[Column]:
    return [*cols(keys), *cols(name for name in METRICS if name in metrics), *(
        column for kind in ("donation", "donor") for column in (
            ratio(col(f"{kind}_count"), col(f"__whole_{kind}_count")).alias(f"{kind}_percentage"),
            col(f"{kind}_count")))]


def _need_metrics(metrics: Sequence[str]) -> None:
    unknown = [name for name in metrics if name not in METRICS]
    if not metrics or unknown:
        raise KeyError(f"Provide metrics out of {sorted(METRICS)}; not valid: {unknown}.")


def rate_metrics(data: DataFrame, site: str, strata: Sequence[str], donor_level: bool,
                 metrics: Sequence[str], subject: str = SUBJECT) -> DataFrame:
    """Weekly rate metrics with counts, and shares of the site, per site x strata. The rows are
    read once, and no join is needed."""
    _need_metrics(metrics)
    rated = _rated(data, site, strata, donor_level, metrics, subject)
    return rated.select(_shares(rated, [site, *strata], metrics))


def activation_date(data: DataFrame, site: str, date: str = DATE) -> DataFrame:
    """First enrolment per site."""
    return data.groupBy(col(site)).agg(
        F.date_format(F.min(col(date)), "yyyy-MM-dd").alias("activation_date"))


def site_metrics(data: DataFrame, site: str, strata: Sequence[str], donor_level: bool,
                 metrics: Sequence[str], date: str = DATE, subject: str = SUBJECT) -> DataFrame:
    """Rate metrics together with the activation date of the site, from the same read."""
    _need_metrics(metrics)
    rated = _rated(data, site, strata, donor_level, metrics, subject,
                   [F.min("__first").alias("__first")], [F.min(col(date)).alias("__first")])
    return rated.select(*_shares(rated, [site, *strata], metrics), F.date_format(
        "__whole___first", "yyyy-MM-dd").alias("activation_date"))


def projection_steps(metrics: DataFrame, strata: Sequence[str], metric: str) -> DataFrame:
    """Weekly step per stratum taken from a rate metric."""
    return metrics.groupBy(*cols(strata)).agg(F.sum(col(metric)).alias("proj_value"))


def _cumulative(weekly: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Running total at every observed week; a stratum idle in a week keeps its last total."""
    weeks = weekly.agg(F.array_sort(F.collect_set("week")).alias("weeks")).scalar()
    grid = (weekly.select(*cols(strata)).distinct().withColumn("weeks", weeks)
            .select(*cols(strata), F.explode("weeks").alias("week")))
    totals = weekly.withColumn("total", running_total(col("value"), strata, "week")).drop("value")
    return (grid.join(totals, on=[*strata, "week"], how="left")
            .withColumn("value", carried_forward(col("total"), strata, "week")).drop("total"))


def projections(data: DataFrame, strata: Sequence[str], donor_level: bool, steps: DataFrame,
                max_weeks: int, target: float, stop_rule: str = "total",
                subject: str = SUBJECT) -> DataFrame:
    """Cumulative weekly counts, continued by a constant step per stratum and week.

    In closed form: week k after the last adds k steps. The last projected week is the first in
    which all strata together reach ``target``, at most ``max_weeks`` ahead; none if it is
    reached already. ``stop_rule='compounded'`` adds up the totals of all weeks instead.
    """
    need_member(stop_rule, ("total", "compounded"), "'stop_rule'")
    strata = list(strata)
    weekly = settled(working_data(data, strata, donor_level, subject))
    history = _cumulative(weekly, strata)
    latest = history.groupBy(*cols(strata)).agg(
        F.max("week").alias("week"), F.max_by("value", "week").alias("value"))
    ahead = (latest.join(steps, on=strata)
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max_weeks))))
             .withColumn("value", col("value") + col("k") * col("proj_value"))
             .withColumn("week", F.date_add("week", col("k") * 7)))
    per_week = ahead.groupBy("k").agg(F.sum("value").alias("total"))
    if stop_rule == "compounded":    # one row per projected week
        per_week = per_week.withColumn("total", F.sum("total").over(W.orderBy("k")))
    stop = per_week.where(col("total") >= target).agg(
        F.coalesce(F.min("k"), F.lit(max_weeks)).alias("stop")).scalar()
    future = ahead.where((col("k") > 0) & (col("k") <= stop))
    columns = ["week", *strata]
    return (history.select(*cols(columns), col("value").cast("double"))
            .unionByName(future.select(*cols(columns), col("value").cast("double"))))


def projection_marginals(projected: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Projections summed over either of two strata: ``(stratum, level, week, value)``."""
    if len(strata) != 2:
        raise ValueError("Marginals need exactly two strata.")
    first, second = strata
    sums = (projected.groupingSets([cols(["week", first]), cols(["week", second])],
                                   *cols(["week", first, second]))
            .agg(F.grouping_id().alias("__set"), F.sum("value").alias("value")))
    by_first = col("__set") == 1
    return sums.select(
        F.when(by_first, first).otherwise(second).alias("stratum"),
        F.when(by_first, col(first)).otherwise(col(second)).alias("level"), "week", "value")


def first_per_donor(data: DataFrame, date: str = DATE, subject: str = SUBJECT) -> DataFrame:
    """First enrolment row of each subject (one candidate per task and subject)."""
    row = F.struct(*cols(data.columns))
    order = F.struct(*cols([date, *(c for c in data.columns if c not in (date, subject))]))
    return data.groupBy(col(subject).alias("__id")).agg(F.min_by(row, order).alias("r")).select("r.*")


def bar_chart(data: DataFrame, show_by: str, by_donor: bool, strata: Sequence[str],
              only_new_donors: bool = False, date: str = DATE,
              subject: str = SUBJECT) -> DataFrame:
    """Counts per period and stratum, running total, and percent of the period."""
    need_member(show_by, ("week", "day"), "'show_by'")
    source = first_per_donor(data, date, subject) if only_new_donors else data
    counts = (source.groupBy(period_start(col(date), show_by).alias(show_by), *cols(strata))
              .agg(_count(by_donor, subject).alias("absolute")))
    in_period = F.sum("absolute").over(W.partitionBy(show_by))
    return counts.select(show_by, *cols(strata), "absolute",
                         running_total(col("absolute"), strata, show_by).alias("cumsum"),
                         percent(col("absolute"), in_period).alias("percentage"))


def dense_bar_chart(data: DataFrame, show_by: str, by_donor: bool, strata: Sequence[str],
                    only_new_donors: bool = False, date: str = DATE,
                    subject: str = SUBJECT) -> DataFrame:
    """The bar chart on a complete calendar, long: ``(period, strata, metric, value)``."""
    chart = settled(bar_chart(data, show_by, by_donor, strata, only_new_donors, date, subject))
    step = {"week": "7 DAYS", "day": "1 DAY"}[show_by]
    full = calendar(chart, strata, show_by, step).join(chart, on=[*strata, show_by], how="left")
    filled = full.select(show_by, *cols(strata),
                         F.coalesce("absolute", F.lit(0)).cast("double").alias("absolute"),
                         carried_forward(col("cumsum"), strata, show_by).cast("double")
                         .alias("cumsum"),
                         F.coalesce("percentage", F.lit(0.0)).alias("percentage"))
    return filled.unpivot([col(show_by), *cols(strata)],
                          [col(m) for m in ("absolute", "cumsum", "percentage")],
                          "metric", "value")


def _daily_totals(data: DataFrame, strata: Sequence[str], donor_level: bool, date: str,
                  subject: str) -> DataFrame:
    daily = data.groupBy(*cols(strata), period_start(col(date), "day").alias("day")).agg(
        _count(donor_level, subject).alias("value"))
    return daily.select(*cols(strata), "day",
                        running_total(col("value"), strata, "day").cast("double").alias("y"))


def model_projections(data: DataFrame, strata: Sequence[str], donor_level: bool,
                      horizon_days: int, target: float, trend: str = "linear",
                      band: float = .8, date: str = DATE, subject: str = SUBJECT) -> DataFrame:
    """Trend of the cumulative daily count per stratum over history and horizon, with bands.

    ``linear`` is a regression line as SQL aggregates. ``changepoint`` lets the line change at up
    to 5 of 25 evenly spaced days in the first 80 % of the history, the best by least squares and
    information criterion (``operators.trend``). Rows end on the first day on which the strata together reach ``target``.
    """
    need_member(trend, ("linear", "changepoint"), "'trend'")
    strata = list(strata)
    totals = settled(_daily_totals(data, strata, donor_level, date, subject))
    fit = _linear_fit if trend == "linear" else _changepoint_fit
    fitted = fit(totals, strata, horizon_days, NormalDist().inv_cdf((1 + band) / 2))
    per_day = fitted.groupBy("day").agg(F.sum("yhat").alias("total"))
    stop = per_day.where(col("total") >= target).agg(
        F.coalesce(F.min("day"), F.lit("9999-12-31").cast("date")).alias("stop")).scalar()
    return fitted.where(col("day") <= stop)


def _linear_fit(totals: DataFrame, strata: Sequence[str], horizon_days: int,
                z: float) -> DataFrame:
    """Least squares per stratum; the residual sum of squares is syy - slope * sxy."""
    x = F.date_diff(col("day"), F.lit("1970-01-01").cast("date")).cast("double")
    y = col("y")
    line = totals.groupBy(*cols(strata)).agg(
        F.regr_slope(y, x).alias("slope"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count(y).alias("n"),
        F.max("day").alias("last"), F.array_sort(F.collect_set("day")).alias("seen"))
    slope = F.coalesce(col("slope"), F.lit(0.0))
    residual = F.greatest(F.coalesce(col("syy") - slope * col("sxy"), F.lit(0.0)), F.lit(0.0))
    sd = F.sqrt(residual / F.greatest(col("n") - 2, F.lit(1)))
    ahead = (F.sequence(F.date_add("last", 1), F.date_add("last", horizon_days))
             if horizon_days > 0 else F.array().cast("array<date>"))
    days = line.select(*cols(strata), slope.alias("slope"), "mean_x", "mean_y", sd.alias("sd"),
                       F.explode(F.concat("seen", ahead)).alias("day"))
    yhat = col("mean_y") + col("slope") * (x - col("mean_x"))
    return days.select("day", (yhat - z * col("sd")).alias("yhat_lower"),
                       (yhat + z * col("sd")).alias("yhat_upper"), yhat.alias("yhat"),
                       *cols(strata))


def _changepoint_fit(totals: DataFrame, strata: Sequence[str], horizon_days: int,
                     z: float) -> DataFrame:
    """The lines of the best segmentation; days ahead follow the last one. The residual spread
    is that of all stretches together."""
    prefix, lines = trends.changing_trend(totals, strata)
    lines = lines.withColumn("sd", F.sqrt(col("total_sse") / F.greatest(
        col("rows") - 2 * col("stretches"), F.lit(1))))
    days, own = prefix.alias("days"), lines.alias("own")
    seen = days.join(own, (F.col("days.id") == F.col("own.id")) & (F.col("days.r") > F.col("own.a"))
                     & (F.col("days.r") <= F.col("own.b"))).select(
        "own.*", "days.day", "days.since")
    fitted = seen
    if horizon_days > 0:
        last = prefix.where("r = rows").select("id", "day", "since")
        fitted = seen.unionByName(
            lines.where("b = rows").join(last, "id")
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon_days))))
            .withColumns({"day": F.date_add("day", "k"), "since": col("since") + col("k")})
            .select(*seen.columns))
    yhat = trends.line_at(col("since"))
    return fitted.select("day", (yhat - z * col("sd")).alias("yhat_lower"),
                         (yhat + z * col("sd")).alias("yhat_upper"), yhat.alias("yhat"),
                         *(F.col(f"id.`{name}`").alias(name) for name in strata))


def trend_breaks(data: DataFrame, strata: Sequence[str], donor_level: bool, date: str = DATE,
                 subject: str = SUBJECT) -> DataFrame:
    """Stretches of days with one daily rate in the cumulative count of each stratum: first and
    last day, days seen, rate, and the line's value on the last day."""
    strata = list(strata)
    totals = settled(_daily_totals(data, strata, donor_level, date, subject))
    prefix, lines = trends.changing_trend(totals, strata)
    ends = prefix.select("id", "r", "day", "since")
    first = ends.select("id", (col("r") - 1).alias("a"), col("day").alias("first_day"))
    last = ends.select("id", col("r").alias("b"), col("day").alias("last_day"), "since")
    return lines.join(first, ["id", "a"]).join(last, ["id", "b"]).select(
        *(F.col(f"id.`{name}`").alias(name) for name in strata), "first_day", "last_day",
        col("n").alias("days"), col("slope").alias("rate"),
        trends.line_at(col("since")).alias("reached"))
