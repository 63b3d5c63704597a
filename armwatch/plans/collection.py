"""Collection metrics: counts per device and distributions of the measures.

Spread is the sample form per stratum and the population form for the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.columns import col, cols, need_columns, need_member, percent
from armwatch.operators.quantiles import quantiles_of, value_frequencies
from armwatch.operators.shape import OVERALL, complete_grid
from armwatch.session import settled
from armwatch.sources.contract import CATEGORY, PLASMA, POPULATION, SEVERITY, Contract

MEASURES = ("target_vol", "actual_vol", "yield", "yield_resid", "duration_minutes", "speed")
WEEKLY = "col_weekly_per_device"

#: Marks rows of the whole table that stand beside those of the strata.
WHOLE = "__whole"

_QUANTILES = {"median": .5, "quantile_025": .025, "quantile_975": .975}


def _check(data: DataFrame, strata: Sequence[str], pop: str, contract: Contract) -> None:
    need_member(pop, contract.names(POPULATION), "Population")
    for name in strata:
        need_member(name, contract.names(CATEGORY), "'strata'")
    need_columns(data, strata)


def _moments(freq: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Mean and spread from frequencies, the squares centred on the mean.

    ``id`` is a struct, so a null stratum joins like any other.
    """
    rows = freq.select(F.struct(*cols([*strata, "variable"])).alias("id"), "value", "n")
    means = rows.groupBy("id").agg(F.sum("n").alias("total"),
                                   (F.sum(col("value") * col("n")) / F.sum("n")).alias("mean"))
    squares = (rows.join(means, "id").groupBy("id", "total", "mean").agg(
        F.sum(col("n") * (col("value") - col("mean")) ** 2).alias("squares")))
    whole = col("id")[WHOLE] if WHOLE in strata else F.lit(not strata)
    divisor = col("total") - F.when(whole, 0).otherwise(1)
    sd = F.when(divisor > 0, F.sqrt(col("squares") / divisor))
    pairs = F.array(*(F.struct(F.lit(name).alias("metric"), value.alias("value"))
                      for name, value in (("mean", col("mean")), ("sd", sd))))
    return (squares.select("id", F.inline(pairs)).where(col("value").isNotNull())
            .select("id.*", "metric", "value"))


def _quantile_rows(freq: DataFrame, strata: Sequence[str]) -> DataFrame:
    label = F.lit(None).cast("string")
    for name, prob in _QUANTILES.items():
        label = F.when(col("prob") == prob, name).otherwise(label)
    found = quantiles_of(freq, strata, list(_QUANTILES.values()))
    return found.select(*cols(strata), "variable", label.alias("metric"), "value")


def _scoped(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Every row once for its stratum and once for the whole table, whose strata are null: with
    ``WHOLE`` as one more key, an aggregate makes both at once."""
    both = df.withColumn(WHOLE, F.explode(F.array(F.lit(False), F.lit(True))))
    return both.withColumns({name: F.when(~col(WHOLE), col(name)) for name in strata})


def _labelled(rows: DataFrame, strata: Sequence[str]) -> DataFrame:
    """The rows of the whole table under the label ``overall``."""
    return rows.withColumns({name: F.when(col(WHOLE), OVERALL).otherwise(
        col(name).cast("string")) for name in strata}).drop(WHOLE)


def _raw_rows(freq: DataFrame, strata: Sequence[str], metric: str = "raw_data") -> DataFrame:
    return freq.select(*cols(strata), "variable", F.lit(metric).alias("metric"), "value", "n")


def _no_count(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.lit(None).cast("long"))


def _distribution(freq: DataFrame, strata: Sequence[str], raw: bool) -> DataFrame:
    """Five metrics per variable from its frequencies; ``raw`` adds every value with its own."""
    out = _moments(freq, strata).unionByName(_quantile_rows(freq, strata))
    return _no_count(out).unionByName(_raw_rows(freq, strata)) if raw else out


def _measured(chosen: DataFrame, strata: Sequence[str], raw: bool, overall: bool,
              contract: Contract, more: DataFrame | None = None) -> DataFrame:
    """The measures per stratum and, with ``overall``, of the whole table under ``WHOLE``;
    whole-table rows come with the severity flags. The source is read once, for the frequencies
    of all of them; ``more`` are further frequencies, so that one set of ranks serves all."""
    flags = [name for name in contract.names(SEVERITY) if name in chosen.columns]
    shown = flags if overall or not strata else []
    keys = [WHOLE, *strata] if overall else list(strata)
    freq = value_frequencies(
        chosen.withColumns({name: col(name).cast("int") for name in shown}), strata,
        [*MEASURES, *shown])
    if overall:
        freq = _scoped(freq, strata).groupBy(*cols([*keys, "variable", "value"])).agg(
            F.sum("n").alias("n"))
    freq = settled(freq if more is None else freq.unionByName(more))
    is_flag = col("variable").isin(*shown)
    out = _distribution(freq.where(~is_flag), keys, raw)
    if not shown:
        return out
    flagged = freq.where(is_flag & (col(WHOLE) if overall else F.lit(True)))
    return (out if raw else _no_count(out)).unionByName(_raw_rows(flagged, keys, "flags"))


def _visits(data: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Distinct (stratum, device, week, collection): every count below derives from it, so the
    source is read once."""
    return settled(data.select(*cols([*strata, "dev_id", "week", "col_id"])).distinct())


def _weekly(visits: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Distinct collections of each device and week."""
    return visits.groupBy(*cols([*strata, "dev_id", "week"])).agg(
        F.count_distinct("col_id").alias("collections"))


def weekly_per_device(visits: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Mean weekly number of distinct collections of each device, over the weeks it was used."""
    return _weekly(visits, strata).groupBy(*cols([*strata, "dev_id"])).agg(
        F.avg("collections").alias(WEEKLY))


def _complete_weekly(visits: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Frequencies of the same mean over every stratum x device x week, unused ones as 0.

    The mean is the sum over the number of weeks, and the unused devices of a stratum are one
    row with their count: the product of devices and weeks is never built.
    """
    known = visits
    for name in [*strata, "dev_id", "week"]:
        known = known.where(col(name).isNotNull())
    weekly = settled(_weekly(known, strata))
    weeks = weekly.agg(F.count_distinct("week")).scalar()
    devices = weekly.agg(F.count_distinct("dev_id")).scalar()
    used = weekly.groupBy(*cols([*strata, "dev_id"])).agg(
        (F.sum("collections") / weeks).alias("value"))
    per_value = used.groupBy(*cols([*strata, "value"])).agg(F.count(F.lit(1)).alias("n"))
    seen = used.groupBy(*cols(strata)).agg(F.count(F.lit(1)).alias("n"))
    unused = complete_grid(seen, strata, ["n"]).select(
        *cols(strata), F.lit(0.0).alias("value"), (devices - col("n")).alias("n"))
    both = per_value.unionByName(unused.where(col("n") > 0))
    return (both.groupBy(*cols([*strata, "value"])).agg(F.sum("n").alias("n"))
            .select(*cols(strata), F.lit(WEEKLY).alias("variable"), "value", "n"))


def _distinct(visits: DataFrame, strata: Sequence[str], name: str) -> DataFrame:
    counted = visits.groupBy(*cols(strata)).agg(F.count_distinct(name).alias("value"))
    return counted.select(*cols(strata), F.lit(name).alias("variable"), "value")


def _counted(visits: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Distinct collections and devices, with the stratum's share of the sum over all strata."""
    counts = _distinct(visits, strata, "col_id").unionByName(_distinct(visits, strata, "dev_id"))
    metrics = [("nunique", col("value").cast("double"))]
    if strata:
        of_stratum = F.when(~col(WHOLE), col("value")) if WHOLE in strata else col("value")
        total = F.sum(of_stratum).over(W.partitionBy("variable"))   # one row per stratum
        metrics.append(("pct_total", percent(of_stratum, total)))
    return counts.select(*cols(strata), "variable", F.array(*(
        F.struct(F.lit(metric).alias("metric"), value.alias("value"))
        for metric, value in metrics)).alias("m")).select(
            *cols(strata), "variable", F.inline("m")).where(col("value").isNotNull())


def _per_device(visits: DataFrame, strata: Sequence[str]) -> DataFrame:
    return value_frequencies(weekly_per_device(visits, strata), strata, [WEEKLY])


def count_summary(data: DataFrame, strata: Sequence[str] | None = None, pop: str = "itt",
                  raw: bool = False, complete: bool = False,
                  contract: Contract = PLASMA) -> DataFrame:
    """Distinct collections and devices with their share, and the distribution over devices of
    mean weekly collections: ``(strata, variable, metric, value)``."""
    strata = list(strata or [])
    _check(data, strata, pop, contract)
    visits = _visits(data.where(col(pop)), strata)
    freq = settled(_complete_weekly(visits, strata) if complete and strata
                   else _per_device(visits, strata))
    counted = _counted(visits, strata)
    return (_no_count(counted) if raw else counted).unionByName(_distribution(freq, strata, raw))


def plasma_summary(data: DataFrame, strata: Sequence[str] | None = None, pop: str = "itt",
                   raw: bool = False, contract: Contract = PLASMA) -> DataFrame:
    """Mean, sd, median and 2.5/97.5 % quantiles of the six measures.

    ``raw`` adds the whole distribution as ``(value, n)`` rows under metric ``raw_data``. Without
    strata each severity flag's values (1/0 with their counts ``n``) come under metric ``flags``.
    """
    strata = list(strata or [])
    _check(data, strata, pop, contract)
    return _measured(data.where(col(pop)), strata, raw, False, contract)


def summary(data: DataFrame, strata: Sequence[str] = ("site",), population: str = "itt",
            contract: Contract = PLASMA) -> DataFrame:
    """Counts and measures per stratum, together with the ``overall`` rows; ``n`` counts the
    values of the severity flags and is null elsewhere."""
    strata = list(strata)
    _check(data, strata, population, contract)
    chosen = data.where(col(population))
    visits, keys = _visits(chosen, strata), strata
    if strata:
        visits, keys = _scoped(visits, strata), [WHOLE, *strata]
    measured = _measured(chosen, strata, False, bool(strata), contract,
                         _per_device(visits, keys))
    rows = _no_count(_counted(visits, keys)).unionByName(measured)
    return _labelled(rows, strata) if strata else rows


def distribution(data: DataFrame, strata: Sequence[str] = ("site",), population: str = "itt",
                 contract: Contract = PLASMA) -> DataFrame:
    """Measures with their whole distribution per stratum, together with ``overall``."""
    strata = list(strata)
    _check(data, strata, population, contract)
    rows = _measured(data.where(col(population)), strata, True, bool(strata), contract)
    return _labelled(rows, strata) if strata else rows


__all__ = ["MEASURES", "OVERALL", "WEEKLY", "count_summary", "distribution", "plasma_summary",
           "summary", "weekly_per_device"]
