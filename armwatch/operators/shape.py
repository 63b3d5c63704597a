"""Result shaping on small aggregates: level grids, subtotals, shares, long/wide, calendars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.columns import col, cols, percent
from armwatch.session import settled

GRAND_TOTAL, SUBTOTAL, SEPARATOR, BLANK, OVERALL = (
    "grand_total", "subtotal", " | ", " ", "overall")


def level_grid(counts: DataFrame, strata: Sequence[str],
               levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Every combination of the strata's levels, from the levels seen in ``counts`` or given.

    Levels of several strata meet as arrays, so this is for categories, not for ids.
    """
    if levels is None and len(strata) == 1:
        return counts.select(*cols(strata)).where(col(strata[0]).isNotNull()).distinct()
    seen = counts.agg(*(F.array_sort(F.collect_set(col(name))).alias(name) for name in strata))
    if levels is not None:
        seen = seen.withColumns({name: F.array(*map(F.lit, levels[name]))
                                 for name in strata if name in levels})
    for name in strata:
        seen = seen.withColumn(name, F.explode(col(name)))
    return seen


def complete_grid(counts: DataFrame, strata: Sequence[str], measures: Sequence[str],
                  levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """An aggregate over all level combinations; the empty ones count 0."""
    counts = settled(counts)
    grid = level_grid(counts, strata, levels)
    return grid.join(counts, on=list(strata), how="left").fillna(0, subset=list(measures))


def with_subtotals(df: DataFrame, strata: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Add subtotal rows at each strata prefix and a grand total; measures are added up.

    Labels: ``('A', 'A - subtotal', ' ')`` and ``('grand_total', ' ', ' ')``.
    """
    depth = F.lit(len(strata)) - F.bit_count(F.grouping_id())
    rolled = df.rollup(*cols(strata)).agg(*(F.sum(col(m)).alias(m) for m in measures),
                                          depth.alias("__depth"))
    labels = []
    for i, name in enumerate(strata):
        at = (F.lit(GRAND_TOTAL) if i == 0 else
              F.concat(F.concat_ws(SEPARATOR, *cols(strata[:i])), F.lit(f" - {SUBTOTAL}")))
        labels.append(F.when(F.col("__depth") > i, col(name).cast("string"))
                      .when(F.col("__depth") == i, at).otherwise(BLANK).alias(name))
    return rolled.select(*labels, *cols(measures))


def share_within(df: DataFrame, measure: str, parents: Sequence[str], output: str) -> DataFrame:
    """Percent of ``measure`` within the parent strata (of all rows without parents).

    For aggregated tables: the window spans one row per stratum.
    """
    total = F.sum(col(measure)).over(W.partitionBy(*cols(parents)))
    return df.withColumn(output, percent(col(measure), total))


def long_metrics(df: DataFrame, ids: Sequence[str], metrics: Mapping[tuple[str, str], Column],
                 drop_null: bool = True) -> DataFrame:
    """Wide aggregate -> ``(ids, variable, metric, value)``."""
    rows = F.array(*(F.struct(F.lit(variable).alias("variable"), F.lit(metric).alias("metric"),
                              value.cast("double").alias("value"))
                     for (variable, metric), value in metrics.items()))
    out = df.select(*cols(ids), F.explode(rows).alias("r")).select(*cols(ids), "r.*")
    return out.where(F.col("value").isNotNull()) if drop_null else out


def wide_metrics(df: DataFrame, ids: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(ids, variable, metric, value)`` -> one column ``variable_metric`` per given pair."""
    keyed = df.withColumn("__pair", F.concat_ws("_", "variable", "metric"))
    return (keyed.groupBy(*cols(ids)).pivot("__pair", [f"{v}_{m}" for v, m in pairs])
            .agg(F.first("value")))


def split_and_overall(df: DataFrame, strata: Sequence[str],
                      aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per stratum and for the whole table in one scan."""
    sets = [cols(strata), []]
    depth = F.grouping_id().alias("__set")
    out = df.groupingSets(sets, *cols(strata)).agg(depth, *aggregates)
    return out.withColumns({name: F.when(F.col("__set") == 0, col(name).cast("string"))
                            .otherwise(OVERALL) for name in strata}).drop("__set")


def calendar(df: DataFrame, strata: Sequence[str], period: str, step: str) -> DataFrame:
    """Every observed stratum x every period from the first to the last of the whole table.

    The calendar is one scalar array (one entry per period), exploded per stratum.
    """
    span = df.agg(F.sequence(F.min(col(period)), F.max(col(period)),
                             F.expr(f"INTERVAL {step}")).alias("days")).scalar()
    return (df.select(*cols(strata)).distinct().withColumn("__days", span)
            .select(*cols(strata), F.explode("__days").alias(period)))


def running_total(measure: Column, strata: Sequence[str], period: str) -> Column:
    """Cumulative sum over periods per stratum; for tables with one row per period."""
    return F.sum(measure).over(W.partitionBy(*cols(strata)).orderBy(col(period)).rowsBetween(
        W.unboundedPreceding, W.currentRow))


def carried_forward(measure: Column, strata: Sequence[str], period: str) -> Column:
    """Last known value up to the period, 0 before the first."""
    last = F.last(measure, ignorenulls=True).over(
        W.partitionBy(*cols(strata)).orderBy(col(period)).rowsBetween(
            W.unboundedPreceding, W.currentRow))
    return F.coalesce(last, F.lit(0))
