"""Exact interpolated quantiles that never hold a whole group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here the values
are first collapsed to (value, count), shuffled on the value as well as the key, and then spread
by ranges of (group, value): a group holding a third of all rows fills many partitions, whatever
the distribution of its values. One sum per group and partition tells which partition holds a
wanted rank, and only those partitions' rows of the group are cumulated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.columns import col, cols
from armwatch.session import settled


def value_frequencies(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``(keys, variable, value, n)``: each distinct value of each measure with its count.

    A lossless form of "all raw values of the group" that stays a distributed table.
    """
    long = df.select(*cols(keys), F.inline(F.array(*(
        F.struct(F.lit(m).alias("variable"), col(m).cast("double").alias("value"))
        for m in measures))))
    return (long.where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(F.struct(*cols(keys), "variable").alias("id"), "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("id.*", "value", "n"))


def quantiles_of(freq: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(keys, variable, prob, value)`` with linear interpolation between ranks.

    The range partitions are settled on the shared folder, as both the sums and the cumulated
    rows refer to them. ``id`` is a struct, so a null key is a group like any other.
    """
    probs = [float(p) for p in probs]
    position = {p: F.lit(p) * (F.col("total") - 1) for p in probs}
    ranks = F.array_distinct(F.array(*(edge(position[p]).cast("long")
                                       for p in probs for edge in (F.floor, F.ceil))))
    rows = settled(freq.select(F.struct(*cols([*keys, "variable"])).alias("id"), "value", "n")
                   .repartitionByRange("id", "value")
                   .withColumn("part", F.spark_partition_id()))
    group = W.partitionBy("id")     # one row per range partition
    sums = rows.groupBy("id", "part").agg(F.sum("n").alias("here")).withColumns({
        "total": F.sum("here").over(group),
        "below": F.sum("here").over(group.orderBy("part")) - F.col("here")})
    inside = F.filter(ranks, lambda r: (r >= F.col("below"))
                      & (r < F.col("below") + F.col("here")))
    holders = (sums.withColumn("ranks", inside).where(F.size("ranks") > 0)
               .select("id", "part", "total", "below", "ranks"))
    running = F.sum("n").over(W.partitionBy("id", "part").orderBy("value").rowsBetween(
        W.unboundedPreceding, W.currentRow))
    reached = rows.join(holders, ["id", "part"]).withColumn("reached", F.col("below") + running)
    here = F.filter("ranks", lambda r: (r >= F.col("reached") - F.col("n"))
                    & (r < F.col("reached")))
    found = (reached.select("id", "total", "value", F.explode(here).alias("rank"))
             .groupBy("id", "total").agg(
                 F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")))
    return found.select("id", F.explode(F.array(*(
        F.struct(F.lit(p).alias("prob"), _interpolate(position[p]).alias("value"))
        for p in probs))).alias("q")).select("id.*", "q.prob", "q.value")


def exact_quantiles(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
                    probs: Sequence[float]) -> DataFrame:
    return quantiles_of(value_frequencies(df, keys, measures), keys, probs)


def quantile_edges(df: DataFrame, measure: str, bins: int) -> Column:
    """Scalar subquery: the inner edges of ``bins`` equally filled bins as an array."""
    found = exact_quantiles(df, [], [measure], [i / bins for i in range(1, bins)])
    return (found.agg(F.array_sort(F.collect_list(F.struct("prob", "value"))).alias("e"))
            .select(F.col("e.value").alias("edges")).scalar())


def _interpolate(position: Column) -> Column:
    low = F.col("at")[F.floor(position).cast("long")]
    high = F.col("at")[F.ceil(position).cast("long")]
    return low + (high - low) * (position - F.floor(position))
