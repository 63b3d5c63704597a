"""Trend lines that change at a few points: optimal segmentation from prefix moments.

Per stratum there is one row per day. Running sums of 1, t, y, t^2, ty and y^2 give the least
squares line and its squared error of any stretch of days by two subtractions. Breaks are chosen
among ``candidates`` evenly spaced rows of the first ``span`` of the history, so a stratum has at
most (candidates + 1)(candidates + 2) / 2 stretches whatever its length. The best segmentation
with k stretches that ends at a row is the best one with k - 1 that ends at an earlier row, and the
stretch between: one join over candidate rows for each k. The number of stretches is the one with
the smallest Bayesian information criterion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.columns import col, cols
from armwatch.session import settled

CANDIDATES, SPAN, CHANGES = 25, .8, 5
#: Mean squared error under which a stretch counts as a straight line.
STRAIGHT = 1e-9
MOMENTS = ("t", "y", "tt", "ty", "yy")


def prefix_moments(totals: DataFrame, strata: Sequence[str], day: str = "day",
                   y: str = "y") -> DataFrame:
    """``(id, day, r, rows, t, y, tt, ty, yy, first)``: running sums up to the r-th day of each
    stratum, whose days are counted from its first. ``id`` is a struct, so a null is a level."""
    own = totals.select(F.struct(F.lit(0).alias("one"), *cols(strata)).alias("id"),
                        col(day).alias("day"), col(y).cast("double").alias("value"))
    group = W.partitionBy("id")
    running = group.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    t, value = F.col("since"), F.col("value")
    terms = {"t": t, "y": value, "tt": t * t, "ty": t * value, "yy": value * value}
    return (own.withColumns({"first": F.min("day").over(group), "rows": F.count("*").over(group),
                             "r": F.count("*").over(running)})
            .withColumn("since", F.date_diff("day", "first").cast("double"))
            .select("id", "day", "first", "rows", "r", "since", "value",
                    *(F.sum(terms[m]).over(running).alias(m) for m in MOMENTS)))


def stretches(prefix: DataFrame, candidates: int = CANDIDATES, span: float = SPAN) -> DataFrame:
    """``(id, a, b, rows, n, slope, mean_t, mean_y, sse)`` of every stretch of the rows a + 1 to b
    between candidate rows; a stretch of one row only where the stratum has no more."""
    marks = F.array(F.col("rows"), *(F.floor(F.lit(span * i / candidates) * F.col("rows"))
                                     .cast("long") for i in range(1, candidates + 1)))
    nodes = prefix.where(F.array_contains(marks, F.col("r"))).select(
        "id", "rows", "r", *MOMENTS)
    start = prefix.where("r = 1").select("id", "rows", F.lit(0).cast("long").alias("r"),
                                         *(F.lit(0.0).alias(m) for m in MOMENTS))
    nodes = settled(nodes.unionByName(start))
    left, right = nodes.alias("left"), nodes.alias("right")
    pairs = left.join(right, (F.col("left.id") == F.col("right.id"))
                      & (F.col("left.r") < F.col("right.r")))
    inside = {m: F.col(f"right.{m}") - F.col(f"left.{m}") for m in ("r", *MOMENTS)}
    sums = pairs.select(F.col("left.id").alias("id"), F.col("left.r").alias("a"),
                        F.col("right.r").alias("b"), F.col("left.rows").alias("rows"),
                        *(inside[m].alias(m) for m in MOMENTS), inside["r"].alias("n"))
    sums = sums.where("n >= 2 OR (a = 0 AND b = rows)")
    n = F.col("n")
    spread = F.col("tt") - F.col("t") * F.col("t") / n
    joint = F.col("ty") - F.col("t") * F.col("y") / n
    slope = F.when(spread > 0, joint / spread).otherwise(0.0)
    error = F.col("yy") - F.col("y") * F.col("y") / n - slope * joint
    return sums.select("id", "a", "b", "rows", "n", slope.alias("slope"),
                       (F.col("t") / n).alias("mean_t"), (F.col("y") / n).alias("mean_y"),
                       F.greatest(error, F.lit(0.0)).alias("sse"))


def segmentation(pieces: DataFrame, changes: int = CHANGES) -> DataFrame:
    """``(id, edges, sse)`` of the best segmentation of each stratum: rows at which the trend
    changes, with 0 and the last row. Of equal ones the one with fewer, then earlier breaks."""
    step = pieces.select("id", "a", "b", "rows", "sse")
    best = step.where("a = 0").select("id", "rows", "b", F.struct(
        F.col("sse").alias("sse"), F.array("a").alias("path")).alias("best"))
    levels = [best.withColumn("k", F.lit(1))]
    for k in range(2, changes + 2):
        before, last = best.alias("before"), step.alias("last")
        longer = F.struct(
            (F.col("before.best.sse") + F.col("last.sse")).alias("sse"),
            F.concat("before.best.path", F.array("last.a")).alias("path"))
        best = (before.join(last, (F.col("before.id") == F.col("last.id"))
                            & (F.col("before.b") == F.col("last.a")))
                .groupBy(F.col("last.id").alias("id"), F.col("last.rows").alias("rows"),
                         F.col("last.b").alias("b")).agg(F.min(longer).alias("best")))
        levels.append(best.withColumn("k", F.lit(k)))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    whole = whole.where("b = rows")
    n, k = F.col("rows").cast("double"), F.col("k")
    criterion = (n * F.log(F.greatest(F.col("best.sse") / n, F.lit(STRAIGHT)))
                 + (3 * k - 1) * F.log(n))
    return whole.groupBy("id").agg(F.min(F.struct(
        criterion.alias("criterion"), "k", "best", "rows")).alias("m")).select(
        "id", F.concat("m.best.path", F.array("m.rows")).alias("edges"),
        F.col("m.best.sse").alias("sse"))


def changing_trend(totals: DataFrame, strata: Sequence[str], candidates: int = CANDIDATES,
                   span: float = SPAN, changes: int = CHANGES) -> tuple[DataFrame, DataFrame]:
    """The prefix moments, and the chosen stretches ``(id, a, b, rows, n, slope, mean_t, mean_y,
    sse, total_sse, stretches)``."""
    prefix = prefix_moments(totals, strata)
    pieces = settled(stretches(prefix, candidates, span))
    chosen = segmentation(pieces, changes)
    place = F.explode(F.sequence(F.lit(1), F.size("edges") - 1))
    edges = chosen.select("id", "edges", F.col("sse").alias("total_sse"), place.alias("i")).select(
        "id", "total_sse", (F.size("edges") - 1).alias("stretches"),
        F.element_at("edges", F.col("i")).alias("a"),
        F.element_at("edges", F.col("i") + 1).alias("b"))
    return prefix, pieces.join(edges, ["id", "a", "b"])


def line_at(since: Column) -> Column:
    """The line of a stretch, so many days after the stratum's first."""
    return F.col("mean_y") + F.col("slope") * (since - F.col("mean_t"))
