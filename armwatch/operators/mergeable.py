"""Partial aggregates that merge: distinct counts and quantiles of any union of cells.

A cell is one value of the keys, such as a month and a site. Its partial aggregate is written
once; reports over fewer keys or other periods merge cells and never read the rows again.

* Bitmaps count distinct whole-number ids exactly: one word of 64 bits per cell and bucket of ids.
  A lone id takes one word, so a cell with few of the ids is no larger than its rows, and words are
  merged in place, without sorting.
* HLL sketches count any ids within about 1.04 / sqrt(2^lg_k) (one standard error).
* KLL sketches give quantiles whose rank is off by less than about 2.3 / k^0.9 (99 %).

Nulls are in no cell's count; a null key is a cell like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwatch.columns import col, cols

LG_WORD = 6
LG_K = 14
KLL_K = 400


def _id_of(keys: Sequence[str]) -> Column:
    """The keys as one struct, in which nulls are equal."""
    return F.struct(F.lit(0).alias("one"), *cols(keys)).alias("id")


def _keys_of(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"id.`{key}`").alias(key) for key in keys]


def whole_number(name: str) -> Column:
    """An id as a whole number; fails on one that isn't, rather than count it with others."""
    number = col(name).try_cast("bigint")
    return F.when(col(name).isNull(), None).otherwise(F.coalesce(number, F.raise_error(F.concat(
        F.lit(f"Bitmaps need whole numbers in {name}; use sketches for "),
        col(name).cast("string"))).cast("bigint")))


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """``(keys, bucket, ids)``: the ids of each cell as the bits of whole numbers."""
    number = df.select(*cols(keys), whole_number(ident).alias("__id")).where("__id IS NOT NULL")
    place = F.col("__id").bitwiseAND(F.lit(2 ** LG_WORD - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    return (number.groupBy(*cols(keys), F.shiftright("__id", LG_WORD).alias("bucket"))
            .agg(F.bit_or(bit).alias("ids")))


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same over fewer keys."""
    return bitmaps.groupBy(*cols(keys), "bucket").agg(F.bit_or("ids").alias("ids"))


def bitmap_counts(bitmaps: DataFrame, keys: Sequence[str], output: str = "n") -> DataFrame:
    """Exact distinct ids per value of the keys."""
    return merged_bitmaps(bitmaps, keys).groupBy(*cols(keys)).agg(
        F.sum(F.bit_count("ids")).alias(output))


def bitmap_rollup(bitmaps: DataFrame, keys: Sequence[str], output: str = "n") -> DataFrame:
    """Distinct ids at every prefix of the keys, ``level`` keys deep: each level is merged from
    the one below, so the cells are read once."""
    out, below = None, bitmaps
    for depth in range(len(keys), -1, -1):
        below = merged_bitmaps(below, keys[:depth])
        level = below.groupBy(*cols(keys[:depth])).agg(F.sum(F.bit_count("ids")).alias(output))
        if depth == 0:
            level = level.withColumn(output, F.coalesce(col(output), F.lit(0)))
        level = level.select(
            F.lit(depth).cast("long").alias("level"), *cols(keys[:depth]),
            *(F.lit(None).cast(bitmaps.schema[k].dataType).alias(k) for k in keys[depth:]),
            output)
        out = level if out is None else out.unionByName(level)
    return out


def distinct_sketches(df: DataFrame, keys: Sequence[str], ident: str,
                      lg_k: int = LG_K) -> DataFrame:
    """``(keys, sketch)`` of the ids of each cell, of any type."""
    return df.groupBy(*cols(keys)).agg(F.hll_sketch_agg(col(ident), lg_k).alias("sketch"))


def sketched_counts(sketches: DataFrame, keys: Sequence[str], output: str = "n") -> DataFrame:
    """Estimated distinct ids per value of the keys."""
    return sketches.groupBy(*cols(keys)).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(output))


def quantile_sketches(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
                      k: int = KLL_K) -> DataFrame:
    """``(keys, variable, sketch)``: one KLL sketch per cell and measure. NaN counts as null."""
    long = df.select(*cols(keys), F.inline(F.array(*(
        F.struct(F.lit(m).alias("variable"), col(m).cast("double").alias("value"))
        for m in measures))))
    return (long.where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(_id_of(keys), "variable")
            .agg(F.kll_sketch_agg_double("value", k).alias("sketch"))
            .select(*_keys_of(keys), "variable", "sketch"))


def sketched_quantiles(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float],
                       k: int = KLL_K) -> DataFrame:
    """``(keys, variable, prob, value, n)`` over all cells of the keys: values of the data whose
    rank is near the asked one, and the exact number of values."""
    merged = (sketches.groupBy(_id_of(keys), "variable")
              .agg(F.kll_merge_agg_double("sketch", k).alias("sketch")))
    found = F.array(*(F.struct(
        F.lit(float(p)).alias("prob"),
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value"))
        for p in probs))
    return merged.select(*_keys_of(keys), "variable", F.inline(found),
                         F.kll_sketch_get_n_double("sketch").alias("n"))


def rank_error(estimates: DataFrame, df: DataFrame, keys: Sequence[str],
               measures: Sequence[str]) -> DataFrame:
    """The estimates with how far their exact ranks (shares of values below, and at or below)
    lie from the asked ones; 0 inside. One pass over the rows, for tests and audits."""
    held = estimates.groupBy(_id_of(keys), "variable").agg(
        F.collect_list(F.struct("prob", "value")).alias("asked"))
    long = df.select(_id_of(keys), F.inline(F.array(*(
        F.struct(F.lit(m).alias("variable"), col(m).cast("double").alias("own"))
        for m in measures))))
    counted = (long.where(F.col("own").isNotNull() & ~F.isnan("own"))
               .groupBy("id", "variable", "own").agg(F.count("*").alias("often"))
               .join(held, ["id", "variable"]).select("*", F.inline("asked"))
               .groupBy("id", "variable", "prob", "value").agg(
                   F.sum("often").alias("n"),
                   F.sum(F.when(F.col("own") < F.col("value"), F.col("often")).otherwise(0))
                   .alias("below"),
                   F.sum(F.when(F.col("own") <= F.col("value"), F.col("often")).otherwise(0))
                   .alias("upto")))
    n, prob = F.col("n"), F.col("prob")
    return counted.select(*_keys_of(keys), "variable", "prob", "value", "n", F.greatest(
        F.col("below") / n - prob, prob - F.col("upto") / n, F.lit(0.0)).alias("error"))
