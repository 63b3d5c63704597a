"""Exact quantiles against numpy, also for skewed and heavy-tailed groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from armwatch.operators.prepare import quantile_bins
from armwatch.operators.quantiles import exact_quantiles, value_frequencies

PROBS = [0, .025, .25, .5, .75, .975, 1]


def _frame(spark, groups):
    rows = [(key, float(v)) for key, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "key string, v double")


def test_same_as_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(800, 50, 4000), "tail": np.exp(rng.normal(0, 8, 501)),
              "ties": rng.integers(0, 3, 300), "one": [7.5], "two": [1, 2],
              "same": [3.0] * 50, "negative": -rng.exponential(1, 77)}
    found = exact_quantiles(_frame(spark, groups), ["key"], ["v"], PROBS).collect()
    assert len(found) == len(groups) * len(PROBS)
    for row in found:
        assert row.value == pytest.approx(np.quantile(groups[row.key], row.prob), rel=1e-12)


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, [], ["v"], [.5]).first().value == 2.0


def test_frequencies_keep_every_value(spark):
    df = _frame(spark, {"a": [1, 1, 2], "b": [2]})
    found = {(r.key, r.value): r.n for r in value_frequencies(df, ["key"], ["v"]).collect()}
    assert found == {("a", 1): 2, ("a", 2): 1, ("b", 2): 1}


def test_quantile_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3, 4, 5, 6]], "v double")
    binned = quantile_bins(df, "v", ("q1", "q2", "q3", "q4"), "bin")
    found = [(r.v, r.bin) for r in binned.orderBy("v").collect()]
    # quartiles 1, 2.5, 4.25: the first bin is closed on both sides
    assert found == [(1, "q1"), (1, "q1"), (1, "q1"), (2, "q2"), (3, "q3"), (4, "q3"), (5, "q4"),
                     (6, "q4")]


def test_freq_is_computed_once(spark, sf_dir):
    from armwatch.sources.collections import collections
    found = exact_quantiles(collections(spark, sf_dir), ["site"], ["speed"], [.5])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # The source was read for the range partitions; what remains reads those from the checkpoint.
    assert plan.count("FileScan parquet") == 0


@pytest.mark.parametrize("shape", ["outlier", "log"])
def test_no_task_holds_a_whole_group(spark, shape):
    rng = np.random.default_rng(7)
    values = rng.normal(0, 1, 40_000) if shape == "outlier" else np.exp(rng.normal(0, 20, 40_000))
    if shape == "outlier":
        values[0] = 1e12
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = value_frequencies(df, [], ["v"]).repartitionByRange("variable", "value")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * len(values) / len(sizes)
        for row in exact_quantiles(df, [], ["v"], PROBS).collect():
            assert row.value == pytest.approx(np.quantile(values, row.prob), rel=1e-12)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
