"""Partial aggregates against one aggregate over all rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from armwatch.operators import filters, mergeable
from armwatch.plans import safety
from armwatch.sources import tables
from armwatch.sources.collections import collections, safety_view
from armwatch.sources.contract import SAFETY
from armwatch.streaming import partials

FLAGS = ("all_ae", "non_hyp", "hyp", "sig_hyp", "only_1.1")


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 50 == 0 else f"s{i % 3}", int(i % 7),
             None if i % 31 == 0 else int(rng.integers(-70_000, 70_000)), float(rng.normal()))
            for i in range(6000)]
    rows += [("s0", 1, 5, float("nan")), ("s1", 2, 0, None), ("s9", 1, None, None)] * 2
    return spark.createDataFrame(rows, "site string, month int, ident long, x double").cache()


def distinct(rows, key):
    out = {}
    for r in rows:
        if r.ident is not None:
            out.setdefault(key(r), set()).add(r.ident)
    return {k: len(v) for k, v in out.items()}


def test_bitmaps_are_exact_over_any_keys(spark, cells):
    rows = cells.collect()
    held = mergeable.distinct_bitmaps(cells, ["site", "month"], "ident")
    by_site = {r.site: r.n for r in mergeable.bitmap_counts(held, ["site"]).collect()}
    assert by_site == distinct(rows, lambda r: r.site)
    some = mergeable.bitmap_counts(held.where("month < 3"), []).first().n
    assert some == distinct([r for r in rows if r.month < 3], lambda r: 0)[0]
    levels = {(r.level, r.site, r.month): r.n
              for r in mergeable.bitmap_rollup(held, ["site", "month"]).collect()}
    assert levels[0, None, None] == distinct(rows, lambda r: 0)[0]
    assert levels[1, None, None] == by_site[None]
    assert levels[2, "s1", 4] == distinct(rows, lambda r: (r.site, r.month))["s1", 4]
    none = mergeable.bitmap_rollup(held.where("false"), ["site"]).collect()
    assert [(r.level, r.n) for r in none] == [(0, 0)]
    with pytest.raises(Exception, match="whole numbers in name"):
        mergeable.distinct_bitmaps(cells.withColumn("name", F.lit("x7")), [], "name").collect()


def test_a_lone_id_takes_one_word(spark):
    ids = [*range(-130, 130), *(k * 40_000 + j for k in range(-50, 50) for j in (0, 63))]
    rows = spark.createDataFrame([(i % 2, i) for i in ids * 2], "k int, ident long")
    held = mergeable.distinct_bitmaps(rows, ["k"], "ident")
    words = {(i % 2, i // 64) for i in ids}
    assert held.count() == len(words) and dict(held.dtypes)["ids"] == "bigint"
    assert mergeable.bitmap_counts(held, []).first().n == len(set(ids))
    by_key = {r.k: r.n for r in mergeable.bitmap_counts(held, ["k"]).collect()}
    assert by_key == {k: len({i for i in ids if i % 2 == k}) for k in (0, 1)}


def test_the_latest_versions_need_no_task_per_unit(spark):
    rows = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 11), ("a", 2, 12), (None, 1, 13), ("b", None, 14), ("b", 1, 15)],
        "unit string, version int, x int")
    kept = partials.latest(rows)
    assert sorted(r.x for r in kept.collect()) == [11, 12, 13, 15]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_sketches_are_near(cells):
    rows = cells.collect()
    held = mergeable.distinct_sketches(cells, ["site", "month"], "ident")
    exact = distinct(rows, lambda r: r.site)
    for r in mergeable.sketched_counts(held, ["site"]).collect():
        assert abs(r.n - exact.get(r.site, 0)) <= .05 * exact.get(r.site, 0)


def test_quantile_sketches_are_near_in_rank(cells):
    held = mergeable.quantile_sketches(cells, ["site", "month"], ["x", "ident"])
    found = mergeable.sketched_quantiles(held, ["site"], [0, .1, .5, .9, 1])
    errors = mergeable.rank_error(found, cells, ["site"], ["x", "ident"]).collect()
    assert len(errors) == 4 * 2 * 5 and {r.site for r in errors} == {None, "s0", "s1", "s2"}
    assert max(r.error for r in errors) < .02
    part = mergeable.sketched_quantiles(held.where("month < 2"), [], [.5])
    own = mergeable.rank_error(part, cells.where("month < 2"), [], ["x", "ident"]).collect()
    assert len(own) == 2 and max(r.error for r in own) < .02
    assert {r.n for r in part.collect()} == {r.n for r in own}


def test_a_redelivered_file_replaces_its_own_partials(spark, sf_dir, tmp_path):
    columns = ["col_id", "col_date", "group", *(F.col(f"`{f}`") for f in FLAGS)]
    table = safety_view(collections(spark, sf_dir)).select(*columns)
    data, schema = table.toPandas(), table.schema
    source, target = tmp_path / "in", str(tmp_path / "out")

    def deliver(folder, name, rows):
        (source / folder).mkdir(parents=True, exist_ok=True)
        rows.to_csv(source / folder / name, index=False)

    def update():
        partials.maintain(
            spark, f"{source}/*", schema, target, str(tmp_path / "progress"), ["group"], FLAGS,
            ["col_id"], file_format="csv")

    def risk(sums, ids):
        return sorted(map(tuple, safety.risk_of_partials(sums, ids).collect()))

    def reported(**days):
        return risk(partials.sums(spark, target, ["group"], FLAGS, **days),
                    partials.ids(spark, target, "col_id", ["group"]))

    def whole(rows):
        return sorted(map(tuple, safety.summary_risk(spark.createDataFrame(rows, schema)).collect()))

    half = len(data) // 2
    deliver("first", "a.csv", data[:half - 100])         # a hundred rows are missing at first
    update()
    assert reported() == whole(data[:half - 100])
    deliver("second", "b.csv", data[half:])
    deliver("second", "c.csv", data[half:half + 10])
    update()
    deliver("third", "a.csv", data[:half])
    deliver("third", "c.csv", data[:0])                  # no rows: the old partials stay
    deliver("fourth", "b.csv", data[half:])
    update()
    update()                                             # nothing new
    both = data.iloc[[*range(len(data)), *range(half, half + 10)]]
    assert reported() == whole(both)
    start, end = dt.date(1996, 1, 1), dt.date(1997, 6, 30)
    days = partials.sums(spark, target, ["group"], FLAGS, start, end).collect()
    inside = both[(both.col_date >= start) & (both.col_date <= end)]
    assert {r.group: r.n for r in days} == inside.groupby("group").size().to_dict()


def test_a_date_range_reads_only_its_months(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    data = safety_view(collections(spark, sf_dir, quartiles=True))
    tables.save_rows(data.select(*(F.col(f"`{c}`") for c in SAFETY.selected(data.columns))),
                     path, month_of="col_date")
    table = tables.read_parquet(spark, path, SAFETY, month_of="col_date")
    chosen = filters.date_range(table, "1996-02-10", "1996-04-01", strict=False)
    want = data.where("col_date BETWEEN '1996-02-10' AND '1996-04-01'").count()
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for folder in (tmp_path / "t").glob("month=*"):      # files of other months can't be read
        if folder.name[6:] not in ("1996-02", "1996-03", "1996-04"):
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"spoilt")
    assert chosen.count() == want > 0
    with pytest.raises(Exception):
        table.select("col_id").collect()
    with pytest.raises(KeyError, match="no folders by month"):
        tables.read_parquet(spark, str(tmp_path / "t" / "month=1996-02"), SAFETY,
                            month_of="col_date")
    with pytest.raises(KeyError, match="of its own"):
        tables.save_rows(data.withColumn("month", F.lit(1)), path + "2", month_of="col_date")
    # a month column that doesn't come from folders is an ordinary one
    own = spark.createDataFrame([(dt.date(1996, 2, 11), "x")], "col_date date, month string")
    assert filters.date_range(own, "1996-02-10", "1996-04-01", strict=False).count() == 1
