"""Hand-computed small tables for the decisions that the SQL comparison does not pin down."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from armwatch.operators.filters import date_range, filter_rows, predicate
from armwatch.operators.shape import complete_grid, with_subtotals
from armwatch.plans import collection, dashboard, enrolment, power, profile, safety, volume
from armwatch.sources.contract import SAFETY

DAY = dt.date(2020, 3, 2)        # a Monday


@pytest.fixture(scope="module")
def arms(spark):
    """Donor d1 is in both arms; collection c1 appears twice; group B has no events."""
    rows = [("d1", "c1", "A", "male", DAY, True, True, False),
            ("d1", "c1", "A", "male", DAY, True, False, False),
            ("d2", "c2", "A", "female", DAY + dt.timedelta(7), False, False, False),
            ("d1", "c3", "B", "male", DAY + dt.timedelta(7), True, False, False),
            ("d3", "c4", "B", "male", DAY + dt.timedelta(7), True, False, False)]
    return spark.createDataFrame(
        rows, "don_id string, col_id string, `group` string, gender string, col_date date, "
              "itt boolean, all_ae boolean, `only_1.1` boolean").withColumns({
                  "mitt": F.lit(True), "pp": F.lit(True), "sig_hyp": F.col("all_ae"),
                  "hyp": F.col("all_ae"), "non_hyp": F.lit(False), "1.1": F.col("all_ae")})


def by(rows, *keys):
    return {tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]: row for row in rows}


def test_donation_totals_are_added_up(arms):
    table = by(safety.summary_donat(arms, plan=10).collect(), "group")
    assert (table["A"].don_id_nunique, table["B"].don_id_nunique) == (2, 2)
    assert table["grand_total"].don_id_nunique == 4            # d1 counted in both arms
    assert table["grand_total"].col_id_pct == 40.0             # of the plan
    assert table["A"].col_per_don_mean == 1.0
    assert table["grand_total"].col_per_don_mean == 1.0


def test_risk_counts_rows_against_distinct_collections(arms):
    table = by(safety.summary_risk(arms).collect(), "group", "variable", "metric")
    assert table["A", "all_ae", "sum"].value == 1
    assert table["A", "all_ae", "pct"].value == 50.0
    assert table["grand_total", "all_ae", "pct"].value == 25.0
    assert not any(key[1] == "ser_hyp" for key in table)


def test_severity_keeps_empty_levels(arms):
    table = by(safety.summary_sev(arms, ["group", "gender"], "all_ae").collect(),
               "group", "gender")
    assert table["B", "female"]["sum"] == 0                    # no such rows at all
    assert table["B", "male"].pct is None                      # share of an empty total
    assert table["A", "male"].pct == 100.0
    assert table["A", "A - subtotal"]["sum"] == 1
    assert table["grand_total", " "]["sum"] == 1
    given = safety.summary_sev(arms, ["gender"], "all_ae", levels={"gender": ["male", "other"]})
    assert {r.gender for r in given.collect()} == {"male", "other", "grand_total"}


def test_longitudinal_counts_a_missing_arm_as_zero(arms):
    table = by(safety.summary_longitudinal(arms, "wald", "all_ae", "mitt", "w").collect(),
               "period", "sample", "metric")
    assert table[DAY, "B", "n"].value == 0
    assert (DAY, "B", "rate") not in table
    assert table[DAY, "pulled", "n"].value == 1


def test_unknown_names(arms):
    with pytest.raises(ValueError):
        safety.calc_ci(arms, "mild")
    with pytest.raises(ValueError):
        safety.summary_aes(arms, "all_ae", "everyone")
    with pytest.raises(TypeError):
        safety.summary_sev(arms, [], "all_ae")
    with pytest.raises(KeyError):
        safety.severity_piechart(arms, ["gender", "site"], "all_ae")
    with pytest.raises(ValueError):
        safety.summary_longitudinal(arms, "wald", "all_ae", aggregate="y")
    with pytest.raises(ValueError):
        dashboard.summary_demographic(arms, "EYES")
    with pytest.raises(KeyError):
        enrolment.rate_metrics(arms, "group", [], True, ["mode"])
    with pytest.raises(KeyError):
        enrolment.rate_metrics(arms, "group", [], True, [])


def test_filters(arms):
    assert filter_rows(arms, SAFETY, query={"SEV": "only_1.1"}).count() == 0
    assert filter_rows(arms, SAFETY, query={"gender": "male", "POP": "itt"}).count() == 4
    with pytest.raises(ValueError):
        predicate({"gender": "unknown"}, SAFETY, {"gender": ["male", "female"]})
    with pytest.raises(ValueError):
        predicate({"POP": "nobody"}, SAFETY)
    with pytest.raises(ValueError):
        date_range(arms, start="2019-01-01")
    assert date_range(arms, start="2019-01-01", strict=False).count() == 5
    assert date_range(arms, end="2020-03-02").count() == 2


def test_subtotal_labels(spark):
    df = spark.createDataFrame([("a", "x", "p", 1), ("a", "y", "p", 2)], "r string, s string, t string, n int")
    found = {(r.r, r.s, r.t): r.n for r in with_subtotals(df, ["r", "s", "t"], ["n"]).collect()}
    assert found["a", "x", "a | x - subtotal"] == 1
    assert found["a", "a - subtotal", " "] == 3
    assert found["grand_total", " ", " "] == 3


def test_complete_grid(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "r string, s string, n int")
    assert sorted(tuple(r) for r in complete_grid(df, ["r", "s"], ["n"]).collect()) == [
        ("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 2)]


# ------------------------------------------------------------------------------- enrolment

@pytest.fixture(scope="module")
def enrolled(spark):
    """Stratum f has no enrolment in the last week; subject 1 enrols twice."""
    rows = [(dt.datetime(2020, 3, 2, 9), "1", "S", "m"), (dt.datetime(2020, 3, 3), "2", "S", "m"),
            (dt.datetime(2020, 3, 4), "3", "S", "f"), (dt.datetime(2020, 3, 16), "1", "S", "m"),
            (dt.datetime(2020, 3, 17), "4", "S", "m")]
    return enrolment.load(spark.createDataFrame(
        rows, "ENR_DATE timestamp_ntz, SUBJECT_ID string, SITE string, STRATA1 string"))


def test_projection_carries_idle_strata(spark, enrolled):
    steps = spark.createDataFrame([("m", 2.0), ("f", 1.0)], "STRATA1 string, proj_value double")
    found = by(enrolment.projections(enrolled, ["STRATA1"], False, steps, 10, 10).collect(),
               "week", "STRATA1")
    last = dt.date(2020, 3, 16)
    assert found[last, "f"].value == 1                         # carried, not restarted
    assert found[last, "m"].value == 4
    ahead = {k: r.value for k, r in found.items() if k[0] > last}
    # totals 8 and 11: the second week reaches 10
    assert ahead == {(dt.date(2020, 3, 23), "m"): 6, (dt.date(2020, 3, 23), "f"): 2,
                     (dt.date(2020, 3, 30), "m"): 8, (dt.date(2020, 3, 30), "f"): 3}
    reached = enrolment.projections(enrolled, ["STRATA1"], False, steps, 10, 5)
    assert reached.agg(F.max("week")).first()[0] == last       # nothing to project
    early = enrolment.projections(enrolled, ["STRATA1"], False, steps, 10, 10, "compounded")
    assert early.agg(F.max("week")).first()[0] == dt.date(2020, 3, 23)


def test_new_donors_only_count_once(enrolled):
    chart = enrolment.bar_chart(enrolled, "week", True, ["STRATA1"], only_new_donors=True)
    assert chart.agg(F.sum("absolute")).first()[0] == 4


def test_dense_chart_fills_idle_weeks(enrolled):
    found = by(enrolment.dense_bar_chart(enrolled, "week", False, ["STRATA1"]).collect(),
               "week", "STRATA1", "metric")
    idle = dt.date(2020, 3, 9)
    assert found[idle, "m", "absolute"].value == 0
    assert found[idle, "m", "cumsum"].value == 2
    assert found[dt.date(2020, 3, 16), "f", "cumsum"].value == 1


def test_trend_recovers_a_line(spark):
    start = dt.datetime(2020, 1, 6)
    rows = [(start + dt.timedelta(days=d), str(d * 3 + i), "S", "m")
            for d in range(20) for i in range(3)]
    data = enrolment.load(spark.createDataFrame(
        rows, "ENR_DATE timestamp_ntz, SUBJECT_ID string, SITE string, STRATA1 string"))
    for trend in ("linear", "changepoint"):
        found = enrolment.model_projections(data, ["SITE"], True, 30, 74, trend).collect()
        last = max(found, key=lambda r: r.day)
        assert last.yhat == pytest.approx(75, abs=1e-3)
        assert last.day == (start + dt.timedelta(days=24)).date()
        assert all(r.yhat_lower <= r.yhat + 1e-6 and r.yhat <= r.yhat_upper + 1e-6 for r in found)


# --------------------------------------------------------------------- profile, volume, others

def test_chronology_of_one_busy_day(spark, sf_dir):
    from armwatch.sources.collections import collections, profile_view
    data = profile_view(collections(spark, sf_dir))
    one = data.limit(1)
    rows = [one.withColumns({"don_id": F.lit("d"), "col_id": F.lit(str(i)),
                             "col_date": F.lit(day).cast("date"), "proc_start":
                             F.lit(f"{day} {hour:02d}:00:00").cast("timestamp_ntz")})
            for i, (day, hour) in enumerate([("2020-01-01", 9), ("2020-01-04", 8),
                                             ("2020-01-04", 15), ("2020-01-09", 8)])]
    together = rows[0]
    for row in rows[1:]:
        together = together.unionByName(row)
    found = profile.chronology(together).orderBy("collection_id").collect()
    assert [r.days_total for r in found] == [0, 3, 3, 8]
    assert [r.days_lag for r in found] == [0, 3, 0, 5]
    twice = profile.chronology(together.unionByName(together))
    assert twice.count() == 8 and twice.agg(F.sum("days_lag")).first()[0] == 8
    nobody = together.withColumn("don_id", F.lit(None).cast("string"))
    assert [r.days_lag for r in profile.chronology(nobody).collect()] == [None] * 4


def test_nomogram_is_capped_and_gain_has_the_sign_of_the_mean(spark, sf_dir):
    from armwatch.sources.collections import collections, volume_view
    data = volume_view(collections(spark, sf_dir, quartiles=True))
    targets = volume.with_nomograms(data)
    assert targets.agg(F.max("persona_2")).first()[0] <= 1000
    assert targets.where("persona_2 < persona_1").count() == 0
    for row in volume.comparative_gain(data, "mitt", "gender").collect():
        assert row["left"] <= row["mean"] <= row["right"]


def test_shares_add_up(spark, sf_dir):
    from armwatch.sources.collections import collections, dashboard_view
    table = dashboard_view(collections(spark, sf_dir, quartiles=True))
    for row in dashboard.summary_demographic(table, "AGE").collect():
        assert row.A + row.B == pytest.approx(1)
    for by_name in ("GENDER", "STATUS"):
        total = dashboard.summary_demographic(table, by_name, False).agg(F.sum("value")).first()[0]
        assert total == pytest.approx(2)                       # both arms


def test_raw_distribution_holds_every_row(spark, sf_dir):
    from armwatch.sources.collections import collections
    data = collections(spark, sf_dir)
    kept = collection.plasma_summary(data, ["site"], "mitt", raw=True).where("metric = 'raw_data'")
    assert kept.agg(F.sum("n")).first()[0] == data.where("mitt").count() * 6
    flags = collection.plasma_summary(data, None, "mitt", raw=True).where("metric = 'flags'")
    assert flags.agg(F.sum("n")).first()[0] == data.where("mitt").count() * 5


# ----------------------------------------------------------------------------------- power

@pytest.fixture(scope="module")
def post(spark):
    rows = [("A", "1", i < 5) for i in range(1000)] + [("B", "2", i < 6) for i in range(1000)]
    data = spark.createDataFrame(rows, "`group` string, k string, sig_hyp boolean").withColumns({
        "col_id": F.concat("k", F.monotonically_increasing_id().cast("string")),
        "col_date": F.lit(DAY)})
    return power.posterior(data)


def test_posterior(post):
    row = post.where("`group` = 'A'").first()
    assert (row.n_aes, row.n_col, row.post_n) == (5, 1000, 1001)
    assert row.weighted_p == pytest.approx(5.5 / 1001)
    assert row.success + row.failure == pytest.approx(1001)
    with pytest.raises(ValueError):
        power.posterior(post, prior_p=(.1, 1.2))
    with pytest.raises(ValueError):
        power.posterior(post, prior_n=(1,))


def test_draws_have_the_predictive_mean(post):
    sizes = power.sample_sizes(post, 6000, 1000)
    assert [r.group_size for r in sizes.orderBy("group_size").collect()] == [1000, 2000, 3000]
    draws = power.predictive_draws(sizes, 15_000, seed=3)
    means = {r.group_size: r for r in draws.groupBy("group_size").agg(
        F.count("*").alias("n"), F.avg("x_A").alias("mean"), F.stddev("x_A").alias("sd")).collect()}
    for size, row in means.items():
        expected = 5 + (size - 1000) * 5.5 / 1001
        assert row.n == 15_000
        assert abs(row["mean"] - expected) <= 5 * (row.sd or 0) / 15_000 ** .5 + 1e-9


def test_simulation_does_not_depend_on_partitioning(spark, post):
    def run():
        return [tuple(r) for r in power.simulate(post, 12_000, 1000, plan=6000, seed=1)
                .orderBy("group_size").collect()]
    first = run()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    by_size = {row[0]: row for row in first}
    assert by_size[3000][1] < by_size[1000][1]                 # intervals get narrower


def test_bucketed_donors_need_no_shuffle(spark, sf_dir):
    from armwatch.plans import profile
    from armwatch.sources.collections import collections, profile_view
    from armwatch.sources.tables import by_key

    plain = profile_view(collections(spark, sf_dir))
    kept = by_key(plain, "don_id", ("col_date",), buckets=4)
    assert kept.count() == plain.count() and kept.columns == plain.columns
    for report in (profile.summary_dem, profile.summary_col,
                   lambda df: profile.summary_dem(df, ["10", "11"])):
        plan = report(kept)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
    # A repeated donor, a donor without an id and an empty table.
    odd = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", None)], "k string, n int")
    again = by_key(odd, "k", buckets=3)
    assert sorted(map(str, again.collect())) == sorted(map(str, odd.collect()))
    counts = again.groupBy("k", "n").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.k, r.n): r["count"] for r in counts.collect()} == {
        ("a", 1): 2, (None, 2): 1, ("b", None): 1}
    assert by_key(odd.limit(0), "k", buckets=3).count() == 0


def test_chronology_sorts_the_rows_once(spark, sf_dir):
    from armwatch.sources.collections import collections, profile_view

    data = profile_view(collections(spark, sf_dir))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = profile.chronology(data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.split("\n")
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    window = next(i for i, line in enumerate(lines) if "Window" in line)
    assert not any("Exchange" in line or "Sort [" in line for line in lines[join:window])


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    from armwatch.sources import tables

    monkeypatch.setattr(tables, "BUCKET_ROWS", 100, raising=False)
    rows = spark.range(2_050).selectExpr("id % 500 AS k", "id AS n")
    kept = tables.by_key(rows, "k", ("n",), buckets=4)
    files = spark.read.format("parquet").load(kept.inputFiles()).groupBy(
        F.input_file_name()).count().collect()
    assert len(files) == 21 and max(r["count"] for r in files) < 300
    assert sorted(kept.collect()) == sorted(rows.collect())
    few = tables.by_key(rows.limit(50), "k", buckets=4)
    assert len(few.inputFiles()) <= 4 and few.count() == 50


@pytest.mark.parametrize("donors", [True, False])
def test_site_metrics_from_one_read(spark, tmp_path, donors):
    """Rates, counts, shares and activation dates as counted by hand; null subjects count in no
    column, rows of a null stratum count for their site only. One scan, no join."""
    rows = [(f"s{i % 3}", None if i % 17 == 0 else "xy"[i % 5 % 2], None if i % 11 == 0 else i % 23,
             dt.date(2020, 1, 1 + i % 28)) for i in range(400)]
    path = str(tmp_path / "enrolled")
    spark.createDataFrame(rows, "site string, arm string, id int, day date").withColumn(
        "week", enrolment.week_of(F.col("day"))).write.parquet(path)
    data = spark.read.parquet(path)
    table = enrolment.site_metrics(data, "site", ["arm"], donors, ["max", "mean"], "day", "id")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    found = {(r.site, r.arm): r for r in table.collect()}
    assert set(found) == {(f"s{i}", a) for i in range(3) for a in "xy"}
    for (site, arm), r in found.items():
        whole = [x for x in rows if x[0] == site]
        own = [x for x in whole if x[1] == arm]
        weeks = {}
        for x in own:
            weeks.setdefault(x[3] - dt.timedelta(x[3].weekday()), []).append(x[2])
        sizes = [len({v for v in w if v is not None}) if donors
                 else sum(v is not None for v in w) for w in weeks.values()]
        ids = [[x[2] for x in part if x[2] is not None] for part in (own, whole)]
        assert (r.max, r.mean) == (max(sizes), pytest.approx(sum(sizes) / len(sizes)))
        assert (r.donation_count, r.donor_count) == (len(ids[0]), len(set(ids[0])))
        assert r.donation_percentage == pytest.approx(len(ids[0]) / len(ids[1]))
        assert r.donor_percentage == pytest.approx(len(set(ids[0])) / len(set(ids[1])))
        assert r.activation_date == str(min(x[3] for x in whole))
