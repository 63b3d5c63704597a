"""Contracts, raw preparation, sources, sinks and incremental refresh."""

import os

import pytest
from pyspark.sql import functions as F

from armwatch.operators import ledger, prepare
from armwatch.sources import tables
from armwatch.sources.collections import collections, raw_view, safety_view
from armwatch.sources.contract import (
    PLASMA, RAW_PLASMA, RAW_PROFILE, RAW_SAFETY, SAFETY, spark_pattern)
from armwatch.streaming.intake import refresh_from_files


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return raw_view(collections(spark, sf_dir)).cache()


def test_contract_names_absent_and_repeated_columns():
    header = SAFETY.names()
    SAFETY.check(header)
    with pytest.raises(KeyError, match="don_id"):
        SAFETY.check(header[1:])
    with pytest.raises(KeyError, match="col_id"):
        SAFETY.check([*header, "col_id"])


def test_event_codes_follow_the_header():
    assert SAFETY.event_codes("sig_hyp", ["1.1", "1.2", "2.1"]) == ["1.2"]
    assert SAFETY.event_codes("all_ae", ["10.6", "1.1"]) == ["1.1", "10.6"]
    assert SAFETY.margin("sig_hyp") == .15


def test_patterns():
    assert spark_pattern("%m/%d/%Y %H:%M") == "M/d/yyyy H:m"
    with pytest.raises(ValueError):
        spark_pattern("%j")


def test_bins_are_half_open(spark):
    df = spark.createDataFrame([(17.9,), (18.0,), (24.9,), (25.0,), (1000.0,)], "v double")
    label = prepare.fixed_bins(F.col("v"), (18, 25, 1000), ("young", "old"))
    assert [r[0] for r in df.select(label).collect()] == [None, "young", "young", "old", None]
    with pytest.raises(ValueError):
        prepare.fixed_bins(F.col("v"), (1, 2), ("a",))


def test_nulls_are_rejected_before_binning(raw):
    spoiled = raw.withColumn("AGE", F.when(F.col("COLLECTION_NUMBER").endswith("3"), None)
                             .otherwise(F.lit(5.0)))
    data, missing = prepare.prepare_safety(spoiled)
    assert missing.count() == spoiled.where("AGE IS NULL").count() > 0
    assert data.count() + missing.count() == raw.count()
    assert data.where("age IS NOT NULL").count() == 0          # out of range: kept, unlabelled


def test_missing_flag_counts_as_no(raw):
    data = prepare.prepare_safety(raw.withColumn("PP", F.lit(None).cast("string"))).data
    assert data.where("pp").count() == 0 and data.count() > 0


def test_unfiltered_preparation_keeps_all(raw):
    data, missing = prepare.prepare_plasma(raw, na_filter=False)
    assert data.count() == raw.count() and missing.count() == 0


def test_procedures_must_end_after_they_start(raw):
    wrong = raw.withColumn("PROCEDURE_END", F.col("PROCEDURE_START"))
    with pytest.raises(Exception, match="proc_end"):
        prepare.prepare_plasma(wrong).data.select("speed").collect()


def test_profile_keeps_numbers_next_to_bins(raw):
    data = prepare.prepare_profile(raw).data
    assert dict(data.dtypes)["age"] == "double" and dict(data.dtypes)["age_cat"] == "string"


def test_csv_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "export")
    tables.save_rows(raw, path, "csv")
    back = tables.read_csv(spark, path, RAW_PROFILE, raw=True)
    assert back.count() == raw.count()
    data, missing = prepare.prepare_profile(back)
    assert data.count() == prepare.prepare_profile(raw).data.count()
    target = str(tmp_path / "rejected")
    tables.save_missing(missing, target)
    assert spark.read.parquet(target).count() == missing.count()


def test_no_rejected_rows_is_an_error(spark, raw, tmp_path):
    with pytest.raises(KeyError):
        tables.save_missing(raw.limit(0), str(tmp_path / "none"))


def test_repeated_header_is_found(spark, tmp_path):
    path = tmp_path / "twice.csv"
    path.write_text(",".join([*SAFETY.names(), "site"]) + "\n")
    with pytest.raises(KeyError, match="site"):
        tables.read_csv(spark, str(path), SAFETY)


def test_analysis_csv_types(spark, tmp_path):
    """Dates with a space before the time, null tokens and boolean text, as a plain file."""
    path, header = tmp_path / "plasma.csv", PLASMA.names()
    values = {"col_date": "2020-02-03", "week": "2020-02-03", "proc_start": "2020-02-03 08:15:00",
              "proc_end": "2020-02-03 09:00:00", "target_vol": "800", "actual_vol": "0",
              "duration_minutes": "45", "speed": "0", "yield": "1", "yield_resid": "0",
              "itt": "True", "pp": "False"}
    path.write_text(",".join(header) + "\n"
                    + ",".join(values.get(name, "1" if "vol" in name else "true") for name in header))
    row = tables.read_csv(spark, str(path), PLASMA).first()
    assert str(row.proc_start) == "2020-02-03 08:15:00" and str(row.col_date) == "2020-02-03"
    assert row.actual_vol is None and row.target_vol == 800 and row.speed == 0
    assert row.itt is True and row.pp is False


def test_month_folders_are_pruned(spark, sf_dir, tmp_path):
    path = str(tmp_path / "safety")
    data = safety_view(collections(spark, sf_dir, quartiles=True))
    tables.save_rows(data.select(*(F.col(f"`{c}`") for c in SAFETY.selected(data.columns))),
                     path, month_of="col_date")
    assert "month=1996-05" in os.listdir(path)
    plan = spark.read.parquet(path).where("month = '1996-05'")._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(month" in plan.executedPlan().toString()


def test_refresh_reads_new_files_once(spark, raw, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    missing, progress = str(tmp_path / "missing"), str(tmp_path / "progress")
    header = raw.columns
    edges = {"weight_cat": [150.0, 200.0, 250.0]}

    def run():
        refresh_from_files(spark, "plasma", source, header, target, missing, progress, edges)
        return spark.read.parquet(target).count(), spark.read.parquet(missing).count()

    first, second = (raw.where(F.crc32("COLLECTION_NUMBER") % 2 == i) for i in (0, 1))
    first.coalesce(1).write.option("header", True).mode("append").csv(source)
    kept, lost = run()
    assert kept + lost == first.count()
    assert run() == (kept, lost)                               # nothing new
    second.coalesce(1).write.option("header", True).mode("append").csv(source)
    kept, lost = run()
    assert kept + lost == raw.count()
    assert lost == prepare.prepare_plasma(raw).missing.count()
    RAW_PLASMA.check(header, raw=True)
    RAW_SAFETY.check(header, raw=True)


def _line(header, **values):
    row = {"don_id": "d", "col_date": "2020-02-03", "week": "2020-02-03",
           "proc_start": "2020-02-03 08:15:00", "proc_end": "2020-02-03 09:00:00",
           **{name: "1" for name in header if "vol" in name or name in (
               "speed", "yield", "yield_resid", "duration_minutes")}, **values}
    return ",".join(header) + "\n" + ",".join(row.get(name, "true") for name in header) + "\n"


def test_every_file_of_a_folder_has_the_header(spark, tmp_path):
    header = PLASMA.names()
    swapped = [{"target_vol": "actual_vol", "actual_vol": "target_vol"}.get(n, n) for n in header]
    (tmp_path / "a.csv").write_text(_line(header, target_vol="800", actual_vol="700"))
    assert tables.read_csv(spark, str(tmp_path), PLASMA).first().actual_vol == 700
    (tmp_path / "b.csv").write_text(_line(swapped, target_vol="800", actual_vol="700"))
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(tmp_path), PLASMA).collect()


def test_malformed_number_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text(_line(PLASMA.names(), target_vol="oops"))
    with pytest.raises(Exception, match="oops|MALFORMED"):
        tables.read_csv(spark, str(tmp_path), PLASMA).collect()


def test_complete_cases_on_load(spark, tmp_path):
    (tmp_path / "a.csv").write_text(_line(PLASMA.names()))
    (tmp_path / "b.csv").write_text(_line(PLASMA.names(), actual_vol="0"))
    data, missing = prepare.load_complete(spark, str(tmp_path), PLASMA, "csv")
    assert data.count() == missing.count() == 1


def test_order_of_times_is_asserted_by_any_use(raw):
    wrong = raw.withColumn("PROCEDURE_END", F.col("PROCEDURE_START"))
    data = prepare.prepare_plasma(wrong, edges={"weight": [1., 2., 3.]}).data
    for use in (data.count, data.select("yield").collect):
        with pytest.raises(Exception, match="proc_end"):
            use()
    unknown = raw.withColumn("PROCEDURE_END", F.lit(None).cast("string"))
    data = prepare.prepare_plasma(unknown, na_filter=False, edges={"weight": [1., 2., 3.]}).data
    assert data.where("duration_minutes IS NULL").count() == raw.count()


def test_unknown_level_is_an_error(spark, sf_dir):
    from armwatch.operators.filters import filter_rows
    data = collections(spark, sf_dir)
    with pytest.raises(ValueError, match="nowhere"):
        filter_rows(data, SAFETY, query={"site": "nowhere", "POP": "pp"})
    assert filter_rows(data, SAFETY, query={"gender": "male"}).count() > 0


def test_ledger_of_one_writing_job(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    number = F.col("COLLECTION_NUMBER").cast("bigint")
    faulty = raw.withColumns({
        "PROCEDURE_END": F.when(number % 89 == 0, F.col("PROCEDURE_START"))
        .when(number % 97 == 0, None).otherwise(F.col("PROCEDURE_END")),
        "GENDER": F.when(number % 83 != 0, F.col("GENDER"))})
    found = ledger.save_with_ledger(faulty, RAW_PROFILE, path)
    kept, rejected = ledger.kept_rows(spark, path), ledger.rejected_rows(spark, path)
    assert (found["read"], found["kept"], found["rejected"]) == (
        raw.count(), kept.count(), rejected.count())
    by_reason = {r.reason: r.rows for r in ledger.reasons_by(rejected, []).collect()}
    assert by_reason == {k: n for k, n in found.items() if k not in ("read", "kept", "rejected")}
    assert set(by_reason) == {"no actual_vol", "no gender", "no proc_end", ledger.OUT_OF_ORDER}
    assert by_reason["no gender"] == faulty.where(number % 83 == 0).count()
    late = faulty.where((number % 89 != 0) & F.col("GENDER").isNotNull())
    assert kept.count() == prepare.prepare_profile(late, edges={"weight": [1.0, 2.0, 3.0]}).data.count()
    assert ledger.save_with_ledger(faulty.where("false"), RAW_PROFILE, path + "2") == {
        "read": 0, "kept": 0, "rejected": 0}


@pytest.mark.parametrize("name", ["prepare_profile", "prepare_plasma"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, sf_dir, name):
    """The JVM leaves methods of over 8000 bytes to its interpreter, at several times the cost."""
    from armwatch.checks import QUERIES

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")    # else plans show no code
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution()
        code = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(part.split(";")[0]) for part in code.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) <= 8000, sizes


def test_flags_are_yes_or_no(spark):
    rows = spark.createDataFrame([("Yes",), ("No",), (None,), ("yes",)], "flag string")
    kept = prepare.yes_no(rows, ["flag"])
    assert [r.flag for r in kept.collect()] == [True, False, False, False]
