"""Adverse-event safety reports by study arm."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from armwatch.columns import col, cols, flag, need_columns, need_member, percent, ratio
from armwatch.functions.intervals import (
    DIFF_METHODS, method_rows, rate_diff_ci_summary, with_rate_ci)
from armwatch.operators.filters import Day, date_range
from armwatch.operators.mergeable import bitmap_counts
from armwatch.operators.prepare import period_start
from armwatch.operators.shape import (
    BLANK, GRAND_TOTAL, SUBTOTAL, complete_grid, long_metrics, share_within, with_subtotals)
from armwatch.sources.contract import CATEGORY, POPULATION, SAFETY, SEVERITY, Contract


def _whole():
    """The whole table as one window: only over aggregates of one row per arm or stratum."""
    return W.partitionBy()


def _of_total(measure: str):
    """The grand-total row's value next to every row of a per-arm aggregate."""
    return F.max(F.when(col("group") == GRAND_TOTAL, col(measure))).over(_whole())


def summary_donat(data: DataFrame, plan: int = SAFETY.plan) -> DataFrame:
    """Donors, collections and collections per donor by arm, plus a grand total.

    The total adds the arms up (a donor in both arms counts twice), its percentage is relative
    to the plan, and its mean weights the arms by collections.
    """
    # mean over donors of distinct collections = distinct (donor, collection) pairs / donors.
    # Both distinct counts follow from the pairs, grouped once more by either id: no row is
    # copied per count.
    pairs = data.select(*cols(("group", "don_id", "col_id"))).distinct()

    def counted(key: str, other: str, weight) -> DataFrame:
        known = F.when(col(key).isNotNull(), 1).otherwise(0)
        return pairs.groupBy(col("group"), col(key)).agg(weight.alias("pairs")).select(
            "group", known.alias(f"{key}_nunique"), F.lit(0).alias(f"{other}_nunique"), "pairs")

    both = counted("don_id", "col_id", F.count(F.lit(1))).unionByName(
        counted("col_id", "don_id", F.first(F.lit(0).cast("long"))))
    per_arm = both.groupBy(col("group")).agg(*(
        F.sum(name).alias(name) for name in ("don_id_nunique", "col_id_nunique", "pairs")))
    per_arm = per_arm.withColumn("per_donor", ratio(col("pairs"), col("don_id_nunique")))
    per_arm = per_arm.withColumn("weighted", col("per_donor") * col("col_id_nunique"))
    table = with_subtotals(per_arm, ["group"], ["don_id_nunique", "col_id_nunique", "weighted"])
    is_total = col("group") == GRAND_TOTAL
    return table.select(
        "group", "don_id_nunique", "col_id_nunique",
        percent(col("col_id_nunique"), F.when(is_total, F.lit(plan))
                .otherwise(_of_total("col_id_nunique"))).alias("col_id_pct"),
        (col("weighted") / col("col_id_nunique")).alias("col_per_don_mean"))


def _flag_counts(data: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Flag sums and distinct collections per arm, with the grand total: one aggregate."""
    per_arm = data.groupBy(col("group")).agg(
        *(F.sum(flag(name)).alias(name) for name in flags),
        F.count_distinct("col_id").alias("col_id"))
    return with_subtotals(per_arm, ["group"], [*flags, "col_id"])


def _severities(data: DataFrame, contract: Contract) -> list[str]:
    return [name for name in contract.names(SEVERITY) if name in data.columns]


def summary_risk(data: DataFrame, contract: Contract = SAFETY) -> DataFrame:
    """Count and percent (of distinct collections) of each severity group by arm and in total."""
    names = _severities(data, contract)
    return _risk_rows(_flag_counts(data, names), names)


def risk_of_partials(sums: DataFrame, ids: DataFrame, contract: Contract = SAFETY) -> DataFrame:
    """``summary_risk`` from partial aggregates by arm: sums of the flags, and bitmaps of the
    collections (see ``streaming.partials``). The rows themselves are not read."""
    names = _severities(sums, contract)
    per_arm = (sums.groupBy(col("group")).agg(*(F.sum(col(name)).alias(name) for name in names))
               .join(bitmap_counts(ids, ["group"], "col_id"), "group"))
    return _risk_rows(with_subtotals(per_arm, ["group"], [*names, "col_id"]), names)


def _risk_rows(table: DataFrame, names: Sequence[str]) -> DataFrame:
    return long_metrics(table, ["group"], {
        key: value for name in names for key, value in (
            ((name, "sum"), col(name)),
            ((name, "pct"), percent(col(name), col("col_id"))))})


def _check(sev: str, pop: str, contract: Contract) -> None:
    need_member(sev, contract.names(SEVERITY), "Severity group")
    need_member(pop, contract.names(POPULATION), "Population")


def summary_aes(data: DataFrame, sev: str, pop: str = "itt", conditional: bool = False,
                contract: Contract = SAFETY) -> DataFrame:
    """Counts of a severity group and each of its event codes, by arm and in total.

    Percent of the collections, or of the severity count if ``conditional``. The collections
    row itself is relative to the grand total (no percentage if ``conditional``).
    """
    _check(sev, pop, contract)
    names = list(dict.fromkeys([sev, *contract.event_codes(sev, data.columns)]))
    table = _flag_counts(data.where(col(pop)), names)
    base = col(sev) if conditional else col("col_id")
    share = F.lit(None) if conditional else percent(col("col_id"), _of_total("col_id"))
    table = table.withColumn("share", share)
    metrics = {("col_id", "sum"): col("col_id"), ("col_id", "pct"): col("share")}
    for name in names:
        metrics |= {(name, "sum"): col(name), (name, "pct"): percent(col(name), base)}
    return long_metrics(table, ["group"], metrics, drop_null=False)


def summary_sev(data: DataFrame, strata: Sequence[str], sev: str, pop: str = "itt",
                contract: Contract = SAFETY,
                levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Severity counts over all level combinations of the strata, percent within the parent
    strata, with subtotals (whose percentages are added up as well)."""
    _check(sev, pop, contract)
    strata = list(strata)
    if not strata:
        raise TypeError("'strata' should be a non-empty list of categories.")
    for name in strata:
        need_member(name, contract.names(CATEGORY), "'strata'")
    need_columns(data, strata)
    # Levels come from the whole table, the counts from the population: one scan for both.
    counts = data.groupBy(*cols(strata)).agg(
        F.sum(F.when(col(pop), flag(sev)).otherwise(0)).alias("sum"))
    grid = complete_grid(counts, strata, ["sum"], levels)
    shared = share_within(grid, "sum", strata[:-1], "pct")
    return with_subtotals(shared, strata, ["sum", "pct"])


def calc_ci(data: DataFrame, sev: str, pop: str = "itt", limits: str = "both", conf: float = .89,
            contract: Contract = SAFETY) -> DataFrame:
    """Rate difference B - A in percent with its bounds by every method, and the margin."""
    _check(sev, pop, contract)
    arms = data.where(col(pop)).groupBy(col("group")).agg(
        F.count_distinct("col_id").alias("n"), F.sum(flag(sev)).alias("x"))
    one_row = arms.agg(*(F.max(F.when(col("group") == arm, col(name))).alias(f"{name}{i}")
                         for i, arm in enumerate(("A", "B")) for name in ("x", "n")))
    rows = method_rows(
        rate_diff_ci_summary(one_row, limits=limits, conf=conf)
        .withColumn("risk_diff", percent(col("x1"), col("n1")) - percent(col("x0"), col("n0"))),
        ["risk_diff"], DIFF_METHODS, limits)
    ends = [end for end in ("LL", "UL") if end in rows.columns]
    return rows.select("method", *((col(end) * 100).alias(end) for end in ends), "risk_diff",
                       F.lit(contract.margin(sev)).alias("margin"))


def summary_longitudinal(data: DataFrame, method: str, sev: str, pop: str = "itt",
                         aggregate: str = "w", conf: float = .89, start: Day = None,
                         end: Day = None, contract: Contract = SAFETY,
                         bounds=None) -> DataFrame:
    """Rate and bounds per period for each arm and pooled: ``(period, sample, metric, value)``.

    An arm without collections in a period counts 0; its rate and bounds are left out.
    """
    need_member(aggregate, ("d", "w", "m"), "'aggregate'")
    _check(sev, pop, contract)
    chosen = date_range(data, start, end, bounds=bounds).where(col(pop))
    counts = (chosen.groupBy(col("group"), period_start(col("col_date"), aggregate)
                             .alias("period"))
              .agg(F.count_distinct("col_id").alias("n"), F.sum(flag(sev)).alias("x")))

    def arm(name: str, measure: str):
        return F.coalesce(F.sum(F.when(col("group") == name, col(measure))), F.lit(0))

    arms = counts.groupBy("period").agg(*(arm(g, m).alias(f"{m}_{g}")
                                          for g in ("A", "B") for m in ("n", "x")))
    sample = F.explode(F.array(*(
        F.struct(F.lit(name).alias("sample"), x.alias("x"), n.alias("n")) for name, x, n in (
            ("A", col("x_A"), col("n_A")), ("B", col("x_B"), col("n_B")),
            ("pulled", col("x_A") + col("x_B"), col("n_A") + col("n_B"))))))
    rows = arms.select("period", sample.alias("s")).select("period", "s.*")
    filled = rows.withColumn("trials", F.when(col("n") > 0, col("n")))
    table = with_rate_ci(filled, "x", "trials", method, conf=conf)
    return long_metrics(table, ["period", "sample"], {
        (m, m): value for m, value in (
            ("LL", col("LL")), ("UL", col("UL")), ("n", col("n")), ("x", col("x")),
            ("rate", col("x") / col("trials")))}).drop("variable")


def general_summary(data: DataFrame, plan: int = SAFETY.plan,
                    contract: Contract = SAFETY) -> DataFrame:
    """Donation and risk summaries in one long table; ``part`` tells them apart."""
    donation = long_metrics(summary_donat(data, plan), ["group"], {
        ("don_id", "nunique"): col("don_id_nunique"),
        ("col_id", "nunique"): col("col_id_nunique"),
        ("col_id", "pct"): col("col_id_pct"),
        ("col_per_don", "mean"): col("col_per_don_mean")})
    risk = summary_risk(data, contract)
    return (donation.withColumn("part", F.lit("donation"))
            .unionByName(risk.withColumn("part", F.lit("risk"))))


def _sum_and_pct(long: DataFrame, ids: Sequence[str]) -> DataFrame:
    return long.groupBy(*cols(ids)).agg(
        F.max(F.when(col("metric") == "sum", col("value"))).alias("sum"),
        F.max(F.when(col("metric") == "pct", col("value"))).alias("pct"))


def event_summary(data: DataFrame, severity: str, population: str = "itt",
                  contract: Contract = SAFETY) -> DataFrame:
    """One row per arm and event with count and percent of collections."""
    return _sum_and_pct(summary_aes(data, severity, population, False, contract),
                        ["group", "variable"])


def event_piechart(data: DataFrame, severity: str, population: str = "itt",
                   contract: Contract = SAFETY) -> DataFrame:
    """Events of both arms together, percent within the severity group."""
    table = summary_aes(data, severity, population, True, contract)
    return _sum_and_pct(table.where(col("group") == GRAND_TOTAL), ["variable"])


def severity_piechart(data: DataFrame, strata: Sequence[str], severity: str,
                      population: str = "itt", contract: Contract = SAFETY) -> DataFrame:
    """Severity counts by arm and one stratum; an arm's row shows its share of all flags in the
    population, the total shows none."""
    if len(strata) != 1:
        raise KeyError("'strata' should hold a single category in addition to 'group'.")
    inner = strata[0]
    table = summary_sev(data, ["group", inner], severity, population, contract)
    is_arm = col(inner).endswith(f" - {SUBTOTAL}")
    is_total = (col("group") == GRAND_TOTAL) & (col(inner) == BLANK)
    flags = F.sum(F.when(is_arm, col("sum"))).over(_whole())
    return table.select("group", col(inner), "sum",
                        F.when(is_total, None).when(is_arm, percent(col("sum"), flags))
                        .otherwise(col("pct")).alias("pct"))


def severity_bargraph(data: DataFrame, strata: Sequence[str], severity: str,
                      population: str = "itt", contract: Contract = SAFETY) -> DataFrame:
    return summary_sev(data, strata, severity, population, contract)
