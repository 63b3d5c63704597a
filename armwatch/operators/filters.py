"""Row selection by date range, category level, flag role and donor list."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwatch.columns import col
from armwatch.sources.contract import CATEGORY, POPULATION, SEVERITY, Contract
from armwatch.sources.tables import MONTH_OF

ROLE_NAMES = {"POP": POPULATION, "SEV": SEVERITY}
Day = dt.date | str | None


def date_bounds(df: DataFrame, date: str = "col_date") -> tuple[dt.date, dt.date]:
    """First and last date (one aggregate over one column)."""
    low, high = df.agg(F.min(col(date)), F.max(col(date))).first()
    return low, high


def date_range(df: DataFrame, start: Day = None, end: Day = None, date: str = "col_date",
               bounds: tuple[dt.date, dt.date] | None = None, strict: bool = True) -> DataFrame:
    """Both ends inclusive. ``strict`` rejects a bound outside the table's own range; pass the
    known ``bounds`` to spare the job that looks them up. A table with folders by month of this
    date (see ``sources.tables.read_parquet``) is read from the folders of the range only."""
    start, end = _as_date(start), _as_date(end)
    if strict and (start or end):
        low, high = bounds or date_bounds(df, date)
        if low is None or (start and start < low) or (end and end > high):
            raise ValueError(f"The table has dates from {low} to {high}; choose 'start' and 'end' "
                             "among them, or pass strict=False.")
    out = in_months(df, start, end, date)
    if start:
        out = out.where(col(date) >= F.lit(start))
    if end:
        out = out.where(col(date) < F.lit(end + dt.timedelta(days=1)))
    return out


def in_months(df: DataFrame, start: dt.date | None, end: dt.date | None, date: str) -> DataFrame:
    """Add the months that a range of dates implies, where the table has folders by them."""
    marked = [f.name for f in df.schema.fields if f.metadata.get(MONTH_OF) == date]
    for name in marked:
        if start:
            df = df.where(col(name) >= F.lit(f"{start:%Y-%m}"))
        if end:
            df = df.where(col(name) <= F.lit(f"{end:%Y-%m}"))
    return df


def level_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(variable, level)`` of the distinct values, as a distributed table."""
    long = df.select(*(col(name).cast("string").alias(name) for name in names)).unpivot(
        [], [col(name) for name in names], "variable", "level")
    return long.where(F.col("level").isNotNull()).distinct()


def predicate(query: Mapping[str, str], contract: Contract,
              levels: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Conjunction of ``{'gender': 'male', 'POP': 'itt', 'SEV': 'non_hyp'}`` style selections.

    A role key (``POP``, ``SEV``) selects the boolean column it names. Unknown columns, flags
    and -- when ``levels`` is given -- levels raise ``ValueError``.
    """
    categories = contract.names(CATEGORY)
    condition, wrong = F.lit(True), {}
    for key, value in query.items():
        if key in ROLE_NAMES and value in contract.names(ROLE_NAMES[key]):
            condition = condition & col(value)
        elif key in categories and (levels is None or value in levels.get(key, ())):
            condition = condition & (col(key) == value)
        else:
            wrong[key] = value
    if wrong:
        raise ValueError(f"Can't select by {wrong}: use a category with one of its levels, or POP "
                         "or SEV with a flag.")
    return condition


def filter_rows(df: DataFrame, contract: Contract, start: Day = None, end: Day = None,
                query: Mapping[str, str] | None = None, date: str = "col_date",
                levels: Mapping[str, Sequence[str]] | None = None,
                bounds: tuple[dt.date, dt.date] | None = None, strict: bool = True) -> DataFrame:
    """Rows of a date range and of a selection as in ``predicate``. A level that the table does
    not have raises ``ValueError``: known ``levels`` spare the job that looks the asked ones up."""
    out = date_range(df, start, end, date, bounds, strict)
    if not query:
        return out
    condition = predicate(query, contract, levels)
    asked = {k: v for k, v in query.items() if k not in ROLE_NAMES}
    if asked and levels is None:
        seen = df.agg(*(F.coalesce(F.bool_or(col(k) == v), F.lit(False)).alias(k)
                        for k, v in asked.items())).first()
        unknown = {k: v for k, v in asked.items() if not seen[k]}
        if unknown:
            raise ValueError(f"No row has {unknown}; see level_table for the levels.")
    return out.where(condition)


def of_donors(df: DataFrame, donors: Sequence[str] | DataFrame | None,
              don_id: str = "don_id") -> DataFrame:
    """Rows of the given donors: an in-list, a one-column table (semi join), or everyone."""
    if donors is None:
        return df
    if isinstance(donors, DataFrame):
        ids = donors.select(F.col(f"`{donors.columns[0]}`").alias(don_id))
        return df.join(ids, on=don_id, how="left_semi")
    return df.where(col(don_id).isin([str(donor) for donor in donors]))


def experimental_arm(df: DataFrame, arm: str = "A", group: str = "group") -> DataFrame:
    return df.where(col(group) == arm)


def in_population(df: DataFrame, population: str) -> DataFrame:
    return df.where(col(population))


def _as_date(value: Day) -> dt.date | None:
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value[:10])
