"""Small column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its exact name: event codes such as ``1.1`` contain dots."""
    return F.col(f"`{name}`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(name) for name in names]


def flag(name: str) -> Column:
    """A boolean column as 0/1, null counted as 0."""
    return F.when(col(name), 1).otherwise(0)


def ratio(top: Column, bottom: Column) -> Column:
    """Double division; null where the denominator is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    return ratio(top, bottom) * 100


def on_columns(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two sides share."""
    shared = [name for name in left.columns if name in right.columns]
    return left.join(right, on=shared, how=how)


def need_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise KeyError(f"The table lacks {', '.join(absent)}, which this report reads.")


def need_member(value: str, allowed: Iterable[str], what: str) -> None:
    allowed = list(allowed)
    if value not in allowed:
        raise ValueError(f"{what} should be one of {allowed}, got {value!r}.")
