"""Preparation with a quality ledger: rows, reasons and counts from one writing job.

Every row of an export is written with the reasons against it, in a folder of kept and one of
rejected rows. The counts of the ledger are observed by the job that writes, so neither a second
scan nor a test for emptiness is run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwatch.columns import col, cols
from armwatch.operators.prepare import standardize
from armwatch.sources.contract import Contract

KEPT, REASONS = "kept", "reasons"
OUT_OF_ORDER = "proc_end not after proc_start"
LEDGER = T.StructType([T.StructField("entry", T.StringType()), T.StructField("rows", T.LongType())])


def checks(df: DataFrame, contract: Contract) -> dict[str, Column]:
    """What may be wrong with a row, by reason; each column is never null."""
    found = {f"no {name}": col(name).isNull()
             for name in contract.selected(df.columns) if name in df.columns}
    if {"proc_start", "proc_end"} <= set(df.columns):
        found[OUT_OF_ORDER] = F.coalesce(col("proc_end") <= col("proc_start"), F.lit(False))
    return found


def with_reasons(df: DataFrame, contract: Contract) -> DataFrame:
    """Add ``reasons``, those that apply to the row, and ``kept``, whether there are none."""
    reasons = F.array_compact(F.array(*(F.when(wrong, name)
                                        for name, wrong in checks(df, contract).items())))
    return df.withColumn(REASONS, reasons).withColumn(KEPT, F.size(REASONS) == 0)


def save_with_ledger(raw: DataFrame, contract: Contract, path: str,
                     measures: Callable[[DataFrame], DataFrame] | None = None,
                     mode: str = "error") -> dict[str, int]:
    """Prepare an export, write it to ``path`` and return the ledger: rows read, kept and rejected,
    and rows by reason (a row may have several). ``measures`` adds columns to the typed rows."""
    typed = standardize(raw, contract)
    marked = with_reasons(typed if measures is None else measures(typed), contract)
    names = list(checks(typed, contract))
    counted = Observation()

    def rows(condition: Column) -> Column:
        return F.count_if(condition)

    watched = marked.observe(
        counted, F.count(F.lit(1)).alias("read"), rows(col(KEPT)).alias("kept"),
        rows(~col(KEPT)).alias("rejected"),
        *(rows(F.array_contains(REASONS, name)).alias(f"reason {i}")
          for i, name in enumerate(names)))
    watched.write.mode(mode).partitionBy(KEPT).parquet(path)
    metrics = counted.get
    by_reason = {name: metrics[f"reason {i}"] for i, name in enumerate(names)}
    return {"read": metrics["read"], "kept": metrics["kept"], "rejected": metrics["rejected"],
            **{name: n for name, n in by_reason.items() if n}}


def kept_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(col(KEPT).cast("boolean")).drop(KEPT, REASONS)


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rejected rows with their reasons."""
    return spark.read.parquet(path).where(~col(KEPT).cast("boolean")).drop(KEPT)


def as_table(spark: SparkSession, ledger: dict[str, int]) -> DataFrame:
    """The ledger as rows (entry, rows): one per entry, of which there are a few dozen at most."""
    return spark.createDataFrame(list(ledger.items()), LEDGER)


def reasons_by(rejected: DataFrame, keys: list[str]) -> DataFrame:
    """Rejected rows by reason and the keys."""
    return rejected.select(*cols(keys), F.explode(REASONS).alias("reason")).groupBy(
        *cols(keys), "reason").agg(F.count(F.lit(1)).alias("rows"))
