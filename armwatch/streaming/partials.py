"""Reports that cost what changed: partial aggregates maintained from new export files.

Every delivered unit (a file, or what ``unit`` names) has its own partition of partial sums per
day and strata, and of distinct ids per month and strata as bitmaps. A batch overwrites the
partitions of the units it holds and no others, so a unit that is delivered again, or a batch that
is retried, replaces its own partials. Reports read the partials only.

A unit that is delivered several times within a batch counts in its latest ``version``. A unit
delivered again without any row leaves no trace in the batch and keeps its old partials; delete
its partition to withdraw it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwatch.columns import col, cols, flag
from armwatch.operators.filters import Day, date_range
from armwatch.operators.mergeable import distinct_bitmaps, merged_bitmaps
from armwatch.operators.prepare import period_start
from armwatch.session import settled

UNIT, VERSION = "unit", "version"


def latest(rows: DataFrame) -> DataFrame:
    """Rows of the latest version of each unit. The versions, one row per unit, are found once and
    sent to all tasks: a unit may hold any share of the rows."""
    newest = settled(rows.select(UNIT, VERSION).distinct().groupBy(col(UNIT).alias("__unit")).agg(
        F.max(VERSION).alias("__newest")))
    return rows.join(F.broadcast(newest), col(UNIT).eqNullSafe(col("__unit"))
                     & (col(VERSION) == col("__newest"))).drop(VERSION, "__unit", "__newest")


def day_sums(rows: DataFrame, keys: Sequence[str], date: str, flags: Sequence[str]) -> DataFrame:
    """``(keys, day, n, flags)``: rows and set flags."""
    return rows.groupBy(*cols(keys), period_start(col(date), "day").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(flag(name)).alias(name) for name in flags))


def month_ids(rows: DataFrame, keys: Sequence[str], date: str, ident: str) -> DataFrame:
    """``(keys, month, bucket, ids)``: distinct ids as bitmaps."""
    months = rows.withColumn("month", period_start(col(date), "month"))
    return distinct_bitmaps(months, [*keys, "month"], ident)


def maintain(spark: SparkSession, source: str, schema: T.StructType, target: str,
             checkpoint: str, strata: Sequence[str], flags: Sequence[str],
             idents: Sequence[str], date: str = "col_date", unit: Column | None = None,
             version: Column | None = None, file_format: str = "parquet",
             prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Bring the partials under ``target`` up to date with the files of ``source`` and return.

    ``unit`` names what is delivered and replaced as a whole (default: the file's name) and
    ``version`` orders deliveries of a unit (default: modification time, then path). ``prepare``
    turns a batch's rows, which carry both as columns, into the rows to aggregate.
    """
    unit = F.col("_metadata.file_name") if unit is None else unit
    version = (F.struct("_metadata.file_modification_time", "_metadata.file_path")
               if version is None else version)
    keys = [UNIT, *strata]

    def write(partials: DataFrame, name: str) -> None:
        (partials.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(UNIT).parquet(f"{target}/{name}"))

    def update(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch if prepare is None else prepare(batch))
        write(day_sums(rows, keys, date, flags), "sums")
        for ident in idents:
            write(month_ids(rows, keys, date, ident), f"ids_{ident}")

    options = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}
    stream = (spark.readStream.schema(schema).format(file_format)
              .options(**(options if file_format == "csv" else {})).load(source)
              .withColumns({UNIT: unit.cast("string"), VERSION: version}))
    (stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def sums(spark: SparkSession, target: str, strata: Sequence[str], flags: Sequence[str],
         start: Day = None, end: Day = None) -> DataFrame:
    """``(strata, n, flags)`` over a range of days, from the partials."""
    days = date_range(spark.read.parquet(f"{target}/sums"), start, end, "day", strict=False)
    return days.groupBy(*cols(strata)).agg(*(F.sum(col(m)).alias(m) for m in ("n", *flags)))


def ids(spark: SparkSession, target: str, ident: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, bucket, ids)`` of all units; ``month`` may be one of the keys."""
    return merged_bitmaps(spark.read.parquet(f"{target}/ids_{ident}"), keys)
