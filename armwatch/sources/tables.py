"""Reading and writing the flat tables (CSV, Parquet) behind every module."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armwatch.columns import col, cols
from armwatch.session import scratch_dir
from armwatch.sources.contract import ID, VOLUME, Contract

#: The folder column of a table written by month, and the metadata that names its date column.
MONTH, MONTH_OF = "month", "month_of"
#: Rows of a bucket, on average: a few hundred bytes each are sorted in one task's memory.
BUCKET_ROWS = 1_000_000
#: Each file's header is held against the schema, and malformed values fail instead of
#: turning into nulls.
STRICT_CSV = {"header": True, "enforceSchema": False, "mode": "FAILFAST"}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Names on the first line as written, duplicates included (reads one row)."""
    first = spark.read.option("header", False).csv(path).first()
    return [] if first is None else [name or "" for name in first]


def read_csv(spark: SparkSession, path: str, contract: Contract, raw: bool = False) -> DataFrame:
    """Typed CSV scan of the declared columns only; the header is checked, nothing inferred.

    ``raw=True`` reads a study export (raw header names, text dates and Yes/No flags);
    otherwise the file is an analysis table under standard names. Measures equal to
    their null token come back as null. Every file of a folder must have the same header in
    the same order, and a value that is not of its column's type fails the scan.
    """
    header = csv_header(spark, path)
    contract.check(header, raw)
    table = (spark.read.schema(contract.struct(header, raw))
             .options(**STRICT_CSV)
             .csv(path)
             .select(*cols(contract.selected(header, raw))))
    return table if raw else null_tokens(table, contract)


def null_tokens(df: DataFrame, contract: Contract) -> DataFrame:
    """Measures equal to their declared token (0) become null."""
    tokens = {spec.var: spec.null_token for spec in contract.of(VOLUME)
              if spec.null_token is not None and spec.var in df.columns}
    return df.withColumns({var: F.nullif(col(var), F.lit(float(token)))
                           for var, token in tokens.items()})


def month_name(date: Column) -> Column:
    """The folder name of a date's month."""
    return F.date_format(date, "yyyy-MM")


def read_parquet(spark: SparkSession, path: str, contract: Contract,
                 month_of: str | None = None) -> DataFrame:
    """Parquet scan of the declared columns; header checked.

    ``month_of`` is the date column by which ``save_rows`` made the folders. The folder column is
    then kept, marked with that name, and ``filters.date_range`` on the date reads the folders of
    the range only.
    """
    table = spark.read.parquet(path)
    contract.check(table.columns)
    wanted = cols(contract.selected(table.columns))
    if month_of is not None:
        if MONTH not in table.columns:
            raise KeyError(f"The table at {path} has no folders by month; write it with "
                           f"month_of={month_of!r} or read it without.")
        wanted.append(col(MONTH).cast("string").alias(MONTH, metadata={MONTH_OF: month_of}))
    return table.select(*wanted)


def refresh(spark: SparkSession, path: str, contract: Contract,
            old: DataFrame | None = None, file_format: str = "parquet",
            month_of: str | None = None) -> DataFrame:
    """Reload after the files changed: drop the old cache and file listing, then read again."""
    if old is not None:
        old.unpersist()
    spark.catalog.refreshByPath(path)
    if file_format == "parquet":
        return read_parquet(spark, path, contract, month_of)
    return read_csv(spark, path, contract)


def raw_data(df: DataFrame, contract: Contract, date: str = "col_date") -> DataFrame:
    """The relevant columns in date order."""
    keys = [date, *(var for var in contract.names(ID) if var in df.columns)]
    return df.select(*cols(contract.selected(df.columns))).orderBy(*cols(keys))


def save_rows(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "error",
              month_of: str | None = None) -> None:
    """Write rows. ``month_of`` names a date column: one folder per month, so that date
    filters prune whole folders (``read_parquet`` with the same ``month_of``). Rows are spread by ranges of (month, hash of the row), so a
    folder gets few files and a busy month still has several writers."""
    writer = df
    if month_of is not None:
        if MONTH in df.columns:
            raise KeyError(f"A table written by month can't have a column {MONTH} of its own.")
        writer = df.withColumn(MONTH, month_name(col(month_of)))
        writer = writer.repartitionByRange(MONTH, F.xxhash64(*cols(df.columns)))
    out = writer.write.mode(mode)
    if month_of is not None:
        out = out.partitionBy(MONTH)
    if file_format == "csv":
        out = out.option("header", True)
    out.format(file_format).save(path)


def save_missing(missing: DataFrame, path: str, file_format: str = "parquet",
                 mode: str = "error") -> None:
    """Write rejected rows; ``KeyError`` if there are none."""
    if missing.isEmpty():
        raise KeyError("There are no rejected rows to write; skip this call.")
    save_rows(missing, path, file_format, mode)


def by_key(df: DataFrame, key: str, order: tuple[str, ...] = (), buckets: int = 64,
           name: str | None = None, path: str | None = None) -> DataFrame:
    """Rows written once as a table bucketed by a key and sorted inside each bucket.

    Whatever groups by the key afterwards, alone or with further columns, reads its bucket and
    needs no shuffle. ``name`` and ``path`` default to a new table of the session under the shared
    folder. Rows without a key are one bucket's. A bucket is written, sorted and read by one task, so
    the rows are counted first and there are more than ``buckets`` where a bucket would hold over
    ``BUCKET_ROWS`` on average. A table whose largest key holds a large part of the rows is better
    left unbucketed.
    """
    spark = df.sparkSession
    buckets = max(buckets, math.ceil(df.count() / BUCKET_ROWS))
    name = name or f"by_{key}_{uuid.uuid4().hex}"
    (df.repartition(buckets, col(key)).write.format("parquet")
     .option("path", path or f"{scratch_dir(spark)}/table")
     .bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name))
    return spark.table(name)
