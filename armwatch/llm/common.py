"""What the operators of this subpackage share: tables, words, and frames made whole."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space; ``bytes.split()`` gives the same.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
LAST = 2**63 - 1


#: Bytes of one Arrow batch. Spark's own bound is 64 MB, and 10,000 rows; texts are long.
BATCH = "4m"


def bounded(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a table that is written go when it is written, not when the
    driver's memory is next collected; the setting is put back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where the frame has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
