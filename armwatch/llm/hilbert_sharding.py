"""Sharding along a Hilbert curve over metadata, in DataFrame operations only.

Source, language and size are quantised to five bits each; the place of a cell on the curve
orders documents so that near places have near metadata, and cuts into runs of about equal bytes
give files whose statistics exclude each other in several dimensions. The law is ``bytes``:
shards hold near equal sizes.

Equal texts are one group and lie together in one shard unless the group is larger than a
twentieth of a shard; the rows of a larger group are spread along its run by a digest of doc_id.
No window spans a shard, a source or a group: runs are added up by cell, then by blocks of a
cell, then within a block, and a group of many rows has blocks of its own.

Null texts have size 1. Null sources and languages take the last place of their dimension; a
null doc_id is ordered first. Rows that repeat stay rows, each with a slot of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from armwatch.llm.common import fresh, text_of
from armwatch.session import settled, stored

BITS = 5
BLOCKS = 1024
#: Rows of a group from which on each row is placed by itself.
MANY = 4096


def with_curve(df: DataFrame, axes: list[str], out: str, bits: int = BITS) -> DataFrame:
    """Add the place of a cell on the Hilbert curve (Skilling's transformation of the axes,
    whole numbers below 2**bits). Each step is a projection of its own, so no expression grows."""
    x = fresh(df, *(f"h{i}" for i in range(len(axes))), "turn")
    x, turn = x[:-1], x[-1]
    df = df.withColumns({new: F.col(old).cast("int") for new, old in zip(x, axes)})
    for bit in range(bits - 1, 0, -1):
        q = 1 << bit
        for axis in x:
            is_set = F.col(axis).bitwiseAND(q) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(axis)).bitwiseAND(q - 1)
            df = df.withColumn(turn, F.when(is_set, F.lit(q - 1)).otherwise(swap))
            new = {x[0]: F.col(x[0]).bitwiseXOR(F.col(turn))}
            if axis != x[0]:
                new[axis] = F.when(is_set, F.col(axis)).otherwise(
                    F.col(axis).bitwiseXOR(F.col(turn)))
            df = df.withColumns(new)
    for before, axis in zip(x, x[1:]):
        df = df.withColumn(axis, F.col(axis).bitwiseXOR(F.col(before)))
    flip = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << bit) != 0,
                                      F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    df = df.withColumn(turn, flip)
    places = [F.shiftleft(F.shiftright(F.col(axis).bitwiseXOR(F.col(turn)), bit).bitwiseAND(
        F.lit(1)), bit * len(x) + len(x) - 1 - i)
        for bit in range(bits) for i, axis in enumerate(x)]
    index = places[0]
    for bit in places[1:]:
        index = index.bitwiseOR(bit)
    return df.withColumn(out, index).drop(*x, turn)


def ranked(values: DataFrame, name: str) -> DataFrame:
    """Distinct values of a dimension with their code: the rank, scaled to the axis. One row per
    value: the window runs over as many rows as the dimension has values."""
    order = Window.orderBy(F.col(name).asc_nulls_last())
    return stored(values.select(name).distinct().select(
        F.col(name).alias(f"{name}_value"), F.floor(
            (F.row_number().over(order) - 1) * (1 << BITS) / F.count("*").over(
                Window.partitionBy())).cast("int").alias(f"{name}_axis")))


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)))


def assigned(docs: DataFrame, shards: int = 8, row: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, curve) of every row; ``row`` names a column that
    tells the rows apart and goes along."""
    text, along_too = text_of(), [] if row is None else [row]
    rows = settled(docs.select(
        "doc_id", *along_too, F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.lit("group")).alias("text_hash"))
        .withColumn("own", F.xxhash64("doc_id", F.lit("row"))))
    named = ["text_hash", "text_crc32", "size"]
    groups = settled(rows.groupBy(*named).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "source", "lang")).alias("first"))
        .select(*named, "n", "first.source", "first.lang",
                (F.col("n") * F.col("size")).alias("bytes")))
    sources, langs = ranked(groups, "source"), ranked(groups, "lang")
    placed = (groups.join(sources, F.col("source").eqNullSafe(F.col("source_value")))
              .join(langs, F.col("lang").eqNullSafe(F.col("lang_value")))
              .withColumn("size_axis", F.least(
                  F.lit((1 << BITS) - 1), F.floor(F.log2("size") * 1.5).cast("int"))))
    axes = ["source_axis", "lang_axis", "size_axis"]
    # at most 2**15 cells; written, since a filter pushed below the steps would unfold them
    places = stored(with_curve(placed.select(*axes).distinct(), axes, "curve"))
    placed = placed.join(places, axes).select(
        *named, "n", "bytes", "curve",
        F.pmod("text_hash", F.lit(BLOCKS)).cast("int").alias("block"))
    # where each group begins: bytes before its cell, its block, and itself
    blocks = placed.groupBy("curve", "block").agg(F.sum("bytes").alias("bytes"))
    cells = blocks.groupBy("curve").agg(F.sum("bytes").alias("bytes"))
    cells = stored(sums_before(cells, [], "curve", "bytes", "cell_start").withColumn(
        "total", F.sum("bytes").over(Window.partitionBy())))
    blocks = sums_before(blocks, ["curve"], "block", "bytes", "block_start").join(
        cells.select("curve", "cell_start", "total"), "curve").select(
        "curve", "block", "total", (F.col("cell_start") + F.col("block_start")).alias("begin"))
    order = Window.partitionBy("curve", "block").orderBy(*named).rowsBetween(
        Window.unboundedPreceding, -1)
    begun = placed.withColumn("before", F.coalesce(F.sum("bytes").over(order), F.lit(0))).join(
        blocks, ["curve", "block"]).withColumn("begin", F.col("begin") + F.col("before"))
    part = F.col("total") / F.lit(shards)
    begun = begun.select(*named, "curve", "block", "begin", "bytes", part.alias("part"),
                         (F.col("n") > MANY).alias("many"),
                         (F.col("bytes") <= part / 20).alias("whole"))
    # a group that is not whole spreads its rows evenly over its run
    along = F.when(F.col("whole"), F.lit(.5)).otherwise(
        F.pmod("own", F.lit(1 << 30)) / float(1 << 30))
    joined = rows.join(begun, named).select(
        "doc_id", *along_too, "size", "text_crc32", "text_hash", "own", "curve",
        F.least(F.lit(shards - 1), F.floor(
            (F.col("begin") + along * F.col("bytes")) / F.col("part"))).cast("int").alias("shard"),
        (F.col("block") * F.lit(BLOCKS) + F.when(
            F.col("many"), F.pmod("own", F.lit(BLOCKS))).otherwise(F.lit(0)))
        .cast("int").alias("block"))
    joined = settled(joined)
    counted = joined.groupBy("shard", "curve", "block").agg(F.count("*").alias("rows"))
    cells = counted.groupBy("shard", "curve").agg(F.sum("rows").alias("rows"))
    cells = stored(sums_before(cells, ["shard"], "curve", "rows", "cell_slot").drop("rows"))
    slots = sums_before(counted, ["shard", "curve"], "block", "rows", "block_slot").join(
        cells, ["shard", "curve"]).select(
        "shard", "curve", "block", (F.col("cell_slot") + F.col("block_slot")).alias("base"))
    order = Window.partitionBy("shard", "curve", "block").orderBy("text_hash", "doc_id", "size")
    return (joined.withColumn("at", F.row_number().over(order) - 1)
            .join(slots, ["shard", "curve", "block"])
            .select("doc_id", *along_too, "size", "text_crc32", "shard",
                    (F.col("base") + F.col("at")).cast("long").alias("slot"), "curve"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The assignment with its law, as the query returns it."""
    return assigned(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write the documents by shard, each file a stretch of the curve: rows are dealt by ranges
    of (shard, slot), so a large shard has several files and every file few metadata values.

    Every row is written once, null and repeated doc_ids included: the rows are numbered in a
    written copy first. The folder column is ``shard``, with underscores in front where the table
    has such a column."""
    row, shard, slot = fresh(docs, "row", "shard", "slot")
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    own = assigned(held, shards, row).select(row, F.col("shard").alias(shard),
                                             F.col("slot").alias(slot))
    (held.join(own, row).drop(row).repartitionByRange(shard, slot)
     .sortWithinPartitions(shard, slot).drop(slot)
     .write.partitionBy(shard).parquet(path))
