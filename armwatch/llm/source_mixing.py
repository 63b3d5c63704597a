"""Mixing sources to target weights: epochs first, then weighted sampling without replacement.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 150 % of all
words; no target exceeds twice its source, and the excess is shared again by weight. That level
is found directly: sources reach their bound in the order of bound / weight.

A source's complete epochs take every document once each. The rest of its target goes to the
documents with the smallest Efraimidis-Spirakis keys, E / weight for exponential E drawn from a
digest of doc_id, so reruns agree. Keys are sorted over range partitions by source and key; sums
within a partition are running sums, and sums of partitions give their offsets, so a hot source
is spread over as many partitions as it needs. A document is taken while at least half of it
fits, which misses a target by half a document at most.

The quality weight of a document is one minus its share of symbols, 0.1 at least. Null and empty
texts have size 0 and take nothing. Rows that repeat (doc_id, size and source) share a key and
are taken together. A null doc_id is drawn like a number of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from armwatch.llm.common import LAST, count_words, fresh, text_of
from armwatch.session import settled, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SYMBOLS = r"[#*$%&|<>!]"


def quality(text: Column) -> Column:
    chars = F.greatest(F.length(text), F.lit(1))
    return 1 - F.least(F.lit(.9), F.regexp_count(text, F.lit(SYMBOLS)) / chars)


def place(doc_id: Column, text: Column) -> Column:
    """(key, doc_id, digest of the text): the order in which documents of a source are taken."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + .5) / 2.0**52
    return F.struct((-F.log(uniform) / quality(text)).alias("key"),
                    F.coalesce(doc_id, F.lit(LAST)).alias("id"),
                    F.xxhash64(text).alias("digest"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with the target of each source. One row per source: the windows
    run over as many rows as there are sources."""
    whole, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    by_bound = Window.orderBy("bound", F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_bound.rowsBetween(0, Window.unboundedFollowing)
    weighed = sizes.withColumn("weight", F.element_at(
        F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1))
    level = weighed.withColumns({
        "budget": SHARE * F.sum("source_size").over(whole),
        "bound": MOST * F.col("source_size") / F.col("weight")})
    level = level.withColumn("level", (
        F.col("budget") - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0.0)))
        / F.sum("weight").over(onwards))
    level = level.withColumn("open", F.min(F.when(F.col("level") < F.col("bound"), F.struct(
        "bound", "level"))).over(whole)["level"])
    return level.select("source", "source_size", F.least(
        MOST * F.col("source_size"), F.col("open") * F.col("weight")).alias("target"))


_BEFORE = ("source string, key double, id long, digest long, size long, pid int, before long, "
           "nth long")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the words before a row, of its source and within its partition, and the how manieth of
    equal rows it is, from 1; rows are in order and equal rows in one partition."""
    source, total, row, times = (), 0, None, 0
    for batch in batches:
        names = batch.column("source").to_pylist()
        sizes = batch.column("size").to_numpy()
        new = np.array([a != b for a, b in zip(names, [source, *names])], dtype=bool)
        ends = np.cumsum(sizes)
        starts = np.flatnonzero(new)
        base = np.zeros(len(sizes), np.int64) - total
        if len(starts):
            run = np.cumsum(new) - 1
            base = np.where(run >= 0, (ends - sizes)[starts][run], -total)
        before = ends - sizes - base
        places = [batch.column(c).to_numpy() for c in ("key", "id", "digest")]
        other = new.copy()
        for p in places:
            other[1:] |= p[1:] != p[:-1]
        if names:
            other[0] = other[0] or row != tuple(p[0] for p in places)
        run = np.maximum.accumulate(np.where(other, np.arange(len(sizes)), -1))
        nth = np.arange(len(sizes)) - np.maximum(run, 0) + np.where(run < 0, times + 1, 1)
        if names:
            source, total = names[-1], int(before[-1] + sizes[-1])
            row, times = tuple(p[-1] for p in places), int(nth[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(nth)],
                                         names=[*batch.schema.names, "before", "nth"])


def shares(docs: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs, and the last place that the rest takes
    (null where it takes none) with how many of the rows of that place it takes and has."""
    text = text_of()
    slim = docs.select("source", count_words(text).alias("size"),
                       place(F.col("doc_id"), text).alias("p")).select("source", "p.*", "size")
    order = [F.col("source").asc_nulls_last(), "key", "id", "digest"]
    ordered = settled(slim.select("source", "key", "id", "digest", "size")
                      .repartitionByRange(*order)
                      .sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    parts = ordered.groupBy("source", "pid").agg(F.sum("size").alias("words"))
    wanted = stored(targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
                    .withColumn("epochs", F.coalesce(F.floor(
                        F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
                    .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = stored(
        parts.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(wanted.select(F.col("source").alias("name"), "rest"),
              F.col("source").eqNullSafe(F.col("name")))
        .select(F.col("source").alias("name"), F.col("pid").alias("part"), "offset", "rest"))
    taken = (ordered.mapInArrow(_running, _BEFORE)
             .join(offsets, F.col("source").eqNullSafe(F.col("name"))
                   & (F.col("pid") == F.col("part")))
             .where(F.col("offset") + F.col("before") + F.col("size") / 2 < F.col("rest")))
    last = stored(taken.groupBy("name").agg(
        F.max(F.struct("key", "id", "digest", "nth")).alias("p")).select("name", "p.*"))
    tied = (ordered.drop("size").join(last, F.col("source").eqNullSafe(F.col("name")) & (
        F.struct(ordered["key"], ordered["id"], ordered["digest"])
        == F.struct(last["key"], last["id"], last["digest"])))
        .groupBy("name").agg(F.count("*").alias("tied"))
        .withColumnRenamed("name", "of"))
    last = last.join(tied, F.col("name").eqNullSafe(F.col("of"))).select(
        "name", F.struct("key", "id", "digest").alias("last"), "nth", "tied")
    return stored(wanted.join(last, wanted["source"].eqNullSafe(last["name"]), "left")
                  .select("source", "source_size", "target", "epochs", "last", "nth", "tied"))


def mix(docs: DataFrame, times: str = "times") -> DataFrame:
    """Add source_size, target and how many times the mix takes each document. The written table
    of sources is joined; Spark broadcasts it if its files are small.

    Rows equal in doc_id and text are told apart by number where the rest takes some of them
    only: those rows alone are counted off, in one task per source."""
    sources = shares(docs)
    kept = ["source_size", "target"]
    inner = [c for c in sources.columns if c not in kept]
    names = dict(zip(inner, fresh(docs, *(f"_{c}" for c in inner))))
    own = sources.withColumnsRenamed(names)
    epochs, last, nth, tied = (F.col(names[c]) for c in ("epochs", "last", "nth", "tied"))
    here = place(F.col("doc_id"), text_of())
    joined = docs.join(own, docs["source"].eqNullSafe(own[names["source"]]), "left")
    below = F.coalesce((here <= last).cast("int"), F.lit(0))
    if sources.where("nth < tied").isEmpty():
        return joined.withColumn(times, epochs + below).drop(*names.values())
    split = F.coalesce((here == last) & (nth < tied), F.lit(False))
    number = F.row_number().over(Window.partitionBy(names["source"]).orderBy("doc_id"))
    some = joined.where(split).withColumn(times, epochs + (number <= nth).cast("int"))
    others = joined.where(~split).withColumn(times, epochs + below)
    return others.unionByName(some).drop(*names.values())


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    names = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    held = docs.withColumnsRenamed(names).withColumns(
        {c: F.col(names[c]) for c in ("doc_id", "text", "source")})
    mixed = mix(held)
    back = [F.col(new).alias(old) for old, new in names.items()]
    return mixed.where("times > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*back)


def taken(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes."""
    return (mix(docs.select("doc_id", "text", "source"))
            .withColumn("size", count_words(text_of()))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("times")).alias("taken")))


SQL = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
sized AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
  -ln((('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE)
  / (1 - least(0.9::DOUBLE, length(regexp_replace(t, '[^#*$%&|<>!]', '', 'g'))::DOUBLE
      / greatest(length(t), 1))) AS key FROM docs),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS i FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CASE i WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sources),
bounds AS (SELECT *, 2.0::DOUBLE * source_size / w AS bound,
  1.5::DOUBLE * sum(source_size) OVER () AS budget FROM weighed),
levels AS (SELECT *, (budget - coalesce(sum(2.0::DOUBLE * source_size) OVER (
  ORDER BY bound, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY bound, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM bounds),
wanted AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (
  SELECT arg_min(level, bound) FROM levels WHERE level < bound)) AS target FROM levels),
placed AS (SELECT s.doc_id, s.size, w.source_size, w.target,
  floor(w.target / w.source_size) AS epochs,
  sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id) - s.size AS before
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE
  WHEN before + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END)
  AS BIGINT) AS taken FROM placed"""
