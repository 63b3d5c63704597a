"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Fingerprints
that differ in at most ``distance`` of 64 bits agree in at least ``blocks - distance`` of
``blocks`` blocks, so every such pair meets in one bucket of a table keyed by that many blocks,
one table for each choice. Equal fingerprints are one node. Within a bucket, links are verified
and only a spanning forest of them is put out: links of a bucket with n fingerprints are fewer
than n rows, and connectivity is the same. Buckets over ``TILE`` fingerprints are dealt over
pairs of chunks, so that a task holds two chunks at most.

Null and empty texts have fingerprint zero and link like any other. Copies, repeated rows and
ties belong to one group. A row without doc_id links like any other; the smallest doc_id of a
group is taken over its numbered rows, and is null where there are none.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwatch.llm.graph import components
from armwatch.session import settled, stored

SEED = 42
#: Fingerprints of a bucket that are compared at once.
TILE = 4096
#: Bytes of a text that are cut to words at a time.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in blocks, cut at white space."""
    start = 0
    while start < len(data):
        gap = _SPACE.search(data, start + size) if start + size < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64 bits as a signed number."""
    from xxhash import xxh64_intdigest

    ones, total, last = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode().lower()):
        words = last + words
        whole = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)]
        if whole:
            hashes = np.fromiter((xxh64_intdigest(x, SEED) for x in whole), ">u8", len(whole))
            ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            total += len(whole)
        last = words[max(0, len(words) - shingle + 1):]
    if not total and last:
        hashes = np.array([xxh64_intdigest(b" ".join(last), SEED)], ">u8")
        ones, total = np.unpackbits(hashes.view(np.uint8)).astype(np.int64), 1
    return int(np.packbits(2 * ones > total).view(">i8")[0])


def fingerprint_of(text: Column, shingle: int) -> Column:
    @F.arrow_udf(T.LongType())
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())

    return fingerprints(text)


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed masks of every choice of ``blocks - distance`` blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    masks = [sum(chosen) for chosen in itertools.combinations(bits, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_links(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within ``distance`` of each other."""
    rest, a, b = np.arange(len(x)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(x[rest] ^ x[at]) <= distance
            hit = rest[near]
            if len(hit):
                rest = rest[~near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                queue += hit.tolist()
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bucket_links(distance: int):
    """Verified links of sorted (bucket, fp) batches; the last bucket of a batch waits."""
    def links(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]).any(1)])
        sizes = np.diff(np.r_[starts, len(fp)])
        x = fp.view(np.uint64)
        two = starts[sizes == 2]
        two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            i, j = spanning_links(x[start:start + size], distance)
            a.append(fp[start + i])
            b.append(fp[start + j])
        return pa.record_batch([np.concatenate(a), np.concatenate(b)], schema=_LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                             for i in range(3)], 1)
            keys = np.concatenate([waiting[0], keys])
            fp = np.concatenate([waiting[1], batch.column(3).to_numpy()])
            last = int((keys == keys[-1]).all(1).argmax()) if len(keys) else 0
            if last:
                yield links(keys[:last], fp[:last])
            waiting = keys[last:], fp[last:]
        if len(waiting[1]):
            yield links(*waiting)

    return run


def fingerprint_links(distinct: DataFrame, distance: int, blocks: int,
                      tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect what is in reach."""
    masks = block_masks(blocks, distance)
    keyed = distinct.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits"))
        for i, mask in enumerate(masks)))).alias("k")).select("fp", "k.choice", "k.bits")
    large = stored(keyed.groupBy("choice", "bits").count().where(F.col("count") > tile)
                   .withColumn("chunks", F.ceil(F.col("count") / tile).cast("int")))
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = (keyed.join(large, ["choice", "bits"], "left")
             .withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
             .select("choice", "bits",
                     (F.least("chunk", "other") * F.lit(2**31).cast("long")
                      + F.greatest("chunk", "other")).alias("pair"), "fp"))
    bucket = ["choice", "bits", "pair"]
    return (dealt.repartition(*bucket).sortWithinPartitions(*bucket)
            .mapInArrow(_bucket_links(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int, distance: int, blocks: int | None = None,
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: its fingerprint, and the smallest doc_id of the
    rows that links reach."""
    found = settled(docs.select("doc_id", fingerprint_of(F.col(text), shingle).alias("fp")))
    distinct = settled(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    reached = components(fingerprint_links(distinct.select("fp"), distance,
                                           blocks or distance + 2))
    grouped = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    first = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = settled(grouped.join(first, "component").select("fp", "component_id"))
    return found.join(named, "fp")


def without_near_duplicates(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Rows that repeat its doc_id
    are one document, the smallest row; rows without doc_id stay, as no group names them."""
    groups = near_duplicates(docs, shingle, distance)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in docs.columns if c != "doc_id"]
    one = (docs.join(kept, "doc_id", "left_semi")
           .groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
           .select("doc_id", *(F.col("row")[c].alias(c) for c in rest)).select(docs.columns))
    return one.unionByName(docs.where("doc_id IS NULL"))


def groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """Per document its fingerprint in hexadecimal and the smallest doc_id in reach."""
    return near_duplicates(docs, shingle, distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
