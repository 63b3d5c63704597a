"""Suffix-array dedup: maximal repeats of bytes with all their occurrences.

Stretches of texts that share an anchor (see ``anchors``) form a bucket. The suffixes of a
bucket's distinct stretches are sorted, with the common-prefix lengths of neighbours; a stack
scan walks the tree of common-prefix intervals, and an interval whose suffixes are preceded by
different bytes is a maximal repeat, put out with all its occurrences. A byte goes when an
occurrence of a maximal repeat of at least ``least`` bytes covers it and the same repeat starts
in a document with a smaller doc_id.

Suffixes that share their first ``least`` bytes are sorted together, those of a large bucket by
parts, so that a bucket's memory is that of its distinct stretches and one part.

Equal texts are one document in the buckets: all but the one with the smallest doc_id lose every
byte if they have ``least``. Null and empty texts lose nothing. Rows that repeat a doc_id and its
text are one document. A null doc_id counts as larger than any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwatch.llm.anchors import merged, repeated_spans

LEAST = 50
GRAM = 16
#: Suffixes sorted at a time.
PART = 200_000


def elements(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8).astype(np.uint64)


def packed(x: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    data = x.astype(np.uint8).tobytes()
    return [data[a:a + n + LEAST - 1] for a, n in zip(start.tolist(), length.tolist())]


def common_prefix(a: bytes, b: bytes, least: int) -> int:
    """The bytes that two suffixes share at their front, 0 where they are fewer than ``least``."""
    if a[:least] != b[:least]:
        return 0
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = least, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def suffixes(texts: list[bytes], least: int) -> Iterator[list[tuple[bytes, int, int]]]:
    """(suffix, text, place) of all suffixes of at least so many bytes, each part in order. Those
    that share so many bytes at their front lie in one part, so no repeat spans two."""
    counts = [max(0, len(text) - least + 1) for text in texts]
    total = sum(counts)
    if total <= PART:
        yield sorted((text[i:], t, i) for t, text in enumerate(texts)
                     for i in range(len(text) - least + 1))
        return
    parts, counts = total // PART + 1, np.array(counts)
    ends = np.cumsum(counts)
    part = np.fromiter((zlib.crc32(text[i:i + least]) % parts for text in texts
                        for i in range(len(text) - least + 1)), np.uint32, total)
    for own in range(parts):
        at = np.flatnonzero(part == own)
        t = np.searchsorted(ends, at, side="right")
        places = zip(t.tolist(), (at - ends[t] + counts[t]).tolist())
        yield sorted((texts[t][i:], t, i) for t, i in places)


def repeats(texts: list[bytes], suffixes: list[tuple[bytes, int, int]],
            least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences (text, place)) of the maximal repeats among suffixes in order."""
    stack: list[tuple[int, int]] = []  # common-prefix length, first suffix of the interval
    for k in range(1, len(suffixes) + 1):
        same = (common_prefix(suffixes[k - 1][0], suffixes[k][0], least)
                if k < len(suffixes) else 0)
        begin = k - 1
        while stack and stack[-1][0] > same:
            length, begin = stack.pop()
            places = [(t, i) for _, t, i in suffixes[begin:k]]
            left = {texts[t][i - 1:i] if i else (t,) for t, i in places}
            if len(left) > 1:
                yield length, places
        if same >= least and (not stack or stack[-1][0] < same):
            stack.append((same, begin))


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences (text, place)) of every maximal repeat of at least so many bytes."""
    return [x for part in suffixes(texts, least) for x in repeats(texts, part, least)]


def runs(mask: int) -> list[tuple[int, int]]:
    """The runs [a, b) of set bits."""
    out, at = [], 0
    while mask:
        skipped = (mask & -mask).bit_length() - 1
        mask >>= skipped
        length = (~mask & (mask + 1)).bit_length() - 1
        mask >>= length
        out.append((at + skipped, at + skipped + length))
        at += skipped + length
    return out


def removed(texts: list[bytes], least: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Of a bucket's distinct stretches, each with the smallest document that has it, the parts
    that go, by the stretch's number."""
    gone: dict[int, int] = {}  # the bytes that go, as bits
    for part in suffixes(texts, LEAST):
        for length, places in repeats(texts, part, LEAST):
            smallest, run = min(least[t] for t, _ in places), (1 << length) - 1
            for t, i in places:
                if least[t] > smallest:
                    gone[t] = gone.get(t, 0) | run << i
    return {t: runs(mask) for t, mask in gone.items()}


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document the bytes, the removed ones and their runs, and a digest of what is left."""
    rows = repeated_spans(docs, elements, LEAST, GRAM, packed, removed, distinct=True)

    @F.arrow_udf("struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string>")
    def digest(text: pa.Array, own: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, first, found in zip(text, own.to_pylist(), spans):
            data = t.as_py().encode()
            gone = merged(found.as_py()) if first else (
                [(0, len(data))] if len(data) >= LEAST else [])
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append({"n_bytes": len(data), "n_removed": sum(b - a for a, b in gone),
                        "n_spans": len(gone), "kept_sha256": kept.hexdigest()})
        return pa.array(out, pa.struct({"n_bytes": pa.int64(), "n_removed": pa.int64(),
                                        "n_spans": pa.int64(), "kept_sha256": pa.string()}))

    return rows.select("doc_id", digest.asNondeterministic()("text", "own", "spans").alias("d")
                       ).select("doc_id", "d.*")
