"""Relative Lempel-Ziv dedup of words: factors copied from other texts, or from the same one.

Stretches of texts that share an anchor (see ``anchors``) are the reference blocks of a bucket;
their windows of ``WINDOW`` words are indexed by hash. Each distinct stretch is factored
greedily: from a window that also starts elsewhere, the factor follows the indexed occurrence
that goes on longest, and becomes a duplicate span. The parse goes on with the window that
follows, so windows across a factor's boundary are checked like any other, against all blocks.

A word goes when a window that covers it starts anywhere else, in the same document too, so all
occurrences go. Documents with equal texts of ``WINDOW`` words or more lose everything. Null and
empty texts have no words. Rows that repeat are documents like any other; doc_id may be null.
Windows are told apart by 64-bit hashes within a bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwatch.llm.anchors import _ODD, merged, mixed, repeated_spans, spans_hash

WINDOW = 35
GRAM = 8


def elements(text: str) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = text.encode().split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def packed(x: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[bytes]:
    if not len(start):
        return []
    windows = spans_hash(mixed(x + _ODD), WINDOW)
    return [windows[a:a + n].tobytes() for a, n in zip(start.tolist(), length.tolist())]


def factors(block: list[int], which: int, blocks: list[list[int]], often: list[int],
            index: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Stretches [a, b) of a block's windows that are copied from some reference block."""
    out, at = [], 0
    while at < len(block):
        best = 0
        for source, place in index[block[at]]:
            if source == which and place == at and often[which] < 2:
                continue
            other, n = blocks[source], 1
            while at + n < len(block) and place + n < len(other) and (
                    block[at + n] == other[place + n]):
                n += 1
            best = max(best, n)
            if at + best == len(block):
                break
        if best:
            out.append((at, at + best))
        at += max(1, best)
    return out


def removed(docs: list[int], starts: list[int], data: list[bytes]) -> list[tuple[int, int, int]]:
    """(doc, a, b) of the words of a bucket's stretches that go."""
    count: dict[bytes, int] = {}
    for content in data:
        count[content] = count.get(content, 0) + 1
    distinct, often = list(count), list(count.values())
    blocks = [np.frombuffer(c, np.uint64).tolist() for c in distinct]
    index: dict[int, list[tuple[int, int]]] = {}
    for which, block in enumerate(blocks):
        for place, window in enumerate(block):
            index.setdefault(window, []).append((which, place))
    spans = {content: [(0, len(block))] if n > 1 else factors(block, i, blocks, often, index)
             for i, (content, block, n) in enumerate(zip(distinct, blocks, often))}
    return [(doc, start + a, start + b + WINDOW - 1)
            for doc, start, content in zip(docs, starts, data) for a, b in spans[content]]


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document the words, the removed ones, and a digest of what is left."""
    rows = repeated_spans(docs, elements, WINDOW, GRAM, packed, removed)

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept_sha256: string>")
    def digest(text: pa.Array, n: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, copies, found in zip(text, n.to_pylist(), spans):
            words = t.as_py().encode().split()
            if copies > 1:
                gone = [(0, len(words))] if len(words) >= WINDOW else []
            else:
                gone = merged(found.as_py())
            kept, at = [], 0
            for a, b in gone:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append({"n_words": len(words), "n_removed": len(words) - len(kept),
                        "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()})
        return pa.array(out, pa.struct({"n_words": pa.int64(), "n_removed": pa.int64(),
                                        "kept_sha256": pa.string()}))

    return rows.select("doc_id", digest.asNondeterministic()("text", "n", "spans").alias("d")
                       ).select("doc_id", "d.*")
