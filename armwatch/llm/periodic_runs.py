"""Periodic runs of words: branching tandem repeats over an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and at least ``times`` x q words
(and ``least``) that no neighbouring word extends with the same period.

The texts of an Arrow batch are one sequence of word numbers. A word of a run recurs ``times``
times among its neighbours, so words that don't cut a text into pieces, until nothing changes;
only pieces of ``least`` words go on. Ranks of prefixes of 1, 2, 4, ... words (a piece's words
differ from those of other pieces) give the suffix array, its inverse ISA and the common prefixes
of neighbours. A stack scan finds the interval around each boundary of depth d. A square of period
d that can't be moved to the right starts at suffix i if i and i + d lie in different children of
an interval of depth d; the suffixes of the smaller side look up ISA[i + d] and ISA[i - d] in the
other. Each square is rotated to the left as far as its words repeat, which gives the run; runs of
the same place merge into the one with the smallest period. No tree is built.

Nulls, empty texts and texts of white space have no words and no runs. Texts are read whole and
by themselves; a long text is a batch by itself. Rows that repeat give equal results. Other
columns stay as they are; ``runs`` and ``collapsed`` get underscores in front where the table has
such a column. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwatch.llm.common import fresh, text_of

LEAST, TIMES = 6, 4
#: Rounds of cutting by rare words; those left over cost time only.
ROUNDS = 8
#: Suffixes looked up at a time.
CHUNK = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"


def pieces(ids: np.ndarray, doc: np.ndarray, least: int, times: int):
    """Places of the words that a run may hold, and the number of the piece of each."""
    at = np.arange(len(ids))
    for _ in range(ROUNDS):
        if not len(at):
            break
        new = np.r_[True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0)]
        piece = np.cumsum(new) - 1
        _, which, often = np.unique(piece * (ids.max() + 1) + ids[at], return_inverse=True,
                                    return_counts=True)
        stays = (often[which] >= times) & (np.bincount(piece)[piece] >= least)
        if stays.all():
            break
        at = at[stays]
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0)][:len(at)]
    return at, np.cumsum(new) - 1


class SuffixArray:
    """Ranks of the prefixes of 2^k words of every suffix; suffixes of different pieces have
    nothing in common."""

    def __init__(self, words: np.ndarray, piece: np.ndarray):
        n = self.n = len(words)
        distinct, rank = np.unique(piece * (words.max() + 1) + words, return_inverse=True)
        self.levels = [np.r_[rank, -1].astype(np.int32)]
        step = 1
        while len(distinct) < n:
            after = np.zeros(n, np.int64)
            same = np.flatnonzero(piece[step:] == piece[:-step]) if step < n else []
            after[same] = rank[step:][same] + 1
            distinct, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
            self.levels.append(np.r_[rank, -1].astype(np.int32))
            step *= 2
        self.isa = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (i != j) share at their front."""
        length = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            rank = self.levels[k]
            length[rank[i + length] == rank[j + length]] += 1 << k
        return length

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same just before i and j, for i < j."""
        length = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            rank, from_i = self.levels[k], i - length - (1 << k)
            same = (from_i >= 0) & (rank[np.maximum(from_i, 0)]
                                    == rank[np.maximum(j - length - (1 << k), 0)])
            length[same] += 1 << k
        return length


def around(depth: list[int]) -> tuple[list[int], list[int]]:
    """Of each boundary the last one before it that is no deeper, and the first one after it
    that is less deep: the ends of its left child and of its interval."""
    before, after, stack = [0] * len(depth), [len(depth)] * len(depth), []
    for at, d in enumerate(depth):
        while stack and depth[stack[-1]] > d:
            after[stack.pop()] = at
        if stack:
            before[at] = stack[-1]
        stack.append(at)
    return before, after


def squares(array: SuffixArray):
    """(place, period) of every square whose next word breaks the period."""
    n, order, isa = array.n, array.order, array.isa
    depth = np.r_[-1, array.common(order[:-1], order[1:])]
    before, after = map(np.array, around(depth.tolist()))
    at = np.flatnonzero(depth > 0)
    before, after, depth = before[at], after[at], depth[at]
    left = at - before <= after - at                    # the left side is the smaller one
    begin, size = np.where(left, before, at), np.minimum(at - before, after - at)
    low, high = np.where(left, at, before), np.where(left, after, at)
    found = [np.zeros((2, 0), np.int64)]
    chunk = np.cumsum(size) // CHUNK
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(chunk)) + 1):
        own = np.repeat(part, size[part])
        nth = np.arange(len(own)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i, d = order[begin[own] + nth], depth[own]
        for start, other in ((i, i + d), (i - d, i - d)):
            inside = (other >= 0) & (other < n)
            rank = isa[np.where(inside, other, 0)]
            hit = inside & (rank >= low[own]) & (rank < high[own])
            found.append(np.stack([start[hit], d[hit]]))
    return np.concatenate(found, axis=1)


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES):
    """Rows of (first place, words, period) of all runs, by place and period. ``ids`` are word
    numbers, ``doc`` the text each word is of; runs never cross texts."""
    at, piece = pieces(ids, doc, least, times)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    array = SuffixArray(ids[at], piece)
    place, period = squares(array)
    start = place - array.common_before(place, place + period)
    length = place + 2 * period - start
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a multiple of a run's period gives the same stretch again
    first = np.r_[True, (np.diff(start) != 0) | (np.diff(length) != 0)][:len(start)]
    kept = first & (length >= np.maximum(least, times * period))
    start, length, period = at[start[kept]], length[kept], period[kept]
    order = np.lexsort((period, start))
    return np.stack([start, length, period], axis=1)[order]


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
              least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Add the runs of a text (first word, words, period; by first word, then period) and the text
    without the words of a run after its first period, joined by one space."""
    @F.arrow_udf(f"struct<runs: {RUNS}, collapsed: string>")
    def find(texts: pa.Array) -> pa.Array:
        number: dict[bytes, int] = {}
        words, ids, sizes = [], [], []
        for t in texts:
            own = (t.as_py() or "").encode().split()
            words.append(own)
            ids += [number.setdefault(w, len(number)) for w in own]
            sizes.append(len(own))
        ends = np.cumsum(sizes)
        rows: list[list[dict]] = [[] for _ in words]
        gone: list[set[int]] = [set() for _ in words]
        found = runs_of(np.array(ids, np.int64), np.repeat(np.arange(len(words)), sizes),
                        least, times) if ids else []
        for start, length, period in (r.tolist() for r in found):
            d = int(np.searchsorted(ends, start, "right"))
            start -= int(ends[d]) - sizes[d]
            rows[d].append({"start": start, "length": length, "period": period})
            gone[d].update(range(start + period, start + length))
        left = [b" ".join([w for i, w in enumerate(own) if i not in out] if out else own)
                for own, out in zip(words, gone)]
        kind = pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()})
        return pa.StructArray.from_arrays(
            [pa.array(rows, pa.list_(kind)), pa.array(left, pa.binary()).cast(pa.string())],
            ["runs", "collapsed"])

    out, runs, collapsed = fresh(df, "found", runs, collapsed)
    both = df.withColumn(out, find.asNondeterministic()(text_of(text)))
    return (both.withColumns({runs: F.col(f"{out}.runs"), collapsed: F.col(f"{out}.collapsed")})
            .drop(out))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``text`` with a periodic end in a tenth of the documents, chosen by a digest of doc_id:
    from word a on, word i becomes word a + (i - a) mod p. A null doc_id changes nothing."""
    @F.arrow_udf("string")
    def turned(texts: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(texts.to_pylist(), digests.to_pylist()):
            words = t.encode().split() if h is not None and h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = [words[a + i % p] for i in range(n - a)]
                t = b" ".join(words).decode()
            out.append(t)
        return pa.array(out, pa.string())

    digest = F.crc32(F.col("doc_id").cast("string"))
    return docs.withColumn("text", turned(text_of(), digest))


def reported(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of the greatest exponent, and digests."""
    rows = with_runs(docs.select("doc_id", "text"))

    def before(a: Column, b: Column) -> Column:
        """Greatest length / period first, compared as whole numbers, then place and period."""
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1)
                .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).otherwise(1))

    best = F.get(F.array_sort("runs", before), F.lit(0))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
