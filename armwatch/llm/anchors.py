"""Candidates for repeated windows: minimizer anchors of sequences, and the buckets they form.

A window of W elements holds W - k + 1 grams of k elements; its anchor is the gram of the
smallest hash, the first of equals. Equal windows have equal anchors at equal places, so windows
need comparing only within the bucket of an anchor. Consecutive windows mostly share an anchor:
such a run is kept as one stretch. Only stretches whose anchor occurs in two different texts, or
twice in one, are put out: (anchor, text) pairs are sorted once, and those of shared anchors go
back to their texts. A text holds an anchor once, so a passage that a third of all texts share is
a small part of the pairs. Copies of a text are one text in the buckets. Texts are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwatch.llm.common import LAST, released, text_of
from armwatch.session import settled, stored

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xFFFFFF)
#: Elements of a text that are hashed at a time; pieces overlap by a window.
PIECE = 1 << 20
Elements = Callable[[str], np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << n.bit_length()
        inverse = pow(int(_ODD), -1, 1 << 64)
        for base in (int(_ODD), inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            np.multiply.accumulate(steps, out=steps)
            if base == inverse:
                _INVERSE = steps
            else:
                _POWERS = steps
    return _POWERS, _INVERSE


def spans_hash(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many elements."""
    powers, inverse = _powers(len(x) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers[:len(x)], out=total[1:])
        n = len(x) - size + 1
        return mixed((total[size:] - total[:-size]) * inverse[:n])


def smallest(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x, width = np.minimum(x[:-width], x[width:]), width * 2
    if width < size:
        x = np.minimum(x[:len(x) - (size - width)], x[size - width:])
    return x


def stretches(x: np.ndarray, window: int, gram: int):
    """(anchor, first window, number of windows) of every run of windows with one anchor."""
    found = []
    for at in range(0, max(0, len(x) - window + 1), PIECE):
        part = mixed(x[at:at + PIECE + window - 1] + _ODD)
        grams = spans_hash(part, gram)
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (smallest(key, window - gram + 1) & _PLACE).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((grams[place[begin]].view(np.int64), begin + at,
                      np.diff(np.r_[begin, len(place)])))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(p) for p in zip(*found))


def _anchor_rows(elements: Elements, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text, content in zip(batch.column("text"), batch.column("content").to_pylist()):
                own = np.unique(stretches(elements(text.as_py()), window, gram)[0])
                anchors.append(own)
                texts.append(np.full(len(own), content, np.int64))
            yield pa.record_batch({"anchor": np.concatenate(anchors),
                                   "content": np.concatenate(texts)})

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, content) those whose anchor has another content, once each.

    A row shows this by its neighbours, so only the last row of a batch waits for the next one.
    """
    waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def put(anchor: np.ndarray, content: np.ndarray, shown: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"anchor": anchor[shown], "content": content[shown]})

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.r_[waiting[0], batch.column("anchor").to_numpy()]
        content = np.r_[waiting[1], batch.column("content").to_numpy()]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]
        anchor, content = anchor[new], content[new]
        shown = np.zeros(len(anchor), bool)
        shown[:len(waiting[2])] = waiting[2]
        same = anchor[1:] == anchor[:-1]
        shown[1:] |= same
        shown[:-1] |= same
        yield put(anchor[:-1], content[:-1], shown[:-1])
        waiting = anchor[-1:], content[-1:], shown[-1:]
    yield put(*waiting)


def _stretch_rows(elements: Elements, window: int, gram: int, packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for text, doc, shared in zip(batch.column("text"), batch.column("first").to_pylist(),
                                         batch.column("anchors")):
                x = elements(text.as_py())
                anchor, start, length = stretches(x, window, gram)
                _, which, often = np.unique(anchor, return_inverse=True, return_counts=True)
                wanted = often[which] > 1
                if shared.is_valid:
                    wanted |= np.isin(anchor, shared.values.to_numpy())
                at = np.flatnonzero(wanted)
                rows[0].append(anchor[at])
                rows[1].append(np.full(len(at), doc, np.int64))
                rows[2].append(start[at])
                rows[3].extend(packed(x, start[at], length[at]))
            none = [np.zeros(0, np.int64)]
            yield pa.record_batch([*(np.concatenate(r or none) for r in rows[:3]),
                                   pa.array(rows[3], pa.binary())],
                                  names=["anchor", "doc", "start", "data"])

    return run


def _by_anchor(found: Callable):
    """Runs of one anchor in sorted batches, to spans; the last run of a batch waits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, starts, data = None, [], [], []
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch(
                [pa.array([r[i] for r in out], pa.int64()) for i in range(3)],
                names=["doc", "a", "b"])
            out.clear()
            return batch

        for batch in batches:
            for anchor, doc, start, content in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != key:
                    if len(docs) > 1:
                        out += found(docs, starts, data)
                    key, docs, starts, data = anchor, [], [], []
                docs.append(doc)
                starts.append(start)
                data.append(content)
            yield flush()
        if len(docs) > 1:
            out += found(docs, starts, data)
        yield flush()

    return run


class _Bucket:
    """Stretches of one anchor, in order of (data, doc): distinct data, each with the smallest
    document that has it and its places there. Rows of later documents go at once; none is held."""

    def __init__(self) -> None:
        self.data: list[bytes] = []
        self.least: list[int] = []
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, data: list[bytes], which: np.ndarray, doc: np.ndarray,
            start: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, a, b) of the rows that go whole. ``which`` counts ``data`` from 0; the first may
        be the last one of the rows before."""
        least = doc[np.searchsorted(which, np.arange(len(data)))]
        again = int(bool(self.data) and data[0] == self.data[-1])
        if again:
            least[0] = self.least[-1]
        whole, base = doc > least[which], len(self.data) - again
        self.data += data[again:]
        self.least += least[again:].tolist()
        if not whole.all():
            self.rows.append((which[~whole] + base, start[~whole]))
        size = np.array([len(d) for d in data], np.int64)
        return doc[whole], start[whole], start[whole] + size[which[whole]]

    def spans(self, found: Callable) -> tuple[np.ndarray, ...]:
        """(doc, a, b) of the removed parts of the smallest documents."""
        out: list[tuple[int, int, int]] = []
        if len(self.data) > 1:
            which, start = (self.rows[0] if len(self.rows) == 1 else
                            (np.concatenate(r) for r in zip(*self.rows)))
            edges = np.searchsorted(which, np.arange(len(self.data) + 1)).tolist()
            start = start.tolist()
            for i, parts in found(self.data, self.least).items():
                out += [(self.least[i], at + a, at + b) for at in start[edges[i]:edges[i + 1]]
                        for a, b in parts]
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _by_distinct(found: Callable):
    """Rows sorted by (anchor, data, doc), to spans. Anchors that have one data throughout, the
    inside of an exact repeat, are settled for a whole batch at once; only the others become
    Python objects, their equal data once. The last anchor of a batch waits for the next one."""
    def batch_of(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        none = (np.zeros(0, np.int64),) * 3
        return pa.record_batch([pa.array(np.concatenate(r)) for r in zip(none, *parts)],
                               names=["doc", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting = None, _Bucket()
        for batch in batches:
            n, out = batch.num_rows, []
            if not n:
                continue
            anchor, doc, start = (batch.column(c).to_numpy() for c in ("anchor", "doc", "start"))
            data = batch.column("data")
            new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
            new_data = new_anchor.copy()
            if n > 1:
                new_data[1:] |= ~pc.equal(data[1:], data[:-1]).to_numpy(zero_copy_only=False)
            edges = np.r_[np.flatnonzero(new_anchor), n]
            kinds = np.add.reduceat(new_data, edges[:-1])
            sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
            # anchors inside the batch with one data: every row of a later document goes
            inner = np.ones(len(kinds), bool)
            inner[-1] = False
            if key is not None and anchor[0] == key:
                inner[0] = False
            plain = np.repeat(inner & (kinds == 1), np.diff(edges))
            least = np.repeat(doc[edges[:-1]], np.diff(edges))
            gone = plain & (doc > least)
            out.append((doc[gone], start[gone], start[gone] + sizes[gone]))
            shown = data.filter(pa.array(new_data & ~plain)).to_pylist()
            at = np.cumsum(new_data & ~plain)
            for g in np.flatnonzero(~(inner & (kinds == 1))).tolist():
                a, b = int(edges[g]), int(edges[g + 1])
                if key is not None and anchor[a] != key and waiting.data:
                    out.append(waiting.spans(found))
                    waiting = _Bucket()
                key = anchor[a]
                out.append(waiting.add(shown[at[a] - 1:at[b - 1]], at[a:b] - at[a], doc[a:b],
                                       start[a:b]))
            yield batch_of(out)
        if waiting.data:
            yield batch_of([waiting.spans(found)])

    return run


def _wanted_and_spans(rows: DataFrame, elements: Elements, window: int, gram: int,
                      packed: Callable, by_anchor: Callable, order: list[str],
                      kept: Callable = settled) -> tuple[DataFrame, DataFrame]:
    """The first document of each text with its shared anchors, and the removed parts by it."""
    firsts = stored(rows.groupBy("content").agg(F.min("id").alias("first"),
                                                F.count("*").alias("n")))
    anchors = rows.select("text", "content").mapInArrow(
        _anchor_rows(elements, window, gram), "anchor long, content long")
    shared = (anchors.repartition("anchor").sortWithinPartitions("anchor", "content")
              .mapInArrow(_shared_rows, "anchor long, content long"))
    lists = shared.groupBy("content").agg(F.collect_list("anchor").alias("anchors"))
    wanted = stored(firsts.join(lists, "content", "left")
                    .select("content", F.col("first").alias("id"), "first", "n", "anchors"))
    pieces = (rows.join(wanted, ["content", "id"]).select("text", "first", "anchors")
              .mapInArrow(_stretch_rows(elements, window, gram, packed),
                          "anchor long, doc long, start long, data binary"))
    spans = kept(pieces.repartition("anchor").sortWithinPartitions(*order)
                 .mapInArrow(by_anchor, "doc long, a long, b long")
                 .groupBy(F.col("doc").alias("id"))
                 .agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    return wanted, spans


def repeated_spans(docs: DataFrame, elements: Elements, window: int, gram: int, packed: Callable,
                   found: Callable, text: str = "text", distinct: bool = False) -> DataFrame:
    """Every row of (doc_id, text) with ``first`` (the smallest doc_id of equal texts), ``n``
    (rows of that text), ``own`` (whether the row is that document) and ``spans``, the removed
    stretches [a, b) of elements of the first document of a text.

    ``found`` gets the rows of a bucket; with ``distinct`` it gets the distinct data, each with
    the smallest document that has it, and gives the removed parts [(a, b)] by place among them."""
    rows = docs.select("doc_id", text_of(text).alias("text")).withColumns({
        "content": F.xxhash64("text"), "id": F.coalesce("doc_id", F.lit(LAST))})
    if not distinct:
        wanted, spans = _wanted_and_spans(rows, elements, window, gram, packed,
                                          _by_anchor(found), ["anchor"])
    else:
        with released(docs.sparkSession):
            wanted, spans = _wanted_and_spans(rows, elements, window, gram, packed,
                                              _by_distinct(found), ["anchor", "data", "doc"],
                                              stored)
    known = wanted.select("content", "id", "n", F.lit(True).alias("own"))
    return (rows.join(known.join(spans, "id", "left"), ["content", "id"], "left")
            .select("doc_id", "text", F.coalesce("own", F.lit(False)).alias("own"),
                    F.coalesce("n", F.lit(2)).alias("n"), "spans"))


def merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out
