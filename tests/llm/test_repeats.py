import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from armwatch.llm import anchors, relative_lz, suffix_dedup
from armwatch.llm.registry import QUERIES


def plain_bytes(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            w = data[k:k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - 49):
            if first[data[k:k + 50]] < i:
                gone[k:k + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def plain_words(rows):
    count = Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[k:k + 35]) for k in range(len(w) - 34))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts():
    rng = np.random.default_rng(7)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)]
    shared = [" ".join(rng.choice(words, n)) for n in (9, 14, 33, 34, 35, 36, 40, 90)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(3)]
        for at in range(2):
            part = shared[rng.integers(len(shared))]
            parts.insert(at * 2 + 1, part[rng.integers(4):len(part) - rng.integers(4)])
        rows.append((1000 - i, " ".join(parts)))
    near = rows[0][1].split()
    for i in range(30):
        copy = list(near)
        copy[rng.integers(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(2000 + i, rows[3][1]) for i in range(3)]
    rows += [(3000, None), (3001, ""), (3002, "a" * 49), (3003, "a" * 50), (3004, "a" * 130),
             (3005, "ab " * 200), (3006, "ab " * 190), (3007, "b" + "a" * 49), (3008, "q " * 34),
             (3009, "r " * 35), (3010, "r " * 35), (3011, "ü" * 60), (3012, "x" + "ü" * 60)]
    return rows


CASES = [("op8_suffix_array_dedup", suffix_dedup, plain_bytes),
         ("op9_relative_lz_dedup", relative_lz, plain_words)]


@pytest.mark.parametrize("name,op,plain", CASES)
def test_same_as_plain(spark, sf_dir, name, op, plain):
    rows = texts()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "doc_id long, text string, n int, spans string")
    assert sorted(map(tuple, op.deduplicated(df).collect())) == plain(rows)
    assert op.deduplicated(df.where("false")).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = QUERIES[name](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == plain([tuple(r) for r in docs.collect()])


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"k{i}" for i in range(60))
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (None, "short")],
                               "doc_id long, text string")
    found = [(r.doc_id, r.n_removed) for r in suffix_dedup.deduplicated(df).collect()]
    assert Counter(found) == Counter({(5, 0): 2, (None, len(long)): 1, (None, 0): 1})
    found = [(r.doc_id, r.n_removed) for r in relative_lz.deduplicated(df).collect()]
    assert Counter(found) == Counter({(5, 60): 2, (None, 60): 1, (None, 0): 1})


def test_maximal_repeats_have_all_occurrences():
    rng = np.random.default_rng(3)
    found = [rng.choice(np.frombuffer(b"ab", np.uint8), 40).tobytes() for _ in range(4)]
    want = defaultdict(set)
    for length in range(6, 41):
        for t, text in enumerate(found):
            for i in range(len(text) - length + 1):
                want[text[i:i + length]].add((t, i))

    def diverse(places, shift):
        seen = set()
        for t, i in places:
            j = i + shift
            seen.add(found[t][j] if 0 <= j < len(found[t]) else (t, j))
        return len(seen) > 1
    want = {(len(w), frozenset(p)) for w, p in want.items()
            if len(p) > 1 and diverse(p, -1) and diverse(p, len(w))}
    assert {(n, frozenset(p)) for n, p in suffix_dedup.maximal_repeats(found, 6)} == want


def peak_of(run):
    tracemalloc.start()
    try:
        result = run()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_rows_of_a_hot_anchor_are_not_held():
    """300,000 documents share a passage: later documents' rows go with their batch."""
    data = [b"%d" % k + b" the passage of sixty bytes that is in very many other texts" for k in range(3)]

    def batches():
        for text in data:
            for at in range(0, 100_000, 5000):
                docs = pa.array(np.arange(at, at + 5000))
                yield pa.record_batch([pa.array(np.zeros(5000, np.int64)), docs, docs,
                                       pa.array([text] * 5000, pa.binary())],
                                      names=["anchor", "doc", "start", "data"])

    def run():
        found = anchors._by_distinct(lambda data, least: {2: [(1, 51)]} if least == [0] * 3 else {})
        seen, last = 0, None
        for batch in found(batches()):
            seen, last = seen + batch.num_rows, batch.slice(max(0, batch.num_rows - 1))
        return seen, last.to_pylist()

    (seen, last), peak = peak_of(run)
    assert seen == 3 * 99_999 + 1 and last == [{"doc": 0, "a": 1, "b": 51}]
    assert peak < 4, peak


def test_suffixes_of_a_large_bucket_are_sorted_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    core = b"a passage that very many documents hold, in 54 bytes.."
    found = sorted({core[k % 3:] + rng.bytes(30) for k in range(3000)}
                   | {rng.bytes(k % 9) + core for k in range(600)})
    least = rng.permutation(len(found)).tolist()
    first = {}
    for text, doc in zip(found, least):
        for i in range(len(text) - 49):
            first[text[i:i + 50]] = min(first.get(text[i:i + 50], doc), doc)
    want = {}
    for t, (text, doc) in enumerate(zip(found, least)):
        gone = {j for i in range(len(text) - 49) if first[text[i:i + 50]] < doc
                for j in range(i, i + 50)}
        if gone:
            want[t] = gone
    monkeypatch.setattr(suffix_dedup, "PART", 5000, raising=False)
    result, peak = peak_of(lambda: suffix_dedup.removed(found, least))
    assert {t: {j for a, b in v for j in range(a, b)} for t, v in result.items()} == want
    assert peak < 12, peak
