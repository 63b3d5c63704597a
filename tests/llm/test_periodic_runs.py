import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from armwatch.llm import periodic_runs as op
from armwatch.llm.registry import QUERIES


def plain_runs(words, least=6, times=4):
    """Every stretch of each period, kept when no smaller period has the same one."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain(doc_id, text, planted):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = s, length, q
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3),
            1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4),
       st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_runs_of_random_words(texts, bounds):
    ids = np.array([w for t in texts for w in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.cumsum([0, *map(len, texts)])
    want = sorted((s + first[d], n, q) for d, t in enumerate(texts)
                  for s, n, q in plain_runs(t, *bounds))
    found = op.runs_of(ids, doc, *bounds) if len(ids) else []
    assert sorted(tuple(r) for r in np.array(found).tolist()) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "ü c", "d\te"], rng.integers(0, 80))))
            for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "x " * 5), (504, "x " * 6),
             (505, "x y " * 4), (506, "x y z " * 3 + "x y"), (507, "x y " * 9), (3, rows[3][1]),
             (3, rows[3][1]), (None, "p q " * 30), (508, "a a a b " * 9),
             (509, "k " * 300_000), (510, " ".join(f"w{i}" for i in range(200_000)) + " a b" * 20)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "doc_id long, text string, runs int, best string")
    # the brute force is quadratic: periods of the two long texts are known
    short = [plain(*r, False) for r in rows if r[0] not in (509, 510)]
    found = [tuple(r) for r in op.reported(df).collect()]
    assert ordered(r for r in found if r[0] not in (509, 510)) == ordered(short)
    long = {r[0]: r[1:6] for r in found}
    assert long[509] == (1, 0, 300_000, 1, 300_000_000)
    assert long[510] == (1, 200_000, 40, 2, 20_000)
    kept = op.with_runs(df.where("doc_id = 504")).first()
    assert (kept["runs"], kept["best"], kept["collapsed"]) == (1, "x", "x")
    assert [tuple(r) for r in kept["_runs"]] == [(0, 6, 1)]
    assert op.reported(df.where("false")).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_whole_table_with_planted_runs(spark, folder):
    path = f"/root/testdata/{folder}"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = [plain(r.doc_id, r.text, True) for r in docs]
    found = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, path).collect()]
    assert sorted(found) == sorted(want, key=lambda r: r[0])
    assert sum(r[1] > 0 for r in found) > 10


def test_planting_leaves_odd_rows(spark):
    rows = [(i, t) for i in range(40) for t in ("a b c d e f g h i j k", "", None, "one")]
    rows.append((None, "a b c"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in op.reported(op.with_planted_runs(df)).collect()]
    assert ordered(found) == ordered(plain(*r, True) for r in rows)
