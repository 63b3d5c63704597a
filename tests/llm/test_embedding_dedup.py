import numpy as np
import pytest

from armwatch.llm import embedding_dedup as op


def plain(rows, threshold):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1]
          and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    parent = {r[0]: r[0] for r in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    count = dict.fromkeys(parent, 0)
    for x, (i, v, k) in enumerate(ok):
        for j, w, m in ok[:x]:
            if k == m and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    count[i] += 1
                    count[j] += 1
                    lo, hi = sorted((top(i), top(j)))
                    parent[hi] = lo
    return sorted((i, count[i], top(i), i == top(i)) for i in parent)


def vectors(rng, n, dims):
    centres = rng.normal(size=(n // 10, dims))
    x = centres[rng.integers(len(centres), size=n)]
    x = (x + rng.normal(size=x.shape) * rng.choice([0, 0.05, 0.14, 1], size=(n, 1))) * 3
    return x.astype(np.float32)


@pytest.mark.parametrize("chunk", [16, 1024])
def test_same_as_all_pairs(spark, chunk):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in x], int(rng.integers(3)))
            for i, x in enumerate(vectors(rng, 240, 24))]
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = op.near_duplicates(df, 0.98, chunk).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 0.98)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None),
            (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0),
            (10, [None, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1e-30, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>,"
                               " label int, node int, size int")
    found = op.near_duplicates(df).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, 0.98)
    assert op.near_duplicates(df.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, [1.0], 0), (None, [1.0], 0)],
                                  "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in op.near_duplicates(nulls).collect()] == [(None, 0, None, True)] * 2


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(5)
    for dims in (3, 64, 1500):
        x, y = rng.normal(size=(50, dims)), rng.normal(size=(60, dims))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y /= np.linalg.norm(y, axis=1)[:, None]
        (q, su, eu), (p, sv, ev) = op.quantised(x), op.quantised(y)
        whole = op.whole_product(q, p)
        assert (whole == q.astype(np.int64) @ p.astype(np.int64).T).all()
        off = np.abs(x @ y.T - whole * su[:, None] * sv)
        assert (off <= eu[:, None] + (1 + eu)[:, None] * ev).all()
