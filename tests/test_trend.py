"""Trend lines with breaks against an exhaustive search."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest

from armwatch.operators import trend

DAY = dt.date(2020, 1, 1)
TYPES = "site string, day date, y double"


def rows(site, values, step=1):
    return [(site, DAY + dt.timedelta(days=step * i), float(v)) for i, v in enumerate(values)]


def lines(spark, data, **options):
    _, found = trend.changing_trend(spark.createDataFrame(data, TYPES), ["site"], **options)
    return {(r.id.site, r.a): r for r in found.collect()}


def best(values, step, candidates, span, changes):
    n, t = len(values), np.arange(len(values), dtype=float) * step
    y = np.array(values, float)
    marks = sorted({int(np.floor(span * i / candidates * n)) for i in range(1, candidates + 1)})

    def error(a, b):
        line = np.polyfit(t[a:b], y[a:b], 1) if b - a > 1 else [0, y[a]]
        return ((y[a:b] - np.polyval(line, t[a:b])) ** 2).sum()
    found = []
    for k in range(changes + 1):
        for breaks in combinations([m for m in marks if 0 < m < n], k):
            edges = [0, *breaks, n]
            if all(b - a >= 2 for a, b in zip(edges, edges[1:])):
                sse = sum(error(a, b) for a, b in zip(edges, edges[1:]))
                found.append((n * np.log(max(sse / n, trend.STRAIGHT))
                              + (3 * (k + 1) - 1) * np.log(n), edges))
    return min(found)[1]


def test_breaks_of_an_exhaustive_search(spark):
    rng = np.random.default_rng(1)
    data, want = [], {}
    for i, n in enumerate((7, 20, 61, 90)):
        values = np.cumsum(rng.poisson(np.where(np.arange(n) < n * .5, 3, 15)))
        data += rows(f"s{i}", values, step=1 + i % 2)
        edges = best(values, 1 + i % 2, 8, .8, 2)
        want |= {(f"s{i}", a): b for a, b in zip(edges, edges[1:])}
    found = lines(spark, data, candidates=8, changes=2)
    assert {key: r.b for key, r in found.items()} == want
    assert any(r.stretches > 1 for r in found.values())


def test_exact_break_and_straight_line(spark):
    bent = [2 * i for i in range(50)] + [98 + 7 * (i - 49) for i in range(50, 125)]
    data = rows("bent", bent) + rows("straight", range(0, 90, 3)) + rows(None, [1, 5, 9, 13])
    data += rows("one", [4]) + rows("two", [4, 9])
    found = lines(spark, data)
    assert {key[0] for key in found} == {"bent", "straight", None, "one", "two"}
    own = [r for key, r in sorted(found.items(), key=str) if key[0] == "bent"]
    assert {round(r.slope, 6) for r in own} >= {2.0, 7.0}
    assert found["straight", 0].stretches == 1
    assert found["straight", 0].slope == pytest.approx(3)
    assert found[None, 0].slope == pytest.approx(4)
    assert (found["one", 0].slope, found["one", 0].mean_y) == (0, 4)
    assert found["two", 0].slope == pytest.approx(5)


def test_plan_has_no_python_and_size_does_not_grow(spark):
    data = rows("s", np.cumsum(np.ones(2000)))
    prefix = trend.prefix_moments(spark.createDataFrame(data, TYPES), ["site"])
    pieces = trend.stretches(prefix)
    assert pieces.count() <= 26 * 27 / 2
    assert "Python" not in pieces._jdf.queryExecution().toString()
    assert trend.segmentation(trend.stretches(prefix.where("false"))).count() == 0
