"""Quality by regularised quadratic discriminant analysis of document statistics.

A text becomes a vector of transformed statistics (``statistics``): logarithms of counts and
lengths, square roots of shares. They are held as whole multiples of 1/1024, so that sums over
any number of rows are exact and do not depend on the order of rows.

Every labelled row outside the held-out part is fitted on: Spark adds up the moments of each class
in ``FOLDS`` folds, and the driver reads those few sums. A class's covariance is shrunk towards
the pooled one and both towards a multiple of the identity; the strengths are those of ``GRID``
with the smallest log loss over rows of the folds left out, counted in bins of the log-density
difference. A logistic curve over the same bins turns the difference into a probability. Scoring
takes Mahalanobis distances from each class by Cholesky factors cached per worker. Labels of rows
whose crc32(doc_id as text) mod 4 is 2 are never read.

Nulls and empty texts have the statistics of a text without words and are scored like any other.
A text is read whole, whatever its length. Rows that repeat score alike; of several labels of one
doc_id the largest counts. A null doc_id has no label. Columns beside doc_id, text and quality
are not read. Without labels of both classes every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwatch.session import stored

UNIT = 1024
FOLDS = 4
#: Shares of the pooled covariance and of the identity in a class's covariance.
GRID = [(pooled, ridge) for pooled in (0.0, .1, .4, .8) for ridge in (.001, .01, .1)]
#: Width of the bins of log-density differences, and the largest difference told apart.
STEP, LIMIT = .25, 60.0
_UPPER, _LETTER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}")
_DIGIT, _ENDING = regex.compile(r"\p{Nd}"), regex.compile(r"[.!?]\s")
NAMES = ("words", "word_length", "longest_word", "letters", "upper", "digits", "symbols",
         "distinct", "top_word", "repeats", "lines", "line_copies", "sentence", "entropy")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def statistics(text: str | None) -> list[int]:
    """The statistics of ``NAMES`` in units of 1/1024."""
    text = text or ""
    words, size = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    letters = len(_LETTER.findall(text))
    digits = len(_DIGIT.findall(text))
    spaces = sum(map(text.count, " \n\t\r"))
    entropy = math.log(n) - sum(c * math.log(c) for c in counts.values() if c > 1) / n
    values = (
        math.log1p(len(words)),
        math.log1p(sum(map(len, words)) / n),
        math.log1p(max(map(len, words), default=0)),
        math.sqrt(letters / size),
        math.sqrt(len(_UPPER.findall(text)) / max(letters, 1)),
        math.sqrt(digits / size),
        math.sqrt(max(0, len(text) - letters - digits - spaces) / size),
        math.log1p(len(counts)) / math.log1p(n),
        math.sqrt(max(counts.values(), default=0) / n),
        math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n),
        math.log1p(n / max(len(lines), 1)),
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.log1p(n / (1 + len(_ENDING.findall(text)))),
        entropy / math.log1p(n))
    return [round(v * UNIT) for v in values]


@F.arrow_udf(T.ArrayType(T.LongType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.int64()))


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the texts are read once, here; what follows reads the vectors only."""
    return stored(docs.select("doc_id", statistics_of(F.col("text")).alias("x")))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, quality, x) of every labelled row of vectors outside the held-out part."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("quality"))
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int")
    return rows.join(known, "doc_id").select(fold.alias("fold"), "quality", "x")


def moments(rows: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """Number, sum and sum of products of the vectors of each fold and class, as whole numbers."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = rows.groupBy("fold", "quality").agg(
        F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(d)),
        *(F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs))
    out = {}
    for r in sums.collect():    # two rows a fold
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"] / UNIT ** 2
        out[r.fold, r.quality] = (
            r.n, np.array([r[f"s{i}"] for i in range(d)]) / UNIT, products)
    return out


def added(parts: list) -> tuple[float, np.ndarray, np.ndarray]:
    d = len(NAMES)
    return (sum(p[0] for p in parts), sum((p[1] for p in parts), np.zeros(d)),
            sum((p[2] for p in parts), np.zeros((d, d))))


def discriminant(bad: tuple, good: tuple, pooled: float, ridge: float) -> list[dict] | None:
    """Per class the mean, the lower Cholesky factor of the shrunk covariance and its log
    determinant, in units of the spread over both classes; None when a class has no rows."""
    if not (bad[0] and good[0]):
        return None
    n, total, products = added([bad, good])
    spread = np.sqrt(np.maximum(np.diag(products) / n - (total / n) ** 2, 1e-6))
    scatter, means = [], []
    for count, s, p in (bad, good):
        means.append(s / count / spread)
        scatter.append((p - np.outer(s, s) / count) / np.outer(spread, spread))
    both, out = sum(scatter) / n, []
    for (count, _, _), mean, own in zip((bad, good), means, scatter):
        cov = (1 - pooled) * own / count + pooled * both
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        out.append({"mean": mean.tolist(), "factor": factor.tolist(), "spread": spread.tolist(),
                    "log_det": 2 * float(np.log(np.diag(factor)).sum())})
    return out


def difference(x: np.ndarray, model: list[dict]) -> np.ndarray:
    """Log density of good minus that of bad rows, within ``LIMIT``."""
    density = []
    for own in model:
        z = np.linalg.solve(own["factor"], (x / own["spread"] - own["mean"]).T)
        density.append(-((z ** 2).sum(0) + own["log_det"]) / 2)
    return np.clip(density[1] - density[0], -LIMIT, LIMIT)


@lru_cache(maxsize=4)
def loaded(held: str) -> list:
    """Models with their Cholesky factors as arrays, parsed once per worker."""
    return [None if m is None else [{k: np.array(v) for k, v in own.items()} for own in m]
            for m in json.loads(held)]


def curve(bins: list[tuple[float, int, int]], steps: int = 50) -> tuple[float, float, float]:
    """Slope, constant and mean log loss of a logistic curve over (difference, label, rows)."""
    d, y, n = (np.array(c, float) for c in zip(*bins))
    x, w = np.column_stack([d / 10, np.ones_like(d)]), np.zeros(2)
    ridge = np.array([1e-2, 1e-6])    # keeps the slope finite when the classes don't mix
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -(n * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / n.sum()
    return max(w[0], 0.0) / 10, float(w[1]), float(loss)


def fit(rows: DataFrame, labels: DataFrame) -> dict | None:
    """The discriminant and its curve from ``vectors``, or None without labels of both classes."""
    rows = stored(labelled(rows, labels))
    sums = moments(rows)
    folds = sorted({fold for fold, _ in sums})

    def model(chosen: list[int], strengths: tuple[float, float]) -> list[dict] | None:
        sides = [added([sums[f, q] for f in chosen if (f, q) in sums]) for q in (0, 1)]
        return discriminant(*sides, *strengths)

    if model(folds, GRID[0]) is None:
        return None
    # the model for a row of fold f and the strengths g is at place f * len(GRID) + g
    held = json.dumps([model([f for f in folds if f != fold], g)
                       for fold in range(FOLDS) for g in GRID])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def left_out(fold: pa.Array, x: pa.Array) -> pa.Array:
        models, at = loaded(held), fold.to_numpy()
        vectors = np.array(x.to_pylist(), float).reshape(-1, len(NAMES)) / UNIT
        out = np.zeros((len(at), len(GRID)))
        for f in np.unique(at):
            for g in range(len(GRID)):
                own = models[f * len(GRID) + g]
                if own is not None:
                    out[at == f, g] = difference(vectors[at == f], own)
        return pa.array((np.round(out / STEP) * STEP).tolist(), pa.list_(pa.float64()))

    # at most 2 x 2 x LIMIT / STEP + 1 bins of each pair of strengths
    bins = (rows.select("quality", F.posexplode(left_out("fold", "x")).alias("g", "d"))
            .groupBy("g", "d", "quality").count().orderBy("g", "d", "quality").collect())
    curves = [curve([(r.d, r.quality, r["count"]) for r in bins if r.g == g])
              for g in range(len(GRID))]
    best = min(range(len(GRID)), key=lambda g: (round(curves[g][2], 9), g))
    return {"classes": model(folds, GRID[best]), "strengths": GRID[best],
            "slope": curves[best][0], "constant": curves[best][1]}


def score_of(x: Column, model: dict | None) -> Column:
    """Probability that a text with these statistics is of quality 1."""
    if model is None:
        return F.lit(.5)
    held = json.dumps([model["classes"]])
    slope, constant = model["slope"], model["constant"]

    @F.arrow_udf(T.DoubleType())
    def scores(rows: pa.Array) -> pa.Array:
        own = np.array(rows.to_pylist(), float).reshape(-1, len(NAMES)) / UNIT
        logit = difference(own, loaded(held)[0]) * slope + constant
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    # else each expression that reads the score computes it anew
    return scores.asNondeterministic()(x)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = .7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = vectors(docs)
    model = fit(rows, labels)
    return (rows.select("doc_id", held_out().alias("held_out"),
                        score_of(F.col("x"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
