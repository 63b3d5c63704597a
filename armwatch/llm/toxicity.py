"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are words and parts of words that are much more frequent in toxic than in clean labelled
rows, at one of several rates per word of a text; they are found in a bounded sample of labelled
rows (``SAMPLE`` of each class, the first by a digest of doc_id). Each voter fires or abstains on
a document. The label model holds, for a hidden label, how often each voter fires under either
value of it, estimated by expectation-maximisation over the sample's votes, and the correlations
of voters given the hidden label, by which voters that repeat each other share their weight. A
logistic regression on the counted rates learns the model's posterior labels; a second one, of its
sum alone, takes back what its penalty shrank. It scores every text, whole and of any length.
Labels of rows whose crc32(doc_id as text) mod 3 is 1 are never read.

Null and empty texts get the score of a text without any voter. Rows that repeat score alike.
Without labels of both classes there are no voters, and every score is the prior 0.5.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwatch.session import stored

#: Labelled rows of each class that are fitted on.
SAMPLE = {1: 2000, 0: 5000}
VOTERS = 64
#: Items that the voters are chosen from.
CANDIDATES = 2000
#: Lengths of the parts of words that may become voters.
PARTS = (5, 7)
#: Rates per word at which a voter may fire.
RATES = (0.0, .004, .008, .015, .03)
MARGIN = 12.0
WORDS = regex.compile(r"\p{L}+")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def items_of(text: str) -> tuple[Counter, int]:
    """How often each word (between bars) and part of a word occurs, and the words."""
    words = Counter(WORDS.findall(text.lower()))
    found: Counter = Counter()
    for word, n in words.items():
        found[f"|{word}|"] += n
        for size in PARTS:
            for part in {word[i:i + size] for i in range(len(word) - size + 1)}:
                found[part] += n
    return found, sum(words.values())


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, rate index, toxic, documents) within a partition."""
    seen: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(),
                               batch.column("toxic").to_pylist()):
            found, words = items_of(text or "")
            for item, n in found.items():
                for i, rate in enumerate(RATES):
                    if n < rate * words or i and n < 2:
                        break
                    seen[item, i, toxic] += 1
    if seen:
        keys = list(seen)
        yield pa.record_batch({"item": [k[0] for k in keys], "rate": [k[1] for k in keys],
                               "toxic": [k[2] for k in keys], "n": list(seen.values())})


class Matcher:
    """Counts of the voters' items in a text, by one automaton over the whole text."""

    def __init__(self, items: tuple[str, ...]):
        import ahocorasick

        self.size, self.automaton = len(items), ahocorasick.Automaton()
        for i, item in enumerate(items):
            self.automaton.add_word(item.strip("|"), (i, item))
        if items:
            self.automaton.make_automaton()

    def rates(self, texts: list[str | None]) -> np.ndarray:
        """Rows of counts, with the number of words last."""
        out = np.zeros((len(texts), self.size + 1))
        for row, text in zip(out, texts):
            low = (text or "").lower()
            row[-1] = low.count(" ") + low.count("\n") + 1
            for end, (i, item) in self.automaton.iter(low) if self.size else ():
                start = end - len(item.strip("|")) + 1
                if item[0] != "|" or not (low[start - 1:start].isalpha()
                                          or low[end + 1:end + 2].isalpha()):
                    row[i] += 1
        return out


@lru_cache(maxsize=2)
def matcher(items: tuple[str, ...]) -> Matcher:
    return Matcher(items)


def votes_of(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    n, words = counts[:, :-1], counts[:, -1:]
    return (n >= np.where(rates > 0, 2, 1)) & (n >= rates * words)


def features_of(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Per voter how far its rate is towards the one it fires at, and whether it fires; the
    number of voters that fire; one."""
    n, words = counts[:, :-1], counts[:, -1:]
    near = np.minimum(1, n / np.maximum(np.where(rates > 0, 2, 1), rates * words))
    fires = votes_of(counts, rates)
    return np.hstack([near ** 2 / 2 + fires / 2,
                      np.log1p(fires.sum(1, keepdims=True)), np.ones((len(n), 1))])


def label_model(votes: np.ndarray, start: np.ndarray, steps: int = 60) -> np.ndarray:
    """Posterior of the hidden label of each row. ``start`` holds the rows' known labels: they
    are one more voter, which may err like the others, and the first guess.

    Rates of firing under either label and the weight of each voter, one over the sum of its
    absolute correlations with all voters given the label, are estimated in turn."""
    votes = np.column_stack([votes, start.astype(bool)])
    v, q = votes.astype(float), np.clip(start.astype(float), .02, .98)
    for _ in range(steps):
        rates, rest = [], v.copy()
        for weight in (1 - q, q):
            rate = (weight @ v + .1) / (weight.sum() + 1)
            rates.append(np.clip(rate, 1e-4, 1 - 1e-4))
        rest -= (1 - q)[:, None] * rates[0] + q[:, None] * rates[1]
        spread = np.sqrt((rest ** 2).mean(0)) + 1e-6
        alike = np.abs(rest.T @ rest / len(v) / spread[:, None] / spread)
        np.fill_diagonal(alike, 1)
        share = 1 / np.where(alike > .2, alike, 0).sum(1)
        fire = np.log(rates[1] / rates[0])
        quiet = np.log((1 - rates[1]) / (1 - rates[0]))
        prior = np.clip(q.mean(), .01, .5)
        logit = np.log(prior / (1 - prior)) + (share * np.where(votes, fire, quiet)).sum(1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return new


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = .5, steps: int = 40) -> np.ndarray:
    """Weights for soft labels by Newton steps; the last column is the constant."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def apart(best: list) -> list:
    """The best voters of which no two share four letters in a row."""
    used, kept = set(), []
    for row in best:
        word = row.item.strip("|")
        parts = {word[i:i + 4] for i in range(max(1, len(word) - 3))}
        if not parts & used and len(kept) < VOTERS:
            used |= parts
            kept.append(row)
    return kept


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Items, the rates they fire at, and weights. Labels of held-out rows are not read."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    digest = F.md5(F.col("doc_id").cast("string"))
    parts = [known.where(F.col("toxic") == kind).orderBy(digest, "doc_id").limit(n)
             for kind, n in SAMPLE.items()]
    # at most SAMPLE rows of each class: small enough to broadcast
    chosen = stored(parts[0].unionByName(parts[1]))
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    support = (sample.select("text", "toxic").mapInArrow(
        _support, "item string, rate long, toxic long, n long").groupBy("item", "rate").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")))
    sizes = dict(sample.groupBy("toxic").count().collect())
    empty = {"items": [], "rates": [], "weights": [0.0, 0.0]}
    if len(sizes) < 2:
        return empty
    lift = (F.col("bad") + .5) / sizes[1] / ((F.col("good") + 1) / sizes[0])
    best = (support.where((F.col("bad") >= max(5, .004 * sizes[1])) & (lift >= MARGIN))
            .groupBy("item").agg(F.max_by(F.struct("rate", "bad"), F.log(lift) * F.sqrt("bad"))
                                 .alias("x"), F.max(F.log(lift) * F.sqrt("bad")).alias("score"))
            .orderBy(F.desc("score"), F.desc(F.length("item")), "item")
            .limit(CANDIDATES).collect())
    best = apart(best)
    if not best:
        return empty
    items, rates = tuple(r.item for r in best), np.array([RATES[r.x.rate] for r in best])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matcher(items).rates(batch.column("text").to_pylist())
            yield pa.record_batch({"toxic": batch.column("toxic"),
                                   "counts": pa.array(rows.tolist(), pa.list_(pa.float64()))})

    # a vector of counts for each row of the bounded sample
    rows = sample.select("text", "toxic").mapInArrow(
        count, "toxic int, counts array<double>").orderBy("toxic", "counts").collect()
    counts, toxic = np.array([r.counts for r in rows]), np.array([r.toxic for r in rows])
    posterior = label_model(votes_of(counts, rates), toxic)
    x = features_of(counts, rates)
    weights = logistic(x, posterior)
    slope, constant = logistic(np.column_stack([x @ weights, np.ones(len(x))]), posterior, .1)
    weights *= max(slope, 1.0)
    weights[-1] += constant
    return {"items": list(items), "rates": rates.tolist(), "weights": weights.tolist()}


def score_of(text: Column, model: dict) -> Column:
    """Probability that a text is toxic."""
    held = json.dumps(model)

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        own = json.loads(held)
        counts = matcher(tuple(own["items"])).rates(texts.to_pylist())
        x = features_of(counts, np.array(own["rates"])) @ np.array(own["weights"])
        return pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    # else each expression that reads the score computes it anew
    return scores.asNondeterministic()(text)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = .7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out().alias("held_out"),
                        score_of(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
