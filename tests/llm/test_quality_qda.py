import zlib

import numpy as np
import pytest

from armwatch.llm import quality_qda as op
from armwatch.llm.registry import QUERIES

TYPES = "doc_id long, text string, lang string, score double"


def outside(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{a}{b}rd" for a in "abcdefgh" for b in "abcdefgh"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, rng.integers(20, 90)))
        good = i % 5 > 0
        if not good:
            text = [w.upper() + "!!" for w in text] if i % 2 else [text[0], text[1]] * 30
        rows.append((i, " ".join(text) + ".", "x", 0.5))
        labels.append((i, int(good), 0))
    rows += [(1000, None, None, 0.1), (1001, "", None, 0.1), (None, rows[1][1], None, 0.1),
             (1, rows[1][1], "x", 0.5), (1002, rows[1][1][:-1] + " wabrd" * 200_000, "x", 0.5)]
    labels += [(0, 0, 1), (7, None, 0), (2000, 1, 0)]
    return (spark.createDataFrame(rows, TYPES),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_rows_and_odd_rows(spark):
    df, labels = docs(spark)
    found = op.scored(df, labels).collect()
    assert len(found) == 605
    by = {r.doc_id: r for r in found}
    assert all(by[i].held_out == outside(i) for i in range(600))
    assert all(r.predicted == int(r.score >= .7) and 0 <= r.score <= 1 for r in found)
    held = [i for i in range(600) if outside(i)]
    assert np.mean([by[i].predicted == int(i % 5 > 0) for i in held]) > .98
    assert by[1000].score == by[1001].score and by[None].score == by[1].score
    assert by[1002].score < .5


def test_held_out_labels_are_not_read(spark):
    df, labels = docs(spark)
    turned = spark.createDataFrame(
        [(r.doc_id, 1 - (r.quality or 0) if outside(r.doc_id) else r.quality, r.toxic)
         for r in labels.collect()], labels.schema)
    assert op.fit(op.vectors(df), labels) == op.fit(op.vectors(df.repartition(7)),
                                                    turned.repartition(5))


def test_same_as_plain_moments_and_densities(spark):
    df, labels = docs(spark)
    model = op.fit(op.vectors(df), labels)
    known = {r.doc_id: r.quality for r in labels.collect()
             if r.quality is not None and not outside(r.doc_id)}
    rows = [(known[r.doc_id], op.statistics(r.text)) for r in df.collect() if r.doc_id in known]
    y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]) / op.UNIT
    spread = np.sqrt(np.maximum(x.var(0), 1e-6))
    z, (pooled, ridge) = x / spread, model["strengths"]
    within = sum(np.cov(z[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / len(y)
    density = []
    for k in (0, 1):
        cov = (1 - pooled) * np.cov(z[y == k].T, bias=True) + pooled * within
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        rest = z - z[y == k].mean(0)
        density.append(-((rest @ np.linalg.inv(cov) * rest).sum(1)
                         + np.linalg.slogdet(cov)[1]) / 2)
    want = np.clip(density[1] - density[0], -op.LIMIT, op.LIMIT)
    assert op.difference(x, model["classes"]) == pytest.approx(want, abs=1e-5)


def test_without_labels_or_rows(spark):
    df, labels = docs(spark)
    assert {r.score for r in op.scored(df, labels.where("quality = 1")).collect()} == {.5}
    assert op.scored(df.where("false"), labels).count() == 0
    one_bad = labels.where("quality = 1 OR doc_id = 5")
    assert all(0 <= r.score <= 1 for r in op.scored(df, one_bad).collect())


def test_held_out_quality_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op13_quality_qda"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > .97
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
