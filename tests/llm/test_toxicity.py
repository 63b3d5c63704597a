import zlib

import numpy as np

from armwatch.llm import toxicity as op


def outside(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def docs(spark):
    rng = np.random.default_rng(2)
    words = [f"w{a}{b}rd" for a in "abcdefgh" for b in "abcdefgh"]
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, 60))
        toxic = i % 6 == 0
        if toxic:
            for at in rng.integers(0, 60, 4):
                text[at] = str(rng.choice(["grobian", "schurke", "lumpenpack"]))
        rows.append((i, " ".join(text), "x", 0.5))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, 0.1), (1001, "", None, 0.1), (None, "grobian schurke", None, 0.1),
             (1, rows[1][1], "x", 0.5), (1002, "grobian schurke " + "wabrd " * 300_000, "x", 0.5)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_rows_and_odd_rows(spark):
    df, labels = docs(spark)
    found = op.scored(df, labels).collect()
    assert len(found) == 905
    by = {r.doc_id: r for r in found}
    for i in range(900):
        assert by[i].held_out == outside(i)
        assert by[i].predicted == int(i % 6 == 0) == int(by[i].score >= .7)
    assert by[1000].score == by[1001].score < .1 and by[None].score > .7
    assert 0 <= by[1002].score <= 1


def test_held_out_labels_are_not_read(spark):
    df, labels = docs(spark)
    turned = spark.createDataFrame(
        [(r.doc_id, r.quality, 1 - r.toxic if outside(r.doc_id) else r.toxic)
         for r in labels.collect()], labels.schema)
    assert op.fit(df, labels) == op.fit(df, turned)


def test_without_labels(spark):
    df, labels = docs(spark)
    assert {r.score for r in op.scored(df, labels.where("toxic = 0")).collect()} == {.5}
    assert op.scored(df.where("false"), labels).count() == 0


def test_label_model_weighs_repeated_voters_as_one():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < .3
    good = [np.where(y, rng.random(4000) < .8, rng.random(4000) < .05) for _ in range(3)]
    poor = np.where(y, rng.random(4000) < .4, rng.random(4000) < .3)
    votes = np.column_stack([*good, *[poor] * 12])
    posterior = op.label_model(votes, np.where(rng.random(4000) < .1, ~y, y))
    assert ((posterior > .5) == y).mean() > .95
