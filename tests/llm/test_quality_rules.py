import math
import os
import re

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from armwatch.llm import quality_rules as q
from armwatch.llm.registry import QUERIES, SQL


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(hit))


ODD = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "é# ** |\n\né#\x85",
       "l one\nl one\n \nl one", "a b c d e f\n" * 3, "w " * 4000 + "a b c d e", "Ünï cödé a"]


def test_counts_and_odd_rows(spark):
    rows = [(i, t, None if i % 2 else "en", 3) for i, t in enumerate(ODD)] + [(None, "a", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int")
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in q.judged(df, labels).collect()}
    assert len(found) == len(rows)
    for i, text in enumerate(ODD):
        want = plain(text)
        assert tuple(found[i])[1:6] == want, text
        assert found[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert q.judged(df.where("false"), labels.where("false")).count() == 0
    kept = q.without_poor(df, labels)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        i for i in range(len(ODD)) if not found[i].base_failed)


def test_tails_bound_the_exact_probability(spark):
    cases = [(0, 1), (0, 500), (3, 900), (40, 9000), (2500, 700_000), (30, 1000)]
    df = spark.createDataFrame(cases, "k long, n long")
    p = .004
    for (k, n), row in zip(cases, df.select(q.binomial_tail(F.col("k"), F.col("n"), p)
                                            .alias("t")).collect()):
        exact = math.fsum(math.exp(
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        want = 1.0 if k >= n * p else exact
        assert row.t == pytest.approx(want, rel=1e-7)


def test_certified_rules_reject_few_good_and_most_poor(spark, tmp_path):
    """A stratum with enough labels gets cutoffs, one without gets none; same as SQL."""
    docs, labels = [], []
    for i in range(4000):
        poor = i % 8 == 0
        lang = "en" if i < 3600 else None
        words = [f"w{i}x{k}" + ("###" if poor else "") for k in range(12)]
        docs.append((i, " ".join(words), lang))
        labels.append((i, int(not poor), 0))
    folder = str(tmp_path)
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string"),
                               ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(
            os.path.join(folder, f"{name}.parquet"))
    found = {r.doc_id: r.kept for r in QUERIES["op4_quality_rules"](spark, folder).collect()}
    assert all(found[i] == (i % 8 != 0 or i >= 3600) for i in found)
    assert compare(spark, duck(folder), "op4", QUERIES["op4_quality_rules"],
                   SQL["op4_quality_rules"], folder) is None
