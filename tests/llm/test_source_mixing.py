from collections import defaultdict

import pytest

from armwatch.llm import source_mixing as op


def test_targets_share_the_excess_by_weight(spark):
    sizes = [("a", 10), ("b", 500), ("c", 40), (None, 100), ("d", 0)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    found = {r.source: r.target for r in op.targets(df).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(order)}
    size, want, left, open_ = dict(sizes), {}, 1.5 * 650, set(weights)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * size[s]}
        if not full:
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    assert found == pytest.approx(want)


def docs(spark):
    rows = [(i, " ".join(["word"] * (i % 17)), f"s{i % 5 if i % 3 else 0}", 1) for i in range(900)]
    rows += [(None, "no id here", "s1", 1), (5000, None, None, 1), (5001, "", None, 1),
             (5002, "###### a", None, 1), (7, "word " * 7, "s2", 1), (6000, "long " * 900, "s9", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets_are_met(spark):
    df = docs(spark)
    found = op.taken(df).collect()
    assert len(found) == df.count()
    assert sorted(map(str, op.taken(df.repartition(3)).collect())) == sorted(map(str, found))
    by_source = defaultdict(list)
    sources = {(r.doc_id, len((r.text or "").split())): r.source for r in df.collect()}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        by_source[sources[r.doc_id, r.size]].append(r)
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
        assert sum(r.size for r in rows) == rows[0].source_size
    copies = op.repeated(df)
    assert copies.columns == df.columns
    assert copies.where("doc_id IS NOT NULL AND doc_id <> 7").count() == sum(
        r.taken // r.size for r in found if r.size and r.doc_id is not None and r.doc_id != 7) + sum(
        1 for r in copies.collect() if r.doc_id in (5000, 5001) or r.text == "" and r.doc_id != None)


def test_empty_table(spark):
    assert op.taken(docs(spark).where("false")).count() == 0
    assert op.repeated(docs(spark).where("false")).count() == 0


def test_better_documents_come_first(spark):
    rows = [(i, "word " * 5 + ("### " * 5 if i % 2 else "more " * 5), "a") for i in range(4000)]
    df = spark.createDataFrame(rows + [(9999, "w " * 400_000, "b")],
                               "doc_id long, text string, source string")
    found = op.mix(df).where("source = 'a'").collect()
    assert {r.times for r in found} <= {0, 1, 2}
    small = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = [0, 0]
    for r in op.mix(small).collect():
        by[r.doc_id % 2] += r.times == 2
    assert by[0] > 1.2 * by[1]


def test_rows_that_repeat_are_told_apart(spark):
    rows = [(i, f"w{i} " * 5, "a") for i in range(200)]
    rows += [(None, "same same same", "b")] * 1000 + [(7, "one two three", "c")] * 1000
    rows += [(8, f"other text {i}", "d") for i in range(700)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "doc_id long, text string, source string, epochs int")
    found = op.mix(df)
    assert found.columns == [*df.columns, "source_size", "target", "times"]
    by_source = defaultdict(list)
    for r in found.collect():
        by_source[r.source].append(r)
    assert sorted(r.epochs for rs in by_source.values() for r in rs) == list(range(len(rows)))
    for own in by_source.values():
        size = len(own[0].text.split())
        assert abs(sum(r.times * size for r in own) - own[0].target) <= size
    assert sum(r.taken for r in op.taken(df).collect()) == sum(
        r.times * len(r.text.split()) for own in by_source.values() for r in own)
