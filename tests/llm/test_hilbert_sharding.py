import itertools
import zlib
from collections import Counter, defaultdict

from armwatch.llm import hilbert_sharding as op


def test_neighbours_on_the_curve_are_neighbours_in_space(spark):
    for bits, n in ((3, 2), (2, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        names = [f"a{i}" for i in range(n)]
        df = spark.createDataFrame(cells, ", ".join(f"{x} int" for x in names))
        path = op.with_curve(df, names, "place", bits).orderBy("place").collect()
        assert [r.place for r in path] == list(range(len(cells)))
        for a, b in itertools.pairwise(path):
            assert sum(abs(a[x] - b[x]) for x in names) == 1


def check(rows, found, shards=8, near=.1):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want
    slots, sizes, where = defaultdict(list), Counter(), defaultdict(Counter)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        where[r.text_crc32, r.size][r.shard] += r.size
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    part = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - part) <= near * part for s in range(shards))
    for shares in where.values():
        assert len(shares) == 1 or sum(shares.values()) > part / 20


def test_hot_group_and_hot_cell(spark):
    rows = [(i, f"text {i} " * (1 + i % 40)) for i in range(3000)]
    rows += [(10_000 + i, "the same text " * 9) for i in range(6000)]
    rows += [(20_000 + i, "twice") for i in range(2)] + [(None, None), (7, ""), (7, "")]
    data = [(i, t, None if (i or 0) % 50 == 0 else f"s{(i or 0) % 7}", "en", 1) for i, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, curve int")
    found = op.sharded(df).collect()
    check(rows, found)
    assert sorted(map(str, op.sharded(df.repartition(5)).collect())) == sorted(map(str, found))


def test_few_rows(spark, tmp_path):
    schema = "doc_id long, text string, source string, lang string"
    assert op.sharded(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a", None, None), (2, "a", "s", "en")], schema)
    assert [r.slot for r in op.sharded(df).collect()] and op.sharded(df).count() == 2
    op.write(df, f"{tmp_path}/out")
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_whole_table(spark, sf_dir):
    from armwatch.llm.registry import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", "text").collect()]
    check(rows, QUERIES["op10_hilbert_sharding"](spark, sf_dir).collect(), near=.5)


def test_every_row_is_written_once(spark, tmp_path):
    rows = [(1, "a", "s", "en", 5)] * 3 + [(None, "b", None, None, 6), (None, None, "s", "en", 7),
                                           (2, "", "t", "de", 8), (3, "long " * 100_000, "s", "en", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, "
                                     "shard int")
    op.write(df, f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert set(found.columns) == {*df.columns, "_shard"}
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, found.select(df.columns).collect()), key=key) == sorted(rows, key=key)
    own = {(r.doc_id, r.size): r.shard for r in op.sharded(df).collect()}
    assert len(own) == 5 and set(own.values()) <= set(range(8))
