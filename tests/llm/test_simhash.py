import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from armwatch.llm import simhash
from armwatch.llm.graph import components
from armwatch.llm.registry import QUERIES


def plain_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = ([" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
             if len(words) >= k else [" ".join(words)])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, fps, distance):
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [least.get(top(i)) for i in range(len(rows))]


def same_as_plain(found, rows):
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    want = sorted(zip([str(d) for d, _ in rows], [f"{f:016x}" for f in fps],
                      [str(c) for c in plain_groups(rows, fps, 4)]))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet")
            .select("doc_id", "text").collect()]
    same_as_plain(QUERIES["op3_simhash_near_dedup"](spark, sf_dir).collect(), rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None), (4, ""), (3, " \t"), (2, "One two"), (9, "one  TWO"), (9, "one two"),
            (None, "one two"), (None, "alone here"), (7, long), (8, long + " end"),
            (10, "Ä ä \x85 x y"), (11, "a b c d"), (12, "a b c d e")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows],
                               "doc_id long, text string, fp int, component string")
    same_as_plain(simhash.groups(df).collect(), rows)
    empty = df.where("false")
    assert simhash.groups(empty).count() == 0
    assert simhash.without_near_duplicates(empty, 4, 4).count() == 0
    kept = simhash.without_near_duplicates(df, 4, 4)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["3", "2", "None", "None", "7", "10", "11"]
        + (["12"] if (plain_fingerprint("a b c d", 4) ^ plain_fingerprint("a b c d e", 4)).bit_count() > 4
           else []))


def test_words_are_cut_alike_in_blocks():
    data = b" ab  cd\tef\n" * 50 + b"long" * 100
    for size in (1, 3, 7, 64, 10_000):
        assert [w for block in simhash.word_blocks(data, size) for w in block] == data.split()


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_reach_the_same_as_all_pairs(spark, tile):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))
              for c in centres for _ in range(80)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.fingerprint_links(df, 4, 6, tile)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    found = {r.node: r.component for r in components(links).collect()}
    rows = list(zip(signed, signed))
    want = plain_groups(rows, [v & (1 << 64) - 1 for v in signed], 4)
    assert [found.get(v, v) for v in signed] == want


def test_pigeonhole_covers_every_pair_of_close_fingerprints():
    rng = np.random.default_rng(0)
    masks = simhash.block_masks(6, 4)
    for _ in range(300):
        difference = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & difference == 0 for m in masks)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    found = dict(components(spark.createDataFrame(path, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 200 for i in range(200, 260)}}
