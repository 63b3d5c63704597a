import base64
import hashlib
import json
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from armwatch.llm import byte_bpe
from armwatch.llm.registry import QUERIES


@pytest.fixture(scope="module")
def exact():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


ODD = ["", None, " ", "\n\n  a", "a\t\tb  ", "<|endoftext|> x", "👩‍👩‍👧 naïve ß z", "ab" * 30000,
       "1234567 don't I'll  \r\n x", "日本語テキスト", "\x00\x1f\x85", "a", "a"]


def test_same_as_rank_merging(spark, exact):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in byte_bpe.digests(df).collect()}
    for i, text in rows:
        ids = exact.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark, sf_dir, exact):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
                 .collect())
    found = QUERIES["op5_byte_bpe"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = np.array(exact.encode_ordinary(texts[row.doc_id]), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_offsets_and_extra_columns(spark, exact):
    df = spark.createDataFrame([(1, "é👍 a", "x"), (2, None, "y")], "doc_id long, text string, ids0 string")
    rows = byte_bpe.with_offsets(byte_bpe.encode(df)).orderBy("doc_id").collect()
    text, tokens = "é👍 a", exact.encode_ordinary("é👍 a")
    at = 0
    starts, ends = [], []
    for token in tokens:
        size = len(exact.decode_single_token_bytes(token))
        character = [i for i, c in enumerate(text) for _ in c.encode()]
        starts.append(character[at])
        ends.append(character[at + size - 1] + 1)
        at += size
    assert (rows[0].starts, rows[0].ends, rows[0].ids0) == (starts, ends, "x")
    assert (rows[1].starts, rows[1].ends) == ([], [])


def test_unknown_id_is_refused(spark):
    df = spark.createDataFrame([(bytearray(np.array([9_999_999], "<u4").tobytes()),)], "ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(df).collect()


def test_empty_table_and_one_evaluation(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    result = byte_bpe.digests(empty)
    assert result.count() == 0
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("encode_batch(") == 1 and plan.count("decode_batch(") == 1


def test_a_worker_stays_small():
    """Many distinct pieces in one batch: neither pieces nor a store of them may pile up."""
    code = """
import re, sys
import numpy as np
from armwatch.llm import byte_bpe
def held():
    with open("/proc/self/smaps_rollup") as file:
        return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", file.read()))) / 1024
letters = np.random.default_rng(1).integers(97, 123, 8_000_000).astype(np.uint8)
letters[::9] = 32
texts = [letters[i:i + 2000].tobytes().decode() for i in range(0, len(letters), 2000)]
before = held()
own = byte_bpe.encoder(None, None)
for text in texts if isinstance(own.encode(""), bytes) else [texts]:
    own.encode(text)
print(held() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 70


def test_very_long_pieces_and_texts(exact):
    own = byte_bpe.encoder(None, None)
    blanks = own.encode(" " * 1_200_000 + "x")
    assert byte_bpe.decoder(None).decode(blanks) == b" " * 1_200_000 + b"x"
    mixed = " ".join(t for t in ODD if t) + "\n"
    for text in (mixed * 3, "ab" * 40000 + "  é\t" * 9, "a" * (byte_bpe.LONG - 1), " x" * byte_bpe.LONG):
        assert own.encode(text) == np.array(exact.encode_ordinary(text), "<u4").tobytes()


def merged(piece, rank):
    """Adjacent parts of the smallest rank are joined, the first of equals, until none can be."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        least = min(range(len(parts) - 1),
                    key=lambda i: rank.get(parts[i] + parts[i + 1], len(rank)))
        if parts[least] + parts[least + 1] not in rank:
            break
        parts[least:least + 2] = [parts[least] + parts[least + 1]]
    return [rank[p] for p in parts]


def test_same_as_merging_by_hand(exact, sf_dir):
    import pyarrow.parquet as pq
    rank = {exact.decode_single_token_bytes(i): i for i in range(exact.n_vocab)}
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:60]
    own = byte_bpe.encoder(None, None)
    for text in [t or "" for t in texts] + [t for t in ODD if t and len(t) < 1000]:
        want = [i for piece in regex.findall(public_tokenizers.PATTERN, text)
                for i in merged(piece.encode(), rank)]
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want


def test_vocabulary_whose_ids_are_not_ranks(tmp_path):
    with open(byte_bpe.file_of(None), encoding="utf-8") as file:
        content = json.load(file)
    vocab = content["model"]["vocab"]
    content["model"]["vocab"] = {t: 60_000 - i for t, i in vocab.items()}
    content["added_tokens"] = [x | {"id": 60_000 - x["id"]} for x in content["added_tokens"]]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content))
    text = "don't naïve 👩 12 <|endoftext|>"
    ids = np.frombuffer(byte_bpe.Encoder(str(path), None).encode(text), "<u4")
    usual = np.frombuffer(byte_bpe.encoder(None, None).encode(text), "<u4")
    assert (60_000 - ids).tolist() == usual.tolist()
    assert byte_bpe.Decoder(str(path)).decode(ids.tobytes()) == text.encode()
