"""Byte-level BPE: texts to token ids with character offsets, and back to bytes.

``tiktoken`` cuts each text by the vocabulary's pattern and merges the bytes of a piece by rank;
a long text is cut here, piece by piece. A worker holds the ids of one text at a time and no pieces.
A token stands for bytes, written in the vocabulary file with one printable character per byte;
that table is reversed, so pieces of a character that two tokens share are put together again
before the bytes become text.

Ids are held as little-endian unsigned 32-bit integers in a binary column.

Nulls and empty texts have no tokens. The white space, ties and copies of a text are kept as they
are: each row is encoded by itself, whatever its length. ``<|endoftext|>`` in a text is ordinary
text.
"""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters from which on a text is cut here: tiktoken's own cutting ends the process on runs of
#: about a million blanks.
LONG = 1 << 16


def byte_of_character() -> dict[str, int]:
    """The library's characters for bytes: printable bytes stand for themselves, the others
    take the characters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def file_of(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.json")


def content_of(path: str | None) -> tuple[dict, dict[str, bytes]]:
    """A vocabulary file, and the bytes of its tokens without the special ones."""
    with open(file_of(path), encoding="utf-8") as file:
        content = json.load(file)
    table, special = byte_of_character(), {x["content"] for x in content["added_tokens"]}
    return content, {token: bytes(map(table.__getitem__, token))
                     for token in content["model"]["vocab"] if token not in special}


class Encoder:
    """One vocabulary file, loaded once per worker."""

    def __init__(self, path: str | None, pattern: str | None):
        import public_tokenizers
        import regex
        import tiktoken

        content, data = content_of(path)
        vocab, merges = content["model"]["vocab"], content["model"]["merges"]
        tokens = [t for t in vocab if len(data.get(t, b"")) == 1]
        if len(tokens) < 256:
            raise ValueError("the vocabulary lacks tokens of single bytes")
        tokens += ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        tokens = list(dict.fromkeys(tokens))
        self.id_of_rank = np.array([vocab[t] for t in tokens], "<u4")
        pattern = pattern or public_tokenizers.PATTERN
        self.cut = regex.compile(pattern).finditer
        self.library = tiktoken.Encoding(
            "vocabulary", pat_str=pattern, special_tokens={},
            mergeable_ranks={data[t]: rank for rank, t in enumerate(tokens)})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) < LONG:
            ranks = self.library.encode_ordinary(text)
        else:
            ranks = array("I")
            for piece in self.cut(text):
                ranks.extend(self.library._encode_single_piece(piece[0]))
        return self.id_of_rank[ranks].tobytes()


class Decoder:
    """The bytes of each id."""

    def __init__(self, path: str | None):
        content, data = content_of(path)
        tokens = content["model"]["vocab"]
        special = {x["id"]: x["content"].encode() for x in content["added_tokens"]}
        self.bytes_of: list[bytes | None] = [None] * (max([*tokens.values(), *special]) + 1)
        for token, found in data.items():
            self.bytes_of[tokens[token]] = found
        for i, found in special.items():
            self.bytes_of[i] = found
        self.length = np.array([len(b or b"") for b in self.bytes_of])

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        try:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except (IndexError, TypeError) as error:
            raise ValueError("an id is not in the vocabulary") from error

    def offsets(self, ids: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the first character it holds a byte of, and the one after the last."""
        tokens = np.frombuffer(ids or b"", "<u4")
        data = np.frombuffer(self.decode(ids), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        after = np.cumsum(self.length[tokens])
        return (character[after - self.length[tokens]].astype("<i4"),
                (character[after - 1] + 1).astype("<i4"))


@functools.lru_cache(maxsize=2)
def encoder(path: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, pattern)


@functools.lru_cache(maxsize=2)
def decoder(path: str | None) -> Decoder:
    return Decoder(path)


def encoded(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Token ids of a text; ``path`` names a byte-level vocabulary of the tokenizers library."""
    @F.arrow_udf(T.BinaryType())
    def encode_batch(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        return pa.array((own.encode(text.as_py()) for text in texts), pa.binary())

    # else the optimizer repeats the encoding within every expression that reads the ids
    return encode_batch.asNondeterministic()(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The bytes that token ids stand for."""
    @F.arrow_udf(T.BinaryType())
    def decode_batch(rows: pa.Array) -> pa.Array:
        return pa.array(map(decoder(path).decode, rows.to_pylist()), pa.binary())

    return decode_batch(ids)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """Add the token ids of a text column."""
    return df.withColumn(ids, encoded(F.col(text), path, pattern))


def decode(df: DataFrame, ids: str = "ids", data: str = "decoded",
           path: str | None = None) -> DataFrame:
    """Add the bytes of an id column; they are the text's UTF-8 bytes, also where a token ends
    within a character. ``F.col(data).cast('string')`` is the text."""
    return df.withColumn(data, decoded(F.col(ids), path))


def with_offsets(df: DataFrame, ids: str = "ids", starts: str = "starts", ends: str = "ends",
                 path: str | None = None) -> DataFrame:
    """Add the character offsets of each token, end exclusive; tokens that share a character
    both hold it."""
    @F.arrow_udf("struct<s: array<int>, e: array<int>>")
    def offset_batch(rows: pa.Array) -> pa.Array:
        found = map(decoder(path).offsets, rows.to_pylist())
        return pa.array([{"s": s, "e": e} for s, e in found],
                        pa.struct({"s": pa.list_(pa.int32()), "e": pa.list_(pa.int32())}))

    both = df.withColumn("_offsets", offset_batch(F.col(ids)))
    return (both.withColumns({starts: F.col("_offsets.s"), ends: F.col("_offsets.e")})
            .drop("_offsets"))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document the number of tokens and digests of ids and decoded bytes."""
    coded = decode(encode(docs.select("doc_id", "text"), path=path, pattern=pattern), path=path)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
