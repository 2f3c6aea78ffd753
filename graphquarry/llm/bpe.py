"""Byte-level BPE through one global shuffle of the distinct pre-tokens.

Every text is cut by the tokenizer's pattern; positions stay with the text as
packed codes (see ``blocks``), the distinct pre-tokens are shuffled by word,
each is merged once by the given ranks, the ids go back to the blocks, and each
text's ids are put together by position. Decoding joins the token-byte table.

The vocabulary's size bounds what is broadcast: the rank table.

Defined results: a null or empty text has no ids, and decodes to the empty
text; rows sharing an id stay separate rows; a null id stays null; extra
columns are ignored; no special tokens are ever produced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm import blocks as B

SPACE = r"\t-\r \x85\xa0  -     　"
#: Texts of these characters only are cut by ``re``, which is the faster one.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xc0-\\u024f]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def cutter(pattern: str):
    """The function that cuts a text into pre-tokens as ``pattern`` does.

    White space is the Unicode property, as in the tokenizer's own library.
    """
    import regex

    full = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+"))
    plain = None
    if r"\p" in pattern:
        p = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\w{SPACE}]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        p = p.replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")
        plain = re.compile(p) if r"\p" not in p else None

    def cut(text: str) -> list[str]:
        if plain is not None and _PLAIN.search(text) is None:
            return plain.findall(text)
        return full.findall(text)

    return cut


def _merge(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Word rows in, the same rows out with ids: ``extra`` counts, ``data`` holds them."""
    import tiktoken

    core = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    known: dict[bytes, list[int]] = {}  # of this bucket: each word is merged once
    current, rows = None, []
    for block, bucket, packed in B.streamed(batches, "block", "bucket", "data"):
        if bucket != current:
            current, known = bucket, {}
        got = []
        for w in B.unpack_words(packed):
            ids = known.get(w)
            if ids is None:
                ids = known[w] = [ranks[w]] if w in ranks else core._encode_single_piece(w)
            got.append(ids)
        flat = np.fromiter((i for ids in got for i in ids), np.uint32)
        rows.append((1, block, bucket, None, None, len(got), B.pack(flat), B.pack(np.fromiter(map(len, got), np.uint32, len(got)))))
        if len(rows) >= 2000:
            yield B.batch(rows)
            rows = []
    yield B.batch(rows)


def _id_table(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all the block's words, where each word's begin, and how many."""
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    flat = np.concatenate([B.unpack(r[6].as_buffer().to_pybytes()) for r in words])
    many = np.concatenate([B.unpack(r[7].as_buffer().to_pybytes()) for r in words]).astype(np.int64)
    return flat, np.cumsum(many) - many, many


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for words, texts in B.blocks(batches):
        flat, start, many = _id_table(words)
        for r in texts:
            seq = B.unpack(r[6].as_buffer().to_pybytes())
            n = many[seq]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            yield r[3], flat[np.repeat(start[seq] - ends + n, n) + np.arange(total)]


def _utf8(word: str) -> bytes:
    return word.encode("utf-8", "surrogatepass")


def _encoded(docs: DataFrame, ranks, pattern: str) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("flag"), "text")
    words, texts = (B.encode(d, lambda: cutter(pattern), _utf8, B.buckets_for(d), kinds) for kinds in ("words", "texts"))
    ids = B.by_bucket(words).mapInArrow(lambda x: _merge(x, ranks.value), B.SCHEMA)
    return B.by_block(texts, ids)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for doc_id, ids in _put_together(batches):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return _encoded(docs, shipped, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: bytes by id."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and the bytes that ``ids`` stand for."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table = token_bytes(shipped.value)
        for b in batches:
            data = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        table = token_bytes(shipped.value)
        rows = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for doc_id, ids in _put_together(batches):
            text = b"".join(map(table.__getitem__, ids.tolist()))
            rows.append((doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
            if len(rows) >= 2000:
                yield out()
                rows = []
        if rows:
            yield out()

    return _encoded(docs, shipped, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
