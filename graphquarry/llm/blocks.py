"""Texts as blocks of word codes, with a global shuffle of the distinct words.

Texts are cut into words; consecutive texts of a task form a block, and every
word occurrence becomes a code into the block's list of distinct words. So a
text keeps its words' positions in packed form, and what is shuffled by word
holds each word once per block, however common it is. The words of a block are
ordered by hash bucket; one row holds a block's words of one bucket.

    text rows   kind 0: block, row data, packed codes
    word rows   kind 1: block, bucket, packed words, packed counts

The kinds are made in one pass over the texts, to be written to a table, or each
in its own pass, so that nothing needs to be written twice. Two passes must cut
the same input partitions into the same blocks, so the input has to be one that
is read in the same order again, such as a table's files; a block's id holds a
checksum of its words, and a text whose block has no words raises an error, so
an input that changes between the passes is noticed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import small_batches

#: Characters of text after which a block is closed.
BLOCK_CHARS = 8_000_000
SCHEMA = "kind byte, block long, bucket int, doc_id long, flag boolean, n long, data binary, extra binary"
_FIELDS = [("kind", pa.int8()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("flag", pa.bool_()), ("n", pa.int64()), ("data", pa.binary()), ("extra", pa.binary())]

def pack(a: np.ndarray) -> bytes:
    """Unsigned integers, compressed byte plane by byte plane."""
    a = a.astype(np.uint32)
    planes = a.view(np.uint8).reshape(-1, 4)
    width = 1 + (int(a.max()).bit_length() - 1) // 8 if len(a) and a.max() else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, :width].T).tobytes())

def unpack(b: bytes) -> np.ndarray:
    width, raw = b[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8)
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.reshape(-1).view(np.uint32)

def pack_words(words: list[bytes]) -> bytes:
    lens = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(lens).to_bytes(4, "little") + lens + zstandard.ZstdCompressor(level=1).compress(b"".join(words))

def unpack_words(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:4], "little")
    ends = np.cumsum(unpack(b[4 : 4 + n]), dtype=np.int64).tolist()
    raw = zstandard.ZstdDecompressor().decompress(b[4 + n :])
    return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]

def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)], names=[n for n, _ in _FIELDS])

class _Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code

def buckets_for(docs: DataFrame) -> int:
    """Hash buckets of words: more for more input, so that each stays small."""
    return max(1024, 4 * docs.rdd.getNumPartitions())

def encode(docs: DataFrame, cut: Callable[[], Callable[[str], list]], to_bytes: Callable, n_buckets: int, kinds: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``kinds`` ("texts", "words" or "texts words") of rows of ``docs`` (doc_id, flag, text).

    ``cut()`` is called in the worker and gives the function that cuts a text
    into words; ``to_bytes`` turns a word into bytes. A word row's ``extra``
    counts the occurrences in rows whose flag is true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = cut()
        serial = None
        codes, held, chars = _Codes(), [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal serial, codes, held, chars
            words = [to_bytes(w) for w in codes]
            at = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
            order = np.argsort(at, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            counts = np.zeros(len(words), np.int64)
            block = (serial << 32 | zlib.crc32(b"\n".join(words))) & (1 << 63) - 1
            rows = []
            for doc_id, flag, code in held:
                seq = place[code]
                if flag and "words" in kinds:
                    counts += np.bincount(seq, minlength=len(words)) if len(seq) * 8 > len(words) else 0
                    if len(seq) * 8 <= len(words):
                        np.add.at(counts, seq, 1)
                if "texts" in kinds:
                    rows.append((0, block, 0, doc_id, flag, len(seq), pack(seq), None))
                if len(rows) >= 500:
                    yield batch(rows)
                    rows = []
            ordered = [words[i] for i in order]
            cuts = np.searchsorted(at[order], np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)) if "words" in kinds else ():
                lo, hi = cuts[b], cuts[b + 1]
                rows.append((1, block, int(b), None, None, int(hi - lo), pack_words(ordered[lo:hi]), pack(counts[lo:hi])))
            yield batch(rows)
            serial, codes, held, chars = serial + 1, _Codes(), [], 0

        for b in batches:
            if serial is None and b.num_rows:
                serial = b.column("part")[0].as_py() << 8
            for doc_id, flag, text in zip(b.column("doc_id").to_pylist(), b.column("flag").to_pylist(), b.column("text")):
                text = text.as_py() or ""
                if held and chars + len(text) > block_chars:
                    yield from close()
                found = words_of(text)
                held.append((doc_id, bool(flag), np.fromiter(map(codes.__getitem__, found), np.uint32, len(found))))
                chars += len(text) + 64
        if held:
            yield from close()

    # the input's own partition, wherever this pass stands in a stage
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "flag", "text", F.spark_partition_id().alias("part")).mapInArrow(run, SCHEMA)

def streamed(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The named columns' values row by row; packed ones as views, so no row is copied."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(c)) for c in columns]
        for row in zip(*(c if pa.types.is_binary(c.type) else c.to_pylist() for c in cols)):
            yield tuple(x.as_buffer().to_pybytes() if isinstance(x, pa.BinaryScalar) and x.is_valid else None if isinstance(x, pa.BinaryScalar) else x for x in row)

def by_bucket(word_rows: DataFrame) -> DataFrame:
    return word_rows.repartition("bucket").sortWithinPartitions("bucket", "block")

def by_block(text_rows: DataFrame, word_rows: DataFrame) -> DataFrame:
    """Each block's word rows, by bucket, then its texts."""
    rows = word_rows.select(*text_rows.columns).union(text_rows)
    return rows.repartition("block").sortWithinPartitions("block", F.desc("kind"), "bucket")

def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Iterator]]:
    """Stream of (word rows, iterator of text rows) of each block.

    Only a block's word rows are held; its texts stream, and must be read
    before the next block.
    """

    def rows():
        for b in batches:
            yield from zip(*(b.column(i) if n in ("data", "extra") else b.column(i).to_pylist() for i, n in enumerate(b.schema.names)))

    stream = rows()
    nxt = next(stream, None)
    while nxt is not None:
        block, words = nxt[1], []
        while nxt is not None and nxt[1] == block and nxt[0] == 1:
            words.append(nxt)
            nxt = next(stream, None)

        def texts():
            nonlocal nxt
            while nxt is not None and nxt[1] == block:
                if not words and nxt[5]:
                    raise RuntimeError("the input changed between two passes over it; write it to a table first")
                yield nxt
                nxt = next(stream, None)

        own = texts()
        yield words, own
        for _ in own:
            pass
