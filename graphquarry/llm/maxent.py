"""Hashed maximum-entropy language model with a class-factored softmax.

Every word has a cell: a class, which is a hash of its last two bytes, and a
slot in the class. The most frequent words of a class have a slot each; all
other words, seen or not, share the class's other slots by a hash of their last
three bytes, and have within a slot their share of its counts, plus one, with
one place for a word that training has not seen. A token's probability is

    P(class | context) * P(slot | class, context) * P(word | slot)

so each context's probabilities over the known words, and one unknown word for
each shared slot, sum to 1.

Features of the class are the cells of the last word, of the word before it
alone and of the one before that (skips), and the hashed pair of the last two;
of the slot, with the class itself, the last word's cell and the classes of the
last two words, all hashed. Sizes follow the corpus: with V distinct words and
N tokens there are about V^(2/9) classes of twice as many slots and 16 N^(1/3)
rows of pairs, until the weights, which are broadcast, take ``WEIGHT_BYTES``.

Training is by distributed gradient updates: each part of the training texts
sums what the features were seen with and what the shared weights expect; the
sums are added up row by row, and a weight moves along its gradient by the step
of iterative scaling, log(seen / expected) over the number of features, which
no fixed rate has to be chosen for. The first update takes all training texts,
whose expectation under the bare class and slot shares needs no pass; then each
of ``ROUNDS`` takes its share of the texts, chosen by a hash of the id, so every
text is in one, and updates one of the softmaxes, by turns. Only sums are exchanged, so the scores are the same, but for
rounding, however the input is partitioned.

Counts come from one global shuffle of distinct words (see ``blocks``).

Defined results: a null or empty text is one token, the end; texts of any
length are scored whole; rows with a null id are training texts that are
scored too; rows sharing an id, repeated ones too, stay separate rows; equal
texts score equally; of words as frequent the first by bytes has the slot;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm import blocks as B
from graphquarry.llm.common import forget, stage_table

END = b"\n"  # no word holds white space
#: Bound of what is broadcast; sizes stop to follow the corpus there.
WEIGHT_BYTES = 256 << 20
ROUNDS = 2
#: Tokens that a step of numpy works on, so that its arrays stay in the cache.
CHUNK = 2048
#: Tokens whose expectations are added up together.
SUMMED = 4 * CHUNK
#: A part's tokens are featured together in pieces of about this many.
PIECE = 200_000
#: How many sightings the prior share weighs in an update.
PRIOR = 3.0
SEGMENT = 256
HELD_OUT_MODULUS, HELD_OUT = 7, 2


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MODULUS == HELD_OUT, F.lit(False))


def _cut():
    return lambda text: [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _same(word: bytes) -> bytes:
    return word


# --- lexicon -----------------------------------------------------------------


class Layout:
    """How many classes, slots and feature rows there are, and where a word goes."""

    def __init__(self, distinct: int, total: int):
        self.classes = max(8, round(max(1, distinct) ** (2 / 9)))
        self.pairs = 16 * max(1, round(max(1, total) ** (1 / 3)))
        while self.classes > 8 and self.weight_bytes() > WEIGHT_BYTES:
            self.classes -= 1
        while self.pairs > 16 and self.weight_bytes() > WEIGHT_BYTES:
            self.pairs //= 2
        self.slots = 2 * self.classes
        self.own = self.classes  # slots of a class that hold one word each; the rest are shared
        self.cells = self.classes * self.slots
        # feature rows; index ``cells`` stands for what precedes a text
        self.class_rows = 3 * (self.cells + 1) + self.pairs
        self.slot_rows = 2 * self.pairs + 2 * (self.classes + 1) * self.classes

    def weight_bytes(self) -> int:
        k = self.classes
        return 4 * (k * (3 * (2 * k * k + 1) + self.pairs) + 2 * k * (2 * self.pairs + 2 * k * (k + 1)))

    def class_of(self, word: bytes) -> int:
        return zlib.crc32(word[-2:]) % self.classes

    def shared_cell(self, word: bytes) -> int:
        return self.class_of(word) * self.slots + self.own + zlib.crc32(word[-3:], 7) % (self.slots - self.own)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket: its words (training counts over 0) and their counts."""

    def out():
        words = list(total)
        return B.batch([(2, 0, current, None, None, len(words), B.pack_words(words), np.array([total[w] for w in words], np.int64).tobytes())])

    total: dict[bytes, int] = {}
    current = None
    for bucket, words, counts in B.streamed(batches, "bucket", "data", "extra"):
        if bucket != current:
            if current is not None:
                yield out()
            current, total = bucket, {}
        for w, c in zip(B.unpack_words(words), B.unpack(counts).tolist()):
            if c:
                total[w] = total.get(w, 0) + c
    if current is not None:
        yield out()


def _frequent(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for data, extra in B.streamed(batches, "data", "extra"):
        counts = np.frombuffer(extra, np.int64)
        at = np.flatnonzero(counts >= least)
        if len(at):
            words = B.unpack_words(data)
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.binary()), pa.array(counts[at])], names=["word", "n"])


def own_cells(frequent: list[tuple[bytes, int]], layout: Layout) -> dict[bytes, int]:
    """Cells of the words that have one to themselves."""
    out: dict[bytes, int] = {}
    taken = [0] * layout.classes
    for word, _ in sorted(frequent, key=lambda x: (-x[1], x[0])):
        c = layout.class_of(word)
        if taken[c] < layout.own:
            out[word] = c * layout.slots + taken[c]
            taken[c] += 1
    return out


def _cell_sums(batches: Iterator[pa.RecordBatch], own: dict[bytes, int], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Tokens and distinct words of each cell."""
    tokens, distinct = np.zeros(layout.cells, np.int64), np.zeros(layout.cells, np.int64)
    for data, extra in B.streamed(batches, "data", "extra"):
        for w, c in zip(B.unpack_words(data), np.frombuffer(extra, np.int64).tolist()):
            at = own.get(w)
            at = layout.shared_cell(w) if at is None else at
            tokens[at] += c
            distinct[at] += 1
    at = np.flatnonzero(distinct)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tokens[at]), pa.array(distinct[at])], names=["cell", "tokens", "words"])


def _looked_up(batches: Iterator[pa.RecordBatch], own: dict[bytes, int], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Word rows with counts (``data``) and cells (``extra``); a lexicon row leads each bucket."""
    known: dict[bytes, tuple[int, int]] = {}
    current, rows = None, []

    def place(w: bytes, c: int) -> tuple[int, int]:
        at = own.get(w)
        got = known[w] = (c, layout.shared_cell(w) if at is None else at)
        return got

    for kind, block, bucket, data, extra in B.streamed(batches, "kind", "block", "bucket", "data", "extra"):
        if bucket != current:
            current, known = bucket, {}
        words = B.unpack_words(data)
        if kind == 2:
            for w, c in zip(words, np.frombuffer(extra, np.int64).tolist()):
                place(w, c)
            continue
        got = [known.get(w) or place(w, 0) for w in words]
        counts, cells = np.fromiter((x[0] for x in got), np.int64, len(got)), np.fromiter((x[1] for x in got), np.uint32, len(got))
        rows.append((1, block, bucket, None, None, len(words), counts.astype("<i8").tobytes(), B.pack(cells)))
        if len(rows) >= 2000:
            yield B.batch(rows)
            rows = []
    yield B.batch(rows)


_TEXT_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, seq binary"


def _coded(batches: Iterator[pa.RecordBatch], total: int, distinct: int, cell_total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts with their base score, the score of the words within their cells, and the cells."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inside", "seq"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    for words, texts in B.blocks(batches):
        counts = np.frombuffer(b"".join(r[6].as_py() for r in words), "<i8") if words else np.empty(0, np.int64)
        cells = np.concatenate([B.unpack(r[7].as_py()) for r in words]) if words else np.empty(0, np.uint32)
        base = np.log10((counts + 1) / (total + distinct + 1))
        share = cell_total[cells]
        inside = np.where(share > 0, np.log10((counts + 1) / np.maximum(share, 1)), 0.0)
        rows = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for r in texts:
            seq = B.unpack(r[6].as_py())
            rows.append((r[3], not r[4], len(seq), int((counts[seq] > 0).sum()), math.fsum(base[seq]), math.fsum(inside[seq]), B.pack(cells[seq])))
            if len(rows) >= 1000:
                yield out()
                rows = []
        if rows:
            yield out()


# --- model -------------------------------------------------------------------


def _sum_rows(into: np.ndarray, at: np.ndarray, what: np.ndarray) -> None:
    """into[at] += what, row by row, with repeated rows."""
    if len(into) <= 1 << 16:
        at = at.astype(np.uint16)  # these are sorted by radix
    order = np.argsort(at, kind="stable")
    rows = at[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    into[rows[first]] += np.add.reduceat(what[order], first, axis=0)


class Model:
    """Weights of both softmaxes over the bare shares of classes and slots."""

    def __init__(self, layout: Layout, cell_tokens: np.ndarray):
        self.layout = layout
        slots = cell_tokens.reshape(layout.classes, layout.slots) + np.where(np.arange(layout.slots) < layout.own, 0.0, 1.0)
        self.class_share = slots.sum(1) / slots.sum()
        self.slot_share = slots / slots.sum(1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.class_bias = np.log(self.class_share).astype(np.float32)
            self.slot_bias = np.maximum(np.log(self.slot_share), -1e4).astype(np.float32)
        self.classes = np.zeros((layout.class_rows, layout.classes), np.float32)
        self.slots = np.zeros((layout.slot_rows, layout.slots), np.float32)

    def features(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, class features (4 x tokens) and slot features (3 x tokens) of whole texts, one after the other."""
        lay = self.layout
        lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
        y = np.concatenate(seqs).astype(np.int64)
        place = np.arange(len(y)) - np.repeat(np.cumsum(lens) - lens, lens)
        before = []
        for back in (1, 2, 3):
            b = np.full(len(y), lay.cells, np.int64)
            b[back:] = y[:-back]
            b[place < back] = lay.cells
            before.append(b)
        a, b, c = before
        pair = (((a * 1_000_003 + b) * 2_654_435_761) >> 7) % lay.pairs
        each = lay.cells + 1
        f = np.stack([a, each + b, 2 * each + c, 3 * each + pair])
        k, near, far = y // lay.slots, a // lay.slots, b // lay.slots
        own = ((a * 40_503 + k * 7_919_317) * 2_654_435_761 >> 7) % (2 * lay.pairs)
        size = (lay.classes + 1) * lay.classes
        g = np.stack([own, 2 * lay.pairs + near * lay.classes + k, 2 * lay.pairs + size + far * lay.classes + k])
        return y, f, g

    @staticmethod
    def _shares(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shifted scores and their exponentials, not yet divided by their sums."""
        z = weights[rows[0]]
        for r in rows[1:]:
            z += weights[r]
        z += bias
        z -= z.max(1, keepdims=True)
        return z, np.exp(z)

    def log_e(self, y: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's cell."""
        out = np.empty(len(y))
        for lo in range(0, len(y), CHUNK):
            at = slice(lo, lo + CHUNK)
            k, s = np.divmod(y[at], self.layout.slots)
            rows = np.arange(len(k))
            z, e = self._shares(self.class_bias, self.classes, f[:, at])
            got = z[rows, k] - np.log(e.sum(1))
            z, e = self._shares(self.slot_bias[k], self.slots, g[:, at])
            out[at] = got + (z[rows, s] - np.log(e.sum(1)))
        return out

    def expect(self, name: str, y: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
        """Add what the weights of one softmax expect each of its features to be seen with."""
        weights = getattr(self, name)
        e = np.empty((SUMMED, weights.shape[1]), np.float32)
        for first in range(0, len(y), SUMMED):
            n = min(SUMMED, len(y) - first)
            for lo in range(first, first + n, CHUNK):
                at = slice(lo, min(lo + CHUNK, first + n))
                bias = self.class_bias if name == "classes" else self.slot_bias[y[at] // self.layout.slots]
                _, got = self._shares(bias, weights, rows[:, at])
                got /= got.sum(1, keepdims=True)
                e[lo - first : at.stop - first] = got
            for r in rows:
                _sum_rows(into, r[first : first + n], e[:n])

    def step(self, name: str, rows: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """How ``rows`` of the weights move along their gradient."""
        lay = self.layout
        if name == "classes":
            prior, many = PRIOR * self.class_share, 4
        else:
            at = rows - 2 * lay.pairs
            prior = np.where((at < 0)[:, None], PRIOR / lay.slots, PRIOR * self.slot_share[np.maximum(at, 0) % lay.classes])
            many = 3
        return (np.log((seen + prior + 1e-9) / (expected + prior + 1e-9)) / many).astype(np.float32)


def _gathered(batches: Iterator[pa.RecordBatch], make, names: tuple[str, ...], first: bool) -> Iterator[pa.RecordBatch]:
    """What this part's features of the named softmaxes were seen with and are expected with, in segments of rows."""
    model = None
    seqs: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal seqs, held
        lay = model.layout
        y, f, g = model.features(seqs)
        k, s = np.divmod(y, lay.slots)
        for name in names:
            rows, values = (f, k) if name == "classes" else (g, s)
            for r in rows:
                np.add.at(seen[name].reshape(-1), r * seen[name].shape[1] + values, 1)
            if not first:
                model.expect(name, y, rows, expected[name])
        if first:
            np.add.at(mixed.reshape(-1), g[0] * lay.classes + k, 1)
        seqs, held = [], 0

    for b in batches:
        for raw in b.column("seq").to_pylist():
            if model is None:
                model = make()
                seen, expected = ({name: np.zeros(getattr(model, name).shape, kind) for name in names} for kind in (np.int64, np.float64))
                mixed = np.zeros((2 * model.layout.pairs, model.layout.classes), np.int64)  # classes of the hashed slot features
            seq = B.unpack(raw)
            seqs.append(seq)
            held += len(seq)
            if held >= PIECE:
                flush()
    if model is None:
        return
    if seqs:
        flush()
    lay = model.layout
    if first:
        expected["classes"] += seen["classes"].sum(1, keepdims=True) * model.class_share
        rest = np.arange(lay.slot_rows - 2 * lay.pairs) % lay.classes
        expected["slots"][: 2 * lay.pairs] += mixed @ model.slot_share
        expected["slots"][2 * lay.pairs :] += seen["slots"][2 * lay.pairs :].sum(1, keepdims=True) * model.slot_share[rest]
    for name in names:
        s, e = seen[name], expected[name]
        for lo in range(0, len(s), SEGMENT):
            k = np.flatnonzero(s[lo : lo + SEGMENT].any(1)) + lo
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([lo], pa.int64()), *(pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes())], pa.binary()) for x in (k.astype(np.int64), s[k], e[k]))], names=["name", "segment", "rows", "seen", "expected"])


def _stepped(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """The steps of the weights, from the sums over all parts."""
    model, current, seen, expected = None, None, None, None

    def out():
        k = np.flatnonzero(seen.any(1))
        return pa.RecordBatch.from_arrays([pa.array([current[0]]), *(pa.array([x.tobytes()], pa.binary()) for x in (k + current[1], model.step(current[0], k + current[1], seen[k], expected[k])))], names=["name", "rows", "step"])

    for name, segment, *packed in B.streamed(batches, "name", "segment", "rows", "seen", "expected"):
        model = model or make()
        rows, s, e = (np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind) for x, kind in zip(packed, (np.int64, np.int64, np.float64)))
        k = rows - segment
        s, e = s.reshape(len(k), -1), e.reshape(len(k), -1)
        if current != (name, segment):
            if current is not None:
                yield out()
            current, seen, expected = (name, segment), np.zeros((SEGMENT, s.shape[1]), np.int64), np.zeros((SEGMENT, s.shape[1]))
        seen[k] += s
        expected[k] += e
    if current is not None:
        yield out()


def _pieces(seqs: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Whole texts of about PIECE tokens together."""
    some, n = [], 0
    for seq in seqs:
        some.append(seq)
        n += len(seq)
        if n >= PIECE:
            yield some
            some, n = [], 0
    if some:
        yield some


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("flag"), "text")
    coded = stage_table(B.encode(d, _cut, _same, B.buckets_for(d), "texts words"))
    texts, words = coded.where("kind = 0"), coded.where("kind = 1")
    lexicon = stage_table(B.by_bucket(words).mapInArrow(_counted, B.SCHEMA))

    def sums(batches):
        for n, extra in B.streamed(batches, "n", "extra"):
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(extra, np.int64).sum())]), pa.array([n])], names=["total", "n"])

    total, distinct = (int(x or 0) for x in lexicon.mapInArrow(sums, "total long, n long").agg(F.sum("total"), F.sum("n")).first())
    layout = Layout(distinct, total)
    least = max(2.0, total / (8 * layout.cells))  # so at most 8 words a cell come to the driver
    frequent = lexicon.mapInArrow(lambda x: _frequent(x, least), "word binary, n long").collect()
    own = own_cells([(bytes(r[0]), r[1]) for r in frequent], layout)
    shipped = spark.sparkContext.broadcast(own)
    cells = lexicon.mapInArrow(lambda x: _cell_sums(x, shipped.value, layout), "cell long, tokens long, words long")
    cell_tokens, cell_words = np.zeros(layout.cells), np.zeros(layout.cells)
    for cell, t, w in cells.groupBy("cell").agg(F.sum("tokens"), F.sum("words")).collect():  # one row a cell
        cell_tokens[cell], cell_words[cell] = t, w
    shared = np.arange(layout.cells) % layout.slots >= layout.own
    cell_total = np.where(shared, cell_tokens + cell_words + 1, 0.0)  # 0: the word is all of its cell

    both = lexicon.union(words.select(*lexicon.columns)).repartition("bucket").sortWithinPartitions("bucket", F.desc("kind"))
    known = both.mapInArrow(lambda x: _looked_up(x, shipped.value, layout), B.SCHEMA)
    ready = stage_table(B.by_block(texts, known).mapInArrow(lambda x: _coded(x, total, distinct, cell_total), _TEXT_SCHEMA))

    forget(coded, lexicon)
    model = Model(layout, cell_tokens)

    def sent():
        return spark.sparkContext.broadcast((layout, cell_tokens, model.classes, model.slots))

    training = ready.where(~F.col("held_out"))
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long"))), F.lit(ROUNDS))
    for r in range(-1, ROUNDS):
        weights = sent()
        rows = training if r < 0 else training.where(part == r)
        names = ("classes", "slots") if r < 0 else (("classes", "slots")[r % 2],)
        gathered = rows.select("seq").mapInArrow(lambda x, s=weights, names=names, f=r < 0: _gathered(x, lambda: _rebuilt(s.value), names, f), "name string, segment long, rows binary, seen binary, expected binary")
        ordered = gathered.repartition("name", "segment").sortWithinPartitions("name", "segment")
        steps = ordered.mapInArrow(lambda x, s=weights: _stepped(x, lambda: _rebuilt(s.value)), "name string, rows binary, step binary")
        for row in steps.collect():  # all together as large as the weights, whatever the input
            k = np.frombuffer(row["rows"], np.int64)
            getattr(model, row["name"])[k] += np.frombuffer(row["step"], np.float32).reshape(len(k), -1)
        weights.unpersist()
    final = sent()

    def scored(batches):
        m = None
        for b in batches:
            m = m or _rebuilt(final.value)
            got = []
            for some in _pieces([B.unpack(x) for x in b.column("seq").to_pylist()]):
                lens = np.fromiter(map(len, some), np.int64, len(some))
                got.append(np.add.reduceat(m.log_e(*m.features(some)), np.cumsum(lens) - lens) / math.log(10))
            out = (np.concatenate(got) if got else np.empty(0)) + b.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(out, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = ready.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _rebuilt(parts) -> Model:
    layout, cell_tokens, classes, slots = parts
    m = Model(layout, cell_tokens)
    m.classes, m.slots = classes, slots
    return m
