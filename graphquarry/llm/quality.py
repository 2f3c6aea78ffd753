"""Quality classifier: a factorisation machine over hashed words and structure.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so the pairwise interactions of all features cost time linear in the number of
non-zero features. Features are hashed lower-cased words (log term frequency,
unit length) and one-hot bins of structure statistics that are computed from
the text itself; the document's id, source, language and labels are never
inputs.

Defined results: a null or empty text scores as a text without words; a text
of any length is scored whole; equal texts score equally; rows sharing an id,
repeated ones too, are scored each; of a labelled id's rows one is learnt from,
the first by its features' checksum; a null id has no label and isn't held out;
extra columns are ignored, and kept by ``keep_good``; empty tables give empty
tables. With no labelled rows at all (or one class only) the model is the
constant prior (0.5 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import small_batches, unused

N_WORDS = 1 << 15
STAT_BINS = 12
N_STATS = 12
RANK = 8
#: Bound of the labelled training sample, taken in the order of a hash of doc_id.
MAX_TRAIN_ROWS = 12_000
EPOCHS = 12
THRESHOLD = 0.3
HELD_OUT_MODULUS = 5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[33, 44, 46, 58, 59, 63]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(_UPPER | _LOWER | _DIGIT)
_KINDS = np.array([_UPPER, _LOWER, _DIGIT, _SPACE, _SENTENCE, _SYMBOL], np.float64).T


class _WordSlots(dict):
    """Word to hashed slot; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        slot = self[word] = zlib.crc32(word) % N_WORDS
        return slot


def _share_bin(x: float) -> int:
    """Bins of a share, finer near 0."""
    return 0 if x <= 0 else min(STAT_BINS - 1, 1 + int(np.sqrt(min(x, 1.0)) * (STAT_BINS - 1.001)))


def features(text: str | None, slots: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices (ascending) and values of the non-zero features of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n = len(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS
    letters = kinds[0] + kinds[1]
    if words:
        idx, tf = np.unique(np.fromiter(map(slots.__getitem__, words), np.int32, len(words)), return_counts=True)
        val = np.log1p(tf).astype(np.float32)
        val /= np.sqrt((val * val).sum())
        distinct = len(set(words)) / len(words)
    else:
        idx, val, distinct = np.empty(0, np.int32), np.empty(0, np.float32), 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    full = max(1.0, n - kinds[3])
    ended = sum(w[-1] in b"!$%&*#|" for w in words)
    stats = (
        min(STAT_BINS - 1, int(np.log2(len(words) + 1))),
        _share_bin(kinds[0] / max(1.0, letters)),
        _share_bin(kinds[2] / full),
        _share_bin(kinds[4] / full),
        _share_bin((kinds[5] - kinds[4]) / full),
        _share_bin(distinct),
        _share_bin(1 - len(set(lines)) / len(lines) if lines else 0.0),
        min(STAT_BINS - 1, int(np.log2(1 + len(words) / max(1, len(lines))))),
        min(STAT_BINS - 1, int(full / max(1, len(words)))),
        _share_bin(raw.count(b"!") / max(1, len(words))),
        _share_bin(ended / max(1, len(words))),
        _share_bin(words.count(b"|") / max(1, len(words))),
    )
    at = N_WORDS + np.arange(N_STATS, dtype=np.int32) * STAT_BINS + np.array(stats, np.int32)
    return np.concatenate([idx, at]), np.concatenate([val, np.full(N_STATS, 0.3, np.float32)])


class FactorisationMachine:
    """Weights and the linear-time score."""

    def __init__(self, rank: int = RANK, seed: int = 7):
        size = N_WORDS + N_STATS * STAT_BINS
        self.w0 = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; ``starts`` delimits the texts."""
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, starts)
        pair = (s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * pair

    def scores(self, texts, slots: dict) -> np.ndarray:
        rows = [features(t, slots) for t in texts]
        if not rows:
            return np.empty(0)
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        z = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.08, decay: float = 2e-5, seed: int = 11) -> "FactorisationMachine":
        """Mini-batch AdaGrad on the logistic loss; deterministic."""
        if len(rows) == 0:
            return self
        share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
        self.w0 = float(np.log(share / (1 - share)))
        if labels.min() == labels.max():
            self.w[:] = 0
            self.v[:] = 0
            return self
        g0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                idx = np.concatenate([rows[i][0] for i in part])
                val = np.concatenate([rows[i][1] for i in part])
                lens = np.array([len(rows[i][0]) for i in part])
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                vx = self.v[idx] * val[:, None]
                s = np.add.reduceat(vx, starts)
                z = self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]).astype(np.float32) / len(part)
                e = np.repeat(err, lens) * val
                dv = e[:, None] * (np.repeat(s, lens, axis=0) - vx)
                own, inverse = np.unique(idx, return_inverse=True)
                by = np.argsort(inverse, kind="stable")
                at = np.concatenate([[0], np.flatnonzero(np.diff(inverse[by])) + 1])
                dw, dv = np.add.reduceat(e[by], at), np.add.reduceat(dv[by], at)
                dw += decay * self.w[own]
                dv += decay * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * 0.5 * dv / np.sqrt(gv[own])
                d0 = float(err.sum())
                g0 += d0 * d0
                self.w0 -= 0.02 * d0 / np.sqrt(g0)
        return self


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MODULUS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    The bound makes what is broadcast (ids) and gathered (sparse features, one
    row an id) constant whatever the size of the tables. Conflicting labels of
    one id count as 0; null ids or labels are passed over.
    """
    d, lab = docs.select("doc_id", "text"), labels.select("doc_id", "quality")
    chosen = (
        lab.where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def encode(batches):
        slots = _WordSlots()
        for b in batches:
            rows = [features(t, slots) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("quality").cast(pa.int32()), pa.array([zlib.crc32(i.tobytes() + v.tobytes()) for i, v in rows], pa.int64()), *(pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in (0, 1))],
                names=["doc_id", "quality", "sum", "idx", "val"],
            )

    encoded = d.join(F.broadcast(chosen), "doc_id").mapInArrow(encode, "doc_id long, quality int, sum long, idx binary, val binary")
    one = F.min(F.struct("sum", "idx", "val", "quality")).alias("one")
    got = encoded.groupBy("doc_id").agg(one).select("doc_id", "one.*").toArrow()  # max_rows at most
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    idx, val, y = got["idx"].to_pylist(), got["val"].to_pylist(), got["quality"].to_numpy()
    rows = [(np.frombuffer(idx[i], np.int32), np.frombuffer(val[i], np.float32)) for i in order]
    return FactorisationMachine().fit(rows, (y[order] > 0).astype(np.float64))


def score_column(spark, model: FactorisationMachine, text):
    """Column with the score of each whole text."""
    small_batches(spark)
    shipped = spark.sparkContext.broadcast((model.w0, model.w, model.v))

    @F.arrow_udf("double")
    def score(batches: "Iterator[pa.Array]") -> "Iterator[pa.Array]":
        slots, m = _WordSlots(), FactorisationMachine()
        m.w0, m.w, m.v = shipped.value
        for b in batches:
            parts = [m.scores(b.slice(lo, 256).to_pylist(), slots) for lo in range(0, len(b), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return score(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = train(docs, labels)
    d = docs.select("doc_id", score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    name = unused("__quality_score", docs.columns)
    model = train(docs, labels)
    return docs.withColumn(name, score_column(docs.sparkSession, model, F.col("text"))).where(F.col(name) >= THRESHOLD).drop(name)
