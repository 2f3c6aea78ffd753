"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A hash function rotates a unit vector by three rounds of random signs and a
fast Walsh-Hadamard transform and takes the nearest signed axis; a table's
bucket joins FUNCTIONS of them. Every vector is in one bucket of each table,
and a query probes the buckets of a table whose axes fit it best: as many as
hold about CANDIDATES vectors when they are dealt evenly, PROBES at least.
The buckets of a table are dealt to slots, and a query is sent once to each slot
that has some of its buckets. There it is scored against every vector of those
buckets by the exact cosine, in double precision on the original vectors, and
only by that score and the smallest id are its k + 1 best kept, so vectors that
are nearly equal are told apart before anything is cut.

Equal vectors are indexed once, with the smallest ids that can be in a result,
so ties and thousands of copies cost nothing and lose nothing. Large slots
are salted: their vectors are dealt over tasks and their queries copied to each.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null id; a query with fewer than k
candidates gets all that were found; vectors of unlike length are compared
within their length only; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.llm.common import forget, sorted_runs, stage_table

TABLES = 32
FUNCTIONS = 2
PROBES = 64
#: Vectors that a query's buckets of one table hold at least, if all buckets are as full.
CANDIDATES = 100
SEED = 97
#: Vectors of one slot in one task, at most about.
SALT_ROWS = 4096
#: Scored candidates that a task holds before it cuts them to the best.
HELD_ROWS = 500_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two wide), orthonormal."""
    n = x.shape[1]
    x = x.reshape(len(x), n)
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(dim: int, table: int, seed: int = SEED) -> np.ndarray:
    """Random signs of a table: functions x 3 rounds x padded width."""
    width = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng([seed, dim, table]).choice(np.array([-1.0, 1.0], np.float32), (FUNCTIONS, 3, width))


def axes(x: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
    """Fit of each row to each signed axis, for every function of a table."""
    width = signs.shape[2]
    if x.shape[1] < width:
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = []
    for rounds in signs:
        y = x
        for s in rounds:
            y = hadamard(y * s)
        out.append(np.concatenate([y, -y], axis=1))
    return out


def buckets(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for fit in axes(x, signs):
        code = code * fit.shape[1] + fit.argmax(1)
    return code


def probed(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """Buckets of each row in order of fit, ``probes`` of them."""
    total = None
    for fit in axes(x, signs):
        total = fit if total is None else (total[:, :, None] + fit[:, None, :]).reshape(len(x), -1)
    probes = min(probes, total.shape[1])
    return np.argpartition(-total, probes - 1, axis=1)[:, :probes].astype(np.int64)


def _unit(vectors) -> np.ndarray:
    v = np.stack(vectors).astype(np.float64)
    return (v / np.sqrt((v**2).sum(1, keepdims=True))).astype(np.float32)


def _slots(code: np.ndarray, slots: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slots)).astype(np.int64)


def _usable(batches: Iterator[pa.RecordBatch], keep: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes of ``kind``, at most ``keep`` smallest ids of each per batch."""
    for b in batches:
        found: dict[bytes, list[int]] = {}
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or not v or None in v:
                continue
            a = np.array(v, np.float64) + 0.0  # -0.0 and 0.0 are one value
            if np.isfinite(a).all() and a.any():
                found.setdefault(a.astype(kind).tobytes(), []).append(i)
        rows = [(k, sorted(set(ids))[:keep]) for k, ids in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.list_(pa.int64()))], names=["vec", "ids"])


def _merged(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    for (vec,), run in sorted_runs(batches, "vec"):
        ids = sorted({i for x in run["ids"].to_pylist() for i in x})[:keep]
        yield pa.RecordBatch.from_arrays([pa.array([vec], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["vec", "rep", "ids"])


def probes_for(dim: int, vectors: int, least: int = PROBES) -> int:
    """How many buckets of a table of so many vectors a query probes."""
    width = 1 << max(1, (dim - 1).bit_length())
    buckets_of_all = (2 * width) ** FUNCTIONS
    return min(buckets_of_all, max(least, -(-CANDIDATES * buckets_of_all // max(1, vectors))))


def _placed(batches: Iterator[pa.RecordBatch], probes: int, tables: int, slots: int, kind: str, vectors: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows (tab, slot, id, codes, vec) of a vector's bucket; with ``probes`` of all buckets of a slot that a query probes."""
    for b in batches:
        for lo in range(0, b.num_rows, 250):
            part = b.slice(lo, 250)
            ids, data = part.column("rep").to_numpy(), np.array(part.column("vec").to_pylist(), object)
            raw = [np.frombuffer(x, kind) for x in data]
            for dim in sorted({len(x) for x in raw}):
                at = np.array([i for i, x in enumerate(raw) if len(x) == dim])
                unit = _unit([raw[i] for i in at])
                for t in range(tables):
                    signs = rotations(dim, t)
                    code = probed(unit, signs, probes_for(dim, vectors, probes)) if probes else buckets(unit, signs)[:, None]
                    row, code = np.repeat(np.arange(len(at)), code.shape[1]), code.reshape(-1)
                    slot = _slots(code, slots)
                    order = np.lexsort((slot, row))
                    row, code, slot = row[order], code[order], slot[order]
                    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])]))
                    ends = [*first[1:], len(row)]
                    codes = [code[x:y].tobytes() for x, y in zip(first, ends)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first), dim * 1000 + t, np.int64)), pa.array(slot[first]), pa.array(ids[at][row[first]]), pa.array(codes, pa.binary()), pa.array(data[at][row[first]], pa.binary())],
                        names=["tab", "slot", "id", "codes", "vec"],
                    )


def _best(query: np.ndarray, ids: np.ndarray, near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` best different vectors of each query: by exact score, then by smallest id."""
    order = np.lexsort((ids, -near, query))
    query, ids, near = query[order], ids[order], near[order]
    # a pair that several tables found has one score, so its rows are neighbours
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])])
    query, ids, near = query[new], ids[new], near[new]
    first = np.concatenate([[0], np.flatnonzero(query[1:] != query[:-1]) + 1])
    top = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < n
    return query[top], ids[top], near[top]


def _scored_batch(query: np.ndarray, ids: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(near)], names=["query", "id", "near"])


def _matched(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Best k + 1 vectors of each query among this task's buckets that it probes (itself may be one)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for _, run in sorted_runs(batches, "tab", "slot", "salt"):
        role, ids = run["kind"].to_numpy(), run["id"].to_numpy()
        if role[0] == 1 or role[-1] == 0:
            continue
        n = int((role == 0).sum())
        v = np.frombuffer(b"".join(run["vec"].to_pylist()), kind).reshape(len(ids), -1).astype(np.float64)
        codes = run["codes"].to_pylist()
        code = np.frombuffer(b"".join(codes[n:]), np.int64)
        order = np.argsort(code, kind="stable")
        code, c, m = code[order], ids[n:][order], v[n:][order]
        norms = np.sqrt((m * m).sum(1))
        for i in range(n):
            asked = np.frombuffer(codes[i], np.int64)
            lo, hi = np.searchsorted(code, asked, "left"), np.searchsorted(code, asked, "right")
            found = [np.arange(x, y) for x, y in zip(lo, hi) if x < y]
            if not found:
                continue
            at = np.concatenate(found)
            near, own = cosine(v[i], m[at], norms[at]), c[at]
            if len(at) > k + 1:
                top = np.lexsort((own, -near))[: k + 1]
                near, own = near[top], own[top]
            held.append((np.full(len(own), ids[i], np.int64), own, near))
            rows += len(own)
            if rows >= HELD_ROWS:
                held = [_best(*map(np.concatenate, zip(*held)), k + 1)]
                rows = len(held[0][0])
                if rows > HELD_ROWS // 2:
                    yield _scored_batch(*held[0])
                    held, rows = [], 0
    if held:
        yield _scored_batch(*_best(*map(np.concatenate, zip(*held)), k + 1))


def _hopeful(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k + 1 best of all that a query's tables have found."""
    for _, run in sorted_runs(batches, "query"):
        query, ids, _ = _best(*(run[c].to_numpy() for c in ("query", "id", "near")), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids)], names=["query", "id"])


def cosine(q: np.ndarray, m: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """Cosines of the rows of ``m`` with ``q``; the same for a row wherever it stands."""
    return (m * q).sum(1) / ((np.sqrt((m * m).sum(1)) if norms is None else norms) * np.sqrt((q * q).sum()))


def _ranked(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    for (query,), run in sorted_runs(batches, "query_id"):
        vecs = [np.frombuffer(x.as_buffer(), kind).astype(np.float64) for chunk in run["vec"].chunks for x in chunk]
        q = np.frombuffer(run["qvec"][0].as_buffer(), kind).astype(np.float64)
        scores = cosine(q, np.stack(vecs))
        best = sorted((-s, i) for s, ids in zip(scores.tolist(), run["ids"].to_pylist()) for i in ids if i != query)[:k]
        n = len(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, query, np.int64)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array([i for _, i in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())],
            names=["query_id", "rank", "vec_id", "score"],
        )


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query.

    Both frames have (vec_id, embedding); a query never finds its own id.
    """
    keep = k + 1
    # single precision as it came, where that is what the tables hold: lossless and half as long
    kind = "<f4" if all(x.schema["embedding"].dataType.simpleString() == "array<float>" for x in (vectors, queries)) else "<f8"
    named = [x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) for x in (vectors, queries)]
    base, asked = (x.mapInArrow(lambda it: _usable(it, keep, kind), "vec binary, ids array<long>") for x in named)
    base = stage_table(base.withColumn("h", F.xxhash64("vec")).repartition("h").sortWithinPartitions("h", "vec").select("vec", "ids").mapInArrow(lambda it: _merged(it, keep), "vec binary, rep long, ids array<long>"))
    # every asking id is kept, but each distinct vector is searched once
    asked_ids = stage_table(named[1].mapInArrow(lambda it: _usable(it, 1 << 40, kind), "vec binary, ids array<long>"))
    probe = stage_table(asked.groupBy("vec").agg(F.min(F.array_min("ids")).alias("rep")))

    size = base.count()
    slots = max(1, -(-size // SALT_ROWS))
    row = "tab long, slot long, id long, codes binary, vec binary"
    placed = stage_table(base.select("rep", "vec").mapInArrow(lambda it: _placed(it, 0, tables, slots, kind), row))
    # staged, so that its size is known: the few slots over size are broadcast and no vector moves for them
    large = stage_table(placed.groupBy("tab", "slot").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    looking = probe.mapInArrow(lambda it: _placed(it, probes, tables, slots, kind, size), row).join(large, ["tab", "slot"], "left")
    looking = looking.select("tab", "slot", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "id", "codes", "vec")
    stored = placed.join(large, ["tab", "slot"], "left").select("tab", "slot", F.pmod(F.xxhash64("id"), salts).alias("salt"), F.lit(1).alias("kind"), "id", "codes", "vec")
    both = looking.union(stored).repartition("tab", "slot", "salt").sortWithinPartitions("tab", "slot", "salt", "kind")
    found = both.mapInArrow(lambda it: _matched(it, k, kind), "query long, id long, near double").repartition("query").sortWithinPartitions("query")
    pairs = stage_table(found.mapInArrow(lambda it: _hopeful(it, k), "query long, id long"))
    forget(placed, large)

    who = asked_ids.select("vec", F.explode("ids").alias("query_id")).join(probe, "vec").select("query_id", F.col("rep").alias("query"), F.col("vec").alias("qvec"))
    cand = pairs.join(base, pairs.id == base.rep).select("query", "vec", "ids").join(who, "query").select("query_id", "qvec", "vec", "ids")
    return cand.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _ranked(it, k, kind), "query_id long, rank int, vec_id long, score double")
