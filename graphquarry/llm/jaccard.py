"""Size-aware heavy-light self-join on the Jaccard similarity of word n-grams.

A text's set holds the distinct n-word shingles of its ASCII-lower-cased words
(maximal runs of characters other than ASCII white space); with fewer than n
words the whole word sequence is the single shingle; without words the set is
empty and linked with nothing. Texts link when 100 * |A & B| >= t * |A | B|.

1. Texts with the same set collapse to one representative.
2. Shingles are ordered rare first (by a sketch of all counts, then by hash).
   Two linked sets share the first L shingles of their intersection,
   and these lie in the first |A| - ceil(t|A|) + L of A, likewise for B.
   * light sets (up to ``boundary`` shingles) enumerate every 2-subset of
     their L=2 prefix as a key;
   * heavy sets, and light ones large enough to link to a heavy one, enter the
     inverted lists of the single shingles of their prefix, with an L that
     grows with the set, so that linked sets share L lists at least.
   The boundary is where enumerating costs as much as scanning lists, by the
   list lengths of the rare shingles that prefixes take, which hardly grow
   with the corpus (those of frequent shingles do).
3. A key's list is known by its head, the smallest id in it. Each set is first
   compared with the head that it shares most keys with; connected sets are
   then merged. Sets that share a head (so all that share a key) and are still
   in different components are compared with each other, the likeliest partner
   in each component first. A set leaves the heads that it shares fewest lists
   with, as long as those are fewer than half of the L that any link has, so
   linked sets still meet while sets with a few chance shingles don't.
   So a group of n near copies costs about n
   comparisons, a pair is met once for each shared head rather than for each
   shared key, and no link between components is lost. A list names a forest
   of likely pairs over its components first, and others only where one of
   those isn't a link.
4. Candidates pass an exact bound from parity bitmaps, then the exact count.

Defined results: a null text has no words; rows with a null id take no part
and form no group; rows sharing an id are one vertex with the links of all
their texts, each row with its own n_shingles; repeated rows stay; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm.common import connected_components, first_rows, forget, small_batches, sorted_runs, stage_table, unused

SKETCH = 1 << 20
#: Slots of the sketch in one row.
SLOTS = 1 << 10
#: Rows up to which a table of ids is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Sets compared with one list head in one task.
SALT_ROWS = 256
#: Sets of one head on either side of one run of comparisons.
LIST_ROWS = 4096
#: Pairs that a run holds before it keeps only those that it will name.
HELD_PAIRS = 200_000
#: Heads of up to this many sets are joined with themselves.
SHORT_LIST = 12
#: Sets of one head are dealt by size in bands as wide as this power of 2.
BAND = 1.0
#: Likeliest pairs of two components that a second search names at once; what else there is takes a third.
PARTNERS = 8
#: What holds more than this share of its table is hot and met by broadcast, so at most so many are.
HOT_SHARE = 2000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LISTED = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _mix((x + _M1) ^ h[i : len(h) - k + 1 + i]) * _M1
    return np.unique(_mix(x))


def needed(n: int, percent: int) -> int:
    """Fewest shared shingles of a set of n with any set it links to."""
    return -(-percent * n // 100)


def in_common(n: int, percent: int) -> int:
    """How many shingles of the list prefix a set of n shares at least with any set that it links to and that isn't smaller."""
    return max(1, min(needed(n, percent), 1 + (n - needed(n, percent)) // 3))


def slack(n: int, percent: int) -> int:
    """Shared lists that a set of n may leave: two linked sets that both do so still share one."""
    return (in_common(needed(n, percent), percent) - 1) // 2


def may_differ(n: int, percent: int) -> bool:
    """Whether a set of n shingles can link to a different set at all."""
    return needed(n, percent) < n or 100 * n >= percent * (n + 1)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the set in 2^k >= 2n (64 at least) hashed bits."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """Upper bound of the overlap of two sets from their parity bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def _summaries(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    counts, pending, held = np.zeros(SKETCH, np.int64), [], 0

    def flush():
        nonlocal pending, held
        if pending:
            s = np.concatenate(pending) & np.uint64(SKETCH - 1)
            np.add(counts, np.bincount(s.astype(np.int64), minlength=SKETCH), out=counts)
        pending, held = [], 0

    def rows(kind, a, b, c, d, blocks):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), *(pa.array(x, pa.int64()) for x in (a, b, c, d)), pa.array(blocks, pa.binary())], names=["kind", "id", "n", "h1", "h2", "counts"])

    for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
        ids, ns, h1, h2 = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingles(text, n)
            ids.append(i)
            ns.append(len(s))
            h1.append(int(_mix(s ^ _M1).sum().astype(np.int64)))
            h2.append(int(np.bitwise_xor.reduce(_mix(s + _M1)).astype(np.int64)) if len(s) else 0)
            pending.append(s)
            held += len(s)
            if held > 500_000:
                flush()
        yield rows(0, ids, ns, h1, h2, [None] * len(ids))
    flush()
    blocks = counts.reshape(-1, SLOTS).astype(np.uint32)
    some = np.flatnonzero(blocks.any(1))
    if len(some):
        yield rows(1, some, *np.zeros((3, len(some)), np.int64), [blocks[k].tobytes() for k in some])


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the sketch, summed; a count stops at 2^32 - 1."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64)
            sums[k] = np.minimum(sums[k] + x, 2**32 - 1) if k in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], names=["id", "counts"])


def _weights(seen: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall in each slot of the sketch."""
    blocks = seen.where("kind = 1").select("id", "counts").mapInArrow(_block_sums, "id long, counts binary")
    weight = np.zeros((SKETCH // SLOTS, SLOTS), np.uint32)
    for k, x in blocks.repartition("id").mapInArrow(_block_sums, "id long, counts binary").collect():
        weight[k] = np.frombuffer(x, np.uint32)
    return weight.reshape(-1)


def _list_length(weight: np.ndarray, percent: int) -> float:
    """Length of a list on average, of the rarest shingles that make up a prefix's share of all, as far as slots show it."""
    load = np.sort(weight).astype(np.float64)
    rare = load[np.cumsum(load) <= (100 - percent) / 100 * load.sum()]
    return float((np.maximum(rare - load.mean(), 0) ** 2).sum() / max(1, rare.sum()))


def _keys(batches: Iterator[pa.RecordBatch], n: int, percent: int, boundary: int, shipped) -> Iterator[pa.RecordBatch]:
    """Keys and bitmaps of the sets; those of lists are the negative ones."""
    weight = shipped.value
    from_list = needed(boundary + 1, percent)  # a heavy set links to none smaller
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            out_id, out_n, out_keys, out_map, out_slack = [], [], [], [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                s = shingles(text, n)
                if not may_differ(len(s), percent):
                    continue
                order = np.lexsort((s, weight[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))
                spare = len(s) - needed(len(s), percent)
                keys = []
                if len(s) <= boundary and needed(len(s), percent) >= 2:
                    p = s[order[: spare + 2]]
                    x, y = np.triu_indices(len(p), 1)
                    keys.append(_mix(np.minimum(p[x], p[y]) * _M1 + np.maximum(p[x], p[y])) & ~_LISTED)
                if len(s) >= from_list or needed(len(s), percent) < 2:
                    keys.append(s[order[: spare + in_common(len(s), percent)]] | _LISTED)
                out_id.append(i)
                out_n.append(len(s))
                out_keys.append(np.unique(np.concatenate(keys)).view(np.int64))
                out_map.append(bitmap(s))
                out_slack.append(slack(len(s), percent))
            lens = np.cumsum([0, *map(len, out_keys)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_n, pa.int64()), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(out_keys) if out_keys else np.empty(0, np.int64))), pa.array(out_map, pa.binary()), pa.array(out_slack, pa.int64())],
                names=["id", "n", "keys", "map", "slack"],
            )


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and heads of the keys that two sets or more have, and whether the key is a list's.

    The stream is sorted by key and id; of a batch only the last row waits.
    """
    key, ids, head = (np.empty(0, np.int64) for _ in range(3))
    listed = np.empty(0, bool)  # whether the waiting row is known to be in a list

    def out(i, h, k, keep):
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (i, h, k < 0)], names=["id", "head", "listed"])

    for batch in batches:
        if not batch.num_rows:
            continue
        k, i = (np.concatenate([a, batch.column(c).to_numpy()]) for a, c in ((key, "key"), (ids, "id")))
        same = np.concatenate([[False], k[1:] == k[:-1]])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
        h = i[start]
        if len(head):
            h[start == 0] = head[0]
        keep = same.copy()
        keep[:-1] |= same[1:]
        if len(listed):
            keep[0] |= listed[0]
        yield out(i[:-1], h[:-1], k[:-1], keep[:-1])
        key, ids, head, listed = k[-1:], i[-1:], h[-1:], keep[-1:]
    if len(key):
        yield out(ids, head, key, listed)


def _boundary(sizes: list[tuple[int, int]], list_length: float, percent: int) -> int:
    """The set size up to which enumerating 2-subsets is the cheaper way.

    Writing a key costs ten times as much as passing an entry of a list.
    ``sizes`` holds (set size, how many) of the corpus, by powers of 1.1.
    """
    best, cost = 0, None
    for cut in sorted({0, *(s for s, _ in sizes)}):
        total = 0.0
        for s, many in sizes:
            spare = s - needed(s, percent)
            subsets = (spare + 2) * (spare + 1) / 2 * 10
            scan = (spare + in_common(s, percent)) * (10 + list_length)
            total += many * (subsets if s <= cut else 0) + many * (scan if s >= needed(cut + 1, percent) else 0)
        if cost is None or total < cost:
            best, cost = cut, total
    return best


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps don't rule a link out."""
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        fits = np.array([(100 + percent) * bound(x.as_buffer(), p, y.as_buffer(), q) >= percent * (p + q) for x, p, y, q in zip(batch.column("ma"), na.tolist(), batch.column("mb"), nb.tolist())], bool)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(fits)), batch.column("b").filter(pa.array(fits))], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, n).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["id", "items"])


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test of two ascending sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that link; a run is one head (kind 0) and the sets to compare with it."""
    for (b, _), run in sorted_runs(batches, "b", "salt"):
        a, kind = run["a"].to_numpy(), run["kind"].to_numpy()
        items = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in run["items"].chunks for x in chunk]
        heads = [items[i] for i in np.flatnonzero(kind == 0)]  # more than one if rows share an id
        ok = [a[i] for i in np.flatnonzero(kind == 1) if any(_link(items[i], h, percent) for h in heads)]
        yield pa.RecordBatch.from_arrays([pa.array(ok, pa.int64()), pa.array(np.full(len(ok), b, np.int64))], names=["a", "b"])


def _verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, counted exactly."""
    m = reps.select("id", "n", "map")
    cand = (
        pairs.join(m.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("map").alias("ma")), "a")
        .join(m.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("map").alias("mb")), "b")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    )
    cand = stage_table(cand.mapInArrow(lambda x: _close(x, percent), "a long, b long"))
    size = cand.count()
    if not size:
        return cand
    wanted = stage_table(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * size)
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    sets = docs.join(ids, "id", "left_semi").mapInArrow(lambda x: _sets(x, n), "id long, items binary")
    salts = cand.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    body = cand.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), "a")
    body = body.join(sets, body.a == sets.id).select("b", "salt", F.lit(1).alias("kind"), "a", "items")
    heads = salts.join(sets, salts.b == sets.id).select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("b").alias("a"), "items")
    both = heads.union(body).repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")
    out = stage_table(both.mapInArrow(lambda x: _linked(x, percent), "a long, b long"))
    forget(cand, wanted)
    return out


def _fold(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def _forest(u: np.ndarray, v: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which of the edges u - v form a maximum spanning forest: every vertex takes its best, those taken merge, and again."""
    at = np.argsort(-share, kind="stable")
    u, v, kept = u[at], v[at], [np.empty(0, np.int64)]
    root = list(range(int(max(u.max(), v.max())) + 1)) if len(u) else []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    while len(at):
        best, back = np.full(len(root), len(at)), np.arange(len(at))[::-1]
        for end in (u, v):
            first = np.full(len(root), len(at))
            first[end[::-1]] = back  # the last assignment stays: the least position
            best = np.minimum(best, first)
        pick = np.unique(best[best < len(at)])
        kept.append(at[pick])
        for x, y in zip(u[pick].tolist(), v[pick].tolist()):
            root[find(x)] = find(y)
        label = np.array([find(x) for x in range(len(root))])
        u, v = label[u], label[v]
        at, u, v = (c[u != v] for c in (at, u, v))
    return np.concatenate(kept)


def _foremost(group: np.ndarray, share: np.ndarray, many: int) -> np.ndarray:
    """Positions of the ``many`` largest shares of each group."""
    order = np.lexsort((-share, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g, "left") < many]


def _unmerged(batches: Iterator[pa.RecordBatch], percent: int, partners: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of a head that are in different components and may link.

    A run compares its left sets (side 0) with its right ones (1) and those of
    both sides (2) with all; sets that visit from a lower band aren't compared
    with each other. Sets that link have bitmaps of the same length, or one
    twice the other's. Of what it finds, a run names a forest that spans the
    components, of the likeliest pairs (``partners`` 0), or so many of the
    likeliest of any two components, or all (None); ``more`` says whether it
    had others.
    """
    for (head, *_), run in sorted_runs(batches, "head", "band", "i", "j"):
        side, home, ids, n, comp = (run[c].to_numpy() for c in ("side", "home", "id", "n", "comp"))
        label = np.unique(comp, return_inverse=True)[1]
        if not label.any():
            continue
        raw = [np.frombuffer(x.as_buffer(), np.uint8) for chunk in run["map"].chunks for x in chunk]
        width = np.array([len(x) for x in raw])
        maps, at = {}, {}
        for w in np.unique(width[side != 0]):
            at[w] = np.flatnonzero((width == w) & (side != 0))
            maps[w] = np.stack([raw[k] for k in at[w]])
        folded = {w: _fold(m) for w, m in maps.items() if w > 8}
        held, size, more = [], 0, False

        def fewer(parts):
            x, k, share = (np.concatenate(c) for c in zip(*parts))
            if partners is None:
                return x, k, share
            lo, hi = np.minimum(label[x], label[k]), np.maximum(label[x], label[k])
            keep = _foremost(lo * len(label) + hi, share, partners) if partners else _forest(lo, hi, share)
            return x[keep], k[keep], share[keep]

        def named(x, k, share):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[x], ids[k], comp[k], share, np.full(len(x), more), np.full(len(x), head))], names=["a", "b", "cb", "share", "more", "head"])

        for x in np.flatnonzero(side != 1):
            w = width[x]
            mine = raw[x][None, :]
            found = []
            for other, theirs, my in ((w, maps.get(w), mine), (2 * w, folded.get(2 * w), mine), (w // 2, maps.get(w // 2), _fold(mine) if w > 8 else mine)):
                if theirs is None:
                    continue
                k = at[other]
                ok = (comp[k] != comp[x]) & (100 * np.minimum(n[k], n[x]) >= percent * np.maximum(n[k], n[x]))
                ok &= (side[k] == 1) | (ids[k] < ids[x])
                if not home[x]:
                    ok &= home[k]
                hit = np.flatnonzero(ok)
                if not len(hit):
                    continue
                k = k[hit]
                most = (n[k] + n[x] - np.bitwise_count(theirs[hit] ^ my).sum(1, dtype=np.int64)) // 2
                fits = (100 + percent) * most >= percent * (n[k] + n[x])
                found.append((k[fits], (most / (n[k] + n[x]))[fits]))
            if not found:
                continue
            k, share = (np.concatenate(c) for c in zip(*found))
            if not len(k):
                continue
            held.append((np.full(len(k), x), k, share))
            size += len(k)
            if size > HELD_PAIRS:
                held = [fewer(held)]
                if partners is None:
                    yield named(*held.pop())
                more |= bool(held) and len(held[0][0]) < size
                size = len(held[0][0]) if held else 0
        if held:
            kept = fewer(held)
            more |= len(kept[0]) < size
            yield named(*kept)


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps don't rule a link out, with the bound's share."""
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        most = np.array([bound(x.as_buffer(), p, y.as_buffer(), q) for x, p, y, q in zip(batch.column("ma"), na.tolist(), batch.column("mb"), nb.tolist())], np.int64)
        fits = pa.array((100 + percent) * most >= percent * (na + nb))
        share = pa.array(most / (na + nb), pa.float64())
        yield pa.RecordBatch.from_arrays([x.filter(fits) for x in (batch.column("a"), batch.column("b"), batch.column("cb"), share)], names=["a", "b", "cb", "share"])


_PAIR = "a long, b long, cb long, share double, more boolean, head long"


def _apart(shared: DataFrame, comp: DataFrame, reps: DataFrame, percent: int, partners: int | None = 0) -> DataFrame:
    """Candidate pairs (a, b) in different components, with b's component, a bound and the head.

    The sets of a head with few are joined with themselves. Those of one with
    many go to the band of their size, and as visitors to the bands above that
    hold sets which may link. A band with more than LIST_ROWS is cut into
    blocks, which meet in runs of two; the sets of the head's own component
    meet only others. So what is copied is what still has to be compared.
    ``partners`` says how many pairs a run names.
    """
    placed = shared.join(comp, "id", "left").select("head", "id", F.coalesce("comp", "id").alias("comp"))
    parts = placed.groupBy("head", "comp").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    mixed = parts.groupBy("head").agg(F.count("*").alias("comps"), F.sum("n").alias("many"), F.min_by("comp", "lo").alias("main")).where("comps > 1")
    staged = stage_table(mixed.select("head", "main", "many"))
    mixed = F.broadcast(staged) if staged.count() <= BROADCAST_ROWS else staged
    rows = stage_table(placed.join(mixed, "head").join(reps.select("id", "n"), "id"))
    x, y = (rows.where(f"many <= {SHORT_LIST}").select("head", F.col("id").alias(i), F.col("comp").alias(c), F.col("n").alias(k)) for i, c, k in (("a", "ca", "na"), ("b", "cb", "nb")))
    near = x.join(y, "head").where(f"a > b and ca <> cb and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "cb", "na", "nb").distinct()
    m = reps.select("id", "map")
    near = near.join(m.select(F.col("id").alias("a"), F.col("map").alias("ma")), "a").join(m.select(F.col("id").alias("b"), F.col("map").alias("mb")), "b")
    near = near.mapInArrow(lambda it: _bounded(it, percent), "a long, b long, cb long, share double").select("*", F.lit(False).alias("more"), F.lit(None).cast("long").alias("head"))

    def band(n):
        return F.floor(F.log2(n) / BAND).cast("int")

    # a hair wider than the sizes that may link, so that rounding leaves none out
    bands = F.sequence(band(F.col("n")), band(F.col("n") * (100 / percent + 1e-9)))
    many = rows.where(f"many > {SHORT_LIST}").withColumn("band", F.explode(bands)).withColumn("home", F.col("band") == band(F.col("n")))
    loads = many.groupBy("head", "band").agg(F.count_if(F.col("comp") != F.col("main")).alias("others"), F.count_if(F.col("comp") == F.col("main")).alias("mains"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("home").alias("homes"))
    loads = loads.where("lo < hi and homes").selectExpr("head", "band", f"int(ceil(others / {LIST_ROWS})) ks", f"if(others + mains <= {LIST_ROWS}, 0, int(ceil(mains / {LIST_ROWS}))) km")
    counted = stage_table(loads)
    loads = F.broadcast(counted) if counted.count() <= BROADCAST_ROWS else counted

    # blocks 0 to ks - 1 hold the others, ks and so on the head's own component; with km = 0 all is one run
    runs = many.join(loads, ["head", "band"]).selectExpr("*", "comp = main own", "int(if(comp = main, if(km = 0, 0, ks + pmod(xxhash64(id), greatest(km, 1))), pmod(xxhash64(id), ks))) p")
    runs = runs.selectExpr("*", "explode(sequence(0, if(own, ks, ks + km) - 1)) t")
    runs = runs.selectExpr("head", "band", "least(p, t) i", "greatest(p, t) j", "tinyint(if(own, 1, if(p = t, 2, if(p < t, 0, 1)))) side", "home", "id", "comp", "n")
    runs = runs.join(m, "id").repartition("head", "band", "i", "j").sortWithinPartitions("head", "band", "i", "j")
    found = near.union(runs.mapInArrow(lambda it: _unmerged(it, percent, partners), _PAIR))
    out = stage_table(found.groupBy("a", "b", "cb").agg(F.max("share").alias("share"), F.max(F.when(F.col("more"), F.col("head"))).alias("more")))
    forget(staged, rows, counted)
    return out


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, in place of ``comp``: only the graph of components is solved anew."""
    edges = links.select("a", "b")
    for end in "ab":
        edges = edges.join(comp.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
    more = connected_components(edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    new = more.select("id", F.col("comp").alias("to"))
    moved = comp.join(new.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    out = stage_table(moved.union(new.join(comp.select("id"), "id", "left_anti").select("id", F.col("to").alias("comp"))))
    forget(more, comp)
    return out


def _still_apart(pairs: DataFrame, comp: DataFrame, *more: str) -> DataFrame:
    """The pairs whose ends are in different components, with ``more`` columns."""
    pairs = pairs.select("a", "b", *more)
    for end in "ab":
        pairs = pairs.join(comp.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
    return pairs.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", *more)


def _copies(rows: DataFrame, total: int) -> DataFrame:
    """id, n and rep of every row: the smallest id that has the same set.

    Groups of many copies are few, so they are met by broadcast and no task
    gets all rows of one.
    """
    same = ["h1", "h2", "n"]
    groups = stage_table(rows.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("many")))
    hot = F.broadcast(groups.where(F.col("many") > max(1, total // HOT_SHARE)).select(*same, "rep"))
    single = groups.where("many = 1").select(F.col("rep").alias("id"), "n", "rep")
    few = groups.where(F.col("many").between(2, max(1, total // HOT_SHARE))).select(*same, "rep")
    some = rows.join(hot, same, "left_anti").join(few, same)
    out = stage_table(single.union(rows.join(hot, same).select("id", "n", "rep")).union(some.select("id", "n", "rep")))
    forget(groups)
    return out


def _key_loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many keys fall in each of SKETCH slots."""
    counts = np.zeros(SKETCH, np.int64)
    for b in batches:
        k = b.column(0).flatten().to_numpy() & (SKETCH - 1)
        counts += np.bincount(k, minlength=SKETCH)
    at = np.flatnonzero(counts)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _shared(reps: DataFrame) -> DataFrame:
    """id, head and how many keys they share, for every key of two sets or more, without the heads that a set may leave."""
    entries = reps.select(F.explode("keys").alias("key"), "id")
    loads = reps.select("keys").mapInArrow(_key_loads, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    loads = stage_table(loads)  # SKETCH rows at most
    total = loads.agg(F.sum("n")).first()[0] or 0
    slots = F.broadcast(loads.where(F.col("n") > max(100, total // HOT_SHARE)).select("slot"))
    slot = F.col("key").bitwiseAND(F.lit(SKETCH - 1).cast("long"))
    entries = entries.withColumn("slot", slot)
    # the lists of very common keys never meet in one task: only their heads do
    common = entries.join(slots, "slot")
    firsts = stage_table(common.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("many")).where("many > 1").select("key", "head"))
    heads = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    rest = entries.join(slots, "slot", "left_anti").select("key", "id").repartition("key").sortWithinPartitions("key", "id")
    pairs = rest.mapInArrow(_lists, "id long, head long, listed boolean").union(common.join(heads, "key").select("id", "head", F.expr("key < 0")))
    met = pairs.groupBy("id", "head").agg(F.count("*").alias("keys"), F.count_if("listed").alias("lists"))
    met = met.join(reps.groupBy("id").agg(F.min("slack").alias("slack")), "id")  # rows may share an id
    fewest = Window.partitionBy("id").orderBy(F.expr("keys > lists"), "lists", "head").rowsBetween(Window.unboundedPreceding, 0)
    out = stage_table(met.withColumn("left", F.sum("lists").over(fewest)).where("keys > lists or left > slack").select("id", "head", "keys"))
    forget(loads, firsts)
    return out


def components(docs: DataFrame, n: int = 4, percent: int = 85, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row with an id.

    ``boundary`` forces the largest light size; by default cost decides.
    """
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    spark = d.sparkSession
    small_batches(spark)
    seen = stage_table(d.mapInArrow(lambda x: _summaries(x, n), "kind byte, id long, n long, h1 long, h2 long, counts binary"))
    rows = seen.where("kind = 0").select("id", "n", "h1", "h2")

    weight = _weights(seen)
    shipped = spark.sparkContext.broadcast(weight)
    step = F.pow(F.lit(1.1), F.floor(F.log(1.1, "n"))).cast("long")
    sizes = [(int(r[0]), int(r[1])) for r in rows.where("n > 0").groupBy(step.alias("s")).count().collect()]
    if boundary is None:
        boundary = _boundary(sizes, _list_length(weight, percent), percent)

    members = _copies(rows.where("n > 0"), sum(c for _, c in sizes))
    copied = stage_table(members.groupBy("id").agg(F.max(F.expr("int(id = rep)")).alias("own")).where("own = 0").select("id"))
    copies = F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied
    keyed = d.mapInArrow(lambda x: _keys(x, n, percent, boundary, shipped), "id long, n long, keys array<long>, map binary, slack long")
    reps = stage_table(keyed.join(copies, "id", "left_anti"))

    shared = _shared(reps)
    best = shared.where("id <> head").groupBy("id").agg(F.max_by("head", F.struct("keys", -F.col("head"))).alias("head"))
    first = _verify(best.select(F.col("id").alias("a"), F.col("head").alias("b")), reps, d, n, percent)
    comp = connected_components(first)

    pairs = _apart(shared, comp, reps, percent)
    likeliest = pairs.groupBy("a", "cb").agg(F.max_by("b", F.struct("share", -F.col("b"))).alias("b")).select("a", "b")
    linked = _verify(likeliest, reps, d, n, percent)
    comp = _joined(comp, linked)
    rest = _still_apart(pairs.join(likeliest, ["a", "b"], "left_anti").select("a", "b"), comp)
    more = _verify(rest, reps, d, n, percent)
    comp = _joined(comp, more)
    old = [reps, shared, pairs, first, linked, more, copied]
    for partners in (PARTNERS, None):  # a run whose pairs failed names others
        heads = stage_table(_still_apart(pairs.where("more is not null"), comp, "more").select(F.col("more").alias("head")).distinct())
        old.append(heads)
        if heads.head() is None:
            break
        pairs = _apart(shared.join(heads, "head", "left_semi"), comp, reps, percent, partners)
        last = _verify(_still_apart(pairs, comp), reps, d, n, percent)
        comp = _joined(comp, last)
        old += [pairs, last]
    forget(*old)

    every = rows.where("n = 0").select("id", "n", F.col("id").alias("rep")).union(members)
    doubled = every.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")  # one id, several texts
    final = _joined(comp, every.join(doubled.select("id"), "id").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    out = every.join(final.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id, all columns kept.

    Rows with one id and different texts are judged by their texts; of rows
    with the same id and text the first by all columns stays, map columns and
    the like aside. Rows with a null id stay as they are. Inside, a row is
    known by a 64-bit hash of its id and text.
    """
    own = unused("__row", docs.columns)
    rows = docs.where("doc_id is not null").withColumn(own, F.xxhash64("doc_id", "text"))
    found = components(rows.select(F.col(own).alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("row"), F.col("component_id").alias("comp"))
    ids = stage_table(rows.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("id")))
    grouped = found.join(found.where("row <> comp").select("comp").distinct(), "comp").distinct()
    grouped = stage_table(grouped.join(ids, "row").distinct())
    first = grouped.groupBy("comp").agg(F.min(F.struct("id", "row")).alias("first"))
    spare = stage_table(grouped.join(first, "comp").where("row <> first.row").select("row").distinct())
    twice = stage_table(ids.groupBy("row").count().where("count > 1").select("row").join(spare, "row", "left_anti"))
    spare, twice = (F.broadcast(x) if x.count() <= BROADCAST_ROWS else x for x in (spare, twice))
    kept = rows.join(spare, rows[own] == spare["row"], "left_anti")
    once = kept.join(twice, kept[own] == twice["row"], "left_anti").select(*docs.columns)
    again = kept.join(twice, kept[own] == twice["row"], "left_semi")
    again = first_rows(again, own, docs.columns).select(*(F.col(f"`{c}`") for c in docs.columns))
    return once.union(again).union(docs.where("doc_id is null"))
