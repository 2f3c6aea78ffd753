"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's target is its share by weight of ``budget`` times all sizes,
stopped at ``cap`` times the source's own size, the excess reshared by weight.
A document of a source with rate r = target / source size is taken floor(r)
times, and once more with the fractional inclusion probability p = r - floor(r).

The cube method settles those fractions: while more units are undecided than
there are constraints, it moves their probabilities along a vector of the
constraints' null space - here the number of documents and the number of words
of the source both stay exactly as they are - until one of them reaches 0 or
1, in one of two directions drawn so that every expectation is kept. It runs
in hashed blocks of a source (so a hot source is many tasks), then over the few
units that each block leaves undecided, and so on; the last few of a source
land by keeping the document total only.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0; rows sharing an id are
drawn separately; rows with the same id, source and text are copies of one row,
of which ``mixed`` writes the first by all columns as often as they are taken
together; extra columns are ignored by ``mix`` and kept by ``mixed``; an empty
table gives an empty table. Draws depend on the rows and the seed only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm.common import WORD, first_rows, stage_table, unused

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
#: Undecided units of a source in one task.
BLOCK = 2048
#: Sources up to which the table of sources is broadcast; beyond, joins shuffle.
BROADCAST_SOURCES = 100_000
SEED = 20_240_601


def _running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """``df`` with running sums of columns in a global order, by ranges of rows.

    Only one row a range meets in one task; the ranges' own rows stay apart.
    """
    at = unused("range", df.columns)
    spread = stage_table(df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), *order).withColumn(at, F.spark_partition_id()))
    lead = spread.groupBy(at).agg(*(F.sum(c).alias(f"of_{n}") for n, c in sums.items()))
    earlier = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    lead = lead.select(at, *(F.coalesce(F.sum(f"of_{n}").over(earlier), F.lit(0)).alias(f"of_{n}") for n in sums))
    inside = Window.partitionBy(at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = spread.join(F.broadcast(lead), at)
    return out.select(*df.columns, *((F.col(f"of_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs and target from per-source totals.

    The resharing settles where target = min(cap * size, level * weight): with
    sources by cap * size / weight, the level is found at the first one that
    its share doesn't fill. Sources are ranked and summed by ranges.
    """
    s = _running(sizes.select("source", "source_size", "n_docs"), [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("full", cap * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("w"))
    s = stage_table(_running(s, [F.col("ratio"), F.col("rank")], {"filled": F.col("full"), "weighed": F.col("w")}))
    total, weight = s.agg(F.sum("source_size"), F.sum("w")).first()
    level = None
    if total:
        share = (budget * F.lit(int(total)) - F.col("filled") + F.col("full")) / (F.lit(float(weight)) - F.col("weighed") + F.col("w"))
        level = s.withColumn("share", share).where("share <= ratio").agg(F.min_by("share", F.struct("ratio", "rank"))).first()[0]
    target = F.col("full") if level is None else F.least(F.col("full"), F.lit(level) * F.col("w"))
    return s.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities after the flight; undecided ones (two at most) stay between 0 and 1.

    With ``land`` the rest settles too: pairs keep the number of documents,
    and a last single unit is drawn.
    """
    p = p.copy()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    eps = 1e-9
    active: list[int] = []

    def settled(i: int) -> bool:
        if p[i] < eps:
            p[i] = 0.0
        elif p[i] > 1 - eps:
            p[i] = 1.0
        else:
            return False
        return True

    def move(units: list[int], u: list[float]) -> list[int]:
        up = down = float("inf")
        for i, v in zip(units, u):
            if v > 0:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < 0:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(units, u):
            p[i] += step * v
        return [i for i in units if not settled(i)]

    for i in range(len(p)):
        if settled(i):
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = (float(size[j]) for j in active)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            top = max(map(abs, u))
            active = move(active, [x / top for x in u])
    if len(active) == 2 and size[active[0]] == size[active[1]]:
        active = move(active, [1.0, -1.0])
    if land:
        if len(active) == 2:
            active = move(active, [1.0, -1.0])
        for i in active:
            p[i] = 1.0 if next(draws) < p[i] else 0.0
    return p


def _settle(df: DataFrame, counts: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """One round of flights over blocks of each source's undecided units."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        # the units that stay undecided are among the last, so the small ones come last
        pdf = pdf.sort_values(["size", "h", "doc_id", "t", "nth"], ascending=[False, True, True, True, True], kind="stable")
        rng = np.random.default_rng([seed, level, int(pdf["h"].iloc[0]) & 0xFFFFFFFF, len(pdf)])
        pdf["p"] = flight(pdf["p"].to_numpy(np.float64), pdf["size"].to_numpy(np.float64), rng, last)
        return pdf[["source", "doc_id", "size", "t", "nth", "h", "base", "p"]]

    keyed = df.join(counts, F.expr("source <=> of"))
    keyed = keyed.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks"))).otherwise(0))
    return keyed.groupBy("source", "block").applyInPandas(fly, "source string, doc_id long, size long, t long, nth long, h long, base int, p double")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame) -> list:
    """What tells rows apart: id, source, size and a hash of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("t")]


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and times of every row."""
    out = _drawn(docs, weights, budget, cap, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "times")


def _drawn(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    d = stage_table(docs.select(*_keyed(docs)))
    goal = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, budget, cap)
    goal = stage_table(goal.withColumnRenamed("source", "of"))
    n_sources, most = goal.agg(F.count("*"), F.max("n_docs")).first()
    few = n_sources <= BROADCAST_SOURCES
    if few:
        goal = F.broadcast(goal)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + 1e-12)
    rows = d.join(goal, F.expr("source <=> of")).withColumn("base", base.cast("int")).withColumn("p", F.greatest(rate - base, F.lit(0.0)))
    # copies of one row are told apart by a count, which needs no ordering of them
    once = rows.groupBy("source", "doc_id", "size", "t").agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("p").alias("p"))
    rows = once.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    open_rows = rows.select("source", "doc_id", "size", "t", "nth", F.xxhash64("doc_id", "size", "t", "nth", F.lit(seed)).alias("h"), "base", "p")
    done, level, many = [], 0, int(most or 0)
    counts = goal.select("of", F.ceil(F.col("n_docs") / BLOCK).alias("blocks"))
    while True:
        last = many <= BLOCK
        out = stage_table(_settle(open_rows, F.broadcast(counts) if few else counts, level, last, seed))
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~undecided))
        if last:
            break
        open_rows = out.where(undecided)
        left = open_rows.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n"))
        left = stage_table(left.withColumnRenamed("source", "of"))
        many = int(left.agg(F.max("n")).first()[0] or 0)
        counts, level = left.select("of", "blocks"), level + 1
    settled = done[0]
    for more in done[1:]:
        settled = settled.union(more)
    times = F.col("base") + F.col("p").cast("int")
    taken = (F.col("size") * times).cast("long").alias("taken")
    return settled.join(goal.select("of", "source_size", "target"), F.expr("source <=> of")).select("doc_id", "source", "size", "t", "source_size", "target", taken, times.alias("times"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every row as often as it is taken, all columns kept."""
    names = {c: unused(f"__{c}", docs.columns) for c in ("doc_id", "source", "size", "t", "n", "times", "row", "copy")}
    n, times, row, copy = (names[c] for c in ("n", "times", "row", "copy"))
    keys = [names[c] for c in ("doc_id", "source", "size", "t")]
    drawn = _drawn(docs, **options).groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    drawn = stage_table(drawn.where("times > 0")).withColumnsRenamed(names)
    own = [c.alias(k) for c, k in zip(_keyed(docs), keys)]
    out = docs.select("*", *own).alias("d").join(drawn.alias("m"), [F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    out = out.select("d.*", n, times)
    single = out.where(F.col(n) == 1)
    several = first_rows(out.where(F.col(n) > 1).withColumn(row, F.struct(*keys)), row, [*docs.columns, times])
    both = single.select(*(F.col(f"`{c}`") for c in docs.columns), times).union(several.drop(row))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long")))).select(*(F.col(f"`{c}`") for c in docs.columns))
