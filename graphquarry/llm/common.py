"""Shared helpers: shared-folder tables, sorted-stream grouping, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.sources.shared import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Small rows of one file.
FILE_ROWS = 50_000
#: Bytes of one file, as Spark estimates a table before it is made.
FILE_BYTES = 32 << 20
#: Rows of one batch for Python.
ARROW_ROWS = 3000


def small_batches(spark: SparkSession) -> None:
    """Rows go to and from Python ARROW_ROWS at a time, unless the session has chosen a number.

    A batch's buffers are allocated outside the heap and whole texts are long,
    so Spark's usual number of rows takes hundreds of megabytes a task.
    """
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, str(ARROW_ROWS))


def stage_table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return what was written.

    This cuts lineage: later jobs reread the files, so losing an executor
    never recomputes (or changes) what has been written. Of a table that is
    known to have about ``rows`` small rows, or that Spark takes to be small,
    few files are made: four a core, or as many as hold FILE_BYTES each.
    """
    spark = df.sparkSession
    path = scratch(spark)
    if rows is None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        df = df.coalesce(min(2**31 - 1, max(4 * spark.sparkContext.defaultParallelism, size // FILE_BYTES)))
    else:
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what ``stage_table`` wrote, where nothing that is still to run reads it."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with as many underscores as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_rows(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``by`` and ``columns`` of the first row by all columns of each value of ``by``; unordered kinds don't count."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    order = F.struct(*(F.col(f"`{c}`") for c in columns if "map<" not in kinds[c] and "variant" not in kinds[c]))
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    return df.groupBy(by).agg(F.min_by(whole, order).alias("first")).select(by, "first.*")


def sorted_runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Group a stream sorted by ``keys``; only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        edges = [0, *starts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in cols)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current = [], key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex of an undirected graph.

    ``edges`` has long columns ``a`` and ``b``. Alternates large-star and
    small-star steps, which need O(log^2 n) rounds and never gather a
    neighbourhood: each step is a partially aggregated minimum joined back to
    the edges. Returns ``id`` and ``comp`` for vertices that have edges, as a
    staged table.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stage_table(e)
    size, before = e.count(), None
    if not size:
        forget(e)
        return stage_table(edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).limit(0))
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m2 = least(large)
        small = large.join(m2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(m2.select("u", F.col("m").alias("v"))).distinct()
        earlier, e = e, stage_table(small, 2 * size)  # a star has no more edges than the graph, plus its vertices
        forget(earlier)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    out = stage_table(e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots.select("id", F.col("id").alias("comp"))), 2 * size)
    forget(e)
    return out
