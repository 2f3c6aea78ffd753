"""Plans over streaming sources.

The plan language has no windows or watermarks, so what can run on a stream is
what needs no state and no order: scans, filters and projections, and grouped
aggregates without ``limit``, in update or complete mode.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from graphquarry.engine import Snapshot
from graphquarry.errors import InvalidArgument

STATELESS = frozenset({"ScanNodes", "Filter", "Project", "Aggregate"})


def _operators(plan: dict) -> set[str]:
    own = {plan["op"]}
    for side in ("input", "left", "right"):
        if side in plan:
            own |= _operators(plan[side])
    return own


def query_stream(snapshot: Snapshot, table: str, stream: DataFrame, text: str) -> DataFrame:
    """A streaming frame of ``text`` with ``stream`` in the place of ``table``.

    ``stream`` has the table's columns; its rows need no order.
    """
    plan = snapshot.parse(text)
    odd = _operators(plan) - STATELESS
    if odd:
        raise InvalidArgument(f"a stream runs no {', '.join(sorted(odd))}")
    t = snapshot.catalog.node_table(table)
    from pyspark.sql import functions as F

    source = stream.select(*(F.col(f"`{n}`").cast(k.spark()).alias(n) for n, k in t.columns), F.lit(0).cast("long").alias("__ord"))
    live = replace(t, frame=lambda spark: source)
    return Snapshot(snapshot.spark, snapshot.catalog.with_("nodes", t.name, live)).plan(plan, ordered=False)
