"""The star-schema tables as a property graph, read from Parquet.

Money and quantities become Decimal(15,2), integers Int64, and places get
coordinates derived from keys, so that exact arithmetic and radius search have
something to work on.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry import types as L
from graphquarry.sources.catalog import Catalog, Interface, NodeTable, RelTable

NODES = {
    "Region": ("region", "r_regionkey"),
    "Nation": ("nation", "n_nationkey"),
    "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"),
    "Orders": ("orders", "o_orderkey"),
    "Event": ("events", "event_id"),
    "Document": ("documents", "doc_id"),
    "Embedding": ("embeddings", "vec_id"),
    "Page": ("pages", "page_id"),
    "Benchmark": ("benchmark", "item_id"),
    "Label": ("labels", "doc_id"),
}
MONEY = frozenset("c_acctbal s_acctbal p_retailprice o_totalprice value l_quantity l_extendedprice l_discount l_tax".split())
#: name: (file, from column, to column, from table, to table, property columns)
RELS = {
    "InRegion": ("nation", "n_nationkey", "n_regionkey", "Nation", "Region", ()),
    "CustomerNation": ("customer", "c_custkey", "c_nationkey", "Customer", "Nation", ()),
    "SupplierNation": ("supplier", "s_suppkey", "s_nationkey", "Supplier", "Nation", ()),
    "Placed": ("orders", "o_custkey", "o_orderkey", "Customer", "Orders", ()),
    "Contains": ("lineitem", "l_orderkey", "l_partkey", "Orders", "Part", ("l_linenumber", "l_quantity", "l_returnflag")),
    "SuppliedBy": ("lineitem", "l_orderkey", "l_suppkey", "Orders", "Supplier", ("l_linenumber", "l_returnflag")),
    "Did": ("events", "user_id", "event_id", "Customer", "Event", ("event_type",)),
    "Follows": ("customer", "c_custkey", "c_next", "Customer", "Customer", ("weight",)),
}
NAMEABLE = {"Region": "r_name", "Nation": "n_name", "Customer": "c_name", "Supplier": "s_name", "Part": "p_name"}


def _logical(name: str, t: T.DataType) -> L.Type:
    if name in MONEY:
        return L.decimal(15, 2)
    if isinstance(t, T.ArrayType):
        return L.vector(64)
    return L.from_spark(t)


def graph(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog over the files of one folder; nothing is read but their schemas."""
    seen: dict = {}

    def raw(file):
        if file not in seen:
            seen[file] = spark.read.parquet(f"{sf_dir}/{file}.parquet")
        return seen[file]

    out = Catalog()
    for name, (file, key) in NODES.items():
        columns = [(f.name, _logical(f.name, f.dataType)) for f in raw(file).schema.fields]
        derived = []
        if name in NAMEABLE:
            derived.append(("name", L.STRING, F.col(NAMEABLE[name])))
        if name == "Customer":
            lat, lng = F.pmod(F.col("c_custkey") * 37, F.lit(18000)) / 100 - 90, F.pmod(F.col("c_custkey") * 91, F.lit(36000)) / 100 - 180
            derived.append(("place", L.GEOPOINT, F.struct(lat.alias("lat_deg"), lng.alias("lng_deg"))))

        def frame(spark, file=file, key=key, columns=tuple(columns), derived=tuple(derived)):
            cols = [F.col(n).cast(k.spark()).alias(n) for n, k in columns] + [c.cast(k.spark()).alias(n) for n, k, c in derived]
            return raw(file).select(*cols, F.col(key).cast("long").alias("__ord"))

        out = out.with_("nodes", name, NodeTable(name, (*columns, *((n, k) for n, k, _ in derived)), key, frame))

    def lines(spark):
        df = raw("lineitem")
        cols = [F.col(f.name).cast(_logical(f.name, f.dataType).spark()).alias(f.name) for f in df.schema.fields]
        return df.select(F.col("_metadata.row_index").alias("line_id"), *cols, F.col("_metadata.row_index").alias("__ord"))

    columns = (("line_id", L.INT64), *((f.name, _logical(f.name, f.dataType)) for f in raw("lineitem").schema.fields))
    out = out.with_("nodes", "Lineitem", NodeTable("Lineitem", columns, "line_id", lines))
    turns = (("id", L.STRING), ("conv_id", L.INT64), ("turn", L.INT64), ("role", L.STRING), ("text", L.STRING))
    out = out.with_("nodes", "Turn", NodeTable("Turn", turns, "id", lambda spark: raw("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "conv_id", "turn", "role", "text", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("__ord"))))

    for name, (file, a, b, source, target, props) in RELS.items():
        kinds = {"l_quantity": L.FLOAT64, "weight": L.INT64, "l_linenumber": L.INT64}
        columns = tuple((p, kinds.get(p, L.STRING)) for p in props)

        def frame(spark, file=file, a=a, b=b, columns=columns):
            df = raw(file)
            at = F.col("l_orderkey") * 100 + F.col("l_linenumber") if file == "lineitem" else F.col(a if file != "orders" else b)
            if "c_next" in (a, b):
                df = df.withColumn("c_next", F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey")).otherwise(F.floor(F.col("c_custkey") / 2) + 1)).withColumn("weight", F.col("c_custkey") % 7)
            if file == "events":
                at = F.col("event_id")
            return df.select(F.col(a).cast("long").alias("__from"), F.col(b).cast("long").alias("__to"), *(F.col(p).cast(k.spark()).alias(p) for p, k in columns), at.cast("long").alias("__ord"))

        out = out.with_("rels", name, RelTable(name, source, target, columns, frame))
    out = out.with_("interfaces", "Nameable", Interface("Nameable", (("name", L.STRING),)))
    out = out.with_("interfaces", "Dormant", Interface("Dormant", (("name", L.STRING),)))
    for name in NAMEABLE:
        out = out.with_("classes", name, {"implements": ("Nameable",), "label": "name"})
    return out
