"""Bulk loading of CSV and Parquet with strict headers and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.errors import InvalidArgument, NotFound
from graphquarry.functions import vectors
from graphquarry.types import Type, from_spark

#: Stands for a quoted empty field, which CSV readers else can't tell from none.
EMPTY = "\u0001E"


def _first_bytes(spark: SparkSession, path: str) -> bytes:
    """The first four bytes of a file, or of the first file of a folder; nothing more is read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    if not found:
        raise NotFound(f"{path} does not exist")
    status = found[0]
    while status.isDirectory():
        inside = [s for s in fs.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        if not inside:
            return b""
        status = sorted(inside, key=lambda s: s.getPath().getName())[0]
    stream = fs.open(status.getPath())
    try:
        return bytes(x for x in (stream.read() for _ in range(4)) if x >= 0)
    finally:
        stream.close()


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field holds a line break: some line has an odd number of quotes then."""
    line = F.col("value")
    return spark.read.text(path).where((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1).head() is not None


def _vector(c, kind: Type, name: str):
    """A bracketed list of finite numbers, as long as the type says."""
    n = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: not a {kind}: "), c)).cast("array<float>")
    got = F.transform(F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ","), lambda x: x.cast("float"))
    read = F.when(c.rlike(rf"^\s*\[\s*{n}(?:\s*,\s*{n})*\s*\]\s*$"), got).otherwise(wrong)
    fits = F.forall(read, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    if kind.a:
        fits = fits & (F.size(read) == kind.a)
    return F.when(c.isNull(), F.lit(None).cast("array<float>")).otherwise(F.when(fits, read).otherwise(wrong))


def _stored(c, kind: Type, name: str):
    """A loaded column as the table keeps it: vectors checked and in their encoding."""
    c = c.cast(kind.spark())
    if kind.kind != "Vector":
        return c
    wrong = F.raise_error(F.lit(f"column {name}: a row's vector is no {kind}")).cast("array<float>")
    fits = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(c) == kind.a if kind.a else F.lit(True))
    return vectors.quantised_column(F.when(c.isNull() | fits, c).otherwise(wrong), kind.encoding)


def _typed(c, kind: Type, name: str):
    """A CSV field as its column's type; unreadable text raises an error."""
    if kind.kind == "String":
        return F.when(c == EMPTY, "").otherwise(c)
    c = F.when(c == EMPTY, F.raise_error(F.lit(f"column {name}: an empty string is no {kind}"))).otherwise(c)

    def checked(value, pattern):
        return F.when(c.isNull(), F.lit(None)).when(c.rlike(pattern), value).otherwise(F.raise_error(F.concat(F.lit(f"column {name}: not a {kind}: "), c)))

    if kind.kind == "Bool":
        return checked(c == "true", "^(true|false)$").cast("boolean")
    if kind.kind == "Int64":
        return checked(c.cast("bigint"), r"^-?\d+$").cast("bigint")
    if kind.kind == "Float64":
        return checked(c.cast("double"), r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$").cast("double")
    if kind.kind == "Decimal":
        text = F.regexp_extract(c, r'^(?:decimal\(")?(-?\d+(?:\.\d+)?)(?:"\))?$', 1)
        return F.when(c.isNull(), F.lit(None)).otherwise(text.cast(kind.spark())).cast(kind.spark())
    if kind.kind == "Timestamp":
        text = F.regexp_replace(F.regexp_replace(c, r'^timestamp\("|"\)$', ""), "Z$", "")
        return text.cast("timestamp_ntz")
    if kind.kind == "Vector":
        return vectors.quantised_column(_vector(c, kind, name), kind.encoding)
    if kind.kind == "GeoPoint":
        n = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
        pattern = rf"^geo\(\s*{n}\s*,\s*{n}\s*\)$"
        return F.when(c.isNotNull(), F.struct(F.regexp_extract(c, pattern, 1).cast("double").alias("lat_deg"), F.regexp_extract(c, pattern, 2).cast("double").alias("lng_deg")))
    if kind.kind == "Bytes":
        return F.unbase64(F.regexp_replace(c, r'^bytes\("|"\)$', ""))
    return c  # Json stays text


def read(spark: SparkSession, path: str, columns: list[tuple[str, Type]]) -> DataFrame:
    """The file's rows with exactly ``columns``; chosen by its first bytes, not its name."""
    if _first_bytes(spark, path) == b"PAR1":
        df = spark.read.parquet(path)
        names = set(df.columns)
        for name, kind in columns:
            if name not in names:
                raise InvalidArgument(f"{path} has no column {name}")
            got = from_spark(df.schema[name].dataType)
            if got.kind != kind.kind or kind.kind == "Decimal" and (got.a, got.b) != (kind.a, kind.b):
                raise InvalidArgument(f"column {name} is {got} in {path}, the table has {kind}")
        if names != {n for n, _ in columns}:
            raise InvalidArgument(f"{path} has other columns: {', '.join(sorted(names - {n for n, _ in columns}))}")
        return df.select(*(_stored(F.col(f"`{n}`"), k, n).alias(n) for n, k in columns))
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=_spans_lines(spark, path), nullValue="", emptyValue=EMPTY, enforceSchema=False)
    wanted = [n for n, _ in columns]
    if sorted(df.columns) != sorted(wanted):
        raise InvalidArgument(f"the header is {', '.join(df.columns)}; it must name each of {', '.join(wanted)} once")
    return df.select(*(_typed(F.col(f"`{n}`"), k, n).alias(n) for n, k in columns))
