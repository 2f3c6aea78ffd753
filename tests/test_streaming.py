"""A plan over a file stream gives what it gives over the files."""

import pytest

from graphquarry.engine import Engine
from graphquarry.errors import InvalidArgument
from graphquarry.streaming import query_stream


def test_stream(spark, tmp_path):
    e = Engine(spark)
    e.execute("create node table T (id Int64 primary key, g String)")
    schema = "id long, g string"
    spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], schema).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    out = query_stream(e, "T", stream, "nodes(T) as t | filter t.id > 3 | project t.id as id, t.g as g")
    q = out.writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("streamed").collect()} == {(i, "ab"[i % 2]) for i in range(4, 10)}
    with pytest.raises(InvalidArgument):
        query_stream(e, "T", stream, "nodes(T) as t | limit 3")
