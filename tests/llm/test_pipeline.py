"""The pipeline's stages and every registered query, on small tables and on awkward ones."""

import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline

DIR = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stage_table(stage(spark, docs, DIR))
        assert docs.columns == columns, name
        if name != "mixing sources to target weights":
            assert docs.count() <= n
        n = docs.count()
        assert n > 0
    last = pipeline.STAGES[-1][1](spark, docs, DIR)
    assert last.count() == n and last.where("n_tokens is null").count() == 0


CONTRACT = {
    "op3_ngram_jaccard_join": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")],
    "op4_cross_polytope_search": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op5_byte_bpe": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op6_hashed_maxent": [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")],
    "op7_cube_mixing": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op8_lossless_webp": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")],
    "op9_factorisation_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_registered_queries(spark, name):
    df = entry.queries()[name](spark, DIR)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == k for c, k in CONTRACT.get(name, []))
    got = df.collect()
    docs = {r["doc_id"]: (r["text"] or "", r["source"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    if "doc_id" in kinds:
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(docs.keys())
    for r in got:
        text = docs[r["doc_id"]][0].encode() if "doc_id" in kinds else b""
        if name.startswith("op5"):
            assert r["decoded_sha256"] == sha(text)
        if name.startswith("op6"):
            assert r["n_tokens"] == len(text.split()) + 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0
        if name.startswith("op8"):
            payload = text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        if name.startswith("op9"):
            assert r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
    if name.startswith("op1_"):
        turns = spark.read.parquet(f"{DIR}/conversations.parquet").collect()
        lines = lambda r: [x for x in r["text"].split("\n") if x.strip()]
        assert sum(r["kind"] == "call" for r in got) == sum(len(lines(r)) for r in turns if r["role"] == "user")
        assert {"linked", "unanswered"} <= {r["status"] for r in got} and any(r["errors"] for r in got if r["kind"] == "call") and max(r["level"] for r in got if r["kind"] == "call") > 1
    if name.startswith("op4"):
        x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
        ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        hit = total = 0
        for q in {r["query_id"] for r in got}:
            s = unit @ (x[q] / np.linalg.norm(x[q]))
            best = [i for _, i in sorted((-round(v, 12), i) for v, i in zip(s.tolist(), ids.tolist()) if i != q)[:5]]
            hit, total = hit + len(set(best) & {r["vec_id"] for r in got if r["query_id"] == q}), total + 5
        assert {r["query_id"] for r in got} == {i for i in x if i % 50 == 0} and hit >= 0.9 * total
    if name.startswith("op7"):
        for s in {v[1] for v in docs.values()}:
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own) + 1
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{DIR}/documents.parquet')")
        want = con.execute(entry.oracle_sql()[name])
        at = [df.columns.index(d[0]) for d in want.description]
        assert sorted(tuple(r[i] for i in at) for r in got) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline_equals_its_stages(spark):
    got = pipeline.run(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        docs = docs if i + 1 == len(pipeline.STAGES) else pipeline.stage_table(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, __row string, score string, __times string, __quality_score string, n string, size string"


def awkward(spark, folder, rows):
    """Tables with nulls, repeated rows and ids, empty and long texts, and columns named as helpers are."""
    spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (5, None, None), (7, 1, 0), (8, 0, 1)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, [1.0, 2.0], 1), (50, None, 1), (100, [0.0, 0.0], None), (None, [1.0, 1.0], 1), (150, [1.0, None], 1), (200, [2.0, 4.0], 2), (200, [2.0, 4.0], 2)][: len(rows)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "a\nb"), (1, 1, "assistant", None), (None, None, None, None), (1, 0, "user", "a\nb")][: len(rows)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_every_query_on_awkward_tables(spark, tmp_path):
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (5, " \n ", None, "b", None), (7, long, "de", "a", 5), (7, long, "de", "a", 5), (7, "another text", None, "a", None), (8, "short", None, None, 5), (None, "no id at all", "en", "b", 1), (None, "no id at all", "en", "b", 1), (9, long + " end", "de", "c", 6), (10, "mail a.b@example.com 😀", "en", "c", 1)]
    folder = awkward(spark, tmp_path / "some", rows)
    for name, query in entry.queries().items():
        if name.startswith("op") or name == "pipeline":
            got = query(spark, folder).collect()
            if name in ("op2_feistel_pseudonyms", "op5_byte_bpe", "op6_hashed_maxent", "op7_cube_mixing", "op8_lossless_webp", "op9_factorisation_quality", "op10_licence_dice"):
                assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows), name
            if name.startswith("op3"):
                assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 5: 5, 7: 7, 8: 8, 9: 7, 10: 10} and len(got) == 9
            if name.startswith("op4"):
                assert [(r["query_id"], r["vec_id"]) for r in got if r["query_id"] == 0] == [(0, 200)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    none = awkward(spark, tmp_path / "none", [])
    assert all(query(spark, none).count() == 0 for name, query in entry.queries().items() if name.startswith("op") or name == "pipeline")
