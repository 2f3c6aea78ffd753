"""The registered queries of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphquarry.llm import ann, bpe, chat, jaccard, licences, maxent, mixing, pii, quality, webp
from graphquarry.llm.common import table


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no tool calls, so each line of a user's turn is made one (``chat.derived``)."""
    return chat.link(chat.derived(table(spark, sf_dir, "conversations")), chat.LINE_SCHEMAS)


def op4_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), pii.key_of(spark))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(table(spark, sf_dir, "documents"))


def op10_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), windows=True)


def op9_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op1_tool_call_linking": op1_tool_call_linking,
    "op4_cross_polytope_search": op4_cross_polytope_search,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_hashed_maxent": op6_hashed_maxent,
    "op7_cube_mixing": op7_cube_mixing,
    "op8_lossless_webp": op8_lossless_webp,
    "op10_licence_dice": op10_licence_dice,
    "op9_factorisation_quality": op9_factorisation_quality,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rest holds trained models, draws, codes or hashes that SQL can't express; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    # every pair that shares a shingle, and all that can be reached by links
    "op3_ngram_jaccard_join": rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS t FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS least FROM e UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.least), d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = d.doc_id GROUP BY d.doc_id""",
}
