"""Training-data pipeline: quality filter, near-duplicate removal, pseudonyms, source mix, tokens.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; ``run`` writes each
stage's rows as Parquet to the shared folder and rereads them for the next.
All stages but the last return the columns of ``documents``.

Defined results: each operator's own for null, empty and very long texts, ties
and repeated rows; rows with a null id go through every stage (they have no
label and are no copies of each other); extra columns are kept by all stages
but the last, whatever their names; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import bpe, jaccard, mixing, pii, quality
from graphquarry.llm.common import forget, stage_table, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by 5-word shingles at 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by format-preserving pseudonyms.

    ``n_chars`` stays right because every pseudonym is as long as its original
    (only addresses and dates with names may change by a few characters, so it is counted anew).
    """
    out = pii.pseudonymise(docs, pii.key_of(spark))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the documents so that the sources reach their target weights."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every drawn document."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pseudonym_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: The stages hold a trained model, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        earlier, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage_table(docs)
            forget(earlier)
    return docs
