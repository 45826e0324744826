"""The corpus pipeline: five stages, each a table of documents in and out; the last returns the encoded documents.

Every stage works on all that its predecessor kept. run() writes each stage's result to the shared folder and reads it back
for the next, so that a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import bpe, exact_dedup, jaccard, mixing, quality
from frameloom.llm.common import bound_batches, discard, materialize, read_table

#: The stages learn from labels and hash with seeds that DuckDB lacks; tests hold them against brute force.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents that the compression classifier does not reject.

    Null and empty texts are judged by the curve at 0; rows that repeat an id are judged one by one; without labels none is rejected;
    an empty table stays empty; other columns pass through.
    """
    bound_batches(spark)
    model = quality.fit(quality.fit_sample(docs, read_table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts, the row with the smallest doc_id; null ids are last, null and empty texts are equal, other columns pass through."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies, as operator 3 but at a share of 0.8 or more of five-word shingles: of linked texts, the row with the smallest doc_id.

    Texts without a word stay; rows that repeat an id are told apart by their texts; null ids are last; other columns pass through.
    """
    bound_batches(spark)
    return jaccard.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mix takes it; a null source is one of its own, a null text has size 0, rows that repeat an id share one draw."""
    return mixing.mix_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids of every document, and digests of ids and decoded text; a null text is encoded as the empty one, repeated rows give repeated results."""
    bound_batches(spark)
    return bpe.encode_documents(docs, bpe.default_path(), with_ids=True)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids", F.concat_ws(" ", F.col("ids").cast("array<string>")))
