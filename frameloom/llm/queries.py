"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, licenses, mixing, ngram_lm, phrases, pieces, quality, simhash, substrings, topk, vector_codes
from .common import bound_batches
from .common import read_table as read


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The queries are an application: they bound the session's Arrow batches before texts go to Python."""
    bound_batches(spark)
    return read(spark, sf_dir, name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.QUERY_EVERY == 0)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for every fifty of a source. Half of the documents that mention a licence are licence files, of their directory or of the whole source."""
    cued, i = F.coalesce(F.col("text").rlike(licenses.CUE), F.lit(False)), F.col("doc_id")
    folder = F.when(cued & (i % 6 == 0), "").otherwise(F.concat(F.lit("/"), F.expr("doc_id div 50").cast("string")))
    name = F.when(cued & (i % 2 == 0), "LICENSE").otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.concat(F.coalesce("source", F.lit("unknown")), folder, F.lit("/"), name)
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"), path, ["doc_id"])


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), bpe.default_path())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(quality.fit_sample(docs, read_table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, model)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(language_id.fit_sample(docs)))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_by_own_model(read_table(spark, sf_dir, "documents"))


def op11_piece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), pieces.default_path())


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_topk_search, op3_simhash_near_dedup, op4_suffix_dedup, op5_license_scan, op6_bpe_roundtrip, op7_exact_dedup, op8_quality_classifier, op9_language_id, op10_lm_scoring,
        op11_piece_roundtrip, op12_phrase_collocations, op13_vector_codes,
    )
}
SQL: dict[str, str] = {
    "op1_mix_sources": mixing.OP1_SQL, "op2_topk_search": topk.OP2_SQL, "op4_suffix_dedup": substrings.OP4_SQL, "op5_license_scan": licenses.OP5_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL,
}
