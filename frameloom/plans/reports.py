"""Composed reports: each a few operators in a row, DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import ratio
from ..operators.dedup import THRESHOLD, keep_in_order, shared_table
from ..operators.stats import full_delta


def merge(images: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Images (image, source, ord, has_label, reason, sha, h, flip) with disposition and duplicate_of.

    In this order: without a label, filtered for a reason, duplicate of one that was kept before, accepted. Only what passed the first
    two takes part in dedup, whose result depends on the order; so their result is written before it.
    """
    early = F.when(~F.col("has_label"), "missing_label").when(F.col("reason").isNotNull(), "filtered")
    staged = shared_table(images.withColumn("early", early))
    kept = keep_in_order(staged.filter("early is null").select("ord", "h", "flip", "sha"), threshold)
    fate = F.coalesce("early", F.when(F.col("kept"), "accepted").otherwise("duplicate"))
    return staged.join(kept, "ord", "left").select("image", "source", fate.alias("disposition"), "duplicate_of")


def quality(by_class: DataFrame, by_image: DataFrame, verified: DataFrame, resolved: DataFrame, n_classes: int) -> DataFrame:
    """One row of figures from coverage by class and image, verified cells and resolved policies."""
    a = by_class.agg(F.sum("annotated").alias("annotated"), F.round(F.sum("residual"), 2).alias("residual"), F.round(F.avg("score"), 4).alias("class_score"))
    b = by_image.agg(F.count("*").alias("images"), F.round(F.avg("score"), 4).alias("image_score"))
    c = verified.agg(F.count("*").alias("verified_cells"))
    d = resolved.agg(F.round(1 - F.avg(F.size("ids")) / n_classes, 4).alias("masked_fraction"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # of one row each


def split_summary(files: DataFrame) -> DataFrame:
    """Per split: files and their share in percent."""
    n = files.groupBy("split").agg(F.count("*").alias("files"))
    total = n.agg(F.sum("files").alias("_t"))
    return n.crossJoin(total).select("split", "files", F.round(100 * F.col("files") / F.col("_t"), 2).alias("pct"))


def completeness(images: DataFrame, policies: DataFrame, splits: DataFrame) -> DataFrame:
    """The completeness artefact's rows: image, policy, ids and split of each image (image, policy), joined with its policy (policy, ids) and its split (image, split); unknown ones are null."""
    return images.select("image", "policy").join(policies.select("policy", "ids"), "policy", "left").join(splits.select("image", "split"), "image", "left").select("image", "policy", "ids", "split")


def coverage(by_class: DataFrame, by_image: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: annotated and residual in all, the score of all, the weakest class, and images in all and below a score."""
    total = F.sum("annotated") + F.sum("residual")
    a = by_class.agg(F.sum("annotated").alias("annotated"), F.round(F.sum("residual"), 3).alias("residual"), F.round(F.when(total > 0, F.sum("annotated") / total).otherwise(1.0), 4).alias("score"), F.min(F.struct("score", "class_id"))["class_id"].alias("weakest"))
    return a.crossJoin(by_image.agg(F.count("*").alias("images"), F.count_if(F.col("score") < least).alias("low")))  # of one row each


def comparison(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Per key of either build: before, after, delta, percent (null where there was nothing) and change: added, removed, more, fewer or same."""
    both = full_delta(before, after, key, value, missing_is_zero=True)
    change = F.when(F.col("before") == 0, F.when(F.col("after") > 0, "added").otherwise("same")).when(F.col("after") == 0, "removed").when(F.col("delta") > 0, "more").when(F.col("delta") < 0, "fewer").otherwise("same")
    return both.select(key, "before", "after", "delta", F.round(ratio(100 * F.col("delta"), F.col("before")), 2).alias("percent"), change.alias("change"))
