"""Captured sessions: staged labels become final, evaluation sets are locked, exports are put together, and steps run once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import content_digest
from ..sources.commits import CommittedTable
from .labels import annotations_of, lines_of

LOCKS = "set string, images long, digest string"


def stage_labels(labels: DataFrame, path: str) -> None:
    """Write an annotator's labels (session, annotator, stem, text) to the staging table at a path; what the same annotator staged for a session before is replaced."""
    labels.select("session", "annotator", "stem", "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session", "annotator").parquet(path)


def finalize_labels(staged: DataFrame, chosen: DataFrame, path: str) -> DataFrame:
    """Write the labels of each session's chosen annotator (session, annotator) to the table of final labels; returns their counts (session, class_id, boxes)."""
    rows = final_labels(staged, chosen)
    missing = chosen.join(rows.select("session").distinct(), "session", "left_anti").limit(10).collect()
    if missing:
        raise FileNotFoundError(f"nothing staged for {[tuple(r) for r in missing]}")
    rows.select("session", "stem", "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path)
    return label_counts(rows)


def final_labels(staged: DataFrame, chosen: DataFrame) -> DataFrame:
    return staged.join(chosen.select("session", "annotator"), ["session", "annotator"], "left_semi")


def label_counts(labels: DataFrame) -> DataFrame:
    """(session, class_id, boxes) of label files (session, stem, text); lines that don't parse are not counted."""
    return annotations_of(lines_of(labels.select("session", "stem", "text"))).groupBy("session", "class_id").agg(F.count("*").alias("boxes"))


def eval_lock(files: DataFrame, locks: DataFrame) -> DataFrame:
    """What locking a set (set, name, sha) would record: set, images, digest, refused (locked, if locks names it already). A set without files has no row."""
    new = files.groupBy("set").agg(F.count("*").alias("images"), content_digest(F.col("name"), F.col("sha")).alias("digest"))
    return new.join(locks.select("set", F.lit("locked").alias("refused")), "set", "left").select("set", "images", "digest", "refused")


def lock_eval_set(files: DataFrame, name: str, path: str) -> str:
    """Record a set's lock in the committed table at a path and return its digest; a locked or empty set is refused, also if another writer locks it meanwhile."""
    spark, got = files.sparkSession, []

    def build(locks: DataFrame) -> DataFrame:
        got[:] = eval_lock(files.filter(F.col("set") == name), locks).collect()
        if not got:
            raise ValueError(f"{name} is empty")
        if got[0]["refused"]:
            raise ValueError(f"{name} is locked; make a new version")
        return spark.createDataFrame([(name, got[0]["images"], got[0]["digest"])], LOCKS)

    CommittedTable(spark, path, LOCKS).append(build)
    return got[0]["digest"]


def pending(inputs: DataFrame, done: DataFrame, key: str = "name", mark: str = "sha") -> DataFrame:
    """Inputs whose key and content have not been worked on yet, so that a step run twice does its work once."""
    return inputs.join(done.select(key, mark).distinct(), [key, mark], "left_anti")


def consolidated(boxes: DataFrame, exports: DataFrame) -> DataFrame:
    """Boxes (export, class_id, ...) of several exports in one numbering: an export's classes come after those of the exports before it (export, n_classes). The window sees a row per export."""
    offset = F.coalesce(F.sum("n_classes").over(W.orderBy("export").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = exports.select("export", offset.alias("_o"))
    return boxes.join(F.broadcast(starts), "export").withColumn("class_id", F.col("class_id") + F.col("_o")).drop("_o")


def files_by_group(files: DataFrame, key: str, name: str) -> DataFrame:
    """(key, n, files): the names of each group in order."""
    return files.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(name)).alias("files"))
