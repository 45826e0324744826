"""Quality checks of a data set in YOLO layout: every named check over its label files, image files and splits, as rows and as a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.labels import lines_of
from ..operators.dedup import shared_table, small

#: The checks and how bad an issue of each is, and the pairs of splits that must not share content.
CHECKS = {
    "invalid_yolo_format": "CRITICAL", "invalid_class_ids": "CRITICAL", "bbox_out_of_bounds": "CRITICAL", "zero_area_boxes": "CRITICAL", "duplicate_annotations": "WARNING",
    "unknown_class_names": "WARNING", "missing_label_files": "WARNING", "missing_image_files": "WARNING", "empty_label_files": "WARNING", "inconsistent_pairs": "INFO",
    "corrupted_images": "CRITICAL", "duplicate_images": "WARNING", "train_val_leakage": "CRITICAL", "train_test_leakage": "CRITICAL", "val_test_leakage": "CRITICAL",
}
RANK = {"INFO": 0, "WARNING": 1, "CRITICAL": 2}
LEAKS = (("train", "val"), ("train", "test"), ("val", "test"))


#: Lines that one task puts in order to find those that stood in their file before.
TASK_LINES = 1_000_000


def _dealt(lines: DataFrame, *by: str) -> DataFrame:
    """A written table dealt out by its own counted size, so that a task's share does not grow with the table; as many parts as any shuffle has, at least."""
    held = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(max(held, lines.count() // TASK_LINES + 1), *by)


def _issue(rows: DataFrame, check: str, line: Column | None = None) -> DataFrame:
    """(check, severity, split, file, line) of rows (split, file)."""
    return rows.select(F.lit(check).alias("check"), F.lit(CHECKS[check]).alias("severity"), "split", "file", (F.lit(None) if line is None else line).cast("long").alias("line"))


def line_issues(labels: DataFrame, names: DataFrame, n_classes: int) -> DataFrame:
    """Issues of lines. labels: split, file, text; names: class_id of the classes that have a name.

    A line of another number of fields than five, or with fields that are no finite numbers, has that one issue; of boxes out of bounds a line has one, however many
    coordinates are. A line that stood in its file before is a duplicate whatever else it is.
    """
    lines = shared_table(lines_of(labels.select("split", "file", "text")))
    parts = F.split(F.regexp_replace("raw", r"\s+", " "), " ")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    read = lines.select("split", "file", "line_num", F.size(parts).alias("fields"), F.try_element_at(parts, F.lit(1)).try_cast("int").alias("class_id"), *[number(i).alias(c) for i, c in ((2, "cx"), (3, "cy"), (4, "w"), (5, "h"))])
    finite = reduce(Column.__and__, [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in ("cx", "cy", "w", "h")])
    sound = (F.col("fields") == 5) & F.col("class_id").isNotNull() & finite
    known = read.withColumn("sound", sound).join(small(names.select("class_id", F.lit(True).alias("named"))), "class_id", "left")
    inside = reduce(Column.__and__, [F.col(c).between(0.0, 1.0) for c in ("cx", "cy", "w", "h")])
    valid = F.col("class_id").between(0, n_classes - 1)
    found = F.array_compact(
        F.array(
            F.when(~F.col("sound"), "invalid_yolo_format"), F.when(F.col("sound") & ~valid, "invalid_class_ids"), F.when(F.col("sound") & valid & F.col("named").isNull(), "unknown_class_names"),
            F.when(F.col("sound") & ((F.col("w") <= 0) | (F.col("h") <= 0)), "zero_area_boxes"), F.when(F.col("sound") & ~inside, "bbox_out_of_bounds"),
        )
    )
    each = known.select("split", "file", "line_num", F.explode(found).alias("check"))
    out = each.select("check", _severity(F.col("check")).alias("severity"), "split", "file", F.col("line_num").cast("long").alias("line"))
    first = F.min("line_num").over(W.partitionBy("split", "file", "raw"))
    again = _dealt(lines, "split", "file", "raw").withColumn("_first", first).filter(F.col("line_num") > F.col("_first"))
    return out.unionByName(_issue(again, "duplicate_annotations", F.col("line_num")))


def _severity(check: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair]), check)


def file_issues(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Issues of files. images: split, file, stem, sha, problem (null for a sound image); labels: split, file, stem, text.

    Splits with files of either kind are looked at. Of equal images in a split the first name is no issue; content in two splits is one, at the first name in the first of both.
    """
    stems = lambda df: df.select("split", "stem")  # noqa: E731; not made distinct: an anti join needs none, and a map task would hold all its names
    counts = images.groupBy("split").agg(F.count("*").alias("a")).join(labels.groupBy("split").agg(F.count("*").alias("b")), "split", "full_outer")
    uneven = counts.filter(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))).withColumn("file", F.lit(None).cast("string"))
    firsts = images.filter("sha is not null").groupBy("split", "sha").agg(F.min("file").alias("first"), F.count("*").alias("n"))
    again = images.join(firsts.filter("n > 1"), ["split", "sha"]).filter(F.col("file") != F.col("first"))
    held = firsts.groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("split", "first"))).alias("by"))
    leaks = [_issue(held.filter(F.map_contains_key("by", F.lit(a)) & F.map_contains_key("by", F.lit(b))).select(F.lit(a).alias("split"), F.col("by")[a].alias("file")), f"{a}_{b}_leakage") for a, b in LEAKS]
    return reduce(
        DataFrame.unionByName,
        [
            _issue(images.join(stems(labels), ["split", "stem"], "left_anti"), "missing_label_files"), _issue(labels.join(stems(images), ["split", "stem"], "left_anti"), "missing_image_files"),
            _issue(labels.filter(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""), "empty_label_files"), _issue(uneven, "inconsistent_pairs"),
            _issue(images.filter("problem is not null"), "corrupted_images"), _issue(again, "duplicate_images"), *leaks,
        ],
    )


def annotation_qa(images: DataFrame, labels: DataFrame, names: DataFrame, n_classes: int) -> DataFrame:
    """All issues of a data set: check, severity, split, file, line."""
    return line_issues(labels, names, n_classes).unionByName(file_issues(images, labels))


def qa_status(issues: DataFrame) -> DataFrame:
    """Per check, those without an issue too: check, severity, issues, status (PASS, or the severity of its issues)."""
    spark = issues.sparkSession
    n = issues.groupBy("check").agg(F.count("*").alias("issues"))
    every = spark.createDataFrame(list(CHECKS.items()), "check string, severity string")
    status = F.when(F.col("issues") == 0, "PASS").otherwise(F.col("severity"))
    return every.join(n, "check", "left").fillna(0, ["issues"]).withColumn("status", status)


def qa_exit_code(issues: DataFrame) -> DataFrame:
    """One row, code: 1 with a critical issue, else 2 with a warning, else 0."""
    worst = F.coalesce(F.max(F.try_element_at(F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair]), F.col("severity"))), F.lit(0))
    return issues.agg(F.element_at(F.array(F.lit(0), F.lit(2), F.lit(1)), worst + 1).alias("code"))
