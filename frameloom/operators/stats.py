"""Counts, imbalance, coverage, calibration, quality and differences between builds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import coverage_score, f1, ratio
from .dedup import small


def class_counts(boxes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return boxes.groupBy(*by, "class_id").agg(F.count("*").alias("boxes"))


def split_stats(boxes: DataFrame, taxonomy: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Per split and class of the taxonomy, zeros included: boxes and distinct images. The grid of splits and classes is small and broadcast."""
    found = boxes.groupBy("split", "class_id").agg(F.count("*").alias("boxes"), F.countDistinct("image").alias("images"))
    grid = taxonomy.select("class_id", F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    none = F.lit(0).cast("long")
    return F.broadcast(grid).join(found, ["split", "class_id"], "left").select("split", "class_id", F.coalesce("boxes", none).alias("boxes"), F.coalesce("images", none).alias("images"))


def dense(counts: DataFrame, taxonomy: DataFrame, value: str = "boxes") -> DataFrame:
    """counts (class_id, value) with a row for every class of the taxonomy."""
    return taxonomy.select("class_id").join(counts, "class_id", "left").select("class_id", F.coalesce(value, F.lit(0)).cast("long").alias(value))


def imbalance(counts: DataFrame, value: str = "boxes") -> DataFrame:
    """One row over classes (a row each): largest, smallest above 0, their ratio, and Gini, by ranks instead of all pairs. The window sees one row per class."""
    nth = F.row_number().over(W.orderBy(value, "class_id"))
    n = F.count("*").over(W.partitionBy())
    ranked = counts.select(F.col(value).cast("double").alias("x"), (2 * nth - n - 1).alias("weight"), n.alias("n"))
    some = F.min(F.when(F.col("x") > 0, F.col("x")))
    total = F.sum("x")
    gini = F.when(total > 0, F.sum(F.col("weight") * F.col("x")) / (F.max("n") * total)).otherwise(F.lit(0.0))
    return ranked.agg(F.max("x").alias("largest"), some.alias("smallest"), F.round(F.max("x") / some, 1).alias("max_ratio"), F.round(gini, 4).alias("gini"))


def share_of(counts: DataFrame, by: Sequence[str], value: str = "boxes") -> DataFrame:
    """counts with pct, the share of their `by` group in percent to two places."""
    total = counts.groupBy(*by).agg(F.sum(value).alias("_total"))
    return counts.join(small(total), list(by)).withColumn("pct", F.round(100 * F.col(value) / F.greatest("_total", F.lit(1)), 2)).drop("_total")


def calibration(matches: DataFrame) -> DataFrame:
    """Per class: tp, fp, fn, cells, precision and recall; null where nothing was measured, which is not 0."""
    sums = matches.groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("cells"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4)})


def unverified_cells(candidates: DataFrame, images: DataFrame, trusted: DataFrame, verified: DataFrame) -> DataFrame:
    """Candidates of known images in cells (image, class_id) that are neither trusted nor verified."""
    open_ = candidates.join(images.select("image"), "image", "left_semi")
    return open_.join(trusted.select("image", "class_id"), ["image", "class_id"], "left_anti").join(verified.select("image", "class_id"), ["image", "class_id"], "left_anti")


def coverage_by_class(annotated: DataFrame, unverified: DataFrame, calibrated: DataFrame, priors: DataFrame, taxonomy: DataFrame, default: float = 0.35) -> DataFrame:
    """Per class of the taxonomy: annotated, unverified, precision used (calibrated, else prior, else default), residual, score.

    annotated and unverified are boxes; they are counted before the joins, which then see a row per class.
    """
    a = annotated.groupBy("class_id").agg(F.count("*").alias("annotated"))
    u = unverified.groupBy("class_id").agg(F.count("*").alias("unverified"))
    rows = taxonomy.select("class_id").join(a, "class_id", "left").join(u, "class_id", "left").join(calibrated.select("class_id", "precision"), "class_id", "left").join(priors.select("class_id", "prior"), "class_id", "left")
    rows = rows.select("class_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("annotated", "unverified")], F.coalesce("precision", "prior", F.lit(float(default))).alias("precision"))
    residual = F.col("unverified") * F.col("precision")
    return rows.withColumns({"residual": F.round(residual, 4), "score": F.round(coverage_score(F.col("annotated"), residual), 4)})


def coverage_by_image(annotated: DataFrame, unverified: DataFrame, precision: DataFrame, default: float = 0.35) -> DataFrame:
    """Per image of either: annotated, estimated (its open candidates, each by its class's precision) and score."""
    a = annotated.groupBy("image").agg(F.count("*").alias("annotated"))
    weight = F.coalesce("precision", F.lit(float(default)))
    e = unverified.join(small(precision.select("class_id", "precision")), "class_id", "left").groupBy("image").agg(F.sum(weight).alias("estimated"))
    both = a.join(e, "image", "full_outer").select("image", F.coalesce("annotated", F.lit(0)).alias("annotated"), F.round(F.coalesce("estimated", F.lit(0.0)), 4).alias("estimated"))
    return both.withColumn("score", F.round(coverage_score(F.col("annotated"), F.col("estimated")), 4))


def nearest_decile(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, below_half, and p10, the element at index int(n / 10) of the values in order, not interpolated.

    Values are counted before they are ranked: the window sees the distinct values, not the rows.
    """
    held = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = held.select("v", "c", F.sum("c").over(W.orderBy("v")).alias("upto"), F.sum("c").over(W.partitionBy()).alias("n"))
    p10 = F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.1), F.col("v")))
    return upto.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 4).alias("mean"), p10.alias("p10"), F.coalesce(F.sum(F.when(F.col("v") < 0.5, F.col("c"))), F.lit(0)).alias("below_half"))


def backend_decision(calibrated: DataFrame, priority: DataFrame, least: float) -> DataFrame:
    """One row: defer if no priority class (class_id) is calibrated, recommend another backend if one's precision is below least, else keep."""
    own = priority.select("class_id").join(calibrated.select("class_id", "precision"), "class_id", "left")
    low = F.coalesce(F.bool_or(F.col("precision") < least), F.lit(False))
    return own.agg(F.count("precision").alias("calibrated"), F.when(F.count("precision") == 0, "defer").when(low, "recommend").otherwise("keep").alias("decision"))


def full_delta(before: DataFrame, after: DataFrame, key: str, value: str, missing_is_zero: bool = False) -> DataFrame:
    """Per key of either side: before, after, delta. A missing side is null and so is the difference, or both count as 0."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    if missing_is_zero:
        both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "after")})
    return both.withColumn("delta", F.col("after") - F.col("before"))


def shortfall(counts: DataFrame, floor: int, value: str = "boxes") -> DataFrame:
    return counts.filter(F.col(value) < floor).withColumn("missing", floor - F.col(value))


def mean_and_deviation(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation (0 of a single row), to three places."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 3).alias("deviation"))


def within_budget(measured: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Per limit: PASS, FAIL, or N/A where nothing was measured."""
    both = limits.join(measured, key, "left")
    return both.withColumn("verdict", F.when(F.col("value").isNull(), "N/A").when(F.col("value") <= F.col("limit"), "PASS").otherwise("FAIL"))


def confusion(pairs: DataFrame, classes: Sequence) -> DataFrame:
    """A row per predicted class and a column per true one."""
    return pairs.groupBy("predicted").pivot("truth", list(classes)).count().na.fill(0)


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Per class of either side of (predicted, truth): tp, fp, fn, precision, recall, f1; a null side is a box without a partner."""
    a = pairs.filter("predicted is not null").groupBy(F.col("predicted").alias("class")).agg(F.count_if(F.col("predicted").eqNullSafe(F.col("truth"))).alias("tp"), F.count_if(~F.col("predicted").eqNullSafe(F.col("truth"))).alias("fp"))
    b = pairs.filter("truth is not null").groupBy(F.col("truth").alias("class")).agg(F.count_if(~F.col("predicted").eqNullSafe(F.col("truth"))).alias("fn"))
    both = a.join(b, "class", "full_outer").select("class", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return both.withColumns({"precision": p, "recall": r, "f1": f1(p, r)})


def latency_summary(frames: DataFrame, by: Sequence[str], ms: str) -> DataFrame:
    avg = F.avg(ms)
    return frames.groupBy(*by).agg(F.count("*").alias("frames"), F.round(avg, 3).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.round(F.when(avg > 0, 1000 / avg).otherwise(F.lit(0.0)), 3).alias("fps"))


def worst(rank: Column, names: tuple[str, ...] = ("PASS", "WARN", "FAIL")) -> Column:
    """Aggregate: the name of the highest rank; the lowest name of nothing."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce(F.max(rank), F.lit(0)) + 1)
