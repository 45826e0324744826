"""Remapping classes and merging sources: disposition of each image, salvage of labels from copies, links and provenance."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.boxes import iou
from .dedup import small

#: Own captures go first and negatives last, so that what is kept of equals is the better labelled.
PRIORITY = {"custom": 0, "negatives": 2}


def with_aliases(base: DataFrame, aliases: DataFrame) -> DataFrame:
    """A table (name, target) overlaid by another: an alias wins."""
    ranked = base.withColumn("_r", F.lit(1)).union(aliases.withColumn("_r", F.lit(0)))
    return ranked.groupBy("name").agg(F.min_by("target", "_r").alias("target"))


def remap(boxes: DataFrame, table: DataFrame, keys: Sequence[str] = ("source", "name")) -> DataFrame:
    """Boxes with target, their class in the taxonomy by the table (keys, target), which is broadcast if small; null where it is dropped."""
    return boxes.join(small(table), list(keys), "left")


def dropped_counts(remapped: DataFrame, keys: Sequence[str] = ("source", "name")) -> DataFrame:
    return remapped.filter("target is null").groupBy(*keys).agg(F.count("*").alias("dropped"))


def merge_rank(source_kind: Column) -> Column:
    out = F.lit(1)
    for kind, rank in PRIORITY.items():
        out = F.when(source_kind == kind, rank).otherwise(out)
    return out


def merge_order(images: DataFrame, by: Sequence[str]) -> DataFrame:
    """Images with ord, an integer that rises in the order of `by`.

    Ranges are sorted in parallel and numbered by partition, so the order is global without one task that sees all rows; numbers have
    gaps.
    """
    return images.orderBy(*by).withColumn("ord", F.monotonically_increasing_id())


def merge_stats(images: DataFrame) -> DataFrame:
    """Per source: images in all and by disposition (accepted, duplicate, filtered, missing_label)."""
    names = {"accepted": "accepted", "duplicates": "duplicate", "filtered": "filtered", "missing_labels": "missing_label"}
    return images.groupBy("source").agg(F.count("*").alias("total"), *[F.count_if(F.col("disposition") == v).alias(k) for k, v in names.items()])


def salvage(kept: DataFrame, copies: DataFrame, trusted: DataFrame, keys: Sequence[str] = ("image",), threshold: float = 0.9) -> DataFrame:
    """Boxes of dropped exact copies that the kept image lacks.

    kept: keys, class_id, box; copies: the same with source; trusted: (source, class_id). A box of a trusted class moves over unless a kept box of its
    class overlaps it by the threshold. Copies' boxes are not compared with each other.
    """
    fit = copies.join(small(trusted), ["source", "class_id"], "left_semi")
    own = kept.groupBy(*keys, "class_id").agg(F.collect_list("box").alias("own"))
    met = F.exists("own", lambda b: iou(F.col("box"), b) >= threshold)
    return fit.join(own, [*keys, "class_id"], "left").filter(~F.coalesce(met, F.lit(False))).drop("own")


def near_links(copies: DataFrame, trusted: DataFrame, keys: Sequence[str] = ("image", "source")) -> DataFrame:
    """Per kept image and source of a near (not identical) copy: its boxes of trusted classes; copies without one make no link."""
    fit = copies.join(small(trusted), ["source", "class_id"], "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("class_id", F.col("box.cx"), F.col("box.cy"), F.col("box.w"), F.col("box.h"))))
    return fit.groupBy(*keys).agg(listed.alias("boxes"))


def without_provenance(images: DataFrame, provenance: DataFrame, key: str = "image") -> DataFrame:
    """Images that the merge knows nothing of; callers treat any as an error."""
    return images.join(provenance.select(key), key, "left_anti")


def require_empty(found: DataFrame, what: str) -> None:
    """Raise if there is a row; up to ten are named."""
    if some := found.limit(10).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def overlay(base: DataFrame, verified: DataFrame, key: str = "image") -> DataFrame:
    """Base label rows and the verified rows of images that have a base label; bag semantics, duplicates stay."""
    return base.unionByName(verified.join(base.select(key).distinct(), key, "left_semi").select(*base.columns))


def greedy_caps(boxes: DataFrame, group: Sequence[str], image: str, caps: Mapping[int, int], most: int | None = None) -> DataFrame:
    """(group, image) taken: images in order, an image is passed over if any class it shows is at its cap, else all its boxes count.

    The scan of a group is sequential by definition; it streams over sorted rows, one per image (its counts of the capped classes), and
    holds a number per class. A class without a cap never stops an image; after `most` images the rest are passed over.
    """
    held = [F.count_if(F.col("class_id") == c).alias(f"c{i}") for i, c in enumerate(caps)]
    rows = boxes.groupBy(*group, image).agg(*(held or [F.count("*").alias("_n")])).repartition(*group).sortWithinPartitions(*group, image)
    limits, names, keys = list(caps.values()), [f"c{i}" for i in range(len(caps))], [*group]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums, took = None, [], 0
        for frame in frames:
            takes = []
            for *key, counts in zip(*(frame[k] for k in keys), frame[names].to_numpy().tolist(), strict=True):
                if key != own:
                    own, sums, took = key, [0] * len(limits), 0
                free = (most is None or took < most) and not any(n and s >= m for n, s, m in zip(counts, sums, limits, strict=True))
                takes.append(free)
                if free:
                    sums, took = [s + n for s, n in zip(sums, counts, strict=True)], took + 1
            yield frame.loc[takes, [*keys, image]]

    out = ", ".join(f"`{c}` {boxes.schema[c].dataType.simpleString()}" for c in (*keys, image))
    return rows.mapInPandas(scan, out)


def running_cap(images: DataFrame, group: Sequence[str], order: Sequence[str], n: str, cap: int) -> DataFrame:
    """Images in order until the number counted before reaches the cap; exact where nothing is passed over."""
    before = F.coalesce(F.sum(n).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return images.withColumn("_before", before).filter(F.col("_before") < cap).drop("_before")
