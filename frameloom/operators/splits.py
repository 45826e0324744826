"""Splits into train, val and test that keep groups whole.

The order is that of md5(seed, key), so it is the same on any cluster and in SQL. Cut points need counts, not a global sort in one task: groups
are ranked by range partitions (see ranked), and only the number of groups passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import house, house_key

RATIOS = (0.8, 0.1)
NAMES = ("train", "val", "test")
#: Buckets in which groups are counted before they are ranked; each is small even of a billion groups.
BUCKETS = 4096


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(rows: DataFrame, order: Column) -> DataFrame:
    """rows with rank, from 1, in the order of a hex digest (then their key `group_key`).

    The digest's first three digits deal rows to buckets; the buckets' counts, a table of fixed size, give each its offset, and
    ranks are counted inside the buckets. So no task sees all rows.
    """
    dealt = rows.withColumn("_d", order).withColumn("_b", F.substring("_d", 1, 3))
    counts = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = counts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_o"))  # at most BUCKETS rows
    within = F.row_number().over(W.partitionBy("_b").orderBy("_d", "group_key"))
    return dealt.join(F.broadcast(offsets), "_b").withColumn("rank", F.col("_o") + within).drop("_d", "_b", "_o")


def _sliced(rank: Column, n: Column, ratios: tuple[float, float]) -> Column:
    train, val = F.bround(n * ratios[0]), F.bround(n * ratios[1])
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def group_aware(files: DataFrame, seed: int = 42, ratios: tuple[float, float] = RATIOS) -> DataFrame:
    """(group_key, split): groups in shuffled order cut by the ratios (half to even), the rest to test."""
    groups = files.select("group_key").distinct()
    n = groups.agg(F.count("*").cast("double").alias("_n"))
    return ranked(groups, shuffled(F.col("group_key"), seed)).crossJoin(F.broadcast(n)).select("group_key", _sliced(F.col("rank"), F.col("_n"), ratios).alias("split"))


def leave_houses_out(files: DataFrame, holdout: list[str], seed: int = 42, ratios: tuple[float, float] = RATIOS) -> DataFrame:
    """(group_key, super_key, split): groups of one house stay together; houses held out are the test set, the rest is cut by train to val."""
    groups = files.select("group_key").distinct().withColumns({"super_key": house_key(F.col("group_key")), "house": house(F.col("group_key"))})
    out = F.coalesce(F.col("house").isin(*holdout), F.lit(False)) if holdout else F.lit(False)
    pool = groups.filter(~out).select(F.col("super_key").alias("group_key")).distinct()
    n = pool.agg(F.count("*").cast("double").alias("_n"))
    train = F.bround(F.col("_n") * ratios[0] / (ratios[0] + ratios[1]))
    cut = ranked(pool, shuffled(F.col("group_key"), seed)).crossJoin(F.broadcast(n)).select(F.col("group_key").alias("super_key"), F.when(F.col("rank") <= train, "train").otherwise("val").alias("_s"))
    return groups.join(cut, "super_key", "left").select("group_key", "super_key", F.when(out, "test").otherwise(F.col("_s")).alias("split"))


def missing_houses(files: DataFrame, holdout: DataFrame) -> DataFrame:
    """Houses (column house) to be held out that no file shows."""
    return holdout.join(files.select(house(F.col("group_key")).alias("house")).distinct(), "house", "left_anti")


def stratified(histogram: DataFrame, sizes: DataFrame, seed: int = 42, ratios: tuple[float, float] = RATIOS) -> DataFrame:
    """(group_key, split): groups by falling number of boxes each go where they fill most of what the classes still lack.

    histogram: group_key, class_id, n; sizes: group_key, images. Gain of a split is the sum over classes of min(n, lack), less its
    surplus share of images; gains equal to nine places go to train, val, test in this order. The scan is sequential by definition; it
    streams over sorted rows, one per group, and holds a count per class. Each stratum (column `stratum` of sizes, if there) is balanced by
    itself, and strata are dealt to tasks; so give a large table strata.
    """
    if "stratum" not in sizes.columns:
        sizes = sizes.withColumn("stratum", F.lit(0).cast("long"))
    grouped = histogram.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct(F.col("class_id").cast("int").alias("class_id"), F.col("n").cast("long").alias("n")))).alias("held"), F.sum("n").alias("boxes"))
    classes = histogram.join(sizes.select("group_key", "stratum"), "group_key").groupBy("stratum", "class_id").agg(F.sum("n").cast("long").alias("n"))
    totals = classes.groupBy("stratum").agg(F.collect_list(F.struct(F.col("class_id").cast("int").alias("class_id"), "n")).alias("total"))
    totals = sizes.groupBy("stratum").agg(F.sum("images").cast("long").alias("every")).join(totals, "stratum", "left")
    rows = sizes.join(grouped, "group_key", "left").join(totals, "stratum").withColumn("_d", shuffled(F.col("group_key"), seed))
    rows = rows.repartition("stratum").sortWithinPartitions("stratum", F.coalesce("boxes", F.lit(0)).desc(), "_d", "group_key")
    share = (*ratios, 1 - sum(ratios))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stratum, counts, filled, total = None, [], [], {}
        for frame in frames:
            out = []
            for own, images, held, every, all_n in zip(frame["stratum"], frame["images"], frame["held"], frame["every"], frame["total"], strict=True):
                if own != stratum:
                    stratum, counts, filled = own, [{}, {}, {}], [0, 0, 0]
                    total = {h["class_id"]: h["n"] for h in all_n} if all_n is not None else {}
                of = [(h["class_id"], h["n"]) for h in held] if held is not None else []
                gain = [round(sum(min(float(n), max(total[c] * share[s] - counts[s].get(c, 0), 0.0)) for c, n in of) - (filled[s] / max(every, 1) - share[s]), 9) for s in range(3)]
                s = max(range(3), key=lambda k: (gain[k], -k))
                out.append(NAMES[s])
                filled[s] += int(images)
                for c, n in of:
                    counts[s][c] = counts[s].get(c, 0) + n
            yield pd.DataFrame({"group_key": frame["group_key"], "split": out})

    kind = sizes.schema["group_key"].dataType.simpleString()
    return rows.select("stratum", "group_key", "images", "held", "every", "total").mapInPandas(assign, f"group_key {kind}, split string")


STRATEGIES: dict[str, Callable] = {"group_aware": group_aware, "leave_one_house_out": leave_houses_out, "stratified_group": stratified}


def strategy(name: str) -> Callable:
    if name == "kfold":
        raise NotImplementedError("kfold is a reserved name")
    if name not in STRATEGIES:
        raise KeyError(f"{name}: one of {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def filename_leakage(files: DataFrame, name: str = "filename") -> DataFrame:
    """Names that are in more than one split, with those splits."""
    held = files.groupBy(name).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return held.filter(F.size("splits") > 1).select(name, F.array_join("splits", ",").alias("splits"))


def negatives(images: DataFrame, excluded: list, n: int, seed: int = 42) -> DataFrame:
    """The first n images in shuffled order that show none of the excluded classes (images: image, classes)."""
    free = images.filter(~F.arrays_overlap("classes", F.array(*[F.lit(x) for x in excluded]))) if excluded else images
    return free.select("image").orderBy(shuffled(F.col("image"), seed), "image").limit(n)
