"""One-to-one matching of boxes, suppression and agreement.

A matching runs inside one (image, class) group as a fold over a sorted array, in code generation; a group is the boxes of one
class in one image, so it is small however many images there are. Groups are keyed by image and spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import iou
from ..functions.scores import f1, ratio

_STATE = "struct<used: array<int>, tp: long, iou_sum: double>"


def _boxes(df: DataFrame, keys: list[str], name: str, order: str = "ord") -> DataFrame:
    """One array of boxes in order per group."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "box"))), lambda x: x["box"]).alias(name))


def _pairs_of_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    none = F.array().cast("array<struct<cx: double, cy: double, w: double, h: double>>")
    both = _boxes(left, keys, "a").join(_boxes(right, keys, "b"), keys, "full_outer")
    return both.select(*keys, F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))


def _start() -> Column:
    return F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).cast("long").alias("tp"), F.lit(0.0).alias("iou_sum")).cast(_STATE)


def _take(state: Column, at: Column, score: Column) -> Column:
    return F.struct(F.array_append(state["used"], at.cast("int")).alias("used"), (state["tp"] + 1).alias("tp"), (state["iou_sum"] + score).alias("iou_sum")).cast(_STATE)


def match_in_order(candidates: DataFrame, truth: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Candidates in their order each take the best truth left (the first of equals) if it overlaps by the threshold.

    Both sides: keys, ord, box. Returns keys, tp, fp, fn, iou_sum for each group of either side.
    """
    both = _pairs_of_groups(candidates, truth, keys)

    def step(state: Column, candidate: Column) -> Column:
        scored = F.transform(F.col("b"), lambda t, i: F.struct(F.when(F.array_contains(state["used"], i), F.lit(-1.0)).otherwise(iou(candidate, t)).alias("s"), (-i).alias("j")))
        best = F.array_max(scored)
        return F.when(best["s"] >= threshold, _take(state, -best["j"], best["s"])).otherwise(state)

    matched = both.withColumn("m", F.aggregate("a", _start(), step))
    return matched.select(*keys, F.col("m.tp").alias("tp"), (F.size("a") - F.col("m.tp")).alias("fp"), (F.size("b") - F.col("m.tp")).alias("fn"), F.col("m.iou_sum").alias("iou_sum"))


def match_by_overlap(left: DataFrame, right: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Pairs are taken from the largest overlap down (then in order of the two sides) while both boxes are free.

    Both sides: keys, ord, box. Returns keys, matched, only_a, only_b, iou_sum for each group of either side.
    """
    both = _pairs_of_groups(left, right, keys)
    pair = lambda a, i: F.transform(F.col("b"), lambda b, j: F.struct((-iou(a, b)).alias("less"), i.alias("i"), j.alias("j")))
    pairs = F.array_sort(F.filter(F.flatten(F.transform("a", pair)), lambda p: p["less"] <= -threshold))
    #: Right-hand boxes are kept in the same list of used ones, as negative numbers below those of the left.
    right_no = lambda p: -1 - p["j"]

    def step(state: Column, p: Column) -> Column:
        free = ~F.array_contains(state["used"], p["i"]) & ~F.array_contains(state["used"], right_no(p))
        used = F.array_append(F.array_append(state["used"], p["i"].cast("int")), right_no(p).cast("int"))
        taken = F.struct(used.alias("used"), (state["tp"] + 1).alias("tp"), (state["iou_sum"] - p["less"]).alias("iou_sum")).cast(_STATE)
        return F.when(free, taken).otherwise(state)

    matched = both.withColumn("m", F.aggregate(pairs, _start(), step))
    return matched.select(*keys, F.col("m.tp").alias("matched"), (F.size("a") - F.col("m.tp")).alias("only_a"), (F.size("b") - F.col("m.tp")).alias("only_b"), F.col("m.iou_sum").alias("iou_sum"))


def suppress(detections: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Non-maximum suppression per group of keys: by falling confidence (then ord), a box stays unless it overlaps one that stayed.

    Detections: keys, ord, conf, box. Returns keys, ord, conf, box of those that stay.
    """
    listed = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("less"), "ord", "box"))).alias("all"))
    kind = listed.schema["all"].dataType
    kept = F.aggregate(
        "all", F.array().cast(kind), lambda kept, d: F.when(F.exists(kept, lambda k: iou(k["box"], d["box"]) >= threshold), kept).otherwise(F.array_append(kept, d))
    )
    return listed.select(*keys, F.explode(kept).alias("d")).select(*keys, "d.ord", (-F.col("d.less")).alias("conf"), "d.box")


def agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sums of match_by_overlap's rows by class (or image, or nothing): agreement is 1 where neither annotator drew a box."""
    out = pairs.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "only_a", "only_b")], F.coalesce(F.sum("iou_sum"), F.lit(0.0)).alias("iou_sum"))
    every = F.col("matched") + F.col("only_a") + F.col("only_b")
    return out.withColumns({"agreement": F.coalesce(ratio(F.col("matched"), every), F.lit(1.0)), "mean_iou": ratio(F.col("iou_sum"), F.col("matched"))}).drop("iou_sum")


def worst_images(by_image: DataFrame, n: int = 5) -> DataFrame:
    """The n images of lowest agreement, by name among equals."""
    return by_image.orderBy("agreement", "image").limit(n)


def agreement_failures(by_class: DataFrame, least: float, overrides: dict[int, float] | None = None) -> DataFrame:
    """Classes whose agreement is below their gate."""
    gate = F.lit(float(least))
    for class_id, own in (overrides or {}).items():
        gate = F.when(F.col("class_id") == class_id, F.lit(float(own))).otherwise(gate)
    return by_class.withColumn("gate", gate).filter(F.col("agreement") < F.col("gate")).select("class_id", "agreement", "gate")


def truth_scores(matches: DataFrame, by: str = "class_id") -> DataFrame:
    """match_in_order's rows by class: tp, fp, fn, precision, recall, f1, mean_iou."""
    sums = matches.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "iou_sum")])
    p, r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return sums.select(by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(F.col("iou_sum"), F.col("tp")).alias("mean_iou"))


def micro_macro(scores: DataFrame) -> DataFrame:
    """truth_scores' rows in one: micro over all boxes, macro the plain mean over classes that the truth has."""
    has = F.col("tp") + F.col("fn") > 0
    one = scores.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(F.when(has, F.col(c))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    p, r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return one.withColumns({"micro_precision": p, "micro_recall": r, "micro_f1": f1(p, r)})
