"""Release and training gates over figures, the manifest of a release, and what they count.

A release's figures are one row; a gate is a row of GATES: its id, when it passes, and the value it reports. So gates are read, added and
tested as data. What is unknown (null) fails.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import gate

#: Limits of a track that does not name its own.
DEFAULTS: dict = {"mode": "core", "verified_cells": 0, "custom_images": 0, "houses": 0, "instances": 0, "allow_noncommercial": True, "agreement": 0.6}
Limits = Mapping

#: (gate, figures -> passes, figures -> value), the prerequisites first.
GATES: tuple[tuple[str, Callable[[Limits], Column], Callable[[Limits], Column]], ...] = (
    ("MODE", lambda x: F.col("mode") == x["mode"], lambda x: (F.col("mode") == x["mode"]).cast("int")),
    ("WETFLOOR", lambda x: F.col("pilot_agreement").isNotNull(), lambda x: F.col("pilot_agreement")),
    ("RG1", lambda x: (F.col("criticals") == 0) & (F.col("sweep_findings") == 0), lambda x: F.col("criticals") + F.col("sweep_findings")),
    ("RG2", lambda x: F.col("completeness_problems") + F.col("stale_inputs") == 0, lambda x: F.col("completeness_problems") + F.col("stale_inputs")),
    ("RG3", lambda x: (F.col("verified_cells") >= x["verified_cells"]) & (F.col("classes_below") == 0), lambda x: F.col("verified_cells")),
    ("RG4", lambda x: F.col("changelog_entry"), lambda x: F.col("changelog_entry").cast("int")),
    ("RG5", lambda x: F.col("tree_clean") & F.col("head_tagged"), lambda x: F.col("head_tagged").cast("int")),
    ("RG6", lambda x: (F.col("push_exit") == 0) & (F.trim("push_output") == ""), lambda x: F.col("push_exit")),
    ("RG7", lambda x: (F.lit(bool(x["allow_noncommercial"])) | (F.col("noncommercial_images") == 0)) & (F.col("unlicensed_slugs") == 0), lambda x: F.col("noncommercial_images")),
    ("RG8", lambda x: F.col("leaked") + F.col("eval_overlap") + F.col("shared_houses") == 0, lambda x: F.col("leaked") + F.col("eval_overlap") + F.col("shared_houses")),
    ("RG9", lambda x: (F.col("custom_images") >= x["custom_images"]) & (F.col("houses") >= x["houses"]) & ((F.lit(x["instances"]) <= 0) | (F.col("least_instances") >= x["instances"])), lambda x: F.col("custom_images")),
    ("RG10", lambda x: F.col("eval_report") & F.col("benchmark_report"), lambda x: F.col("eval_report").cast("int") + F.col("benchmark_report").cast("int")),
)


def release_gates(figures: DataFrame, limits: Limits, only: Sequence[str] | None = None) -> DataFrame:
    """(gate_id, verdict, value) of the gates over a row of figures."""
    x = {**DEFAULTS, **limits}
    return reduce(DataFrame.union, [gate(figures, g, passes(x), value(x)) for g, passes, value in GATES if only is None or g in only])


def dense_counts(counts: DataFrame, wanted: DataFrame, key: str = "class_name", n: str = "n") -> DataFrame:
    """Sums of counts per wanted key, 0 for one that never came, so that a class without any is seen to be short."""
    sums = counts.groupBy(key).agg(F.sum(n).alias("_n"))
    return wanted.select(key).join(sums, key, "left").select(key, F.coalesce("_n", F.lit(0)).cast("long").alias(n))


def pilot_decision(sessions: DataFrame, least: float = DEFAULTS["agreement"]) -> DataFrame:
    """Of double-annotated sessions (session, agreement) the first by name that has an agreement: keep the class's boxes, or demote it to the scene. No row if there is none."""
    first = sessions.filter("agreement is not null").agg(F.min_by("agreement", "session").alias("agreement"), F.min("session").alias("session")).filter("session is not null")
    return first.select("session", "agreement", F.when(F.col("agreement") >= least, "keep").otherwise("demote").alias("decision"))


def precision_checkpoint(metrics: DataFrame, class_name: str, least: float = 0.3) -> DataFrame:
    """One row (available, value, reopen): whether a class's average precision (class_name, value) is so low that its demotion is opened again."""
    own = metrics.filter(F.col("class_name") == class_name).agg(F.count("*").alias("n"), F.max("value").alias("value"))
    return own.select((F.col("n") > 0).alias("available"), "value", F.coalesce(F.col("value") < least, F.lit(False)).alias("reopen"))


def release_manifest(images: DataFrame, boxes: DataFrame, gates: DataFrame, version: str) -> DataFrame:
    """One row: images in all, by split and by source, boxes by class, and the gates' verdicts, each as name=number in order of name."""

    def listed(rows: DataFrame, key: str, value: Column) -> DataFrame:
        return rows.groupBy(key).agg(value.alias("_v")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col(key).cast("string"), F.col("_v").cast("string")))), ",").alias("t"))

    n = images.agg(F.count("*").alias("images"))
    parts = [("by_split", listed(images, "split", F.count("*"))), ("by_source", listed(images, "source", F.count("*"))), ("by_class", listed(boxes, "class_id", F.count("*"))), ("gates", listed(gates, "gate_id", F.min("verdict")))]
    for name, one in parts:
        n = n.crossJoin(one.withColumnRenamed("t", name))  # of one row each
    return n.select(F.lit(version).alias("version"), *n.columns)


def verify_releases(requested: DataFrame, manifests: DataFrame) -> DataFrame:
    """Whether releases that were made still stand. requested: release, lock_sha (of the lock file now); manifests: release (where it lies), version, gates (as name=verdict, joined by commas), lock_sha.

    Returns release, problem (missing; version, where it names another; failed_gates, which is tampered with or broken; null for none), failed (the gates' names, in
    order), and lock: same or differs, which is no problem, for a manifest is made before the lock that holds it.
    """
    both = requested.select("release", F.col("lock_sha").alias("_now")).join(manifests.select("release", "version", "gates", "lock_sha"), "release", "left")
    failed = F.array_sort(F.transform(F.filter(F.split(F.coalesce("gates", F.lit("")), ","), lambda g: g.endswith("=FAIL")), lambda g: F.substring_index(g, "=", 1)))
    problem = F.when(F.col("version").isNull(), "missing").when(F.col("version") != F.col("release"), "version").when(F.size(failed) > 0, "failed_gates")
    lock = F.when(F.col("_now").isNotNull() & F.col("lock_sha").isNotNull(), F.when(F.col("_now") == F.col("lock_sha"), "same").otherwise("differs"))
    return both.select("release", problem.alias("problem"), failed.alias("failed"), lock.alias("lock"))


def training_gates(figures: DataFrame, mixing_policy: str = "forbid") -> DataFrame:
    """The gates before training that look at tables: taxonomy, coverage, consistency, freshness, mixing augmentations, ledger.

    figures: artefact_fingerprint, live_fingerprint, images, missing, split_mismatch, stale, artefact_problems, unused_policies, stale_inputs,
    mixing (sum of mixing augmentations), ledger_problems.
    """
    bad = F.col("mixing") > 0
    return reduce(
        DataFrame.union,
        [
            gate(figures, "G2", F.col("artefact_fingerprint") == F.col("live_fingerprint"), F.lit(0)),
            gate(figures, "G3", (F.col("images") > 0) & (F.col("missing") + F.col("split_mismatch") + F.col("stale") == 0), F.col("missing") + F.col("split_mismatch"), (F.col("images") > 0) & (F.col("missing") + F.col("split_mismatch") == 0)),
            gate(figures, "G4", F.col("artefact_problems") + F.col("unused_policies") == 0, F.col("artefact_problems"), F.col("artefact_problems") == 0),
            gate(figures, "G7", F.col("stale_inputs") == 0, F.col("stale_inputs")),
            gate(figures, "G8", ~bad | F.lit(mixing_policy == "ignore"), F.col("mixing"), F.lit(mixing_policy == "warn")),
            gate(figures, "G9", F.col("ledger_problems") == 0, F.col("ledger_problems")),
        ],
    )


def changed_inputs(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded inputs (name, sha) that are gone or changed among those found (name, sha): name, problem (missing, changed)."""
    both = recorded.join(found.select("name", F.col("sha").alias("_sha")), "name", "left")
    return both.select("name", F.when(F.col("_sha").isNull(), "missing").when(~F.col("_sha").eqNullSafe(F.col("sha")), "changed").alias("problem")).filter("problem is not null")
