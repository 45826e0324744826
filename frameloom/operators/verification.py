"""The loop of verification: what to look for, batches for people, their verdicts in an append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import gain
from ..sources.commits import CommittedTable
from .dedup import drop_table, numbered_rows, shared_table

ACTIVE = ("draft", "exported", "in_review")


def targets(images: DataFrame, promptable: list[int], trusted: DataFrame, verified: DataFrame) -> DataFrame:
    """(image, class_ids): promptable classes that neither the image's policy trusts nor the ledger has verified. images: image, ids (trusted); verified: image, class_id."""
    seen = verified.groupBy("image").agg(F.collect_set(F.col("class_id").cast("int")).alias("seen"))
    base = images.join(trusted.select("image", "ids"), "image", "left").join(seen, "image", "left")
    none = F.array().cast("array<int>")
    left = F.array_except(F.array_except(F.array(*[F.lit(c) for c in sorted(promptable)]), F.coalesce("ids", none)), F.coalesce("seen", none))
    return base.select("image", F.array_sort(left).alias("class_ids")).filter(F.size("class_ids") > 0)


def rank_by_gain(candidates: DataFrame, priority: Column, claimed: DataFrame | None = None) -> DataFrame:
    """(image, gain): candidate detections (image, class_name, conf) of images that no active batch has claimed."""
    free = candidates.join(claimed.select("image"), "image", "left_anti") if claimed is not None else candidates
    return free.groupBy("image").agg(F.round(gain(F.col("conf"), priority), 6).alias("gain"))


def numbered_by_gain(ranked: DataFrame) -> DataFrame:
    """ranked with n, from 1, by falling gain, then image."""
    return numbered_rows(ranked, F.desc("gain"), "image")


def plan_batches(candidates: DataFrame, priority: Column, size: int, claimed: DataFrame | None = None, first_number: int = 1, backend: str = "model") -> DataFrame:
    """Images by falling gain in batches of a size: batch_id, images, target_classes, n_images, expected_gain."""
    if size <= 0:
        raise ValueError(f"batch size {size}")
    rows = numbered_by_gain(rank_by_gain(candidates, priority, claimed)).withColumn("b", F.expr(f"(n - 1) div {size}"))
    classes = candidates.join(rows.select("image", "b"), "image").groupBy("b").agg(F.array_sort(F.collect_set("class_name")).alias("target_classes"))
    heads = rows.groupBy("b").agg(F.array_sort(F.collect_list("image")).alias("images"), F.count("*").alias("n_images"), F.round(F.sum("gain"), 4).alias("expected_gain"))
    return heads.join(classes, "b").select(batch_id(F.col("b") + first_number, backend).alias("batch_id"), "images", "target_classes", "n_images", "expected_gain")


def batch_id(number: Column, backend: str) -> Column:
    return F.format_string("vb%03d_%s", number.cast("long"), F.lit(backend))


def next_number(batch_ids: DataFrame) -> DataFrame:
    """One row, n: the number after the highest in use; numbers are not used again."""
    return batch_ids.agg((F.coalesce(F.max(F.regexp_extract("batch_id", r"^vb(\d{3})_", 1).try_cast("int")), F.lit(0)) + 1).alias("n"))


def agreement_sample(images: Column, fraction: float) -> Column:
    """Evenly spaced picks over the sorted images of a batch, one at least: those to be annotated twice."""
    n = F.size(images)
    picks = F.least(F.greatest(F.lit(1), F.bround(n * fraction).cast("int")), n)
    at = F.transform(F.sequence(F.lit(0), picks - 1), lambda i: F.floor(i * (n / picks)).cast("int"))
    chosen = F.transform(F.array_distinct(at), lambda i: F.element_at(F.array_sort(images), i + 1))
    return F.when((n > 0) & F.lit(fraction > 0), chosen).otherwise(F.array().cast("array<string>"))


def verdicts(batch_images: DataFrame, target_classes: DataFrame, export: DataFrame) -> DataFrame:
    """Per image of a batch and target class: present_labeled with the number of exported boxes, or verified_absent. batch_images: batch_id, image; target_classes: batch_id, class_id; export: image, class_id."""
    cells = batch_images.join(target_classes, "batch_id")
    n = export.groupBy("image", "class_id").agg(F.count("*").alias("boxes"))
    found = cells.join(n, ["image", "class_id"], "left").withColumn("boxes", F.coalesce("boxes", F.lit(0)))
    return found.select("batch_id", "image", "class_id", F.when(F.col("boxes") > 0, "present_labeled").otherwise("verified_absent").alias("status"), "boxes")


def ledger_view(log: DataFrame) -> DataFrame:
    """The ledger as it stands: of each (image, class_id) the last entry by seq that was accepted."""
    nth = F.row_number().over(W.partitionBy("image", "class_id").orderBy(F.desc("seq")))
    return log.withColumn("_n", nth).filter("_n = 1").drop("_n")


def append_outcomes(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """new verdicts (image, class_id, source, status, boxes, supersedes) with outcome, against the ledger's view (image, class_id, source, status, boxes).

    insert; noop where the same is recorded already; supersede where it differs and says so; conflict where it differs and does not;
    source_mismatch where the image is recorded under another source. Callers append inserts and superseding rows, and nothing if there is
    a conflict or mismatch.
    """
    cells = ledger.select("image", "class_id", F.col("status").alias("_s"), F.col("boxes").alias("_b"))
    sources = ledger.groupBy("image").agg(F.min("source").alias("_source"))
    both = new.join(cells, ["image", "class_id"], "left").join(sources, "image", "left")
    same = F.col("_s").eqNullSafe(F.col("status")) & F.col("_b").eqNullSafe(F.col("boxes"))
    outcome = F.when(F.col("_source") != F.col("source"), "source_mismatch").when(F.col("_s").isNull(), "insert").when(same, "noop").when(F.col("supersedes").isNotNull(), "supersede").otherwise("conflict")
    return both.withColumn("outcome", outcome).drop("_s", "_b", "_source")


def ledger(spark: SparkSession, path: str) -> CommittedTable:
    """The append-only log at a path, a version an append."""
    return CommittedTable(spark, path, "image long, class_id int, source string, status string, boxes long, seq long")


def append(log: CommittedTable, new: DataFrame) -> int:
    """Append what may be appended to the log, all or nothing; returns the number of rows.

    Entries are judged against the log as it stands, and numbered after it. If another writer appends in the meantime, both is done again over
    what that one wrote, so no seq is given twice and a conflict with it is reported.
    """
    fresh: list[DataFrame] = []

    def build(known: DataFrame) -> DataFrame | None:
        while fresh:
            drop_table(fresh.pop())
        outcomes = append_outcomes(ledger_view(known), new)
        bad = outcomes.filter(F.col("outcome").isin("conflict", "source_mismatch")).limit(10).collect()
        if bad:
            raise ValueError(f"ledger conflicts: {[(r['image'], r['class_id'], r['outcome']) for r in bad]}")
        last = known.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        #: Entries of one cell in one append are numbered among themselves, so the ledger's view never depends on their order in a file.
        nth = F.row_number().over(W.partitionBy("image", "class_id").orderBy("supersedes", "status", "boxes"))
        rows = outcomes.filter(F.col("outcome").isin("insert", "supersede")).withColumn("seq", F.lit(last) + nth)
        fresh.append(shared_table(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in log.schema])))
        return None if fresh[0].isEmpty() else fresh[0]

    done = log.append(build)
    n = 0 if done is None else fresh[0].count()
    drop_table(fresh[0])
    return n


def ledger_problems(ledger: DataFrame) -> DataFrame:
    """(image, class_id, problem): unknown verdict, absent with boxes, present without."""
    n = F.coalesce("boxes", F.lit(0))
    problem = F.when(~F.col("status").isin("present_labeled", "verified_absent"), "verdict").when((F.col("status") == "verified_absent") & (n > 0), "absent_with_boxes").when((F.col("status") == "present_labeled") & (n == 0), "present_without_boxes")
    return ledger.select("image", "class_id", problem.alias("problem")).filter("problem is not null")


def candidate_problems(candidates: DataFrame, targeted: DataFrame) -> DataFrame:
    """(image, ord, problem) of candidates (image, ord, class_id, conf, box): not targeted, confidence or box out of range."""
    both = candidates.join(targeted.select("image", "class_ids"), "image", "left")
    within = F.lit(True)
    for c in ("cx", "cy", "w", "h"):
        within = within & F.col(f"box.{c}").between(0.0, 1.0)
    found = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.array_contains("class_ids", F.col("class_id")), F.lit(False)), "not_targeted"),
            F.when(~F.col("conf").between(0.0, 1.0), "conf"), F.when(~within | (F.col("box.w") <= 0) | (F.col("box.h") <= 0), "box"),
        )
    )
    return both.select("image", "ord", F.explode(found).alias("problem"))


def linked_candidates(links: DataFrame, targeted: DataFrame) -> DataFrame:
    """The backend without a model: boxes of near copies, confidence 1, where the class is targeted. links: image, class_id, box."""
    return links.join(targeted.select("image", F.explode("class_ids").alias("class_id")), ["image", "class_id"]).withColumn("conf", F.lit(1.0))
