"""Checks of finished artefacts, as rows (check, subject): completeness, coverage and quality reports, session labels, settings.

Each check is a small query over tables; what is valid gives no row. An artefact's header is a table of one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.hashes import taxonomy_fingerprint
from .dedup import shared_table
from .labels import duplicate_lines, lines_of

#: Versions of the completeness artefact that are read, its modes, and splits.
VERSIONS, SPLITS = (1, 2), ("train", "val", "test")
MODES = ("trusted_list", "trusted_list_plus_ledger", "per_slug", "per_session", "verified_absence_all")
#: By how much a recorded total may differ from the sum of its parts.
TOLERANCE = 1e-3
#: Limits of a kind of configuration.
MOST_LIMITS = 1000


def rule(rows: DataFrame, check: str, broken: Column, subject: Column | None = None) -> DataFrame:
    """(check, subject) of the rows for which broken holds; what is unknown is broken."""
    return rows.filter(F.coalesce(broken, F.lit(True))).select(F.lit(check).alias("check"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def completeness_problems(header: DataFrame, names: DataFrame, policies: DataFrame, images: DataFrame, live_fingerprint: str | None = None, modes: Sequence[str] = MODES) -> DataFrame:
    """header: schema_version, nc, fingerprint, images_total; names: class_id, class_name; policies: policy, mode, ids; images: image, policy, split."""
    ids = names.agg(F.count("*").alias("n"), F.countDistinct("class_id").alias("d"), F.min("class_id").alias("low"), F.max("class_id").alias("high"), taxonomy_fingerprint(F.col("class_id"), F.col("class_name")).alias("fp"))
    one = header.crossJoin(ids).crossJoin(policies.agg(F.count("*").alias("policies"))).crossJoin(images.agg(F.count("*").alias("images")))  # of one row each
    nc = F.col("nc")
    exact = (F.col("n") == nc) & (F.col("d") == nc) & (F.col("low") == 0) & (F.col("high") == nc - 1)
    held = policies.crossJoin(F.broadcast(header.select("nc")))  # one row
    listed = F.col("ids")
    orphan = images.join(policies.select("policy", F.lit(True).alias("_known")), "policy", "left")
    drift = F.col("fingerprint") != F.lit(live_fingerprint) if live_fingerprint is not None else F.lit(False)
    return together(
        rule(one, "schema_version", ~F.col("schema_version").isin(*VERSIONS)), rule(one, "nc", nc <= 0), rule(one, "names", ~exact),
        rule(one, "fingerprint", exact & (F.col("fingerprint") != F.col("fp"))), rule(one, "taxonomy_drift", drift),
        rule(one, "no_policies", F.col("policies") == 0), rule(one, "no_images", F.col("images") == 0), rule(one, "images_total", F.col("images_total") != F.col("images")),
        rule(held, "mode", ~F.col("mode").isin(*modes), F.col("policy")), rule(held, "ids_range", F.exists(listed, lambda i: (i < 0) | (i >= nc)), F.col("policy")),
        rule(held, "ids_order", listed != F.array_sort(F.array_distinct(listed)), F.col("policy")),
        rule(held, "not_all_trusted", (F.col("mode") == "verified_absence_all") & (F.size(listed) != nc), F.col("policy")),
        rule(held, "none_trusted", (F.col("mode") == "trusted_list") & (F.size(listed) == 0), F.col("policy")),
        rule(orphan, "orphan_policy", F.col("_known").isNull(), F.col("image")), rule(images, "split", ~F.col("split").isin(*SPLITS), F.col("image")),
    )


def policy_summary(policies: DataFrame, images: DataFrame, n_classes: int) -> DataFrame:
    """Per policy, unused ones too: mode, images, trusted_count, untrusted_count, unused."""
    n = images.groupBy("policy").agg(F.count("*").alias("images"))
    both = policies.join(n, "policy", "left").withColumn("images", F.coalesce("images", F.lit(0)).cast("long"))
    return both.select("policy", "mode", "images", F.size("ids").alias("trusted_count"), F.greatest(F.lit(0), n_classes - F.size("ids")).alias("untrusted_count"), (F.col("images") == 0).alias("unused"))


def coverage_sets(wanted: DataFrame, recorded: DataFrame, key: str = "image") -> DataFrame:
    """(key, side): missing, wanted but not recorded, which breaks training; stale, recorded but not wanted, which does no harm."""
    a, b = wanted.select(key).distinct(), recorded.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("side")).union(b.join(a, key, "left_anti").select(key, F.lit("stale")))


def coverage_problems(by_class: DataFrame, by_image: DataFrame, header: DataFrame) -> DataFrame:
    """by_class: class_id, score, residual; by_image: image, score; header: residual_total."""
    total = header.crossJoin(by_class.agg(F.round(F.sum("residual"), 4).alias("_sum")))  # of one row each
    out = ~F.col("score").between(0.0, 1.0)
    return together(
        rule(by_class, "class_score", out, F.col("class_id")), rule(by_image, "image_score", out, F.col("image")),
        rule(total, "residual_total", F.abs(F.col("residual_total") - F.coalesce("_sum", F.lit(0.0))) > TOLERANCE),
    )


def quality_problems(report: DataFrame) -> DataFrame:
    """report: one row with masked_fraction and images."""
    return together(rule(report, "masked_fraction", ~F.col("masked_fraction").between(0.0, 1.0)), rule(report, "images", F.col("images") < 0))


def stale_reports(reports: DataFrame, live: DataFrame) -> DataFrame:
    """Reports (report, fingerprint, images) that were made of another taxonomy or number of images than the live one (fingerprint, images; one row)."""
    both = reports.crossJoin(F.broadcast(live.select(F.col("fingerprint").alias("_fp"), F.col("images").alias("_n"))))  # one row
    return together(rule(both, "taxonomy", F.col("fingerprint") != F.col("_fp"), F.col("report")), rule(both, "image_count", F.col("images") != F.col("_n"), F.col("report")))


def session_problems(labels: DataFrame, images: DataFrame, n_classes: int, least_labelled: float) -> DataFrame:
    """An export's labels (stem, text) against the images (stem) of the session they are for.

    no_image; malformed, a box rule's name or duplicate, with stem:line; labelled, if too few of the images have a label.
    """
    # written, since each check reads them: the texts are made and their lines parsed once
    labels, images = shared_table(labels.select("stem", "text")), shared_table(images.select("stem").distinct())
    own = labels.join(images, "stem", "left_semi")
    read = shared_table(lines_of(own).withColumn("_a", B.parse_line(F.col("raw"))))
    lines = read.drop("_a")
    at = F.concat_ws(":", "stem", F.col("line_num").cast("string"))
    broken = read.filter("_a is not null").select(at.alias("subject"), F.explode(B.problems(F.col("_a.class_id"), F.col("_a.box"), n_classes)).alias("check"))
    again = duplicate_lines(lines, "stem", "line_num", "raw")
    n = images.agg(F.countDistinct("stem").alias("_all")).crossJoin(own.agg(F.countDistinct("stem").alias("_own")))  # of one row each
    return together(
        rule(labels.join(images.select("stem"), "stem", "left_anti"), "no_image", F.lit(True), F.col("stem")), rule(read, "malformed", F.col("_a").isNull(), at), broken.select("check", "subject"),
        rule(again, "duplicate", F.lit(True), F.concat_ws(":", "stem", F.col("duplicate_idx").cast("string"))), rule(n, "labelled", F.col("_own") < least_labelled * F.col("_all")),
    )


def setting_problems(settings: DataFrame, limits: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Settings (key, value, as text) against limits (key, low, high, pattern; null is no limit): missing, number, range, pattern.

    configs: (config), if there are many configurations; settings have config too, each is held against all limits, and rows (config, check, subject)
    come back. Limits are few, those of one kind of configuration.
    """
    if configs is None:
        return setting_problems(settings.withColumn("config", F.lit(0)), limits, settings.sparkSession.range(1).select(F.lit(0).alias("config"))).drop("config")
    rows = limits.limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"over {MOST_LIMITS} limits")
    own = settings.groupBy("config").agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("held"))
    both, found = configs.select("config").join(own, "config", "left"), []
    for r in rows:
        value = F.try_element_at("held", F.lit(r["key"]))
        number, there = value.try_cast("double"), value.isNotNull()
        low, high = F.lit(r["low"]).cast("double"), F.lit(r["high"]).cast("double")
        bounded = r["low"] is not None or r["high"] is not None
        wrong = F.coalesce(number < low, F.lit(False)) | F.coalesce(number > high, F.lit(False))
        broken = [("missing", ~there), ("number", there & F.lit(bounded) & number.isNull()), ("range", there & wrong)]
        if r["pattern"] is not None:
            broken.append(("pattern", there & ~value.rlike(r["pattern"])))
        found += [F.when(F.coalesce(b, F.lit(True)), F.struct(F.lit(check).alias("check"), F.lit(r["key"]).alias("subject"))) for check, b in broken]
    return both.select("config", F.explode(F.array_compact(F.array(*found))).alias("p")).select("config", "p.check", "p.subject")


def ledger_consistency(ledger: DataFrame, provenance: DataFrame, lines: DataFrame) -> DataFrame:
    """The ledger's view (image, source, boxes) against provenance (image, source) and the lines of label files made of it (image, lines)."""
    held = ledger.groupBy("image").agg(F.min("source").alias("source"), F.sum("boxes").alias("boxes"))
    known = held.join(provenance.select("image", F.col("source").alias("_source")), "image", "left")
    both = held.join(lines.select("image", "lines"), "image", "left")
    n, there = F.col("boxes"), F.col("lines").isNotNull()
    return together(
        rule(known, "no_provenance", F.col("_source").isNull(), F.col("image")), rule(known, "source", F.col("_source").isNotNull() & (F.col("source") != F.col("_source")), F.col("image")),
        rule(both, "no_file", (n > 0) & ~there, F.col("image")), rule(both, "line_count", (n > 0) & there & (n != F.col("lines")), F.col("image")),
        rule(both, "file_without_boxes", (n == 0) & there, F.col("image")),
    )
