"""Label rows: parsing, validation, thresholds and filters. Every operator is a narrow transformation unless it says otherwise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.scores import threshold_for

#: A detection this sure or less may teach the detector something.
UNCERTAIN = (0.25, 0.55)
#: Classes whose boxes are never logged.
PRIVATE_CLASSES = ("face", "person")


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """A row per line of files' text: the other columns, line_num (from 1, over all lines), raw (stripped). Blank and # lines are left out."""
    rest = [c for c in files.columns if c != text]
    out = files.select(*rest, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "raw"))
    out = out.select(*rest, (F.col("at") + 1).alias("line_num"), F.trim(F.regexp_replace("raw", r"[\r\t]", " ")).alias("raw"))
    return out.filter("raw <> '' AND NOT startswith(raw, '#')")


def annotations_of(lines: DataFrame) -> DataFrame:
    """lines with class_id and box; lines that don't parse are left out."""
    return lines.withColumn("_a", B.parse_line(F.col("raw"))).filter("_a is not null").select(*lines.columns, "_a.class_id", "_a.box")


def box_issues(annotations: DataFrame, n_classes: int) -> DataFrame:
    """A row per broken rule of rows with class_id and box: their other columns and issue."""
    return annotations.withColumn("issue", F.explode(B.problems(F.col("class_id"), F.col("box"), n_classes))).drop("box", "class_id")


def duplicate_lines(lines: DataFrame, image: str, at: str, text: str) -> DataFrame:
    """(image, first_idx, duplicate_idx) of lines whose text stood in the image before. One shuffle, by image and text."""
    first = F.min(at).over(W.partitionBy(image, text))
    return lines.withColumn("first_idx", first).filter(F.col(at) > F.col("first_idx")).select(image, "first_idx", F.col(at).alias("duplicate_idx"))


def image_filter(width: Column, height: Column, brightness: Column, enabled: bool = True, min_dim: int = 200, portrait_below: float = 0.9, outdoor_above: float = 200.0) -> Column:
    """Why an image is left out (too_small, likely_outdoor), or null if it stays. Portraits are not looked at for brightness, unknown figures don't reject."""
    if not enabled:
        return F.lit(None).cast("string")
    return F.when(F.least(width, height) < min_dim, "too_small").when((height > 0) & (width / height < portrait_below), None).when(brightness > outdoor_above, "likely_outdoor")


def above_threshold(detections: DataFrame, thresholds: Mapping[str, float], default: float) -> DataFrame:
    """Detections (class_name, conf) at their class's threshold or above."""
    return detections.filter(F.col("conf") >= threshold_for(F.col("class_name"), thresholds, default))


def uncertain(conf: Column, band: tuple[float, float] = UNCERTAIN) -> Column:
    return conf.between(*band)


def redacted(class_name: Column, box: Column) -> Column:
    """The box, or null for classes that show people."""
    return F.when(~class_name.isin(*PRIVATE_CLASSES), box)


def license_allowed(enabled: Column, commercial: Column, allowed: Column) -> Column:
    return F.coalesce(enabled, F.lit(False)) & (F.coalesce(commercial, F.lit(False)) | F.coalesce(allowed, F.lit(False)))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, else null; unknown is not broken."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])


def class_order_differences(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Ids at which an export's list of names and the taxonomy (both class_id, class_name) differ."""
    a, b = names.select("class_id", F.col("class_name").alias("found")), taxonomy.select("class_id", F.col("class_name").alias("expected"))
    return a.join(b, "class_id", "full_outer").filter(~F.col("found").eqNullSafe(F.col("expected")))


def changed_boxes(base: DataFrame, export: DataFrame, image: str, tolerance: float = 1e-4) -> DataFrame:
    """Images whose boxes (class_id, ord, box) are not the same in both tables, paired in order of class and line.

    Returns image, n_base, n_export, n_moved (pairs that differ by more than the tolerance or in class).
    """

    def numbered(df: DataFrame, side: str) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(image).orderBy("class_id", "ord"))
        return df.select(image, nth.alias("nth"), F.col("class_id").alias(f"class_{side}"), F.col("box").alias(f"box_{side}"))

    both = numbered(base, "a").join(numbered(export, "b"), [image, "nth"], "full_outer")
    far = F.lit(False)
    for c in ("cx", "cy", "w", "h"):
        far = far | (F.abs(F.col(f"box_a.{c}") - F.col(f"box_b.{c}")) > tolerance)
    moved = F.col("class_a").isNotNull() & F.col("class_b").isNotNull() & ((F.col("class_a") != F.col("class_b")) | far)
    out = both.groupBy(image).agg(F.count("class_a").alias("n_base"), F.count("class_b").alias("n_export"), F.count_if(moved).alias("n_moved"))
    return out.filter("n_base <> n_export or n_moved > 0")


def label_index(labels: DataFrame, key: str) -> DataFrame:
    """(key, label_path): of labels that share a key the one of the greatest path."""
    return labels.groupBy(key).agg(F.max("label_path").alias("label_path"))


def pair_images_labels(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Left outer join by key: an image without a label stays, with nulls. Of labels that share a key the greatest path counts."""
    return images.join(label_index(labels, key), key, "left")
