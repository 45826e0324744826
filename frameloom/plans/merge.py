"""A merge of sources from end to end: what becomes of each image, the labels of those that stay, what copies add to them, and what is only linked.

Images come in their order. One without labels is dropped, then one that a filter names a reason for, then one that is near an image kept before.
Of a dropped copy, boxes of the classes that its source labels exhaustively are worth keeping: if the copy is the same file they move to the
kept image, unless a box of their class is there already; if it only looks alike they are linked, for a person or a backend to
look at. Copies of one image are taken in order, and each is compared with all that stands there by then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import THRESHOLD, KeptIndex, keep_in_order, shared_table, small
from ..operators.merging import near_links
from ..streaming.memory import scanned

#: Overlap from which a copy's box is taken for one that is there.
SAME = 0.9


@dataclass(frozen=True)
class Merged:
    """images: image, source, ord, sha, disposition, of (the kept image of a duplicate). labels: image, class_id, box, source (whose label it was), salvaged. links: image, source, of_image (the copy), boxes."""

    images: DataFrame
    labels: DataFrame
    links: DataFrame

    def provenance(self) -> DataFrame:
        """image, source of those that stay."""
        return self.images.filter("disposition = 'accepted'").select("image", "source")

    def sources(self) -> DataFrame:
        """Per source: images in all and by disposition, labels salvaged from it, boxes linked from it."""
        names = {"accepted": "accepted", "duplicates": "duplicate", "filtered_out": "filtered", "missing_labels": "missing_label"}
        counts = self.images.groupBy("source").agg(F.count("*").alias("total"), *[F.count_if(F.col("disposition") == v).alias(k) for k, v in names.items()])
        moved = self.labels.filter("salvaged").groupBy("source").agg(F.count("*").alias("salvaged"))
        linked = self.links.groupBy("source").agg(F.sum(F.size("boxes")).alias("linked"))
        return counts.join(moved, "source", "left").join(linked, "source", "left").fillna(0, ["salvaged", "linked"])

    def class_counts(self) -> DataFrame:
        """class_id, n of the labels of images that stay, salvaged ones with them."""
        return self.labels.groupBy("class_id").agg(F.count("*").alias("n"))


def _overlap(a: tuple, b: tuple) -> float:
    wide = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    high = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    if wide <= 0 or high <= 0:
        return 0.0
    return wide * high / (a[2] * a[3] + b[2] * b[3] - wide * high)


def salvaged(kept: DataFrame, copies: DataFrame, same: float = SAME) -> DataFrame:
    """Boxes that copies add: image, class_id, box, source.

    kept: image, class_id, box; copies: the same of trusted classes, with source, copy and ord (the order of copies, and of boxes in one). A scan per image
    and class that holds the boxes that stand; a copy's boxes are not compared with each other.
    """
    flat = [F.col(f"box.{c}").cast("double").alias(c) for c in ("cx", "cy", "w", "h")]
    own = kept.select("image", "class_id", F.lit(-1).cast("long").alias("copy"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("source"), *flat)
    rows = own.unionByName(copies.select("image", "class_id", F.col("copy").cast("long").alias("copy"), F.col("ord").cast("long").alias("ord"), "source", *flat))

    def step(state: list, row: tuple) -> Iterator[tuple]:
        copy, _, source, *place = row
        if not state:
            state += [copy, [], []]
        if copy != state[0]:
            state[:] = [copy, state[1] + state[2], []]
        if copy < 0:
            state[2].append(place)
        elif all(_overlap(place, b) < same for b in state[1]):
            state[2].append(place)
            yield (*place, source)

    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("image", "class_id")}
    schema = f"image {kinds['image']}, class_id {kinds['class_id']}, cx double, cy double, w double, h double, source string"
    found = scanned(rows, ["image", "class_id"], ["copy", "ord"], schema, list, step, lambda s: ())
    return found.select("image", "class_id", F.struct("cx", "cy", "w", "h").alias("box"), "source")


def merge_sources(images: DataFrame, boxes: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, same: float = SAME, index: KeptIndex | None = None) -> Merged:
    """Merge images (image, source, ord, sha, h, flip, reason; ord unique) with boxes (image, ord, class_id, box), under trusted (source, class_id).

    An image without a box has no label, unless its column allow_empty says that it may. index: a KeptIndex that earlier merges filled; images that
    are near one of theirs are duplicates of it, and their labels go to no one here.
    """
    labelled = boxes.select("image").distinct().withColumn("_labelled", F.lit(True))
    allowed = F.col("allow_empty") if "allow_empty" in images.columns else F.lit(False)
    early = F.when(~F.coalesce("_labelled", F.lit(False)) & ~allowed, "missing_label").when(F.col("reason").isNotNull(), "filtered")
    staged = shared_table(images.join(labelled, "image", "left").withColumn("early", early).select("image", "source", "ord", "sha", "h", "flip", "early"))
    open_images = staged.filter("early is null").select("ord", "h", "flip", "sha")
    kept = shared_table(keep_in_order(open_images, threshold) if index is None else index.extend(open_images))
    fate = F.coalesce("early", F.when(F.col("kept"), "accepted").otherwise("duplicate"))
    firsts = staged.select(F.col("ord").alias("duplicate_of"), F.col("image").alias("of"), F.col("sha").alias("of_sha"))
    decided = staged.join(kept, "ord", "left").withColumn("disposition", fate).join(firsts, "duplicate_of", "left")
    decided = shared_table(decided.select("image", "source", "ord", "sha", "disposition", "of", (F.col("sha") == F.col("of_sha")).alias("identical")))

    stay = decided.filter("disposition = 'accepted'").select("image", "source")
    own = boxes.join(stay, "image").select("image", "class_id", "box", "source", F.lit(False).alias("salvaged"))
    gone = decided.filter("of is not null").select("image", "source", F.col("ord").alias("copy"), "of", F.coalesce("identical", F.lit(False)).alias("identical"))
    worth = shared_table(boxes.join(gone, "image").join(small(trusted), ["source", "class_id"], "left_semi"))
    exact = worth.filter("identical").select(F.col("of").alias("image"), "class_id", "box", "source", "copy", "ord")
    receiving = own.join(exact.select("image", "class_id").distinct(), ["image", "class_id"], "left_semi")
    more = salvaged(receiving, exact, same).withColumn("salvaged", F.lit(True))
    labels = shared_table(own.unionByName(more.select(own.columns)))
    near = worth.filter("not identical").select(F.col("of").alias("image"), F.col("image").alias("of_image"), "source", "class_id", "box")
    links = near_links(near, trusted, ["image", "of_image", "source"])
    return Merged(decided.drop("identical"), labels, links)
