"""Queries of a whole merge: dispositions, labels with what copies add, links, and the manifest's counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..plans.merge import Merged, merge_sources
from .base import BOXES, COARSE, boxes, coarse, grids, query, sql_iou
from .relations import NEAR

#: Overlap from which a copy's box is there already; and how many images the boxes are dealt to.
_SAME, _DEALT = 0.3, 500
#: A vector as an image of one of four sources, which come one after another; some have no box, some are filtered, equal files have equal last digits.
_STAGED = f"""{COARSE}, {BOXES}, bx AS (SELECT image % {_DEALT} AS image, image * 10 + ord AS ord, class_id, cx, cy, w, h FROM boxes WHERE ord <= 2),
 im AS (SELECT vec_id AS image, 's' || (vec_id % 4) AS source, (vec_id % 4) * 100000 + vec_id AS ord, vec_id % 3 AS sha, array_to_string(bits, '')::BIT AS b, array_to_string(flip_bits, '')::BIT AS f,
  CASE WHEN NOT EXISTS (SELECT 1 FROM bx WHERE bx.image = vec_id) THEN 'missing_label' WHEN vec_id % 17 = 0 THEN 'filtered' END AS early FROM hashes),
 r AS (SELECT ord, b, f, row_number() OVER (ORDER BY ord) AS n FROM im WHERE early IS NULL),
 g AS (SELECT n, ord, true AS kept, NULL::BIGINT AS duplicate_of, [{{'ord': ord, 'b': b}}] AS held FROM r WHERE n = 1 UNION ALL
  SELECT n, ord, len(near) = 0, coalesce(list_filter(near, lambda k: k.b = b)[1].ord, near[1].ord), CASE WHEN len(near) = 0 THEN list_append(held, {{'ord': ord, 'b': b}}) ELSE held END
  FROM (SELECT r.n, r.ord, r.b, held, list_filter(held, lambda k: bit_count(xor(k.b, r.b)) < {NEAR} OR bit_count(xor(k.b, r.f)) < {NEAR}) AS near FROM g JOIN r ON r.n = g.n + 1) x),
 dec AS (SELECT im.image, im.source, im.ord, coalesce(im.early, CASE WHEN g.kept THEN 'accepted' ELSE 'duplicate' END) AS disposition, o.image AS of, im.sha = o.sha AS identical
  FROM im LEFT JOIN g USING (ord) LEFT JOIN im o ON o.ord = g.duplicate_of),
 own AS (SELECT image, class_id, cx, cy, w, h, source, false AS salvaged FROM bx JOIN dec USING (image) WHERE disposition = 'accepted'),
 worth AS (SELECT d.of AS image, d.image AS of_image, d.source, d.ord AS copy, d.identical, b.ord, b.class_id, cx, cy, w, h FROM bx b JOIN dec d USING (image) WHERE d.of IS NOT NULL AND class_id % 4 = substr(d.source, 2)::INT)"""
#: Copies of one image and class are numbered, and each adds what does not overlap with what stands there.
_SALVAGED = f"""{_STAGED},
 cp AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY copy) AS k FROM (
  SELECT image, class_id, source, copy, list({{'cx': cx, 'cy': cy, 'w': w, 'h': h}} ORDER BY ord) AS adds FROM worth WHERE identical GROUP BY 1, 2, 3, 4) y),
 f AS (SELECT i.image, i.class_id, 0::BIGINT AS k, '' AS source, coalesce((SELECT list({{'cx': cx, 'cy': cy, 'w': w, 'h': h}}) FROM own WHERE own.image = i.image AND own.class_id = i.class_id), []) AS held, []::STRUCT(cx DOUBLE, cy DOUBLE, w DOUBLE, h DOUBLE)[] AS new
   FROM (SELECT DISTINCT image, class_id FROM cp) i UNION ALL
  SELECT image, class_id, k, source, list_concat(held, new), new FROM (SELECT f.image, f.class_id, cp.k, cp.source, f.held, list_filter(cp.adds, lambda a: len(list_filter(f.held, lambda b: {sql_iou('a', 'b')} >= {_SAME})) = 0) AS new
   FROM f JOIN cp ON cp.image = f.image AND cp.class_id = f.class_id AND cp.k = f.k + 1) z),
 more AS (SELECT image, class_id, unnest(new) AS b, source FROM f WHERE k > 0),
 labels AS (SELECT image, class_id, cx, cy, w, h, source, salvaged FROM own UNION ALL SELECT image, class_id, b.cx, b.cy, b.w, b.h, source, true FROM more)"""


def _merged(spark, sf_dir) -> Merged:
    g = F.col("grid")
    k = F.col("vec_id")
    images = grids(spark, sf_dir).withColumn("grid", coarse(g)).select(
        k.alias("image"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("source"), ((k % 4) * 100_000 + k).alias("ord"), (k % 3).cast("string").alias("sha"),
        H.average_hash(g).alias("h"), H.average_hash(H.mirrored(g)).alias("flip"), F.when(k % 17 == 0, "too_dark").alias("reason"),
    )
    b = boxes(spark, sf_dir).filter("ord <= 2").select((F.col("image") % _DEALT).alias("image"), (F.col("image") * 10 + F.col("ord")).alias("ord"), "class_id", "box")
    trusted = spark.range(4).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(22)), lambda c: c % 4 == F.col("id"))).alias("class_id"))
    return merge_sources(images, b, trusted, NEAR, _SAME)


@query(f"WITH RECURSIVE {_STAGED} SELECT image, source, disposition, of FROM dec")
def merge_images(spark, sf_dir):
    return _merged(spark, sf_dir).images.select("image", "source", "disposition", "of")


def _corners(df: DataFrame) -> list:
    return [F.round(f"box.{c}", 8).alias(c) for c in ("cx", "cy", "w", "h")]


@query(f"WITH RECURSIVE {_SALVAGED} SELECT image, class_id, source, salvaged, round(cx, 8) AS cx, round(cy, 8) AS cy, round(w, 8) AS w, round(h, 8) AS h FROM labels")
def merge_labels(spark, sf_dir):
    labels = _merged(spark, sf_dir).labels
    return labels.select("image", "class_id", "source", "salvaged", *_corners(labels))


@query(f"WITH RECURSIVE {_STAGED} SELECT image, of_image, source, count(*) AS n, string_agg(class_id, ',' ORDER BY class_id) AS classes FROM worth WHERE NOT identical GROUP BY ALL")
def merge_links(spark, sf_dir):
    links = _merged(spark, sf_dir).links
    return links.select("image", "of_image", "source", F.size("boxes").cast("long").alias("n"), F.array_join(F.transform("boxes", lambda b: b["class_id"].cast("string")), ",").alias("classes"))


@query(f"""WITH RECURSIVE {_SALVAGED} SELECT source, count(*) AS total, count(*) FILTER (WHERE disposition = 'accepted') AS accepted, count(*) FILTER (WHERE disposition = 'duplicate') AS duplicates,
 count(*) FILTER (WHERE disposition = 'filtered') AS filtered_out, count(*) FILTER (WHERE disposition = 'missing_label') AS missing_labels,
 (SELECT count(*) FROM more WHERE more.source = dec.source) AS salvaged, (SELECT count(*) FROM worth WHERE worth.source = dec.source AND NOT identical) AS linked FROM dec GROUP BY source""")
def merge_manifest(spark, sf_dir):
    return _merged(spark, sf_dir).sources()
