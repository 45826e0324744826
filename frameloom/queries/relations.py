"""Queries of joins, set operations, dedup, splits and the verification loop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import names as N
from ..operators import dedup, gates, labels, matching, merging, policies, splits, verification
from .base import BOXES, CLASSES, COARSE, IMAGES, N_CLASSES, PRIORITY, boxes, coarse, grids, images, query, sql_distance, sql_iou, table, taxonomy, written_boxes

NEAR = dedup.THRESHOLD
PROMPTABLE = [2, 5, 10, 11, 20]


def _side(spark, sf_dir, side, b=None):
    return (b or boxes(spark, sf_dir)).filter(F.col("side") == side)


def _trust(spark, sf_dir, b=None):
    """A source trusts the classes whose id leaves its own number modulo 3."""
    src = (b or boxes(spark, sf_dir)).select("source").distinct()
    ids = F.filter(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda c: c % 3 == F.substring("source", 2, 1).cast("int") % 3)
    return src.select("source", ids.alias("ids"))


TRUST = "trust AS (SELECT source, list_filter(range(23), lambda c: c % 3 = substr(source, 2, 1)::INT % 3) AS ids FROM (SELECT DISTINCT source FROM boxes))"
_VERIFIED = "verified AS (SELECT DISTINCT image, class_id FROM boxes WHERE side = 'R' AND image % 4 = 0)"


def _verified(spark, sf_dir, b=None):
    return _side(spark, sf_dir, "R", b).filter(F.col("image") % 4 == 0).select("image", "class_id").distinct()


def _box_images(spark, sf_dir, b=None):
    return (b or boxes(spark, sf_dir)).select("image", "source").distinct()


@query("WITH l AS (SELECT p_partkey, p_name AS stem FROM part WHERE p_partkey % 2 = 0), i AS (SELECT stem, max(p_partkey) AS label_path FROM l GROUP BY stem) SELECT p.p_partkey, p.p_name AS stem, i.label_path FROM part p LEFT JOIN i ON p.p_name = i.stem")
def pair_image_label(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("stem"))
    return labels.pair_images_labels(p, p.filter("p_partkey % 2 = 0").select("stem", F.col("p_partkey").alias("label_path")), "stem")


_REMAP = "t AS (SELECT * FROM (VALUES ('ECONOMY', 3), ('SMALL', 5), ('LARGE', 9), ('PROMO', 11)) x(name, target)), al AS (SELECT * FROM (VALUES ('SMALL', 20), ('MEDIUM', 7)) x(name, target)), u AS (SELECT name, coalesce(al.target, t.target) AS target FROM t FULL JOIN al USING (name))"


def _remap_table(spark):
    base = spark.createDataFrame([("ECONOMY", 3), ("SMALL", 5), ("LARGE", 9), ("PROMO", 11)], "name string, target int")
    return merging.with_aliases(base, spark.createDataFrame([("SMALL", 20), ("MEDIUM", 7)], "name string, target int"))


@query(f"WITH {_REMAP} SELECT p_partkey, p_type AS name, target FROM part LEFT JOIN u ON p_type = name")
def remap_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("name"))
    return merging.remap(p, _remap_table(spark), ["name"])


@query(f"WITH {_REMAP} SELECT p_brand AS source, p_type AS name, count(*) AS dropped FROM part LEFT JOIN u ON p_type = name WHERE target IS NULL GROUP BY 1, 2")
def remap_dropped(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("name"))
    return merging.dropped_counts(merging.remap(p, _remap_table(spark), ["name"]))


@query("""WITH b AS (SELECT p_type || '-' || p_size AS name, min(p_partkey) % 23 AS target FROM part WHERE p_partkey % 3 > 0 GROUP BY 1), a AS (SELECT p_type || '-' || p_size AS name, max(p_partkey) % 7 AS target FROM part WHERE p_partkey % 4 = 0 GROUP BY 1)
SELECT name, coalesce(a.target, b.target) AS target FROM b FULL JOIN a USING (name)""")
def remap_table_alias(spark, sf_dir):
    """Kinds of part and their targets, some of them given anew, some only there."""
    p = table(spark, sf_dir, "part").withColumn("name", F.concat_ws("-", "p_type", "p_size"))
    base = p.filter("p_partkey % 3 > 0").groupBy("name").agg((F.min("p_partkey") % 23).alias("target"))
    return merging.with_aliases(base, p.filter("p_partkey % 4 = 0").groupBy("name").agg((F.max("p_partkey") % 7).alias("target")))


def _hashes(spark, sf_dir):
    """Written to the shared folder, since the queries read them several times: each hash is made once."""
    g = F.col("grid")
    return dedup.shared_table(grids(spark, sf_dir).withColumn("grid", coarse(g)).select(F.col("vec_id").alias("ord"), H.average_hash(g).alias("h"), H.average_hash(H.mirrored(g)).alias("flip"), F.lit(None).cast("string").alias("sha")))


@query(f"WITH {COARSE}, d AS (SELECT DISTINCT bits FROM hashes) SELECT least(a.vec_id, b.vec_id) AS a_id, greatest(a.vec_id, b.vec_id) AS b_id, {sql_distance('a.bits', 'b.bits')}::BIGINT AS distance FROM hashes a JOIN hashes b ON a.vec_id < b.vec_id WHERE {sql_distance('a.bits', 'b.bits')} BETWEEN 1 AND {NEAR - 1}")
def hamming_pairs(spark, sf_dir):
    rows = _hashes(spark, sf_dir).select("ord", "h")
    met = dedup.hamming_pairs(rows, NEAR)
    a, b = rows.select(F.col("ord").alias("x"), F.col("h").alias("a")), rows.select(F.col("ord").alias("y"), F.col("h").alias("b"))
    return met.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"), F.col("distance").cast("long").alias("distance"))


def _dedup_sql(hashes: str, near: int) -> str:
    """One hash after another, against all that were kept; hashes: CTEs that end in r (ord, b, f, n)."""
    return f"""WITH RECURSIVE {hashes},
 g AS (SELECT n, ord, true AS kept, NULL::BIGINT AS duplicate_of, [{{'ord': ord, 'b': b}}] AS held FROM r WHERE n = 1 UNION ALL
  SELECT n, ord, len(near) = 0, coalesce(list_filter(near, lambda k: k.b = b)[1].ord, near[1].ord), CASE WHEN len(near) = 0 THEN list_append(held, {{'ord': ord, 'b': b}}) ELSE held END
  FROM (SELECT r.n, r.ord, r.b, held, list_filter(held, lambda k: bit_count(xor(k.b, r.b)) < {near} OR bit_count(xor(k.b, r.f)) < {near}) AS near FROM g JOIN r ON r.n = g.n + 1) x)
SELECT ord, kept, duplicate_of FROM g"""


_BY_GRID = f"{COARSE}, r AS (SELECT vec_id AS ord, array_to_string(bits, '')::BIT AS b, array_to_string(flip_bits, '')::BIT AS f, row_number() OVER (ORDER BY vec_id) AS n FROM hashes)"
_DEDUP = _dedup_sql(_BY_GRID, NEAR)


@query(_DEDUP)
def dedup_near(spark, sf_dir):
    return dedup.keep_in_order(_hashes(spark, sf_dir), NEAR)


@query(_DEDUP)
def dedup_by_index(spark, sf_dir):
    """The same images in three merges, each decided against the index of what was kept before."""
    rows = _hashes(spark, sf_dir).withColumns({"h": F.array("h"), "flip": F.array("flip")})
    index, out = dedup.KeptIndex(spark, f"{dedup.shared_folder(spark)}/kept-{uuid.uuid4().hex}", 64, NEAR), None
    last = rows.agg(F.max("ord")).first()[0] or 0
    for i in range(3):
        done = index.extend(rows.filter(F.col("ord").between(i * (last // 3 + 1), (i + 1) * (last // 3 + 1) - 1)))
        out = done if out is None else out.unionByName(done)
    return out


#: Wide hashes: a bit for each cell and level above the mean, so 256 of a grid of 64, and coarse grids differ in steps of four bits.
_LEVELS, _NEAR_WIDE = (-0.1, 0.0, 0.05, 0.12), 21
_WIDE = ", ".join(f"list_transform({{v}}, lambda x: CASE WHEN x::DOUBLE > list_sum(list_transform({{v}}, lambda y: y::DOUBLE)) / 64 + {t} THEN 1 ELSE 0 END)" for t in _LEVELS)
_BY_LEVELS = f"{COARSE}, r AS (SELECT vec_id AS ord, array_to_string(flatten([{_WIDE.format(v='grid')}]), '')::BIT AS b, array_to_string(flatten([{_WIDE.format(v='mirror')}]), '')::BIT AS f, row_number() OVER (ORDER BY vec_id) AS n FROM grids)"


@query(_dedup_sql(_BY_LEVELS, _NEAR_WIDE))
def dedup_near_wide(spark, sf_dir):
    """Near images by hashes of 256 bits, as four lanes."""
    g = grids(spark, sf_dir).select("vec_id", coarse(F.col("grid")).alias("g"))
    wide = lambda c: F.array(*[H.average_hash(c, t) for t in _LEVELS])
    rows = g.select(F.col("vec_id").alias("ord"), wide(F.col("g")).alias("h"), wide(H.mirrored(F.col("g"))).alias("flip"), F.lit(None).cast("string").alias("sha"))
    return dedup.keep_in_order(dedup.shared_table(rows), _NEAR_WIDE)


@query(f"""WITH {COARSE}, l AS (SELECT vec_id, bits FROM hashes WHERE vec_id % 10 = 0), t AS (SELECT vec_id, bits, flip_bits FROM hashes WHERE vec_id % 10 <> 0),
 e AS (SELECT l.vec_id AS image, min(t.vec_id) AS match FROM embeddings l JOIN embeddings t ON l.embedding = t.embedding AND l.vec_id % 10 = 0 AND t.vec_id % 10 <> 0 GROUP BY 1)
SELECT image, 'exact' AS kind, match FROM e UNION ALL SELECT l.vec_id, 'near', min(t.vec_id) FROM l JOIN t ON {sql_distance('l.bits', 't.bits')} < {NEAR} OR {sql_distance('l.bits', 't.flip_bits')} < {NEAR} WHERE l.vec_id NOT IN (SELECT image FROM e) GROUP BY 1""")
def eval_overlap(spark, sf_dir):
    digest = F.md5(F.array_join(F.col("grid").cast("array<string>"), ","))
    h = grids(spark, sf_dir).select("vec_id", digest.alias("sha")).join(_hashes(spark, sf_dir).drop("sha").withColumn("image", F.col("ord")), F.col("vec_id") == F.col("ord"))
    return dedup.eval_overlap(h.filter("ord % 10 = 0"), h.filter("ord % 10 <> 0"), NEAR)


@query(f"WITH {IMAGES}, f AS (SELECT sha, min(image) AS first FROM images GROUP BY sha) SELECT i.sha, image, first FROM images i JOIN f ON i.sha = f.sha WHERE image <> first")
def dup_files(spark, sf_dir):
    return dedup.copies(images(spark, sf_dir).select("sha", "image"), "sha", "image")


@query(f"WITH {IMAGES}, s AS (SELECT DISTINCT sha, split FROM images) SELECT a.sha, a.split AS split_a, b.split AS split_b FROM s a JOIN s b ON a.sha = b.sha AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test'))")
def split_leakage(spark, sf_dir):
    return dedup.split_leakage(images(spark, sf_dir).select("sha", "split"))


@query("WITH f AS (SELECT DISTINCT p_name AS filename, ['train', 'val', 'test'][CAST(p_partkey % 3 + 1 AS INT)] AS split FROM part  ) SELECT filename, string_agg(split, ',' ORDER BY split) AS splits FROM f GROUP BY 1 HAVING count(*) > 1")
def filename_leakage(spark, sf_dir):
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return splits.filename_leakage(table(spark, sf_dir, "part").select(F.col("p_name").alias("filename"), split.alias("split")))


@query(f"WITH {BOXES}, {TRUST}, k AS (SELECT * FROM boxes WHERE side = 'A'), c AS (SELECT b.* FROM boxes b JOIN trust t ON b.source = t.source AND list_contains(ids, class_id) WHERE side = 'R') SELECT image, ord, class_id FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.image = c.image AND k.class_id = c.class_id AND {sql_iou('k', 'c')} >= 0.2)")
def salvage_theta(spark, sf_dir):
    b = written_boxes(spark, sf_dir)
    trusted = _trust(spark, sf_dir, b).select("source", F.explode("ids").alias("class_id"))
    return merging.salvage(_side(spark, sf_dir, "A", b), _side(spark, sf_dir, "R", b), trusted, threshold=0.2).select("image", "ord", "class_id")


@query(f"WITH {BOXES}, {TRUST} SELECT image, b.source, count(*) AS n, string_agg(class_id, ',' ORDER BY class_id) AS classes FROM boxes b JOIN trust t ON b.source = t.source AND list_contains(ids, class_id) WHERE side = 'N' GROUP BY 1, 2")
def near_link(spark, sf_dir):
    trusted = _trust(spark, sf_dir).select("source", F.explode("ids").alias("class_id"))
    linked = merging.near_links(_side(spark, sf_dir, "N"), trusted)
    return linked.select("image", "source", F.size("boxes").cast("long").alias("n"), F.array_join(F.transform("boxes", lambda b: b["class_id"].cast("string")), ",").alias("classes"))


@query(f"WITH {IMAGES} SELECT DISTINCT l_orderkey AS image FROM lineitem WHERE l_orderkey NOT IN (SELECT image FROM images)")
def provenance_join(spark, sf_dir):
    return merging.without_provenance(boxes(spark, sf_dir).select("image").distinct(), images(spark, sf_dir))


@query(f"WITH {IMAGES}, l AS (SELECT doc_id * 2 AS image, CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE 'src' || ((doc_id * 2) % 20) END AS source FROM labels) SELECT l.image, l.source, CASE WHEN i.source IS NULL THEN 'skipped' WHEN i.source <> l.source THEN 'mismatch' ELSE 'ok' END AS branch FROM l LEFT JOIN images i ON l.image = i.image")
def ledger_prov_join(spark, sf_dir):
    even = F.col("doc_id") * 2
    entries = table(spark, sf_dir, "labels").select(even.alias("image"), F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.concat(F.lit("src"), (even % 20).cast("string"))).alias("source"))
    return policies.provenance_branches(entries, images(spark, sf_dir))


_RESOLVED = "i AS (SELECT DISTINCT image, source FROM boxes), v AS (SELECT image, list(class_id) AS seen FROM verified GROUP BY image), r AS (SELECT i.image, i.source, ids, list_sort(list_distinct(list_concat(ids, coalesce(seen, [])))) AS wide FROM i JOIN trust USING (source) LEFT JOIN v ON v.image = i.image)"


@query(f"WITH {BOXES}, {TRUST}, {_VERIFIED}, {_RESOLVED} SELECT image, CASE WHEN len(wide) > len(ids) THEN source || '+' || substr(sha256('[' || array_to_string(wide, ',') || ']'), 1, 8) ELSE source END AS policy, array_to_string(wide, ',') AS ids FROM r")
def policy_expand(spark, sf_dir):
    base = policies.trusted_list(_box_images(spark, sf_dir), _trust(spark, sf_dir))
    wide = policies.with_ledger(base, _verified(spark, sf_dir))
    return wide.select("image", "policy", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("WITH s AS (SELECT doc_id AS image, count(DISTINCT q % 5) AS n, min(q % 5) AS slug FROM (SELECT doc_id, doc_id % 7 AS q FROM labels WHERE doc_id % 9 <> 0 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1) GROUP BY 1) SELECT d.doc_id AS image, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' ELSE 'untrusted' END AS problem FROM documents d LEFT JOIN s ON s.image = d.doc_id WHERE n IS NULL OR n > 1 OR slug = 4")
def slug_join(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    slugs = lab.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("image"), (F.col("doc_id") % 7 % 5).alias("slug")).union(lab.filter("toxic = 1").select("doc_id", F.lit(1).cast("long")))
    trust = spark.createDataFrame([(s, [s]) for s in range(4)], "slug long, ids array<int>")
    return policies.slug_problems(images(spark, sf_dir).select("image"), slugs, trust)


@query(f"WITH {IMAGES}, s AS (SELECT 'h' || lpad(k::VARCHAR, 2, '0') || x AS session FROM range(12) t(k), (VALUES (''), ('_pooja_room'), ('_pooja_room_s001')) y(x)) SELECT image, max_by(session, len(session)) AS policy FROM images JOIN s ON starts_with(name, session || '_') GROUP BY image")
def session_prefix_join(spark, sf_dir):
    s = spark.range(12).select(F.explode(F.array(*[F.concat(F.lit("h"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(x)) for x in ("", "_pooja_room", "_pooja_room_s001")])).alias("session"), F.array(F.lit(1)).alias("ids"))
    named = images(spark, sf_dir).select(F.col("name").alias("image"), F.col("image").alias("id"))
    return policies.per_session(named, s).join(named, "image").select(F.col("id").alias("image"), "policy")


@query(f"WITH {BOXES}, {TRUST}, {_VERIFIED}, {_RESOLVED} SELECT image, array_to_string(list_filter({PROMPTABLE}, lambda c: NOT list_contains(wide, c)), ',') AS class_ids FROM r WHERE len(list_filter({PROMPTABLE}, lambda c: NOT list_contains(wide, c))) > 0")
def target_anti(spark, sf_dir):
    b = written_boxes(spark, sf_dir)
    i = _box_images(spark, sf_dir, b)
    found = verification.targets(i, PROMPTABLE, policies.trusted_list(i, _trust(spark, sf_dir, b)), _verified(spark, sf_dir, b))
    return found.select("image", F.array_join(F.col("class_ids").cast("array<string>"), ",").alias("class_ids"))


@query(f"WITH {BOXES}, {TRUST} SELECT t.source || '' AS policy, array_to_string(ids, ',') AS ids, count(*) AS images FROM (SELECT DISTINCT image, source FROM boxes) i JOIN trust t ON i.source = t.source GROUP BY 1, 2")
def completeness_policies(spark, sf_dir):
    t = policies.policy_table(policies.trusted_list(_box_images(spark, sf_dir), _trust(spark, sf_dir)))
    return t.select("policy", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "images")


@query(f"WITH {BOXES}, {TRUST}, {_VERIFIED}, {_RESOLVED} SELECT c AS class_id, count(*) AS images FROM (SELECT unnest(wide)::INT AS c FROM r) GROUP BY 1")
def completeness_stats(spark, sf_dir):
    base = policies.trusted_list(_box_images(spark, sf_dir), _trust(spark, sf_dir))
    return policies.completeness_stats(policies.with_ledger(base, _verified(spark, sf_dir)))


def _sides(spark, sf_dir):
    b = written_boxes(spark, sf_dir)
    return tuple(_side(spark, sf_dir, s, b).select("image", "class_id", "ord", "box") for s in "AR")


def _coarse(df):
    """Classes modulo 3, so that groups have several boxes to match."""
    return df.withColumn("class_id", F.col("class_id") % 3)


def _sql_sides(a: str, b: str) -> str:
    """Boxes of two sides, numbered in a group, and the right side's as a list."""
    return f"""s AS (SELECT image, class_id % 3 AS class_id, side, cx, cy, w, h, row_number() OVER (PARTITION BY image, class_id % 3, side ORDER BY ord) AS n FROM boxes WHERE side IN ('{a}', '{b}')),
 na AS (SELECT image, class_id, count(*) FILTER (WHERE side = '{a}') AS a, count(*) FILTER (WHERE side = '{b}') AS b FROM s GROUP BY 1, 2)"""


_SEQ = f"""WITH RECURSIVE {BOXES}, {_sql_sides('A', 'R')}, t AS (SELECT image, class_id, list({{'i': n, 'cx': cx, 'cy': cy, 'w': w, 'h': h}} ORDER BY n) AS t FROM s WHERE side = 'R' GROUP BY 1, 2),
 g AS (SELECT image, class_id, 0::BIGINT AS n, []::BIGINT[] AS used, 0.0::DOUBLE AS total FROM na UNION ALL
  SELECT image, class_id, n, CASE WHEN best.s >= 0.2 THEN list_append(used, -best.i) ELSE used END, CASE WHEN best.s >= 0.2 THEN total + best.s ELSE total END
  FROM (SELECT s.image, s.class_id, s.n, used, total, list_max(list_transform(list_filter(t.t, lambda k: NOT list_contains(used, k.i)), lambda k: {{'s': {sql_iou('k', 's')}::DOUBLE, 'i': -k.i}})) AS best
   FROM g JOIN s ON s.side = 'A' AND s.image = g.image AND s.class_id = g.class_id AND s.n = g.n + 1 LEFT JOIN t ON t.image = g.image AND t.class_id = g.class_id) x),
 m AS (SELECT g.image, g.class_id, len(used) AS tp, na.a - len(used) AS fp, na.b - len(used) AS fn, total AS iou_sum FROM g JOIN na ON g.image = na.image AND g.class_id = na.class_id AND g.n = na.a)"""
_BY_IOU = f"""WITH RECURSIVE {BOXES}, {_sql_sides('A', 'R')}, p AS (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY s DESC, i, j) AS n FROM (
  SELECT k.image, k.class_id, k.n AS i, r.n AS j, {sql_iou('k', 'r')}::DOUBLE AS s FROM s k JOIN s r ON k.side = 'A' AND r.side = 'R' AND k.image = r.image AND k.class_id = r.class_id) x WHERE s >= 0.2),
 np AS (SELECT na.*, (SELECT count(*) FROM p WHERE p.image = na.image AND p.class_id = na.class_id) AS pairs FROM na),
 g AS (SELECT image, class_id, 0::BIGINT AS n, []::BIGINT[] AS ua, []::BIGINT[] AS ub, 0.0::DOUBLE AS total FROM np UNION ALL
  SELECT p.image, p.class_id, p.n, CASE WHEN list_contains(ua, i) OR list_contains(ub, j) THEN ua ELSE list_append(ua, i) END, CASE WHEN list_contains(ua, i) OR list_contains(ub, j) THEN ub ELSE list_append(ub, j) END,
   CASE WHEN list_contains(ua, i) OR list_contains(ub, j) THEN total ELSE total + s END FROM g JOIN p ON p.image = g.image AND p.class_id = g.class_id AND p.n = g.n + 1),
 m AS (SELECT g.image, g.class_id, len(ua) AS matched, np.a - len(ua) AS only_a, np.b - len(ua) AS only_b, total AS iou_sum FROM g JOIN np ON g.image = np.image AND g.class_id = np.class_id AND g.n = np.pairs)"""


@query(f"{_SEQ} SELECT image, class_id, tp, fp, fn, round(iou_sum, 6) AS iou_sum FROM m")
def match_greedy_seq(spark, sf_dir):
    a, b = map(_coarse, _sides(spark, sf_dir))
    return matching.match_in_order(a, b, ["image", "class_id"], 0.2).withColumn("iou_sum", F.round("iou_sum", 6))


@query(f"{_BY_IOU} SELECT image, class_id, matched, only_a, only_b, round(iou_sum, 6) AS iou_sum FROM m")
def match_greedy_iou(spark, sf_dir):
    a, b = map(_coarse, _sides(spark, sf_dir))
    return matching.match_by_overlap(a, b, ["image", "class_id"], 0.2).withColumn("iou_sum", F.round("iou_sum", 6))


_NMS = f"""WITH RECURSIVE {BOXES}, r AS (SELECT image, class_id % 3 AS class_id, ord, conf, cx, cy, w, h, row_number() OVER (PARTITION BY image, class_id % 3 ORDER BY conf DESC, ord) AS n FROM boxes),
 g AS (SELECT image, class_id, n, conf, ord, cx, cy, w, h, true AS kept, [{{'cx': cx, 'cy': cy, 'w': w, 'h': h}}] AS held FROM r WHERE n = 1 UNION ALL
  SELECT r.image, r.class_id, r.n, r.conf, r.ord, r.cx, r.cy, r.w, r.h, len(list_filter(held, lambda k: {sql_iou('k', 'r')} >= 0.3)) = 0,
   CASE WHEN len(list_filter(held, lambda k: {sql_iou('k', 'r')} >= 0.3)) = 0 THEN list_append(held, {{'cx': r.cx, 'cy': r.cy, 'w': r.w, 'h': r.h}}) ELSE held END
  FROM g JOIN r ON r.image = g.image AND r.class_id = g.class_id AND r.n = g.n + 1)
SELECT image, class_id, ord, conf FROM g WHERE kept"""


@query(_NMS)
def nms_theta(spark, sf_dir):
    return matching.suppress(_coarse(boxes(spark, sf_dir)), ["image", "class_id"], 0.3).select("image", "class_id", "ord", "conf")


@query(f"{_BY_IOU} SELECT class_id, sum(matched)::BIGINT AS matched, sum(only_a)::BIGINT AS only_a, sum(only_b)::BIGINT AS only_b, round(sum(matched) / (sum(matched) + sum(only_a) + sum(only_b)), 6) AS agreement, round(CASE WHEN sum(matched) > 0 THEN sum(iou_sum) / sum(matched) END, 6) AS mean_iou FROM m GROUP BY 1")
def agreement(spark, sf_dir):
    a, b = map(_coarse, _sides(spark, sf_dir))
    by = matching.agreement(matching.match_by_overlap(a, b, ["image", "class_id"], 0.2), ["class_id"])
    return by.withColumns({c: F.round(c, 6) for c in ("agreement", "mean_iou")})


@query(f"{_BY_IOU} SELECT image, round(sum(matched) / (sum(matched) + sum(only_a) + sum(only_b)), 6) AS agreement FROM m GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def worst_images(spark, sf_dir):
    """The five images on which annotators agree least: a report's limit."""
    a, b = map(_coarse, _sides(spark, sf_dir))
    by = matching.agreement(matching.match_by_overlap(a, b, ["image", "class_id"], 0.2), ["image"])
    return matching.worst_images(by, 5).select("image", F.round("agreement", 6).alias("agreement"))


_F1 = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


@query(f"""{_SEQ}, c AS (SELECT class_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0 END::DOUBLE AS p, CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0 END::DOUBLE AS r FROM m GROUP BY 1),
 o AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(p) FILTER (WHERE tp + fn > 0) AS mp, avg(r) FILTER (WHERE tp + fn > 0) AS mr, avg({_F1.format(p='p', r='r')}) FILTER (WHERE tp + fn > 0) AS mf,
  coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0)::DOUBLE AS up, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0)::DOUBLE AS ur FROM c)
SELECT tp, fp, fn, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(up, 6) AS micro_precision, round(ur, 6) AS micro_recall, round({_F1.format(p='up', r='ur')}, 6) AS micro_f1 FROM o""")
def micro_macro(spark, sf_dir):
    a, b = map(_coarse, _sides(spark, sf_dir))
    one = matching.micro_macro(matching.truth_scores(matching.match_in_order(a, b, ["image", "class_id"], 0.2)))
    return one.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in one.columns if c not in ("tp", "fp", "fn")])


@query(f"WITH {IMAGES}, g AS (SELECT DISTINCT name AS k FROM images), r AS (SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS rank, count(*) OVER () AS n FROM g) SELECT k AS group_key, CASE WHEN rank <= round_even(n * 0.8, 0) THEN 'train' WHEN rank <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM r")
def split_group_aware(spark, sf_dir):
    return splits.group_aware(images(spark, sf_dir).select(F.col("name").alias("group_key")))


_HOUSE = "'house:' || regexp_extract(name, '(?:^|_)(h\\d{2,})_', 1)"


@query(f"WITH {IMAGES}, g AS (SELECT DISTINCT name AS k, regexp_extract(name, '(?:^|_)(h\\d{{2,}})_', 1) AS hs FROM images), s AS (SELECT k, hs, CASE WHEN hs <> '' THEN 'house:' || hs ELSE 'solo:' || k END AS super_key FROM g), p AS (SELECT DISTINCT super_key FROM s WHERE hs NOT IN ('h01', 'h07')), r AS (SELECT super_key, row_number() OVER (ORDER BY md5('42:' || super_key), super_key) AS rank, count(*) OVER () AS n FROM p) SELECT k AS group_key, s.super_key, CASE WHEN hs IN ('h01', 'h07') THEN 'test' WHEN rank <= round_even(n * 0.8 / (0.8 + 0.1), 0) THEN 'train' ELSE 'val' END AS split FROM s LEFT JOIN r ON s.super_key = r.super_key")
def split_house(spark, sf_dir):
    return splits.leave_houses_out(images(spark, sf_dir).select(F.col("name").alias("group_key")), ["h01", "h07"])


#: Groups of a stratum: each stratum is balanced by itself, in a task of its own.
STRATUM = 200
_STRATIFIED = f"""WITH RECURSIVE {BOXES}, b AS (SELECT image // 20 AS group_key, image, class_id FROM boxes), k AS (SELECT group_key, group_key // {STRATUM} AS stratum, count(DISTINCT image) AS images, count(*) AS total FROM b GROUP BY 1),
 h AS (SELECT group_key, class_id, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2), dense AS (SELECT k.group_key, list(coalesce(h.n, 0) ORDER BY c) AS n FROM k CROSS JOIN range(23) t(c) LEFT JOIN h ON h.group_key = k.group_key AND h.class_id = c GROUP BY 1),
 w AS (SELECT stratum, sum(images) AS all_images, list_transform(range(23), lambda c: list_sum(list_transform(list(n), lambda x: x[c + 1]))) AS all_n FROM k JOIN dense USING (group_key) GROUP BY 1),
 r AS (SELECT k.group_key, k.stratum, k.images, dense.n AS held, row_number() OVER (PARTITION BY k.stratum ORDER BY k.total DESC, md5('42:' || k.group_key), k.group_key) AS nth FROM k JOIN dense ON dense.group_key = k.group_key),
 g AS (SELECT stratum, 0::BIGINT AS nth, NULL::BIGINT AS group_key, NULL::INT AS s, [0.0, 0.0, 0.0]::DOUBLE[] AS filled, list_transform(range(69), lambda i: 0.0::DOUBLE) AS counts FROM w UNION ALL
  SELECT stratum, nth, group_key, s, list_transform(range(3), lambda i: filled[i + 1] + CASE WHEN i = s THEN images ELSE 0 END), list_transform(range(69), lambda i: counts[i + 1] + CASE WHEN i // 23 = s THEN held[i % 23 + 1] ELSE 0 END)
  FROM (SELECT *, CASE WHEN gain[1] >= gain[2] AND gain[1] >= gain[3] THEN 0 WHEN gain[2] >= gain[3] THEN 1 ELSE 2 END AS s FROM (
   SELECT r.*, filled, counts, list_transform([0.8::DOUBLE, 0.1::DOUBLE, 1 - (0.8::DOUBLE + 0.1::DOUBLE)], lambda share, i: round(list_sum(list_transform(range(23), lambda c: least(held[c + 1], greatest(all_n[c + 1] * share - counts[(i - 1) * 23 + c + 1], 0)))) - (filled[i] / all_images - share), 9)) AS gain
   FROM g JOIN r ON r.stratum = g.stratum AND r.nth = g.nth + 1 JOIN w ON w.stratum = r.stratum) x) y)
SELECT group_key, ['train', 'val', 'test'][s + 1] AS split FROM g WHERE nth > 0"""


@query(_STRATIFIED)
def split_stratified(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("group_key", F.expr("image div 20"))
    sizes = b.groupBy("group_key").agg(F.countDistinct("image").alias("images")).withColumn("stratum", F.expr(f"group_key div {STRATUM}"))
    return splits.stratified(b.groupBy("group_key", "class_id").agg(F.count("*").alias("n")), sizes)


@query(f"WITH {BOXES}, i AS (SELECT image FROM boxes GROUP BY image HAVING NOT bool_or(class_id IN (1, 2, 3))) SELECT image FROM i ORDER BY md5('42:' || image), image LIMIT 25")
def negatives_sample(spark, sf_dir):
    held = boxes(spark, sf_dir).groupBy("image").agg(F.collect_set("class_id").alias("classes"))
    return splits.negatives(held, [1, 2, 3], 25)


_CLASS = "CASE class_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CLASSES)) + " END"


@query(f"""WITH {BOXES}, c AS (SELECT image, {_CLASS} AS name, conf FROM boxes WHERE side = 'N' AND image % 5 <> 0),
 g AS (SELECT image, round(sum(CASE WHEN name IN {PRIORITY} THEN 2 ELSE 1 END * conf), 6) AS gain FROM c GROUP BY image), r AS (SELECT *, (row_number() OVER (ORDER BY gain DESC, image) - 1) // 40 AS b FROM g)
SELECT printf('vb%03d_model', b + 3) AS batch_id, count(DISTINCT r.image) AS n_images, md5(string_agg(DISTINCT r.image, ',' ORDER BY r.image)) AS images, string_agg(DISTINCT name, ',' ORDER BY name) AS classes,
 (SELECT round(sum(gain), 4) FROM r s WHERE s.b = r.b) AS expected_gain FROM r JOIN c ON c.image = r.image GROUP BY b""")
def plan_batches(spark, sf_dir):
    c = _side(spark, sf_dir, "N").join(F.broadcast(taxonomy(spark)), "class_id").select("image", "class_name", "conf")
    claimed = c.filter("image % 5 = 0").select("image").distinct()
    b = verification.plan_batches(c, F.col("class_name").isin(*PRIORITY), 40, claimed, first_number=3)
    return b.select("batch_id", "n_images", F.md5(F.array_join(F.col("images").cast("array<string>"), ",")).alias("images"), F.array_join("target_classes", ",").alias("classes"), F.round("expected_gain", 4).alias("expected_gain"))


@query("WITH b AS (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS l FROM part GROUP BY 1), k AS (SELECT p_brand, l, least(greatest(1, round_even(len(l) * 0.1, 0)::INT), len(l)) AS n FROM b) SELECT p_brand, array_to_string(list_transform(range(n), lambda i: l[1 + floor(i * (len(l) / n))::INT]), ',') AS sample FROM k")
def iaa_sample(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("images"))
    return b.select("p_brand", F.array_join(verification.agreement_sample(F.col("images"), 0.1), ",").alias("sample"))


@query("SELECT coalesce(max(TRY_CAST(substr('vb' || lpad((p_partkey % 800)::VARCHAR, 3, '0') || '_m', 3, 3) AS INT)), 0) + 1 AS n FROM part")
def batch_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(verification.batch_id(F.col("p_partkey") % 800, "m").alias("batch_id"))
    return verification.next_number(ids)


@query(f"WITH {BOXES}, i AS (SELECT DISTINCT image, image % 3 AS batch_id FROM boxes), t AS (SELECT * FROM range(3) b(batch_id), (VALUES (2), (5), (11)) c(class_id)), n AS (SELECT image, class_id, count(*) AS boxes FROM boxes GROUP BY 1, 2) SELECT i.batch_id, i.image, t.class_id, CASE WHEN n.boxes > 0 THEN 'present_labeled' ELSE 'verified_absent' END AS status, coalesce(n.boxes, 0) AS boxes FROM i JOIN t ON i.batch_id = t.batch_id LEFT JOIN n ON n.image = i.image AND n.class_id = t.class_id")
def verified_import(spark, sf_dir):
    b = boxes(spark, sf_dir)
    batch = b.select("image").distinct().withColumn("batch_id", F.col("image") % 3)
    wanted = spark.range(3).select(F.col("id").alias("batch_id"), F.explode(F.array(F.lit(2), F.lit(5), F.lit(11))).alias("class_id"))
    return verification.verdicts(batch, wanted, b.select("image", "class_id"))


_LOG = "log AS (SELECT l_orderkey AS image, l_partkey % 23 AS class_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, CASE WHEN l_quantity > 10 THEN 'present_labeled' ELSE 'verified_absent' END AS status, CASE WHEN l_quantity > 10 THEN l_linenumber ELSE l_linenumber // 7 END::BIGINT AS boxes, 's' || (l_orderkey % 7) AS source FROM lineitem)"


def _log(spark, sf_dir):
    """Entries in an order that SQL knows too; numbers have gaps here, which changes nothing."""
    li = table(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    there = F.col("l_quantity") > 10
    return li.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 23).alias("class_id"), "seq", F.when(there, "present_labeled").otherwise("verified_absent").alias("status"), F.when(there, F.col("l_linenumber")).otherwise(F.expr("l_linenumber div 7")).cast("long").alias("boxes"), F.concat(F.lit("s"), (F.col("l_orderkey") % 7).cast("string")).alias("source"))


@query(f"WITH {_LOG} SELECT image, class_id, status, boxes FROM log QUALIFY row_number() OVER (PARTITION BY image, class_id ORDER BY seq DESC) = 1")
def ledger_view(spark, sf_dir):
    return verification.ledger_view(_log(spark, sf_dir)).select("image", "class_id", "status", "boxes")


@query(f"WITH {_LOG}, v AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY image, class_id ORDER BY seq DESC) = 1) SELECT image, class_id, CASE WHEN status = 'verified_absent' THEN 'absent_with_boxes' ELSE 'present_without_boxes' END AS problem FROM v WHERE (status = 'verified_absent' AND boxes > 0) OR (status = 'present_labeled' AND boxes = 0)")
def ledger_validate(spark, sf_dir):
    return verification.ledger_problems(verification.ledger_view(_log(spark, sf_dir)))


@query(f"""WITH {_LOG}, v AS (SELECT * FROM log WHERE image % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY image, class_id ORDER BY seq DESC) = 1),
 n AS (SELECT image, class_id, CASE WHEN image % 10 = 1 THEN 'other' ELSE source END AS source, status, boxes, CASE WHEN image % 2 = 0 THEN 'vb001' END AS supersedes FROM log QUALIFY row_number() OVER (PARTITION BY image, class_id ORDER BY seq) = 1),
 s AS (SELECT image, min(source) AS src FROM v GROUP BY 1)
SELECT n.image, n.class_id, CASE WHEN s.src <> n.source THEN 'source_mismatch' WHEN v.status IS NULL THEN 'insert' WHEN v.status = n.status AND v.boxes = n.boxes THEN 'noop' WHEN supersedes IS NOT NULL THEN 'supersede' ELSE 'conflict' END AS outcome
FROM n LEFT JOIN v ON n.image = v.image AND n.class_id = v.class_id LEFT JOIN s ON s.image = n.image""")
def ledger_upsert(spark, sf_dir):
    log = _log(spark, sf_dir)
    firsts = log.groupBy("image", "class_id").agg(F.min(F.struct("seq", "status", "boxes", "source")).alias("f")).select("image", "class_id", "f.*")
    new = firsts.withColumn("source", F.when(F.col("image") % 10 == 1, "other").otherwise(F.col("source"))).withColumn("supersedes", F.when(F.col("image") % 2 == 0, "vb001"))
    return verification.append_outcomes(verification.ledger_view(log.filter("image % 3 <> 0")), new).select("image", "class_id", "outcome")


@query(f"WITH {BOXES} SELECT image, ord, class_id FROM boxes WHERE side = 'A' UNION ALL SELECT image, ord, class_id FROM boxes b WHERE side = 'R' AND EXISTS (SELECT 1 FROM boxes a WHERE a.image = b.image AND a.side = 'A')")
def union_overlay(spark, sf_dir):
    cols = ["image", "ord", "class_id"]
    return merging.overlay(_side(spark, sf_dir, "A").select(*cols), _side(spark, sf_dir, "R").select(*cols))


@query(f"WITH {BOXES}, {TRUST}, {_VERIFIED}, {_RESOLVED}, t AS (SELECT image, unnest({PROMPTABLE})::INT AS class_id, wide FROM r) SELECT b.image, b.ord, b.class_id, 1.0::DOUBLE AS conf FROM boxes b JOIN t ON t.image = b.image AND t.class_id = b.class_id AND NOT list_contains(t.wide, b.class_id) WHERE side = 'N'")
def cross_dataset_backend(spark, sf_dir):
    b = written_boxes(spark, sf_dir)
    i = _box_images(spark, sf_dir, b)
    wanted = verification.targets(i, PROMPTABLE, policies.trusted_list(i, _trust(spark, sf_dir, b)), _verified(spark, sf_dir, b))
    return verification.linked_candidates(_side(spark, sf_dir, "N", b).select("image", "class_id", "ord", "box"), wanted).select("image", "ord", "class_id", "conf")


@query(f"WITH {BOXES}, {TRUST}, {_VERIFIED}, {_RESOLVED} SELECT b.image, b.ord, p AS problem FROM (SELECT b.image, b.ord, unnest(list_filter([CASE WHEN NOT list_contains({PROMPTABLE}, class_id) OR list_contains(wide, class_id) THEN 'not_targeted' END, CASE WHEN conf > 1 THEN 'conf' END, CASE WHEN cx > 1 OR cy > 1 OR w > 1 OR h > 1 OR cx < 0 OR cy < 0 OR w <= 0 OR h <= 0 THEN 'box' END], lambda x: x IS NOT NULL)) AS p FROM boxes b JOIN r ON b.image = r.image WHERE side = 'N') b")
def candidates_validate(spark, sf_dir):
    b = written_boxes(spark, sf_dir)
    i = _box_images(spark, sf_dir, b)
    wanted = verification.targets(i, PROMPTABLE, policies.trusted_list(i, _trust(spark, sf_dir, b)), _verified(spark, sf_dir, b))
    return verification.candidate_problems(_side(spark, sf_dir, "N", b), wanted)


@query("SELECT coalesce(a.k, b.k) AS class_id, a.n AS before, b.n AS after, b.n - a.n AS delta FROM (SELECT l_partkey % 29 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 29 < 20 GROUP BY 1) a FULL JOIN (SELECT l_partkey % 29 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 29 > 5 GROUP BY 1) b ON a.k = b.k")
def delta_full_join(spark, sf_dir):
    from ..operators.stats import full_delta

    n = table(spark, sf_dir, "lineitem").withColumn("class_id", F.col("l_partkey") % 29).groupBy("l_returnflag", "class_id").agg(F.count("*").alias("n"))
    return full_delta(n.filter("l_returnflag = 'A' and class_id < 20"), n.filter("l_returnflag = 'R' and class_id > 5"), "class_id", "n")


@query(f"WITH {IMAGES}, h AS (SELECT CASE WHEN image // 12 % 3 = 0 THEN 'train' ELSE 'val' END AS split, regexp_extract(name, '(?:^|_)(h\\d{{2,}})_', 1) AS house FROM images) SELECT DISTINCT a.house FROM h a JOIN h b ON a.house = b.house AND a.split = 'train' AND b.split <> 'train' WHERE a.house <> ''")
def house_exclusivity(spark, sf_dir):
    split = F.when(F.expr("image div 12 % 3 = 0"), "train").otherwise("val")
    h = images(spark, sf_dir).select(split.alias("split"), N.house(F.col("name")).alias("house")).filter("house is not null")
    return h.filter("split = 'train'").select("house").intersect(h.filter("split <> 'train'").select("house"))


@query("SELECT 'label_without_image' AS kind, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT 'image_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_antis(spark, sf_dir):
    docs, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(lab.join(docs.filter("doc_id % 2 = 0"), "doc_id", "left_anti"), "label_without_image").union(count(docs.join(lab, "doc_id", "left_anti"), "image_without_label"))


_CONSENT = """s AS (SELECT DISTINCT conv_id AS session, 'h' || lpad((conv_id % 5)::VARCHAR, 2, '0') AS house_id, CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 7 = 1 THEN 'bad' ELSE 'CONSENT-h' || lpad((conv_id % 6)::VARCHAR, 2, '0') || '-2026-001' END AS consent_id FROM conversations),
 r AS (SELECT 'CONSENT-h' || lpad(k::VARCHAR, 2, '0') || '-2026-001' AS consent_id, 'h' || lpad(k::VARCHAR, 2, '0') AS house, k = 2 AS withdrawn FROM range(4) t(k))"""


def _consent(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    c = F.col("conv_id")
    named = F.concat(F.lit("CONSENT-h"), two(c % 6), F.lit("-2026-001"))
    s = table(spark, sf_dir, "conversations").select(c.alias("session"), F.concat(F.lit("h"), two(c % 5)).alias("house_id"), F.when(c % 7 == 1, "bad").when(c % 7 != 0, named).alias("consent_id")).distinct()
    k = F.col("id")
    return s, spark.range(4).select(F.concat(F.lit("CONSENT-h"), two(k), F.lit("-2026-001")).alias("consent_id"), F.concat(F.lit("h"), two(k)).alias("house_id"), (k == 2).alias("withdrawn"))


@query(f"WITH {_CONSENT} SELECT session, unnest(list_filter([CASE WHEN s.consent_id IS NULL THEN 'missing' END, CASE WHEN s.consent_id = 'bad' THEN 'malformed' END, CASE WHEN s.consent_id IS NOT NULL AND r.house IS NULL THEN 'unknown' END, CASE WHEN withdrawn THEN 'withdrawn' END, CASE WHEN house <> house_id THEN 'house' END], lambda x: x IS NOT NULL)) AS problem FROM s LEFT JOIN r ON s.consent_id = r.consent_id")
def consent_check(spark, sf_dir):
    return gates.consent_problems(*_consent(spark, sf_dir))


@query(f"WITH {_CONSENT} SELECT session, s.consent_id FROM s JOIN r ON s.consent_id = r.consent_id WHERE withdrawn")
def consent_withdrawn(spark, sf_dir):
    return gates.withdrawn_sessions(*_consent(spark, sf_dir))


@query("SELECT DISTINCT md5(p_name) AS md5 FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 40)")
def dvc_lock_scan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.md5("p_name").alias("md5"), "p_partkey")
    return gates.missing_objects(p, p.filter("p_partkey < 40"))


_CAPPED = f"""WITH RECURSIVE {BOXES}, i AS (SELECT source, image, [count(*) FILTER (WHERE class_id = 5), count(*) FILTER (WHERE class_id = 11), count(*) FILTER (WHERE class_id = 20)] AS n, row_number() OVER (PARTITION BY source ORDER BY image) AS nth FROM boxes GROUP BY 1, 2),
 g AS (SELECT DISTINCT source, NULL::BIGINT AS image, 0::BIGINT AS nth, false AS takes, 0::BIGINT AS took, [0, 0, 0]::BIGINT[] AS sums FROM i UNION ALL
  SELECT source, image, nth, takes, took + CASE WHEN takes THEN 1 ELSE 0 END, CASE WHEN takes THEN [sums[1] + n[1], sums[2] + n[2], sums[3] + n[3]] ELSE sums END
  FROM (SELECT i.source, i.image, i.nth, i.n, took, sums, took < 300 AND NOT (n[1] > 0 AND sums[1] >= 40 OR n[2] > 0 AND sums[2] >= 60 OR n[3] > 0 AND sums[3] >= 25) AS takes FROM g JOIN i ON i.source = g.source AND i.nth = g.nth + 1) x)
SELECT source, image FROM g WHERE takes"""


@query(_CAPPED)
def capped_greedy(spark, sf_dir):
    return merging.greedy_caps(boxes(spark, sf_dir), ["source"], "image", {5: 40, 11: 60, 20: 25}, most=300)


@query("WITH d AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT source, doc_id, n_chars FROM d WHERE before < 30000")
def face_cap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return merging.running_cap(d, ["source"], ["doc_id"], "n_chars", 30000)


@query(f"WITH {BOXES}, g AS (SELECT image, ord, x0, y0 FROM boxes, (VALUES (0), (320)) a(x0), (VALUES (0), (160)) b(y0) WHERE ord = 1) SELECT image, x0, y0, x0 + 320 AS x1, y0 + 320 AS y1 FROM g")
def tile_plan(spark, sf_dir):
    from ..plans.annotate import tiles

    first = boxes(spark, sf_dir).filter("ord = 1").select("image")
    return tiles(first, F.lit(640), F.lit(480), 320).select("image", "x0", "y0", "x1", "y1")


@query(f"WITH {BOXES} SELECT image, class_id, count(*) AS n, round(avg(cx), 6) AS cx FROM boxes GROUP BY 1, 2")
def image_class_index(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("image", "class_id").agg(F.count("*").alias("n"), F.round(F.avg("box.cx"), 6).alias("cx"))

