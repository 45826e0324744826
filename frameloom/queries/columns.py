"""Queries of scalar functions, filters and validators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import hashes as H
from ..functions import names as N
from ..functions import scores as S
from ..operators import labels as L
from .base import BOXES, CLASSES, DETECTIONS, EVENT_TYPES, GRIDS, IMAGES, N_CLASSES, PRIORITY, boxes, detections, grids, images, query, sql_distance, sql_hex, sql_iou, table

ID = ["image", "ord"]


@query(f"WITH {BOXES} SELECT image, ord, round(w * h, 8) AS area, round(cx - w / 2, 8) AS x1, round(cy - h / 2, 8) AS y1, round(cx + w / 2, 8) AS x2, round(cy + h / 2, 8) AS y2 FROM boxes")
def box_to_xyxy(spark, sf_dir):
    c = B.corners(F.col("box"))
    return boxes(spark, sf_dir).select(*ID, F.round(B.area(F.col("box")), 8).alias("area"), *[F.round(c[x], 8).alias(x) for x in ("x1", "y1", "x2", "y2")])


@query(f"WITH {BOXES} SELECT a.image, a.ord AS ord_a, b.ord AS ord_b, round({sql_iou('a', 'b')}, 6) AS iou FROM boxes a JOIN boxes b ON a.image = b.image AND a.ord < b.ord")
def iou_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir).select("image", "ord", "box")
    both = b.withColumnsRenamed({"ord": "ord_a", "box": "a"}).join(b.withColumnsRenamed({"ord": "ord_b", "box": "b"}), "image").filter("ord_a < ord_b")
    return both.select("image", "ord_a", "ord_b", F.round(B.iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 20 - 60 AS x, l_discount * 8000 AS y, l_quantity AS w, l_tax * 500 AS h FROM lineitem),
 c AS (SELECT *, least(greatest(x, 0), 640) AS x1, least(greatest(y, 0), 480) AS y1, least(greatest(x + w, 0), 640) AS x2, least(greatest(y + h, 0), 480) AS y2 FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x1 + x2) / 2 / 640, 6) AS cx, round((y1 + y2) / 2 / 480, 6) AS cy, round((x2 - x1) / 640, 6) AS w, round((y2 - y1) / 480, 6) AS h
FROM c WHERE x2 - x1 > 1 AND y2 - y1 > 1"""
)
def coco_to_yolo(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    box = B.from_pixels(F.col("l_quantity") * 20 - 60, F.col("l_discount") * 8000, F.col("l_quantity"), F.col("l_tax") * 500, F.lit(640.0), F.lit(480.0))
    rows = t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("b")).filter("b is not null")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query(
    """WITH p AS (SELECT o_orderkey, list_transform(range(2 * (1 + o_orderkey % 5)), lambda i: ((o_orderkey * (i + 3) * 37) % 140 - 20) / 100.0::DOUBLE) AS c FROM orders),
 q AS (SELECT o_orderkey, c, list_transform(list_filter(range(len(c)), lambda i: i % 2 = 0), lambda i: least(greatest(c[i + 1], 0), 1)) AS xs,
  list_transform(list_filter(range(len(c)), lambda i: i % 2 = 1), lambda i: least(greatest(c[i + 1], 0), 1)) AS ys FROM p),
 r AS (SELECT o_orderkey, c, list_min(xs) AS x0, list_max(xs) AS x1, list_min(ys) AS y0, list_max(ys) AS y1 FROM q)
SELECT o_orderkey, CASE WHEN len(c) = 4 THEN c[1] ELSE round(x0 + (x1 - x0) / 2, 6) END AS cx, CASE WHEN len(c) = 4 THEN c[2] ELSE round(y0 + (y1 - y0) / 2, 6) END AS cy,
 CASE WHEN len(c) = 4 THEN c[3] ELSE round(x1 - x0, 6) END AS w, CASE WHEN len(c) = 4 THEN c[4] ELSE round(y1 - y0, 6) END AS h
FROM r WHERE len(c) = 4 OR (len(c) >= 6 AND x1 > x0 AND y1 > y0)"""
)
def poly_to_bbox(spark, sf_dir):
    at = F.sequence(F.lit(0).cast("long"), 2 * (1 + F.col("o_orderkey") % 5) - 1)
    coords = F.transform(at, lambda i: ((F.col("o_orderkey") * (i + 3) * 37) % 140 - 20) / F.lit(100.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", coords.alias("c")).select("o_orderkey", B.from_polygon(F.col("c")).alias("b")).filter("b is not null")
    return rows.select("o_orderkey", "b.*")


@query(
    f"""WITH {BOXES} SELECT image, ord, round((100 + cx * 320) / 640, 8) AS full_cx, round((50 + cy * 320) / 480, 8) AS full_cy, round(w * 320 / 640, 8) AS full_w, round(h * 320 / 480, 8) AS full_h,
 round(cx - w / 2, 8) AS left_x, round(cy - h / 2, 8) AS top_y FROM boxes"""
)
def tile_to_full(spark, sf_dir):
    full = B.tile_to_full(F.col("box"), *[F.lit(float(x)) for x in (100, 50, 420, 370, 640, 480)])
    corner = B.to_top_left(F.col("box"))
    return boxes(spark, sf_dir).select(*ID, *[F.round(full[c], 8).alias(f"full_{c}") for c in ("cx", "cy", "w", "h")], F.round(corner["x"], 8).alias("left_x"), F.round(corner["y"], 8).alias("top_y"))


@query(f"WITH {BOXES} SELECT image, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h), chr(10) ORDER BY printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h)) AS text FROM boxes GROUP BY image")
def sink_yolo(spark, sf_dir):
    from ..sources.sinks import label_texts

    return label_texts(boxes(spark, sf_dir))


@query(f"WITH {GRIDS} SELECT vec_id, {sql_hex('bits')} AS ahash, {sql_hex('flip_bits')} AS flip_ahash FROM hashes")
def ahash(spark, sf_dir):
    g = F.col("grid")
    return grids(spark, sf_dir).select("vec_id", H.hex64(H.average_hash(g)).alias("ahash"), H.hex64(H.average_hash(H.mirrored(g))).alias("flip_ahash"))


@query(f"WITH {GRIDS} SELECT a.vec_id, {sql_distance('a.bits', 'b.bits')}::BIGINT AS distance, {sql_distance('a.flip_bits', 'b.bits')}::BIGINT AS flip_distance FROM hashes a JOIN hashes b ON b.vec_id = a.vec_id + 1")
def hamming(spark, sf_dir):
    h = grids(spark, sf_dir).select("vec_id", H.average_hash(F.col("grid")).alias("h"), H.average_hash(H.mirrored(F.col("grid"))).alias("f"))
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return h.join(nxt, "vec_id").select("vec_id", H.hamming(F.col("h"), F.col("g")).cast("long").alias("distance"), H.hamming(F.col("f"), F.col("g")).cast("long").alias("flip_distance"))


@query(
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS x FROM documents)
SELECT doc_id, array_to_string(list_transform(range(4), lambda i: substr(x, CAST(49 - 16 * i AS INT), 16)), ',') AS lanes FROM h"""
)
def hash_lanes(spark, sf_dir):
    lanes = H.lanes(F.sha2(F.coalesce("text", F.lit("")), 256))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(lanes, H.hex64), ",").alias("lanes"))


@query("SELECT source, sha256(string_agg(doc_id || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id || ':' || sha256(coalesce(text, '')))) AS digest, count(*) AS files FROM documents GROUP BY source")
def content_digest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.groupBy("source").agg(H.content_digest(F.col("doc_id").cast("string"), F.col("sha")).alias("digest"), F.count("*").alias("files"))


@query("""SELECT p_brand AS export, 'sha256:' || sha256('{"nc":' || count(*) || ',"names":[' || string_agg('[' || i || ',"' || p_type || '"]', ',' ORDER BY i) || ']}') AS fingerprint
 FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) t GROUP BY 1""")
def taxonomy_fp(spark, sf_dir):
    """A brand as an export with a taxonomy of its own."""
    nth = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("export"), nth.cast("int").alias("class_id"), F.col("p_type").alias("class_name"))
    return t.groupBy("export").agg(H.taxonomy_fingerprint(F.col("class_id"), F.col("class_name")).alias("fingerprint"))


@query(f"WITH {BOXES}, i AS (SELECT image, list_sort(list(DISTINCT class_id)) AS ids FROM boxes GROUP BY image) SELECT image, substr(sha256('[' || array_to_string(ids, ',') || ']'), 1, 8) AS digest, array_to_string(list_transform(range(23), lambda c: CASE WHEN list_contains(ids, c) THEN 1 ELSE 0 END), '') AS mask FROM i")
def policy_digest(spark, sf_dir):
    ids = boxes(spark, sf_dir).groupBy("image").agg(F.array_sort(F.collect_set("class_id")).alias("ids"))
    return ids.select("image", H.policy_digest(F.col("ids")).alias("digest"), F.array_join(S.mask_row(F.col("ids"), N_CLASSES).cast("array<string>"), "").alias("mask"))


@query("SELECT p_partkey, p_type || '_' || p_brand || '_' || substr(sha256(p_name || ':' || p_size), 1, 8) AS run_id FROM part")
def run_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", H.run_id(F.col("p_type"), F.col("p_brand"), F.concat_ws(":", "p_name", F.col("p_size").cast("string"))).alias("run_id"))


_GROUP = ", ".join(f"nullif(regexp_extract(name, '{p}', 1), '')" for p in N.GROUP_PATTERNS)


@query(
    f"""WITH {IMAGES}, g AS (SELECT image, name, coalesce({_GROUP}, name) AS group_key FROM images)
SELECT image, group_key, CASE WHEN regexp_extract(group_key, '(?:^|_)(h\\d{{2,}})_', 1) <> '' THEN 'house:' || regexp_extract(group_key, '(?:^|_)(h\\d{{2,}})_', 1) ELSE 'solo:' || group_key END AS house_key FROM g"""
)
def group_key(spark, sf_dir):
    g = images(spark, sf_dir).select("image", N.group_key(F.col("name")).alias("group_key"))
    return g.select("image", "group_key", N.house_key(F.col("group_key")).alias("house_key"))


@query(
    """WITH s AS (SELECT conv_id, turn, ['h01_pooja_room_s001', 'h' || lpad((conv_id % 30)::VARCHAR, 2, '0') || '_kitchen_s' || lpad(turn::VARCHAR, 3, '0'), 'kitchen_s01', 'h1_bed_s001'][CAST(conv_id % 4 + 1 AS INT)] AS session FROM conversations)
SELECT conv_id, turn, session, CASE WHEN regexp_matches(session, '^(h\\d{2,})_([a-z][a-z_]*)_(s\\d{3,})$') THEN regexp_extract(session, '^(h\\d{2,})_([a-z][a-z_]*)_(s\\d{3,})$', 1) END AS house,
 CASE WHEN regexp_matches(session, '^(h\\d{2,})_([a-z][a-z_]*)_(s\\d{3,})$') THEN regexp_extract(session, '^(h\\d{2,})_([a-z][a-z_]*)_(s\\d{3,})$', 2) END AS room FROM s"""
)
def session_id(spark, sf_dir):
    named = [F.lit("h01_pooja_room_s001"), F.concat(F.lit("h"), F.lpad((F.col("conv_id") % 30).cast("string"), 2, "0"), F.lit("_kitchen_s"), F.lpad(F.col("turn").cast("string"), 3, "0")), F.lit("kitchen_s01"), F.lit("h1_bed_s001")]
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.array(*named), (F.col("conv_id") % 4 + 1).cast("int")).alias("session"))
    p = N.session_parts(F.col("session"))
    return s.select("conv_id", "turn", "session", p["house"].alias("house"), p["room"].alias("room"))


@query(
    """WITH n AS (SELECT page_id, repeat(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), CAST(1 + page_id % 4 AS INT)) || '-20240722T103743Z-1-001.JPG' AS name FROM pages),
 t AS (SELECT page_id, name, substr(name, 1, len(name) - 4) AS stem FROM n)
SELECT page_id, CASE WHEN len(stem) <= 120 THEN name ELSE substr(stem, 1, 120) || '_' || substr(sha256(name), 1, 8) || '.JPG' END AS safe, lower(trim(regexp_replace(stem, '-\\d{8}T.*$', ''))) AS stem_key, 'jpg' AS kind FROM t"""
)
def safe_filename(spark, sf_dir):
    name = F.concat(F.repeat(F.regexp_replace("url", "[^a-zA-Z0-9]", "_"), (1 + F.col("page_id") % 4).cast("int")), F.lit("-20240722T103743Z-1-001.JPG"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("page_id", N.safe_name(F.col("name")).alias("safe"), N.archive_key(F.col("name")).alias("stem_key"), N.ending(F.col("name")).alias("kind"))


@query("SELECT page_id, regexp_replace('/data/root/' || replace(url, '/', chr(92)), '', '') AS raw, replace(replace(url, '/', chr(92)), chr(92), '/') AS path FROM pages")
def portable_path(spark, sf_dir):
    raw = F.concat(F.lit("/data/root/"), F.replace(F.col("url"), F.lit("/"), F.lit("\\")))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), N.portable(raw, "/data/root").alias("path"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g')) AS spoken FROM conversations")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", N.spoken(F.col("text")).alias("spoken"))


@query(
    f"""WITH {IMAGES}, f AS (SELECT image, 100 + n_chars % 900 AS width, 100 + (n_chars * 7) % 900 AS height, (n_chars * 13) % 256 + 0.0::DOUBLE AS bright FROM images)
SELECT image, CASE WHEN least(width, height) < 200 THEN 'too_small' WHEN width / height < 0.9 THEN NULL WHEN bright > 200 THEN 'likely_outdoor' END AS reason FROM f"""
)
def image_filter(spark, sf_dir):
    f = images(spark, sf_dir).select("image", (100 + F.col("n_chars") % 900).alias("width"), (100 + (F.col("n_chars") * 7) % 900).alias("height"), ((F.col("n_chars") * 13) % 256).cast("double").alias("bright"))
    return f.select("image", L.image_filter(F.col("width"), F.col("height"), F.col("bright")).alias("reason"))


_FUSE = "least(1.0::DOUBLE, greatest(conf, 0.6 * conf + 0.4 * risk))"


@query(
    f"""WITH {DETECTIONS}, r AS (SELECT *, CASE class_name WHEN 'error' THEN 0.9 WHEN 'purchase' THEN 0.6 WHEN 'view' THEN 0.3 END::DOUBLE AS risk FROM detections)
SELECT camera, ord, round(CASE WHEN class_name IN ('error', 'purchase') AND risk > 0 THEN {_FUSE} ELSE conf END, 8) AS fused FROM r"""
)
def fuse_confidence(spark, sf_dir):
    word = F.when(F.col("class_name") == "error", "high").when(F.col("class_name") == "purchase", "medium").when(F.col("class_name") == "view", "low")
    risk = F.try_element_at(F.create_map(*[F.lit(x) for kv in S.RISK_SCORE.items() for x in kv]), word)
    return detections(spark, sf_dir).select("camera", "ord", F.round(S.fused(F.col("conf"), risk, F.col("class_name").isin("error", "purchase")), 8).alias("fused"))


@query(
    """WITH r AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'high' ELSE 'low' END AS sev FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS activity, CASE WHEN event_id % 5 = 4 THEN NULL WHEN sev IS NULL THEN 0 ELSE 1 END AS n_risks, CASE WHEN event_id % 5 <> 4 THEN sev END AS severity FROM r"""
)
def vlm_json_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sev = F.when(F.col("event_id") % 4 == 1, "high").when(F.col("event_id") % 4 != 0, "low")
    risks = F.when(sev.isNull(), F.lit("[]")).otherwise(F.concat(F.lit('[{"risk_type":"Wet Floor","severity":"'), sev, F.lit('"}]')))
    reply = F.when(F.col("event_id") % 5 == 4, F.lit("no scene {")).otherwise(F.concat(F.lit('Sure: {"activity":"'), F.col("event_type"), F.lit('","risks":'), risks, F.lit("} done")))
    parsed = e.select("event_id", N.scene_json(reply).alias("s"))
    return parsed.select("event_id", F.col("s.activity").alias("activity"), F.when(F.col("s").isNotNull(), F.size("s.risks")).alias("n_risks"), F.try_element_at("s.risks", F.lit(1))["severity"].alias("severity"))


@query(
    f"""WITH {BOXES} SELECT image, ord, unnest(list_filter([CASE WHEN class_id < 0 OR class_id >= 20 THEN 'class_id' END, CASE WHEN cx < 0 OR cx > 1 THEN 'cx' END, CASE WHEN cy < 0 OR cy > 1 THEN 'cy' END,
 CASE WHEN w < 0 OR w > 1 THEN 'w' END, CASE WHEN h < 0 OR h > 1 THEN 'h' END, CASE WHEN w <= 0 OR h <= 0 THEN 'area' END,
 CASE WHEN cx - w / 2 < -1e-6 OR cy - h / 2 < -1e-6 OR cx + w / 2 > 1 + 1e-6 OR cy + h / 2 > 1 + 1e-6 THEN 'bounds' END], lambda x: x IS NOT NULL)) AS issue FROM boxes"""
)
def bbox_valid(spark, sf_dir):
    return L.box_issues(boxes(spark, sf_dir).select("image", "ord", "class_id", "box"), 20)


@query(f"WITH {BOXES}, d AS (SELECT image, ord, min(ord) OVER (PARTITION BY image, class_id) AS first_idx FROM boxes) SELECT image, first_idx, ord AS duplicate_idx FROM d WHERE ord > first_idx")
def dup_lines(spark, sf_dir):
    return L.duplicate_lines(boxes(spark, sf_dir), "image", "ord", "class_id")


_LINE = "CASE CAST(image % 4 AS INT) WHEN 0 THEN printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) WHEN 1 THEN printf('# %d', class_id) WHEN 2 THEN printf('%d 0.5 nan 0.1 0.1', class_id) ELSE printf('  %d 0.5 0.25  0.1 0.2 ', class_id) END"


@query(
    f"""WITH {BOXES} SELECT image, ord AS line_num, class_id, CASE WHEN image % 4 = 0 THEN round(cx, 6) ELSE 0.5 END AS cx, CASE WHEN image % 4 = 0 THEN round(h, 6) ELSE 0.2 END AS h FROM boxes WHERE image % 4 IN (0, 3)"""
)
def scan_yolo_file(spark, sf_dir):
    b = F.col("box")
    n = F.col("class_id").cast("string")
    line = F.when(F.col("image") % 4 == 0, B.label_line(F.col("class_id"), b)).when(F.col("image") % 4 == 1, F.concat(F.lit("# "), n)).when(F.col("image") % 4 == 2, F.concat(n, F.lit(" 0.5 nan 0.1 0.1"))).otherwise(F.concat(F.lit("  "), n, F.lit(" 0.5 0.25  0.1 0.2 ")))
    files = boxes(spark, sf_dir).groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return L.annotations_of(L.lines_of(files)).select("image", F.col("line_num").cast("long"), "class_id", F.round("box.cx", 6).alias("cx"), F.round("box.h", 6).alias("h"))


@query(f"WITH {DETECTIONS} SELECT camera, ord, class_name, conf BETWEEN 0.25 AND 0.55 AS uncertain, CASE WHEN class_name <> 'view' THEN conf END AS shown FROM detections WHERE conf >= CASE class_name WHEN 'error' THEN 0.5 WHEN 'view' THEN 0.1 ELSE 0.3 END")
def conf_threshold(spark, sf_dir):
    d = L.above_threshold(detections(spark, sf_dir), {"error": 0.5, "view": 0.1}, 0.3)
    return d.select("camera", "ord", "class_name", L.uncertain(F.col("conf")).alias("uncertain"), F.when(F.col("class_name") != "view", F.col("conf")).alias("shown"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 0 AND (s_nationkey % 2 = 0 OR s_acctbal > 5000) AS allowed FROM supplier")
def license_gate(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", L.license_allowed(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") % 2 == 0, F.col("s_acctbal") > 5000).alias("allowed"))


@query(
    """WITH f AS (SELECT doc_id, n_chars, lang, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id, CASE WHEN lang = 'fr' AND source = 'src1' THEN 'extension' WHEN n_chars < 100 THEN 'size' WHEN nth > 1 THEN 'duplicate' WHEN source IS NULL THEN 'metadata' END AS reason FROM f"""
)
def ingest_reject_chain(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nth = F.row_number().over(W.partitionBy("text").orderBy("doc_id"))
    rules = L.first_reason(((F.col("lang") == "fr") & (F.col("source") == "src1"), "extension"), (F.col("n_chars") < 100, "size"), (F.col("nth") > 1, "duplicate"), (F.col("source").isNull(), "metadata"))
    return d.withColumn("nth", nth).select("doc_id", rules.alias("reason"))


@query(
    f"""WITH {BOXES}, a AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY class_id, ord) AS nth FROM boxes WHERE class_id < 12),
 b AS (SELECT image, class_id, ord, CASE WHEN image % 5 = 0 THEN cx + 0.001 ELSE cx + 0.00001 END AS cx, row_number() OVER (PARTITION BY image ORDER BY class_id, ord) AS nth FROM boxes WHERE class_id < 12 AND NOT (image % 11 = 0 AND ord = 1)),
 j AS (SELECT coalesce(a.image, b.image) AS image, a.class_id AS ca, b.class_id AS cb, a.cx AS xa, b.cx AS xb, a.ord AS oa, b.ord AS ob, a.cy AS ya, a.w AS wa, a.h AS ha, b.nth FROM a FULL JOIN b ON a.image = b.image AND a.nth = b.nth),
 k AS (SELECT j.*, c.cy AS yb, c.w AS wb, c.h AS hb FROM j LEFT JOIN boxes c ON c.image = j.image AND c.ord = j.ob)
SELECT image, count(ca) AS n_base, count(cb) AS n_export, count(*) FILTER (WHERE ca IS NOT NULL AND cb IS NOT NULL AND (ca <> cb OR abs(xa - xb) > 1e-4 OR abs(ya - yb) > 1e-4 OR abs(wa - wb) > 1e-4 OR abs(ha - hb) > 1e-4)) AS n_moved
FROM k GROUP BY image HAVING count(ca) <> count(cb) OR n_moved > 0"""
)
def non_target_unchanged(spark, sf_dir):
    base = boxes(spark, sf_dir).filter("class_id < 12").select("image", "ord", "class_id", "box")
    shift = F.when(F.col("image") % 5 == 0, 0.001).otherwise(0.00001)
    export = base.filter(~((F.col("image") % 11 == 0) & (F.col("ord") == 1))).withColumn("box", F.col("box").withField("cx", F.col("box.cx") + shift))
    return L.changed_boxes(base, export, "image")


@query("WITH e AS (SELECT p_partkey % 25 AS class_id, min(p_brand) AS b FROM part GROUP BY 1), t AS (SELECT p_partkey AS class_id, p_brand AS b FROM part WHERE p_partkey < 23) SELECT coalesce(e.class_id, t.class_id) AS class_id, e.b AS found, t.b AS expected FROM e FULL JOIN t ON e.class_id = t.class_id WHERE e.b IS DISTINCT FROM t.b")
def class_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    found = p.groupBy((F.col("p_partkey") % 25).alias("class_id")).agg(F.min("p_brand").alias("class_name"))
    return L.class_order_differences(found, p.filter("p_partkey < 23").select(F.col("p_partkey").alias("class_id"), F.col("p_brand").alias("class_name")))


_PRIORITY_IDS = ", ".join(str(CLASSES.index(c)) for c in PRIORITY)


@query(f"WITH {BOXES} SELECT image, round(sum(CASE WHEN class_id IN ({_PRIORITY_IDS}) THEN 2 ELSE 1 END * conf), 4) AS gain FROM boxes GROUP BY image")
def expected_gain(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("image").agg(F.round(S.gain(F.col("conf"), F.col("class_id").isin(*[CLASSES.index(c) for c in PRIORITY])), 4).alias("gain"))


@query(f"WITH e AS (SELECT event_type, count(*) FILTER (WHERE value > 20) AS tp, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS m FROM events GROUP BY 1), p AS (SELECT event_type, tp / n AS p, m / n AS r, tp, n FROM e) SELECT event_type, round(2 * p * r / (p + r), 6) AS f1, printf('%.1f%%', 100.0 * tp / n) AS share FROM p WHERE event_type IN {EVENT_TYPES}")
def f1(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 20).alias("tp"), F.count("*").alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("m"))
    return e.select("event_type", F.round(S.f1(F.col("tp") / F.col("n"), F.col("m") / F.col("n")), 6).alias("f1"), N.percent(F.col("tp"), F.col("n")).alias("share"))
