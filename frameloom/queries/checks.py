"""Queries of artefact validation, releases, captures, pixels and plugins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import names as N
from ..functions import pixels
from ..functions.scores import mask_row
from ..operators import captures, gates, labels, matching, policies, releases, splits, stats, validation
from ..plans import annotate, plugins, reports
from ..sources import files, sinks
from ..streaming import memory
from .base import BOXES, CLASSES, COARSE, DETECTIONS, FRAMES, IMAGES, boxes, detections, frames, grids, images, query, sql_hex, table, taxonomy, written_boxes
from .columns import _GROUP
from .relations import _BY_IOU, _HOUSE, _coarse, _hashes, _sides
from .summaries import _BY_IMAGE, _COVER, _coverage, _coverage_images

_POLICIES = """pol AS (SELECT DISTINCT source AS policy, ['trusted_list', 'verified_absence_all', 'other'][len(source) % 3 + 1] AS mode, CASE WHEN len(source) % 2 = 0 THEN [1, 2, 5] ELSE [5, 2, 30] END AS ids FROM documents WHERE source IS NOT NULL),
 im AS (SELECT doc_id AS image, CASE WHEN doc_id % 40 = 0 THEN 'gone' ELSE source END AS policy, CASE WHEN doc_id % 25 = 0 THEN 'holdout' ELSE 'train' END AS split FROM documents)"""


def _completeness(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = F.length("source")
    ids = F.when(n % 2 == 0, F.array(*map(F.lit, (1, 2, 5)))).otherwise(F.array(*map(F.lit, (5, 2, 30))))
    mode = F.element_at(F.array(F.lit("trusted_list"), F.lit("verified_absence_all"), F.lit("other")), n % 3 + 1)
    pol = d.filter("source is not null").select(F.col("source").alias("policy"), mode.alias("mode"), ids.alias("ids")).distinct()
    im = d.select(F.col("doc_id").alias("image"), F.when(F.col("doc_id") % 40 == 0, "gone").otherwise(F.col("source")).alias("policy"), F.when(F.col("doc_id") % 25 == 0, "holdout").otherwise("train").alias("split"))
    return pol, im


@query(f"""WITH {_POLICIES} SELECT 'schema_version' AS "check", NULL::VARCHAR AS subject UNION ALL SELECT 'fingerprint', NULL UNION ALL SELECT 'taxonomy_drift', NULL UNION ALL SELECT 'images_total', NULL
 UNION ALL SELECT 'mode', policy FROM pol WHERE mode = 'other' UNION ALL SELECT 'ids_range', policy FROM pol WHERE list_contains(ids, 30) UNION ALL SELECT 'ids_order', policy FROM pol WHERE ids <> list_sort(ids)
 UNION ALL SELECT 'not_all_trusted', policy FROM pol WHERE mode = 'verified_absence_all' UNION ALL SELECT 'orphan_policy', image::VARCHAR FROM im LEFT JOIN pol ON im.policy = pol.policy WHERE pol.policy IS NULL
 UNION ALL SELECT 'split', image::VARCHAR FROM im WHERE split = 'holdout'""")
def completeness_validate(spark, sf_dir):
    pol, im = _completeness(spark, sf_dir)
    header = im.agg((F.count("*") + 1).alias("images_total")).select(F.lit(3).alias("schema_version"), F.lit(23).alias("nc"), F.lit("sha256:0").alias("fingerprint"), "images_total")
    return validation.completeness_problems(header, taxonomy(spark), pol, im, live_fingerprint="sha256:1")


@query(f"WITH {_POLICIES} SELECT pol.policy, mode, count(image) AS images, 3 AS trusted_count, 20 AS untrusted_count, count(image) = 0 AS unused FROM pol LEFT JOIN im ON im.policy = pol.policy GROUP BY 1, 2")
def completeness_summary(spark, sf_dir):
    return validation.policy_summary(*_completeness(spark, sf_dir), 23)


@query("SELECT doc_id AS image, 'missing' AS side FROM documents WHERE doc_id % 3 <> 2 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'stale' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 2)")
def coverage_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 3 <> 2").select(F.col("doc_id").alias("image"))
    return validation.coverage_sets(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image")))


@query("""WITH c AS (SELECT event_type AS class_id, avg(value) / 50 AS score, round(sum(value), 2) AS residual FROM events GROUP BY 1) SELECT 'class_score' AS "check", class_id AS subject FROM c WHERE NOT score BETWEEN 0 AND 1
 UNION ALL SELECT 'image_score', event_id::VARCHAR FROM events WHERE NOT value / 100 BETWEEN 0 AND 1 UNION ALL SELECT 'residual_total', NULL FROM c HAVING abs(7 - round(sum(residual), 4)) > 0.001""")
def coverage_validate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.groupBy(F.col("event_type").alias("class_id")).agg((F.avg("value") / 50).alias("score"), F.round(F.sum("value"), 2).alias("residual"))
    return validation.coverage_problems(c, e.select(F.col("event_id").alias("image"), (F.col("value") / 100).alias("score")), spark.createDataFrame([(7.0,)], "residual_total double"))


@query("""SELECT 'masked_fraction' AS "check", NULL::VARCHAR AS subject FROM documents HAVING NOT avg(n_chars) BETWEEN 0 AND 1""")
def quality_validate(spark, sf_dir):
    return validation.quality_problems(table(spark, sf_dir, "documents").agg(F.avg("n_chars").alias("masked_fraction"), F.count("*").alias("images")))


@query("""WITH r AS (SELECT source AS report, min(lang) AS fp, count(*) AS n FROM documents GROUP BY 1), l AS (SELECT count(*) AS n FROM documents WHERE source = (SELECT min(source) FROM documents))
SELECT 'taxonomy' AS "check", report AS subject FROM r WHERE coalesce(fp <> 'en', true) UNION ALL SELECT 'image_count', report FROM r, l WHERE r.n <> l.n""")
def stale_reports(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = d.groupBy(F.col("source").alias("report")).agg(F.min("lang").alias("fingerprint"), F.count("*").alias("images"))
    first = r.filter("report is not null").agg(F.min_by("images", "report").alias("images")).select(F.lit("en").alias("fingerprint"), "images")
    return validation.stale_reports(r, first)


_LINES = f"ln AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY line) AS n, class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h, line FROM (SELECT *, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) AS line FROM boxes) x)"


@query(f"""WITH {BOXES}, {_LINES}, own AS (SELECT * FROM ln WHERE image % 5 <> 0) SELECT 'no_image' AS "check", image::VARCHAR AS subject FROM ln WHERE image % 5 = 0 GROUP BY image
 UNION ALL SELECT unnest(list_filter([CASE WHEN class_id >= 20 THEN 'class_id' END, CASE WHEN cx NOT BETWEEN 0 AND 1 THEN 'cx' END, CASE WHEN cy NOT BETWEEN 0 AND 1 THEN 'cy' END, CASE WHEN w NOT BETWEEN 0 AND 1 THEN 'w' END, CASE WHEN h NOT BETWEEN 0 AND 1 THEN 'h' END,
  CASE WHEN w <= 0 OR h <= 0 THEN 'area' END, CASE WHEN cx - w / 2 < -1e-6 OR cy - h / 2 < -1e-6 OR cx + w / 2 > 1 + 1e-6 OR cy + h / 2 > 1 + 1e-6 THEN 'bounds' END], lambda x: x IS NOT NULL)), image || ':' || n FROM own
 UNION ALL SELECT 'duplicate', image || ':' || n FROM own QUALIFY row_number() OVER (PARTITION BY image, line ORDER BY n) > 1""")
def session_label_validate(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return validation.session_problems(sinks.label_texts(b).select(F.col("image").cast("string").alias("stem"), "text"), b.filter("image % 5 <> 0").select(F.col("image").cast("string").alias("stem")).distinct(), 20, 0.5)


@query("""WITH c AS (SELECT p_partkey AS config, p_size / 40.0::DOUBLE AS ratio, p_partkey % 5 <> 0 AS seeded, p_partkey % 7 AS w, p_partkey % 3 AS v FROM part)
SELECT config, 'range' AS "check", 'train_ratio' AS subject FROM c WHERE ratio > 1 UNION ALL SELECT config, 'missing', 'seed' FROM c WHERE NOT seeded UNION ALL SELECT config, 'number', 'workers' FROM c WHERE w = 0
 UNION ALL SELECT config, 'range', 'workers' FROM c WHERE w = 1 UNION ALL SELECT config, 'pattern', 'version' FROM c WHERE v = 0""")
def config_validate(spark, sf_dir):
    """A part as a configuration of four settings."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    values = F.array(
        F.struct(F.lit("train_ratio").alias("key"), text(F.col("p_size") / 40.0).alias("value")), F.struct(F.lit("seed").alias("key"), F.when(k % 5 != 0, "42").alias("value")),
        F.struct(F.lit("workers").alias("key"), F.when(k % 7 == 0, "many").otherwise(text(k % 7 - 1)).alias("value")), F.struct(F.lit("version").alias("key"), F.when(k % 3 == 0, "v1").otherwise(F.concat(F.lit("v1.2."), text(k))).alias("value")),
    )
    settings = table(spark, sf_dir, "part").select(k.alias("config"), F.explode(values).alias("s")).select("config", "s.*")
    limits = spark.createDataFrame([("train_ratio", 0.0, 1.0, None), ("seed", 0.0, None, None), ("workers", 1.0, None, None), ("version", None, None, r"^v\d+\.\d+\.\d+$")], "key string, low double, high double, pattern string")
    return validation.setting_problems(settings, limits, settings.select("config").distinct())


_LEDGER = "l AS (SELECT doc_id AS image, 's' || (doc_id % 3) AS source, quality AS boxes FROM labels), p AS (SELECT doc_id AS image, 's' || (doc_id % 4 % 3) AS source FROM documents WHERE doc_id % 11 <> 0), t AS (SELECT doc_id AS image, 1 + doc_id % 2 AS lines FROM labels WHERE doc_id % 5 <> 0)"


@query(f"""WITH {_LEDGER} SELECT 'no_provenance' AS "check", l.image::VARCHAR AS subject FROM l LEFT JOIN p ON l.image = p.image WHERE p.image IS NULL UNION ALL SELECT 'source', l.image::VARCHAR FROM l JOIN p ON l.image = p.image WHERE l.source <> p.source
 UNION ALL SELECT CASE WHEN boxes > 0 AND t.image IS NULL THEN 'no_file' WHEN boxes > 0 AND lines <> boxes THEN 'line_count' ELSE 'file_without_boxes' END, l.image::VARCHAR FROM l LEFT JOIN t ON l.image = t.image WHERE boxes > 0 AND (t.image IS NULL OR lines <> boxes) OR boxes = 0 AND t.image IS NOT NULL""")
def ledger_consistency(spark, sf_dir):
    lab, i = table(spark, sf_dir, "labels"), F.col("doc_id")
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    led = lab.select(i.alias("image"), s(i % 3).alias("source"), F.col("quality").alias("boxes"))
    prov = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0").select(i.alias("image"), s(i % 4 % 3).alias("source"))
    return validation.ledger_consistency(led, prov, lab.filter("doc_id % 5 <> 0").select(i.alias("image"), (1 + i % 2).alias("lines")))


_FIGURES = f"""fig AS (SELECT (SELECT count(*) FROM boxes WHERE cx + w / 2 > 1 + 1e-6) AS off, (SELECT count(DISTINCT doc_id) FROM labels) AS cells, (SELECT count(*) FROM (SELECT sha FROM images GROUP BY sha HAVING count(DISTINCT split) > 1)) AS leaked,
  (SELECT count(*) FROM images) AS n, (SELECT count(DISTINCT nullif(regexp_extract(name, '(?:^|_)(h\\d{{2,}})_', 1), '')) FROM images) AS houses, (SELECT min(c) FROM (SELECT count(*) AS c FROM boxes GROUP BY class_id)) AS least)"""


def _release(spark, sf_dir):
    b, i = boxes(spark, sf_dir), images(spark, sf_dir)
    c = B.corners(F.col("box"))
    off = b.agg(F.count_if(c["x2"] > 1 + B.EDGE).alias("off"))
    cells = table(spark, sf_dir, "labels").agg(F.countDistinct("doc_id").alias("verified_cells"))
    leaked = i.groupBy("sha").agg(F.countDistinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("leaked"))
    held = i.agg(F.count("*").alias("custom_images"), F.countDistinct(N.house(F.col("name"))).alias("houses"))
    least = b.groupBy("class_id").count().agg(F.min("count").alias("least_instances"))
    one = off.crossJoin(cells).crossJoin(leaked).crossJoin(held).crossJoin(least)  # of one row each
    return one.select(
        "*", F.lit("full").alias("mode"), F.lit(0.7).alias("pilot_agreement"), F.col("off").alias("criticals"), F.lit(0).alias("sweep_findings"), F.lit(0).alias("completeness_problems"), F.lit(2).alias("stale_inputs"),
        F.lit(0).alias("classes_below"), F.lit(True).alias("changelog_entry"), F.lit(False).alias("tree_clean"), F.lit(True).alias("head_tagged"), F.lit(0).alias("push_exit"), F.lit("").alias("push_output"), F.lit(5).alias("noncommercial_images"),
        F.lit(0).alias("unlicensed_slugs"), F.lit(0).alias("eval_overlap"), F.lit(0).alias("shared_houses"), F.lit(True).alias("eval_report"), F.lit(None).cast("boolean").alias("benchmark_report"),
    )


_RELEASE = f"""rel AS (SELECT * FROM (SELECT unnest([
 {{'g': 'MODE', 'v': CASE WHEN 'full' = 'full' THEN 'PASS' ELSE 'FAIL' END, 'x': 1.0::DOUBLE}}, {{'g': 'WETFLOOR', 'v': 'PASS', 'x': 0.7::DOUBLE}}, {{'g': 'RG1', 'v': CASE WHEN off = 0 THEN 'PASS' ELSE 'FAIL' END, 'x': off::DOUBLE}}, {{'g': 'RG2', 'v': 'FAIL', 'x': 2.0::DOUBLE}},
 {{'g': 'RG3', 'v': CASE WHEN cells >= 100 THEN 'PASS' ELSE 'FAIL' END, 'x': cells::DOUBLE}}, {{'g': 'RG4', 'v': 'PASS', 'x': 1.0::DOUBLE}}, {{'g': 'RG5', 'v': 'FAIL', 'x': 1.0::DOUBLE}}, {{'g': 'RG6', 'v': 'PASS', 'x': 0.0::DOUBLE}}, {{'g': 'RG7', 'v': 'FAIL', 'x': 5.0::DOUBLE}},
 {{'g': 'RG8', 'v': CASE WHEN leaked = 0 THEN 'PASS' ELSE 'FAIL' END, 'x': leaked::DOUBLE}}, {{'g': 'RG9', 'v': CASE WHEN n >= 200 AND houses >= 3 AND least >= 150 THEN 'PASS' ELSE 'FAIL' END, 'x': n::DOUBLE}}, {{'g': 'RG10', 'v': 'FAIL', 'x': NULL::DOUBLE}}]) AS r FROM fig) y)"""
_LIMITS = {"mode": "full", "verified_cells": 100, "custom_images": 200, "houses": 3, "instances": 150, "allow_noncommercial": False}


@query(f"WITH {BOXES}, {IMAGES}, {_FIGURES}, {_RELEASE} SELECT r.g AS gate_id, r.v AS verdict, r.x AS value FROM rel")
def release_gates(spark, sf_dir):
    return releases.release_gates(_release(spark, sf_dir), _LIMITS)


@query(f"WITH {BOXES}, {IMAGES}, {_FIGURES}, {_RELEASE} SELECT 3 AS gates, CASE WHEN count(*) FILTER (WHERE r.v = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM rel WHERE r.g IN ('MODE', 'RG3', 'RG9')")
def evaluate_release(spark, sf_dir):
    return gates.fold_verdicts(releases.release_gates(_release(spark, sf_dir), _LIMITS), ["MODE", "RG3", "RG9"])


@query(f"""WITH {BOXES}, {IMAGES}, {_FIGURES}, {_RELEASE} SELECT 'v1' AS version, (SELECT count(*) FROM images) AS images, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT split || '=' || count(*) AS k FROM images GROUP BY split)) AS by_split,
 (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT concat_ws('=', source, count(*)) AS k FROM images GROUP BY source)) AS by_source, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT class_id || '=' || count(*) AS k FROM boxes GROUP BY class_id)) AS by_class,
 (SELECT string_agg(r.g || '=' || r.v, ',' ORDER BY r.g || '=' || r.v) FROM rel) AS gates""")
def release_manifest(spark, sf_dir):
    return releases.release_manifest(images(spark, sf_dir), boxes(spark, sf_dir), releases.release_gates(_release(spark, sf_dir), _LIMITS), "v1")


@query("SELECT t.class_name, count(role) AS n FROM (VALUES ('assistant'), ('user'), ('nobody')) t(class_name) LEFT JOIN conversations ON role = t.class_name GROUP BY 1")
def custom_counts(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("class_name")).agg(F.count("*").alias("n"))
    return releases.dense_counts(n, spark.createDataFrame([("assistant",), ("user",), ("nobody",)], "class_name string"))


@query("WITH s AS (SELECT user_id AS session, avg(value) / 100 AS agreement FROM events WHERE event_type = 'error' GROUP BY 1) SELECT session, round(agreement, 6) AS agreement, CASE WHEN agreement >= 0.2 THEN 'keep' ELSE 'demote' END AS decision FROM s ORDER BY session LIMIT 1")
def wetfloor_pilot(spark, sf_dir):
    s = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("session")).agg((F.avg("value") / 100).alias("agreement"))
    return releases.pilot_decision(s, 0.2).withColumn("agreement", F.round("agreement", 6))


@query("SELECT true AS available, round(avg(value) / 100, 6) AS value, round(avg(value) / 100, 6) < 0.3 AS reopen FROM events WHERE event_type = 'error'")
def wetfloor_ckpt(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("class_name")).agg(F.round(F.avg("value") / 100, 6).alias("value"))
    return releases.precision_checkpoint(m, "error")


@query("""WITH f AS (SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 <> 2) AS n, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 2 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 2)) AS stale, (SELECT count(*) FROM labels WHERE toxic = 1) AS ledger)
SELECT unnest(['G2', 'G3', 'G4', 'G7', 'G8', 'G9']) AS gate_id, unnest(['PASS', CASE WHEN n > 0 AND missing + stale = 0 THEN 'PASS' WHEN n > 0 AND missing = 0 THEN 'WARN' ELSE 'FAIL' END, 'WARN', 'FAIL', 'WARN', CASE WHEN ledger = 0 THEN 'PASS' ELSE 'FAIL' END]) AS verdict,
 unnest([0, missing, 0, 1, 0.5, ledger]::DOUBLE[]) AS value FROM f""")
def training_gates(spark, sf_dir):
    sets = coverage_sets(spark, sf_dir).agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "stale").alias("stale"))
    n = table(spark, sf_dir, "documents").agg(F.count_if(F.col("doc_id") % 3 != 2).alias("images"))
    led = table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("ledger_problems"))
    zero = F.lit(0)
    one = sets.crossJoin(n).crossJoin(led).select("*", F.lit("a").alias("artefact_fingerprint"), F.lit("a").alias("live_fingerprint"), zero.alias("split_mismatch"), zero.alias("artefact_problems"), F.lit(2).alias("unused_policies"), F.lit(1).alias("stale_inputs"), F.lit(0.5).alias("mixing"))  # of one row each
    return releases.training_gates(one, "warn")


@query("SELECT p.p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM part p WHERE p_partkey % 7 = 0 OR p_size > 25")
def input_freshness(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.md5("p_name").alias("sha"), "p_size")
    return releases.changed_inputs(p.select("name", "sha"), p.filter("name % 7 <> 0").select("name", F.when(F.col("p_size") > 25, "new").otherwise(F.col("sha")).alias("sha")))


@query(f"WITH {BOXES} SELECT image % 9 AS session, class_id, count(*) AS boxes FROM boxes WHERE (side = 'A') = (image % 9 % 2 = 0) AND side <> 'N' GROUP BY 1, 2")
def finalize_counts(spark, sf_dir):
    b = boxes(spark, sf_dir).filter("side <> 'N'").withColumn("key", F.struct(F.expr("image % 9").alias("session"), F.col("side").alias("annotator"), F.col("image").alias("stem")))
    staged = sinks.label_texts(b, "key").select("key.*", "text")
    chosen = spark.range(9).select(F.col("id").alias("session"), F.when(F.col("id") % 2 == 0, "A").otherwise("R").alias("annotator"))
    return captures.label_counts(captures.final_labels(staged, chosen))


@query(f"WITH {IMAGES} SELECT split AS \"set\", count(*) AS images, sha256(string_agg(name || ':' || sha, chr(10) ORDER BY name || ':' || sha)) AS digest, CASE WHEN split = 'val' THEN 'locked' END AS refused FROM images GROUP BY split")
def eval_lock(spark, sf_dir):
    return captures.eval_lock(images(spark, sf_dir).select(F.col("split").alias("set"), "name", "sha"), spark.createDataFrame([("val",)], "set string"))


@query("SELECT p_partkey AS name, md5(p_name) AS sha FROM part WHERE p_partkey % 3 <> 0 OR p_size > 25")
def remap_idempotent(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.md5("p_name").alias("sha"), "p_size")
    return captures.pending(p.select("name", "sha"), p.filter("name % 3 = 0").select("name", F.when(F.col("p_size") > 25, "old").otherwise(F.col("sha")).alias("sha")))


@query("WITH e AS (SELECT p_brand AS export, count(DISTINCT p_type) AS n FROM part GROUP BY 1), o AS (SELECT export, coalesce(sum(n) OVER (ORDER BY export ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM e) SELECT p_partkey AS image, p_brand AS export, p_size % 4 + o AS class_id FROM part JOIN o ON export = p_brand")
def scan_roboflow_export(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return captures.consolidated(p.select(F.col("p_partkey").alias("image"), F.col("p_brand").alias("export"), (F.col("p_size") % 4).alias("class_id")), p.groupBy(F.col("p_brand").alias("export")).agg(F.countDistinct("p_type").alias("n_classes"))).select("image", "export", "class_id")


@query(f"WITH {IMAGES}, g AS (SELECT name, coalesce({_GROUP}, name) AS group_key FROM images) SELECT group_key, count(*) AS n, string_agg(name, ',' ORDER BY name) AS files FROM g GROUP BY 1")
def group_files(spark, sf_dir):
    i = images(spark, sf_dir).select(N.group_key(F.col("name")).alias("group_key"), "name")
    return captures.files_by_group(i, "group_key", "name").withColumn("files", F.array_join("files", ","))


@query(f"WITH {COARSE}, x AS (SELECT vec_id, {sql_hex('bits')} AS hash FROM hashes) SELECT hash, count(*) AS n, string_agg(vec_id, ',' ORDER BY vec_id) AS files FROM x GROUP BY 1")
def phash_index(spark, sf_dir):
    from ..functions.hashes import hex64

    h = _hashes(spark, sf_dir).select(hex64(F.col("h")).alias("hash"), "ord")
    return captures.files_by_group(h, "hash", "ord").withColumn("files", F.array_join(F.col("files").cast("array<string>"), ","))


_LAP = "list_transform(range(64), lambda i: g[CASE WHEN i < 8 THEN i + 8 ELSE i - 8 END + 1] + g[CASE WHEN i >= 56 THEN i - 8 ELSE i + 8 END + 1] + g[CASE WHEN i % 8 = 0 THEN i + 1 ELSE i - 1 END + 1] + g[CASE WHEN i % 8 = 7 THEN i - 1 ELSE i + 1 END + 1] - 4 * g[i + 1])"


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: 128 + 200 * x::DOUBLE) AS g FROM embeddings), l AS (SELECT vec_id, list_sum(g) / 64 AS m, list_var_pop({_LAP}) AS v FROM e)
SELECT vec_id, round(m, 6) AS brightness, round(v, 4) AS sharpness, concat_ws(',', CASE WHEN v < 5000 THEN 'blurry' END, CASE WHEN m < 126 THEN 'low_light' END) AS flags FROM l""")
def image_quality(spark, sf_dir):
    g = F.col("g")
    e = grids(spark, sf_dir).select("vec_id", F.transform("grid", lambda x: 128 + 200 * x.cast("double")).alias("g"))
    return e.select("vec_id", F.round(pixels.brightness(g), 6).alias("brightness"), F.round(pixels.sharpness(g, 8), 4).alias("sharpness"), F.array_join(pixels.quality_flags(g, 8, 5000.0, 126.0), ",").alias("flags"))


@query("SELECT page_id, ['webcam', 'video', 'images', 'unsupported'][CAST(page_id % 4 + 1 AS INT)] AS kind FROM pages")
def source_type(spark, sf_dir):
    i = F.col("page_id")
    name = F.element_at(F.array(i.cast("string"), F.concat(F.lit("a/clip"), i.cast("string"), F.lit(".MP4")), F.concat(F.lit("frames/of_"), i.cast("string")), F.concat(F.lit("x"), i.cast("string"), F.lit(".txt"))), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", pixels.source_kind(name).alias("kind"))


@query("""WITH m AS (SELECT vec_id, list_filter(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0.25 THEN i END), lambda i: i IS NOT NULL) AS o FROM embeddings), b AS (SELECT vec_id, len(o) AS n, list_min(list_transform(o, lambda i: i % 8)) AS x0, list_max(list_transform(o, lambda i: i % 8)) + 1 AS x1, list_min(list_transform(o, lambda i: i // 8)) AS y0, list_max(list_transform(o, lambda i: i // 8)) + 1 AS y1 FROM m)
SELECT vec_id, CASE WHEN n > 0 THEN (x0 + x1) / 16 ELSE 0.5 END::DOUBLE AS cx, CASE WHEN n > 0 THEN (y0 + y1) / 16 ELSE 0.5 END::DOUBLE AS cy, CASE WHEN n > 0 THEN (x1 - x0) / 8 ELSE 1 END::DOUBLE AS w, CASE WHEN n > 0 THEN (y1 - y0) / 8 ELSE 1 END::DOUBLE AS h FROM b""")
def refine(spark, sf_dir):
    mask = F.transform("grid", lambda x: (x > 0.25).cast("int"))
    return grids(spark, sf_dir).select("vec_id", annotate.refined(B.box(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(1.0)), mask, 8).alias("b")).select("vec_id", "b.*")


_PLUGINS = [
    plugins.Plugin("errors", "1", lambda f: f.filter(F.array_contains("classes", "error")).select("camera", "frame_no", F.lit("error").alias("kind"), F.lit(3).alias("severity"))),
    plugins.Plugin("crowded", "2", lambda f: f.filter(F.size("classes") >= 4).select("camera", "frame_no", F.lit("crowd").alias("kind"), F.lit(1).alias("severity"))),
    plugins.Plugin("off", "1", lambda f: f, ready=lambda: "its model is not there"),
]


@query(f"WITH {FRAMES} SELECT 'errors' AS plugin, '1' AS version, camera, frame_no, 'error' AS kind, 3 AS severity FROM frames WHERE list_contains(classes, 'error') UNION ALL SELECT 'crowded', '2', camera, frame_no, 'crowd', 1 FROM frames WHERE len(classes) >= 4")
def plugin_alerts(spark, sf_dir):
    return plugins.analyze(frames(spark, sf_dir), _PLUGINS)


@query("""SELECT run, sha256(string_agg(l, chr(10) ORDER BY l)) AS fingerprint FROM (
 SELECT p_brand AS run, printf('%s\t%s\t%.6f', p_name, 'a ' || p_type, (0.25 + p_size / 100.0)::DOUBLE) AS l FROM part) t GROUP BY 1""")
def prompt_fingerprint(spark, sf_dir):
    """A brand as a run, its parts as prompts."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_name").alias("class_name"), F.concat(F.lit("a "), "p_type").alias("prompt"), (0.25 + F.col("p_size") / 100).alias("threshold"))
    return annotate.prompt_fingerprint(t, ["run"])


_QA = f"""qa AS (SELECT 'malformed' AS c, 'critical' AS s FROM conversations WHERE text LIKE '%  %' UNION ALL SELECT 'class_id', 'critical' FROM boxes WHERE class_id >= 22 UNION ALL SELECT 'bounds', 'warning' FROM boxes WHERE cx + w / 2 > 1 + 1e-6
 UNION ALL SELECT 'duplicate_file', 'warning' FROM (SELECT image, min(image) OVER (PARTITION BY sha) AS first FROM images) x WHERE image <> first UNION ALL SELECT 'no_label', 'warning' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'leakage', 'critical' FROM images GROUP BY sha HAVING count(DISTINCT split) > 1
 UNION ALL SELECT 'low_light', 'warning' FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 < 0 UNION ALL SELECT 'house', 'critical' FROM (SELECT {_HOUSE} AS k, split FROM images) h WHERE k <> 'house:' GROUP BY k HAVING count(DISTINCT split) > 1)"""
_CHECKS = ("malformed", "class_id", "bounds", "duplicate_file", "no_label", "leakage", "low_light", "house", "consent")


@query(f"""WITH {BOXES}, {IMAGES}, {_QA} SELECT k AS "check", count(c) AS issues, count(c) FILTER (WHERE s = 'critical') AS criticals, count(c) FILTER (WHERE s = 'warning') AS warnings, CASE WHEN count(c) FILTER (WHERE s = 'critical') > 0 THEN 'FAIL' WHEN count(c) > 0 THEN 'WARN' ELSE 'PASS' END AS status
 FROM (VALUES {", ".join(f"('{c}')" for c in _CHECKS)}) t(k) LEFT JOIN qa ON c = k GROUP BY k""")
def full_qa(spark, sf_dir):
    b, i, d = boxes(spark, sf_dir), images(spark, sf_dir), table(spark, sf_dir, "documents")
    from ..operators import dedup

    text, key = lambda c: F.col(c).cast("string"), N.house(F.col("name"))
    found = gates.issues(
        (table(spark, sf_dir, "conversations").filter(F.contains("text", F.lit("  "))), "malformed", "critical", text("conv_id")),
        (b.filter("class_id >= 22"), "class_id", "critical", text("image")), (b.filter(B.corners(F.col("box"))["x2"] > 1 + B.EDGE), "bounds", "warning", text("image")),
        (dedup.copies(i.select("sha", "image"), "sha", "image"), "duplicate_file", "warning", text("image")),
        (d.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti"), "no_label", "warning", text("doc_id")),
        (i.groupBy("sha").agg(F.countDistinct("split").alias("n")).filter("n > 1"), "leakage", "critical", text("sha")),
        (grids(spark, sf_dir).filter(pixels.brightness(F.col("grid")) < 0), "low_light", "warning", text("vec_id")),
        (i.groupBy(key.alias("h")).agg(F.countDistinct("split").alias("n")).filter("h is not null and n > 1"), "house", "critical", text("h")),
    )
    return gates.qa_summary(found, spark.createDataFrame([(c,) for c in _CHECKS], "check string"))


@query(f"WITH {BOXES} SELECT image, ord, round(w * h, 6) AS area, round(cx - w / 2, 6) AS x, round(cy - h / 2, 6) AS y, conf BETWEEN 0.25 AND 0.55 AS uncertain, CASE WHEN class_id > 1 THEN round(cx, 6) END AS shown FROM boxes")
def box_views(spark, sf_dir):
    """box_area, the top left form and back, the band worth learning from, and boxes that may be logged."""
    b = boxes(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("class_id") + 1)
    top = B.to_top_left(F.col("box"))
    return b.select("image", "ord", F.round(B.area(F.col("box")), 6).alias("area"), F.round(top["x"], 6).alias("x"), F.round(top["y"], 6).alias("y"), labels.uncertain(F.col("conf")).alias("uncertain"), F.round(labels.redacted(name, B.from_top_left(top))["cx"], 6).alias("shown"))


@query(f"{_BY_IOU}, c AS (SELECT class_id, sum(matched) / (sum(matched) + sum(only_a) + sum(only_b)) AS a FROM m GROUP BY 1) SELECT class_id, round(a, 6) AS agreement, CASE WHEN class_id = 1 THEN 0.9 ELSE 0.2 END::DOUBLE AS gate FROM c WHERE a < CASE WHEN class_id = 1 THEN 0.9 ELSE 0.2 END")
def iaa_gate(spark, sf_dir):
    a, b = map(_coarse, _sides(spark, sf_dir))
    by = matching.agreement(matching.match_by_overlap(a, b, ["image", "class_id"], 0.2), ["class_id"])
    return matching.agreement_failures(by, 0.2, {1: 0.9}).withColumn("agreement", F.round("agreement", 6))


@query("SELECT * FROM (VALUES ('h55')) t(house)")
def missing_houses(spark, sf_dir):
    return splits.missing_houses(images(spark, sf_dir).select(F.col("name").alias("group_key")), spark.createDataFrame([("h55",), ("h01",)], "house string"))


@query("SELECT event_type, ['PASS', 'WARN', 'FAIL'][max(CASE WHEN value > 99 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END) + 1] AS worst FROM events GROUP BY 1")
def worst_status(spark, sf_dir):
    rank = F.when(F.col("value") > 99, 2).when(F.col("value") > 50, 1).otherwise(0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(stats.worst(rank).alias("worst"))


@query("SELECT p_name AS stem, max(p_partkey) AS label_path FROM part GROUP BY 1")
def label_index(spark, sf_dir):
    return labels.label_index(table(spark, sf_dir, "part").select(F.col("p_name").alias("stem"), F.col("p_partkey").alias("label_path")), "stem")


@query(f"WITH {IMAGES} SELECT frame_id, path FROM (SELECT name AS path, row_number() OVER (ORDER BY name) AS frame_id, n_chars FROM images) x WHERE n_chars >= 300")
def scan_frames(spark, sf_dir):
    return files.frames_of_folder(images(spark, sf_dir).select(F.col("name").alias("path"), (F.col("n_chars") >= 300).alias("ok"))).select("frame_id", "path")


@query("SELECT doc_id AS image, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 END AS slug FROM documents WHERE source IS NOT NULL")
def slug_for_file(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents").filter("source is not null"), F.col("doc_id")
    bare = F.concat(F.lit("img_"), i.cast("string"))
    f = d.select(i.alias("image"), "source", F.when(i % 2 == 0, F.concat("source", F.lit("_"), bare)).otherwise(bare).alias("filename"))
    return policies.slugs_of_files(f, d.filter(i % 3 == 0).select(bare.alias("name"), (i % 7).alias("slug"))).select("image", "slug")


@query("""WITH p AS (SELECT l_linestatus AS a, l_returnflag AS b FROM lineitem UNION ALL SELECT l_returnflag, l_returnflag FROM lineitem WHERE l_linenumber = 1), c AS (SELECT DISTINCT unnest([a, b]) AS c FROM p),
 n AS (SELECT c, (SELECT count(*) FROM p WHERE a = c AND b = c) AS tp, (SELECT count(*) FROM p WHERE a = c AND b <> c) AS fp, (SELECT count(*) FROM p WHERE b = c AND a <> c) AS fn FROM c), m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r FROM n)
SELECT c AS "class", tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE AS f1 FROM m""")
def per_class_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select(F.col("l_linestatus").alias("predicted"), F.col("l_returnflag").alias("truth")).union(li.filter("l_linenumber = 1").select("l_returnflag", "l_returnflag"))
    return stats.class_metrics(pairs)


@query(f"WITH {DETECTIONS}, a AS (SELECT camera, max(frame_no) // 2 AS f FROM detections GROUP BY 1), s AS (SELECT d.*, f FROM detections d JOIN a ON a.camera = d.camera WHERE frame_no <= f AND frame_no > 2) SELECT camera, class_name, max(f) - max(frame_no) AS frames_since, count(*) FILTER (WHERE frame_no > f - 5) AS n FROM s GROUP BY 1, 2")
def memory_snapshot(spark, sf_dir):
    d = detections(spark, sf_dir)
    at = d.groupBy("camera").agg(F.expr("max(frame_no) div 2").alias("frame_no"), F.lit(2).alias("cleared"))
    return memory.snapshot(d, at, 5)


@query(f"""{_COVER}{_BY_IMAGE} SELECT (SELECT sum(annotated) FROM cov)::BIGINT AS annotated, (SELECT round(sum(residual), 3) FROM cov) AS residual, (SELECT round(sum(annotated) / (sum(annotated) + sum(residual)), 4) FROM cov) AS score, (SELECT class_id FROM cov ORDER BY score, class_id LIMIT 1) AS weakest, (SELECT count(*) FROM si) AS images, (SELECT count(*) FROM si WHERE score < 0.5) AS low""")
def coverage_report(spark, sf_dir):
    b = written_boxes(spark, sf_dir)
    return reports.coverage(_coverage(spark, sf_dir, b), _coverage_images(spark, sf_dir, b))


@query("""WITH a AS (SELECT l_partkey % 29 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_partkey % 29 < 20 GROUP BY 1), b AS (SELECT l_partkey % 29 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 29 > 5 GROUP BY 1), d AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT k AS class_id, x AS before, y AS after, y - x AS delta, round(CASE WHEN x > 0 THEN 100 * (y - x) / x END, 2) AS percent, CASE WHEN x = 0 THEN 'added' WHEN y = 0 THEN 'removed' WHEN y > x THEN 'more' WHEN y < x THEN 'fewer' ELSE 'same' END AS change FROM d""")
def comparison_report(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").withColumn("class_id", F.col("l_partkey") % 29).groupBy("l_returnflag", "class_id").agg(F.count("*").alias("n"))
    return reports.comparison(n.filter("l_returnflag = 'A' and class_id < 20"), n.filter("l_returnflag = 'R' and class_id > 5"), "class_id", "n")


@query(f"WITH {IMAGES}, {_POLICIES} SELECT im.image, im.policy, array_to_string(ids, ',') AS ids, images.split FROM im LEFT JOIN pol ON pol.policy = im.policy LEFT JOIN images ON images.image = im.image")
def completeness_artifact(spark, sf_dir):
    pol, im = _completeness(spark, sf_dir)
    return reports.completeness(im, pol, images(spark, sf_dir)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("SELECT doc_id AS image, CASE WHEN doc_id % 2 = 0 THEN '0,1,0,0,1' ELSE '1,1,1,1,1' END AS mask, printf('%.1f%%', CASE WHEN n_chars > 0 THEN 100.0::DOUBLE * (doc_id % 7) / n_chars ELSE 0 END) AS share FROM documents")
def mask_rows(spark, sf_dir):
    ids = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(4))).otherwise(F.array(*map(F.lit, range(5))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), F.array_join(mask_row(ids, 5).cast("array<string>"), ",").alias("mask"), N.percent(F.col("doc_id") % 7, F.col("n_chars")).alias("share"))
