"""Queries of the named quality checks, of the gates before training and builds, and of packages for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import releases
from ..plans import annotate, preflight, qa
from ..sources import files, sinks
from .base import BOXES, CLASSES, boxes, query, table

#: An order is an image and its label file; a line item is a line, faulty by its part's key.
_FILES = """li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 23 AS p, l_suppkey % 3 AS s FROM lineitem),
 ln AS (SELECT k, n, p, CASE p WHEN 0 THEN '3 0.5 0.5 0.1' WHEN 1 THEN 'x 0.5 0.5 0.1 0.1' WHEN 2 THEN '25 0.5 0.5 0.1 0.1' WHEN 3 THEN '21 0.5 0.5 0.1 0.1' WHEN 4 THEN '4 0.5 0.5 0.0 0.1' WHEN 5 THEN '5 1.2 0.5 0.1 -0.1' WHEN 6 THEN '-1 0.5 nan 0.1 0.1' ELSE s || ' 0.5  0.5 0.1 0.1' END AS raw FROM li),
 o AS (SELECT DISTINCT k, ['train', 'val', 'test'][k % 3 + 1] AS split, k::VARCHAR AS stem FROM li),
 im AS (SELECT split, stem || '.jpg' AS file, stem, k % 4000 AS sha, CASE WHEN k % 19 = 0 THEN 'unreadable' END AS problem FROM o WHERE k % 13 <> 0),
 lb AS (SELECT split, stem || '.txt' AS file, stem, k, k % 7 = 0 AS bare FROM o WHERE k % 11 <> 0),
 rw AS (SELECT lb.split, lb.file, row_number() OVER (PARTITION BY ln.k ORDER BY n, p, raw) AS line, p, raw FROM ln JOIN lb ON lb.k = ln.k WHERE NOT bare),
 fs AS (SELECT split, sha, min(file) AS first FROM im GROUP BY 1, 2)"""
_ISSUES = f"""WITH {_FILES}, issues AS (
 SELECT 'invalid_yolo_format' AS "check", split, file, line FROM rw WHERE p IN (0, 1, 6) UNION ALL SELECT 'invalid_class_ids', split, file, line FROM rw WHERE p = 2 UNION ALL SELECT 'unknown_class_names', split, file, line FROM rw WHERE p = 3
 UNION ALL SELECT 'zero_area_boxes', split, file, line FROM rw WHERE p IN (4, 5) UNION ALL SELECT 'bbox_out_of_bounds', split, file, line FROM rw WHERE p = 5
 UNION ALL SELECT 'duplicate_annotations', split, file, line FROM (SELECT *, min(line) OVER (PARTITION BY split, file, raw) AS first FROM rw) x WHERE line > first
 UNION ALL SELECT 'missing_label_files', split, file, NULL FROM im WHERE NOT EXISTS (SELECT 1 FROM lb WHERE lb.split = im.split AND lb.stem = im.stem) UNION ALL SELECT 'missing_image_files', split, file, NULL FROM lb WHERE NOT EXISTS (SELECT 1 FROM im WHERE lb.split = im.split AND lb.stem = im.stem)
 UNION ALL SELECT 'empty_label_files', split, file, NULL FROM lb WHERE bare UNION ALL SELECT 'inconsistent_pairs', split, NULL, NULL FROM (SELECT split, count(*) AS a FROM im GROUP BY 1) x JOIN (SELECT split, count(*) AS b FROM lb GROUP BY 1) y USING (split) WHERE a <> b
 UNION ALL SELECT 'corrupted_images', split, file, NULL FROM im WHERE problem IS NOT NULL UNION ALL SELECT 'duplicate_images', im.split, file, NULL FROM im JOIN fs ON fs.split = im.split AND fs.sha = im.sha WHERE file <> first
 UNION ALL SELECT a.split || '_' || b.split || '_leakage', a.split, a.first, NULL FROM fs a JOIN fs b ON a.sha = b.sha AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')))"""


def _issues(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 23).alias("p"), (F.col("l_suppkey") % 3).cast("string").alias("s"))
    faulty = ["3 0.5 0.5 0.1", "x 0.5 0.5 0.1 0.1", "25 0.5 0.5 0.1 0.1", "21 0.5 0.5 0.1 0.1", "4 0.5 0.5 0.0 0.1", "5 1.2 0.5 0.1 -0.1", "-1 0.5 nan 0.1 0.1"]
    raw = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in faulty]), (F.col("p") + 1).cast("int")), F.concat("s", F.lit(" 0.5  0.5 0.1 0.1")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p", raw.alias("raw")))), lambda x: x["raw"]), "\n")
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("k") % 3 + 1).cast("int"))
    o = li.groupBy("k").agg(text.alias("text")).select("k", split.alias("split"), F.col("k").cast("string").alias("stem"), F.when(F.col("k") % 7 == 0, " \n").otherwise(F.col("text")).alias("text"))
    o = qa.shared_table(o)
    name = lambda ending: F.concat("stem", F.lit(ending)).alias("file")
    images = o.filter("k % 13 <> 0").select("split", name(".jpg"), "stem", (F.col("k") % 4000).cast("string").alias("sha"), F.when(F.col("k") % 19 == 0, "unreadable").alias("problem"))
    labels = o.filter("k % 11 <> 0").select("split", name(".txt"), "stem", "text")
    return qa.annotation_qa(images, labels, spark.range(21).select(F.col("id").cast("int").alias("class_id")), 23)


@query(f'{_ISSUES} SELECT "check", split, file, line FROM issues')
def annotation_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select("check", "split", "file", "line")


@query(f"""{_ISSUES}, c(k, s) AS (VALUES {", ".join(f"('{k}', '{s}')" for k, s in qa.CHECKS.items())}) SELECT k AS "check", s AS severity, count(i."check") AS issues,
 CASE WHEN count(i."check") = 0 THEN 'PASS' ELSE s END AS status FROM c LEFT JOIN issues i ON i."check" = k GROUP BY 1, 2""")
def annotation_qa(spark, sf_dir):
    return qa.qa_status(_issues(spark, sf_dir))


#: A customer as a training run and a machine.
_FACTS = """fa AS (SELECT c_custkey AS run, c_custkey % 7 <> 0 AS loaded, c_custkey % 2 AS c2, c_custkey % 3 AS c3, c_custkey % 4 AS c4, c_custkey % 5 AS c5, c_custkey % 6 AS c6, c_custkey % 11 AS c11, c_acctbal::DOUBLE AS bal FROM customer)"""
_TRAINING = f"""{_FACTS}, tg AS (SELECT run, unnest([{{'g': 'G1', 'v': CASE WHEN loaded THEN 'PASS' ELSE 'FAIL' END}}, {{'g': 'G2', 'v': CASE WHEN NOT loaded THEN 'SKIPPED' WHEN c3 = 0 THEN 'FAIL' ELSE 'PASS' END}},
 {{'g': 'G3', 'v': CASE WHEN NOT loaded THEN 'SKIPPED' WHEN c11 = 0 OR c5 = 1 THEN 'FAIL' WHEN c4 = 2 THEN 'WARN' ELSE 'PASS' END}}, {{'g': 'G4', 'v': CASE WHEN NOT loaded THEN 'SKIPPED' WHEN c6 = 3 THEN 'FAIL' WHEN c5 = 2 THEN 'WARN' ELSE 'PASS' END}},
 {{'g': 'G5', 'v': CASE WHEN c6 IN (0, 1, 2) AND c11 <> 4 THEN 'PASS' ELSE 'FAIL' END}}, {{'g': 'G6', 'v': CASE WHEN c4 = 3 THEN 'FAIL' ELSE 'PASS' END}}, {{'g': 'G7', 'v': CASE WHEN NOT loaded THEN 'SKIPPED' WHEN c11 = 5 THEN 'FAIL' ELSE 'PASS' END}},
 {{'g': 'G8', 'v': CASE WHEN c2 = 0 OR c3 = 0 THEN 'PASS' WHEN c3 = 1 THEN 'WARN' ELSE 'FAIL' END}}, {{'g': 'G9', 'v': CASE WHEN c5 = 4 THEN 'FAIL' ELSE 'PASS' END}}]) AS x FROM fa)"""
_BUILD = f"""{_FACTS}, bg AS (SELECT run, unnest([{{'g': 'FB1', 'v': CASE WHEN bal >= 1000 THEN 'PASS' ELSE 'FAIL' END}},
 {{'g': 'FB2', 'v': CASE c5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARN' WHEN 2 THEN 'FAIL' ELSE CASE WHEN c3 = 0 THEN 'FAIL' WHEN bal / 2 < 1000 THEN 'WARN' ELSE 'PASS' END END}}, {{'g': 'FB3', 'v': CASE WHEN c2 = 0 OR c3 = 0 THEN 'WARN' WHEN c4 = 1 THEN 'PASS' ELSE 'FAIL' END}},
 {{'g': 'FB4', 'v': CASE WHEN c4 = 0 THEN 'PASS' ELSE 'WARN' END}}, {{'g': 'FB5', 'v': CASE WHEN c6 IN (1, 2, 4) THEN 'WARN' ELSE 'PASS' END}}, {{'g': 'FB6', 'v': CASE WHEN c3 = 2 THEN 'PASS' ELSE 'WARN' END}}]) AS x FROM fa)"""


def _runs(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    flag = lambda n, *at: (k % n).isin(*at)
    pick = lambda n, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("run"), (k % 7 != 0).alias("loaded"), flag(4, 3).cast("int").alias("config_problems"), F.lit("sha256:a").alias("live_fingerprint"), F.when(flag(3, 0), "sha256:b").otherwise("sha256:a").alias("artefact_fingerprint"),
        F.when(flag(11, 0), 0).otherwise(10).alias("images"), flag(5, 1).cast("int").alias("missing"), F.lit(0).alias("split_mismatch"), flag(4, 2).cast("int").alias("stale"), flag(6, 3).cast("int").alias("artefact_problems"),
        flag(5, 2).cast("int").alias("unused_policies"), flag(11, 5).cast("int").alias("stale_inputs"), pick(6, "8.3.0", "8.10.2", "8.4", "8.2.9", "9.0.0", None).alias("library"), (k % 11 != 4).alias("library_fits"),
        flag(2, 1).cast("double").alias("mixing"), pick(3, "ignore", "warn", "forbid").alias("mixing_policy"), flag(5, 4).cast("int").alias("ledger_problems"), F.col("c_acctbal").cast("double").alias("free_gb"),
        pick(5, None, "s3://store/x", "C:\\Users\\me\\OneDrive - Org\\store", "/mnt/store", "/mnt/my-onedrives/x").alias("remote"), (k % 3 != 0).alias("remote_there"), (F.col("c_acctbal") / 2).cast("double").alias("remote_free_gb"),
        flag(2, 1).alias("downloads"), F.when(flag(3, 0), 0).otherwise(2).alias("datasets"), flag(4, 1).alias("has_key"), flag(4, 0).alias("gpu"), pick(6, "/home/a", "/home/OneDrive/b", "/home/onedrive-x", "/home/c", "/d", "/e").alias("repo"),
        pick(6, "/c", "/c", "/c", None, "/x/ONEDRIVE", "/onedriver").alias("cache"), pick(3, "pilot", None, "full").alias("mode"),
    )


@query(f"WITH {_TRAINING} SELECT run, x.g AS gate_id, x.v AS verdict FROM tg")
def training_preflight(spark, sf_dir):
    return preflight.training_preflight(_runs(spark, sf_dir), "run")


@query(f"WITH {_BUILD} SELECT run, x.g AS gate_id, x.v AS verdict FROM bg")
def build_preflight(spark, sf_dir):
    return preflight.build_preflight(_runs(spark, sf_dir), "run", 1000.0)


@query(f"""WITH {_TRAINING} SELECT run, count(*) FILTER (WHERE x.v <> 'SKIPPED') AS gates, CASE WHEN bool_or(x.v = 'FAIL') THEN 'FAIL' WHEN bool_or(x.v = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict FROM tg GROUP BY 1""")
def preflight_verdicts(spark, sf_dir):
    return preflight.verdicts(preflight.training_preflight(_runs(spark, sf_dir), "run"), "run")


_LINE = "printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h)"


@query(f"""WITH {BOXES}, b AS (SELECT *, image // 400 AS batch FROM boxes), im AS (SELECT DISTINCT batch, image FROM b), bs AS (SELECT image, string_agg({_LINE} || chr(10), '' ORDER BY ord) AS t FROM b WHERE side = 'A' GROUP BY 1),
 cd AS (SELECT image, string_agg({_LINE} || chr(10), '' ORDER BY class_id, cx, cy, w, h) AS t FROM b WHERE side = 'R' GROUP BY 1)
SELECT batch::VARCHAR AS archive, 'obj_train_data/' || image || '.txt' AS entry, md5(coalesce(bs.t, '') || coalesce(cd.t, '')) AS md5 FROM im LEFT JOIN bs USING (image) LEFT JOIN cd USING (image)
 UNION ALL SELECT DISTINCT batch::VARCHAR, 'obj.names', md5('{"".join(c + chr(10) for c in CLASSES)}') FROM im UNION ALL SELECT DISTINCT batch::VARCHAR, 'obj.data', md5('{sinks.DATA_TEXT.format(n=len(CLASSES))}') FROM im
 UNION ALL SELECT batch::VARCHAR, 'train.txt', md5(string_agg('data/obj_train_data/' || image || '.jpg' || chr(10), '' ORDER BY image::VARCHAR || '.jpg')) FROM im GROUP BY 1""")
def review_package(spark, sf_dir):
    """Batches of four hundred orders: base labels by one annotator and candidates by another, packed and read back."""
    b = boxes(spark, sf_dir).withColumns({"batch": F.expr("image div 400"), "name": F.concat(F.col("image").cast("string"), F.lit(".jpg"))})
    b = qa.shared_table(b.select("batch", F.col("name").alias("image"), "ord", "side", "class_id", "box"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", sinks.label_line(F.col("class_id"), F.col("box")).alias("line")))), lambda x: x["line"])
    base = b.filter("side = 'A'").groupBy("image").agg(F.array_join(lines, "\n \n").alias("text"))
    texts = sinks.review_texts(b.select("batch", "image").distinct(), base, b.filter("side = 'R'"))
    packed = sinks.review_packages(texts, list(CLASSES)).select(F.col("batch").cast("string").alias("path"), "content")
    return files.archive_entries(packed).select("archive", "entry", F.md5("content").alias("md5"))


@query("""WITH s AS (SELECT 'v' || s_suppkey AS release, s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT release, CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 7 = 0 THEN 'version' WHEN n % 4 = 0 THEN 'failed_gates' END AS problem, CASE WHEN k % 5 <> 0 AND n % 4 = 0 THEN CASE WHEN n % 8 = 0 THEN 'RG10,RG2' ELSE 'RG2' END ELSE '' END AS failed,
 CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'same' ELSE 'differs' END AS lock FROM s""")
def release_verify(spark, sf_dir):
    """A supplier as a release; some were never made, some name another version, some record failed gates."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    name = F.concat(F.lit("v"), k.cast("string")).alias("release")
    s = table(spark, sf_dir, "supplier")
    gates = F.concat_ws(",", F.lit("RG1=PASS"), F.concat(F.lit("RG2="), F.when(n % 4 == 0, "FAIL").otherwise("WARN")), F.concat(F.lit("RG10="), F.when(n % 8 == 0, "FAIL").otherwise("PASS")))
    made = s.filter("s_suppkey % 5 <> 0").select(name, F.concat(F.lit("v"), F.when(k % 7 == 0, k + 1).otherwise(k).cast("string")).alias("version"), gates.alias("gates"), F.when(k % 3 == 0, F.lit("now")).otherwise("then").alias("lock_sha"))
    return releases.verify_releases(s.select(name, F.lit("now").alias("lock_sha")), made).withColumn("failed", F.array_join("failed", ","))


@query("""WITH f AS (SELECT p_partkey AS image, n::INT AS ord, (p_partkey % 5 + n)::INT AS class_id, 1 / (1 + (p_partkey % 5 + n) % 10)::DOUBLE AS conf FROM part, range(2) t(n))
SELECT 'recorded' AS side, image, ord, class_id, conf / 2 AS conf FROM f WHERE image % 40 = 0 AND image % 30 <> 0 UNION ALL SELECT 'fresh', image, ord, class_id, conf FROM f WHERE image % 40 = 0 OR image % 30 = 0""")
def rerun_diff(spark, sf_dir):
    """A backend run again over its images: detections that the record has otherwise, or has lost."""
    k = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(k.alias("image"), F.lit(None).cast("binary").alias("content"), F.array((k % 5).cast("int"), (k % 5 + 1).cast("int")).alias("class_ids"))
    fresh = annotate.annotate(images, "corners")
    recorded = qa.shared_table(fresh.filter("image % 30 <> 0").withColumn("conf", F.when(F.col("image") % 40 == 0, F.col("conf") / 2).otherwise(F.col("conf"))))
    return annotate.rerun_differences(recorded, fresh).select("side", "image", "ord", "class_id", "conf")
