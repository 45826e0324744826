"""Queries of aggregations, windows, gates and composed reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import gates, labels, merging, policies, stats
from ..operators.dedup import shared_table
from ..plans import reports
from .base import BOXES, IMAGES, N_CLASSES, TAXONOMY, boxes, images, query, table, taxonomy, written_boxes
from .relations import _RESOLVED, _VERIFIED, TRUST, _box_images, _trust, _verified

SPLITS = ("train", "val", "test")


@query(f"WITH {BOXES} SELECT split, class_id, count(*) AS boxes FROM boxes GROUP BY 1, 2")
def class_counts(spark, sf_dir):
    return stats.class_counts(boxes(spark, sf_dir), ["split"])


@query(f"WITH {BOXES}, {TAXONOMY} SELECT s AS split, t.class_id, count(b.image) AS boxes, count(DISTINCT b.image) AS images FROM taxonomy t CROSS JOIN (VALUES ('train'), ('val'), ('test')) x(s) LEFT JOIN boxes b ON b.split = s AND b.class_id = t.class_id AND b.class_id < 20 GROUP BY 1, 2")
def split_stats(spark, sf_dir):
    return stats.split_stats(boxes(spark, sf_dir).filter("class_id < 20"), taxonomy(spark), SPLITS)


@query(f"WITH {BOXES}, {TAXONOMY}, n AS (SELECT t.class_id, count(b.image) AS x FROM taxonomy t LEFT JOIN boxes b ON b.class_id = t.class_id AND b.class_id < 20 GROUP BY 1) SELECT max(x)::DOUBLE AS largest, min(x) FILTER (WHERE x > 0)::DOUBLE AS smallest, round(max(x) / min(x) FILTER (WHERE x > 0), 1) AS max_ratio, (SELECT round(sum(abs(a.x - b.x)) / (2 * 23 * (SELECT sum(x) FROM n)), 4) FROM n a, n b) AS gini FROM n")
def imbalance(spark, sf_dir):
    return stats.imbalance(stats.dense(stats.class_counts(boxes(spark, sf_dir).filter("class_id < 20")), taxonomy(spark)))


@query(f"WITH {BOXES}, {TAXONOMY} SELECT 'empty' AS kind, class_id FROM taxonomy WHERE class_id NOT IN (SELECT class_id FROM boxes WHERE class_id < 20) UNION ALL SELECT DISTINCT 'unknown', class_id + 4 FROM boxes WHERE class_id + 4 NOT IN (SELECT class_id FROM taxonomy)")
def empty_missing(spark, sf_dir):
    b, t = boxes(spark, sf_dir), taxonomy(spark).select("class_id")
    empty = t.join(b.filter("class_id < 20").select("class_id").distinct(), "class_id", "left_anti").select(F.lit("empty").alias("kind"), "class_id")
    return empty.union(b.select((F.col("class_id") + 4).alias("class_id")).distinct().join(t, "class_id", "left_anti").select(F.lit("unknown"), "class_id"))


@query(f"WITH {BOXES}, n AS (SELECT split, class_id, count(*) AS boxes FROM boxes GROUP BY 1, 2) SELECT split, class_id, boxes, round(100 * boxes / greatest(sum(boxes) OVER (PARTITION BY split), 1), 2) AS pct FROM n")
def flagged_totals(spark, sf_dir):
    return stats.share_of(stats.class_counts(boxes(spark, sf_dir), ["split"]), ["split"])


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents) SELECT source, count(*) AS total, count(*) FILTER (WHERE doc_id % 10 <> 0 AND n_chars >= 100 AND nth = 1) AS accepted, count(*) FILTER (WHERE doc_id % 10 <> 0 AND n_chars >= 100 AND nth > 1) AS duplicates, count(*) FILTER (WHERE doc_id % 10 <> 0 AND n_chars < 100) AS filtered, count(*) FILTER (WHERE doc_id % 10 = 0) AS missing_labels FROM d GROUP BY source")
def merge_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("nth", F.row_number().over(W.partitionBy("text").orderBy("doc_id")))
    fate = labels.first_reason((F.col("doc_id") % 10 == 0, "missing_label"), (F.col("n_chars") < 100, "filtered"), (F.col("nth") > 1, "duplicate"))
    return merging.merge_stats(d.select("source", F.coalesce(fate, F.lit("accepted")).alias("disposition")))


@query(f"WITH {IMAGES} SELECT sha, count(*) AS n, min(image) AS first FROM images GROUP BY sha HAVING count(*) > 1")
def hash_index(spark, sf_dir):
    return images(spark, sf_dir).groupBy("sha").agg(F.count("*").alias("n"), F.min("image").alias("first")).filter("n > 1")


@query(f"WITH {BOXES} SELECT image // 20 AS group_key, class_id, count(*) AS n FROM boxes GROUP BY 1, 2")
def group_histogram(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy(F.expr("image div 20").alias("group_key"), "class_id").agg(F.count("*").alias("n"))


_MATCH = "m AS (SELECT image, class_id, count(*) FILTER (WHERE conf > 0.25) AS tp, count(*) FILTER (WHERE conf <= 0.25) AS fp, count(*) FILTER (WHERE side = 'N') AS fn FROM boxes WHERE class_id < 15 GROUP BY 1, 2)"
_CAL = "cal AS (SELECT class_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS cells, CASE WHEN sum(tp) + sum(fp) > 0 THEN round(sum(tp) / (sum(tp) + sum(fp)), 4) END AS precision, CASE WHEN sum(tp) + sum(fn) > 0 THEN round(sum(tp) / (sum(tp) + sum(fn)), 4) END AS recall FROM m GROUP BY 1)"


def _calibrated(spark, sf_dir, b=None):
    m = (b or boxes(spark, sf_dir)).filter("class_id < 15").groupBy("image", "class_id").agg(F.count_if(F.col("conf") > 0.25).alias("tp"), F.count_if(F.col("conf") <= 0.25).alias("fp"), F.count_if(F.col("side") == "N").alias("fn"))
    return stats.calibration(m)


@query(f"WITH {BOXES}, {_MATCH}, {_CAL} SELECT * FROM cal")
def calibration(spark, sf_dir):
    return _calibrated(spark, sf_dir)


_OPEN = f"WITH {BOXES}, {TRUST}, {_VERIFIED}, {_RESOLVED}, op AS (SELECT b.* FROM boxes b JOIN r ON r.image = b.image WHERE side = 'N' AND NOT list_contains(wide, class_id)), ann AS (SELECT * FROM boxes WHERE side <> 'N')"


def _open(spark, sf_dir, b=None):
    b = b or written_boxes(spark, sf_dir)
    i = _box_images(spark, sf_dir, b)
    trusted = policies.trusted_pairs(policies.trusted_list(i, _trust(spark, sf_dir, b)))
    return stats.unverified_cells(b.filter("side = 'N'"), i, trusted, _verified(spark, sf_dir, b))


@query(f"{_OPEN} SELECT image, ord, class_id FROM op")
def unverified_anti(spark, sf_dir):
    return _open(spark, sf_dir).select("image", "ord", "class_id")


_COVER = f"""{_OPEN}, {_MATCH}, {_CAL}, {TAXONOMY}, a AS (SELECT class_id, count(*) AS n FROM ann GROUP BY 1), u AS (SELECT class_id, count(*) AS n FROM op GROUP BY 1),
 p AS (SELECT t.class_id, coalesce(a.n, 0) AS annotated, coalesce(u.n, 0) AS unverified, coalesce(cal.precision, CASE WHEN t.class_id = 16 THEN 0.6 END, 0.35)::DOUBLE AS precision FROM taxonomy t LEFT JOIN a ON a.class_id = t.class_id LEFT JOIN u ON u.class_id = t.class_id LEFT JOIN cal ON cal.class_id = t.class_id),
 cov AS (SELECT *, round(unverified * precision, 4) AS residual, round(CASE WHEN annotated + unverified * precision > 0 THEN annotated / (annotated + unverified * precision) ELSE 1 END, 4) AS score FROM p)"""


def _coverage(spark, sf_dir, b=None):
    b = b or written_boxes(spark, sf_dir)
    priors = spark.createDataFrame([(16, 0.6)], "class_id int, prior double")
    return stats.coverage_by_class(b.filter("side <> 'N'"), _open(spark, sf_dir, b), _calibrated(spark, sf_dir, b), priors, taxonomy(spark))


@query(f"{_COVER} SELECT class_id, annotated, unverified, precision, residual, score FROM cov")
def coverage_class(spark, sf_dir):
    return _coverage(spark, sf_dir)


_BY_IMAGE = ", ai AS (SELECT image, count(*) AS n FROM ann GROUP BY 1), ui AS (SELECT image, sum(coalesce(cal.precision, 0.35::DOUBLE)) AS e FROM op LEFT JOIN cal ON cal.class_id = op.class_id GROUP BY 1), ci AS (SELECT coalesce(ai.image, ui.image) AS image, coalesce(n, 0) AS annotated, round(coalesce(e, 0), 4) AS estimated FROM ai FULL JOIN ui ON ai.image = ui.image), si AS (SELECT *, round(CASE WHEN annotated + estimated > 0 THEN annotated / (annotated + estimated) ELSE 1 END, 4) AS score FROM ci)"


def _coverage_images(spark, sf_dir, b=None):
    b = b or written_boxes(spark, sf_dir)
    return stats.coverage_by_image(b.filter("side <> 'N'"), _open(spark, sf_dir, b), _calibrated(spark, sf_dir, b))


@query(f"{_OPEN}, {_MATCH}, {_CAL}{_BY_IMAGE} SELECT * FROM si")
def coverage_image(spark, sf_dir):
    return _coverage_images(spark, sf_dir)


@query(f"{_OPEN}, {_MATCH}, {_CAL}{_BY_IMAGE} SELECT count(*) AS n, round(avg(score), 4) AS mean, list_sort(list(score))[1 + floor(count(*) * 0.1)::INT] AS p10, count(*) FILTER (WHERE score < 0.5) AS below_half FROM si")
def p10_nearest(spark, sf_dir):
    return stats.nearest_decile(_coverage_images(spark, sf_dir), "score")


@query(f"WITH {BOXES}, {_MATCH}, {_CAL} SELECT count(precision) AS calibrated, CASE WHEN count(precision) = 0 THEN 'defer' WHEN bool_or(precision < 0.5) THEN 'recommend' ELSE 'keep' END AS decision FROM (SELECT * FROM (VALUES (10), (11), (20)) t(class_id)) p LEFT JOIN cal ON cal.class_id = p.class_id")
def backend_decision(spark, sf_dir):
    return stats.backend_decision(_calibrated(spark, sf_dir), spark.createDataFrame([(10,), (11,), (20,)], "class_id int"), 0.5)


@query("SELECT count(DISTINCT doc_id) AS images, count(*) AS cells, count(*) FILTER (WHERE quality = 1) AS present FROM labels")
def ledger_stats(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.countDistinct("doc_id").alias("images"), F.count("*").alias("cells"), F.count_if(F.col("quality") == 1).alias("present"))


@query("SELECT o_orderstatus AS status, count(*) AS batches, round(avg(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 1e6::DOUBLE END), 4) AS mean_iaa FROM orders GROUP BY 1")
def batch_progress(spark, sf_dir):
    iaa = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") / 1e6)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("batches"), F.round(F.avg(iaa), 4).alias("mean_iaa"))


@query(f"WITH {IMAGES}, h AS (SELECT image, source, regexp_extract(name, '(?:^|_)(h\\d{{2,}})_', 1) AS house FROM images) SELECT source, count(*) AS images, count(DISTINCT nullif(house, '')) AS houses FROM h GROUP BY 1")
def scale(spark, sf_dir):
    from ..functions.names import house

    return images(spark, sf_dir).groupBy("source").agg(F.count("*").alias("images"), F.countDistinct(house(F.col("name"))).alias("houses"))


@query("SELECT (turn % 5) AS class_id, sum(len(text))::BIGINT AS boxes, count(DISTINCT conv_id) AS sessions FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') GROUP BY 1")
def session_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    counts = c.select(F.col("conv_id").alias("session"), (F.col("turn") % 5).alias("class_id"), F.length("text").alias("n"))
    return gates.session_rollup(c.filter("role = 'assistant'").select(F.col("conv_id").alias("session")).distinct(), counts)


@query("WITH t AS (SELECT * FROM (VALUES (0, 5000), (1, 400000), (2, 9), (9, 7)) x(class_id, target)), n AS (SELECT turn AS class_id, sum(len(text)) AS n FROM conversations GROUP BY 1) SELECT t.class_id, t.target, coalesce(n, 0)::BIGINT AS count, greatest(0, t.target - coalesce(n, 0))::BIGINT AS pending, coalesce(n, 0) >= t.target AS met FROM t LEFT JOIN n ON n.class_id = t.class_id")
def capture_progress(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("turn").cast("int").alias("class_id"), F.length("text").alias("n"))
    return gates.capture_progress(c, spark.createDataFrame([(0, 5000), (1, 400000), (2, 9), (9, 7)], "class_id int, target int"))


_ISSUES = f"""iss AS (SELECT 'box' AS c, 'warning' AS s FROM boxes WHERE cx + w / 2 > 1 + 1e-6 UNION ALL SELECT 'duplicate', 'critical' FROM (SELECT image, class_id FROM boxes GROUP BY 1, 2 HAVING count(*) > 4) UNION ALL SELECT 'low', 'info' FROM boxes WHERE conf < 0.01)"""


def _found(spark, sf_dir):
    b = boxes(spark, sf_dir)
    text = F.col("image").cast("string")
    c = B.corners(F.col("box"))
    return gates.issues(
        (b.filter(c["x2"] > 1 + B.EDGE), "box", "warning", text),
        (b.groupBy("image", "class_id").count().filter("count > 4"), "duplicate", "critical", text),
        (b.filter("conf < 0.01"), "low", "info", text),
    )


@query(f"WITH {BOXES}, {_ISSUES} SELECT k AS check, count(c) AS issues, count(c) FILTER (WHERE s = 'critical') AS criticals, count(c) FILTER (WHERE s = 'warning') AS warnings, CASE WHEN count(c) FILTER (WHERE s = 'critical') > 0 THEN 'FAIL' WHEN count(c) FILTER (WHERE s = 'warning') > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM (VALUES ('box'), ('duplicate'), ('low'), ('pairs')) t(k) LEFT JOIN iss ON iss.c = k GROUP BY k")
def qa_summary(spark, sf_dir):
    return gates.qa_summary(_found(spark, sf_dir), spark.createDataFrame([("box",), ("duplicate",), ("low",), ("pairs",)], "check string"))


_GATES = f"""{_COVER}, g AS (SELECT 'RG1' AS gate_id, CASE WHEN min(score) >= 0.9 THEN 'PASS' WHEN min(score) >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS verdict, min(score) AS value FROM cov
 UNION ALL SELECT 'RG2', CASE WHEN sum(residual) < 10 THEN 'PASS' ELSE 'FAIL' END, round(sum(residual), 4) FROM cov UNION ALL SELECT 'RG3', CASE WHEN count(*) FILTER (WHERE annotated = 0) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (WHERE annotated = 0)::DOUBLE FROM cov)"""


def _gates(spark, sf_dir):
    one = shared_table(_coverage(spark, sf_dir)).agg(F.min("score").alias("low"), F.round(F.sum("residual"), 4).alias("residual"), F.count_if(F.col("annotated") == 0).alias("empty"))
    a = gates.gate(one, "RG1", F.col("low") >= 0.9, F.col("low"), warn=F.col("low") >= 0.5)
    return a.union(gates.gate(one, "RG2", F.col("residual") < 10, F.col("residual"))).union(gates.gate(one, "RG3", F.col("empty") == 0, F.col("empty")))


@query(f"{_GATES} SELECT gate_id, verdict, value FROM g")
def gate_results(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(f"{_GATES} SELECT count(*) AS gates, CASE WHEN count(*) FILTER (WHERE verdict = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE verdict = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g WHERE gate_id IN ('RG1', 'RG3')")
def verdict_fold(spark, sf_dir):
    return gates.fold_verdicts(_gates(spark, sf_dir), ["RG1", "RG3"])


@query(f"WITH {IMAGES} SELECT CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'public' ELSE 'local' END AS kind, count(*) AS images FROM images GROUP BY 1")
def public_local_split(spark, sf_dir):
    return images(spark, sf_dir).groupBy(F.when(F.col("source").isin("src0", "src1", "src2"), "public").otherwise("local").alias("kind")).agg(F.count("*").alias("images"))


@query(f"WITH {BOXES} SELECT class_id, count(*) AS boxes, 2700 - count(*) AS missing FROM boxes GROUP BY 1 HAVING count(*) < 2700")
def shortfall(spark, sf_dir):
    return stats.shortfall(stats.class_counts(boxes(spark, sf_dir)), 2700)


@query("SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, round(coalesce(stddev_samp(value), 0), 3) AS deviation FROM events GROUP BY 1")
def arm_mean_std(spark, sf_dir):
    return stats.mean_and_deviation(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def median_rounds(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("WITH m AS (SELECT event_type, round(avg(value), 4) AS value FROM events WHERE event_type <> 'view' GROUP BY 1), l AS (SELECT * FROM (VALUES ('click', 60.0::DOUBLE), ('error', 1.0), ('view', 5.0)) t(event_type, lim)) SELECT l.event_type, lim AS \"limit\", value, CASE WHEN value IS NULL THEN 'N/A' WHEN value <= lim THEN 'PASS' ELSE 'FAIL' END AS verdict FROM l LEFT JOIN m ON l.event_type = m.event_type")
def budget_eval(spark, sf_dir):
    m = table(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("value"))
    return stats.within_budget(m, spark.createDataFrame([("click", 60.0), ("error", 1.0), ("view", 5.0)], "event_type string, limit double"), "event_type")


@query("WITH f AS (SELECT user_id AS camera, value AS ms FROM events) SELECT camera, count(*) AS frames, round(avg(ms), 3) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(1000 / avg(ms), 3) AS fps FROM f GROUP BY 1")
def inference_summary(spark, sf_dir):
    return stats.latency_summary(table(spark, sf_dir, "events").select(F.col("user_id").alias("camera"), F.col("value").alias("ms")), ["camera"], "ms")


@query(f"WITH {BOXES}, {TRUST}, n AS (SELECT i.image, len(ids) AS k FROM (SELECT DISTINCT image, source FROM boxes) i JOIN trust t ON t.source = i.source) SELECT sum(23 - k)::BIGINT AS masked, count(*) * 23 AS total, round(sum(23 - k) / (count(*) * 23), 6) AS fraction FROM n")
def mask_stats(spark, sf_dir):
    t = policies.trusted_list(_box_images(spark, sf_dir), _trust(spark, sf_dir))
    masked, total = F.sum(N_CLASSES - F.size("ids")), F.count("*") * N_CLASSES
    return t.agg(masked.alias("masked"), total.alias("total"), F.round(masked / total, 6).alias("fraction"))


@query("SELECT l_linestatus AS predicted, count(*) FILTER (WHERE l_returnflag = 'A') AS \"A\", count(*) FILTER (WHERE l_returnflag = 'N') AS \"N\", count(*) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def confusion(spark, sf_dir):
    return stats.confusion(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("predicted"), F.col("l_returnflag").alias("truth")), ["A", "N", "R"])


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + conv_id % 4 AS number FROM conversations WHERE role <> 'system'")
def seq_numbering(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn")
    return gates.sequence_numbers(c, c.select("conv_id", (F.col("conv_id") % 4).alias("existing")).distinct(), "conv_id", ["turn"])


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'info' ELSE 'warning' END AS severity FROM events ORDER BY CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 0 ELSE 1 END DESC, event_id LIMIT 50")
def issue_topk(spark, sf_dir):
    sev = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "view", "info").otherwise("warning")
    return gates.top_issues(table(spark, sf_dir, "events").select("event_id", sev.alias("severity"), F.col("event_id").alias("seq"))).select("event_id", "severity")


@query("WITH e AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events) SELECT user_id, event_id, round(t - coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY event_id), 0), 4) AS took FROM e")
def epoch_diff(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.sum("value").over(w).alias("t"))
    return e.select("user_id", "event_id", F.round(F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0.0)), 4).alias("took"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def smoke_limit(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", nth.alias("n")).filter("n <= 3").drop("n")


@query("WITH l AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE n_chars < 500) SELECT source, count(*) AS offenders, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (WHERE n <= 10) AS shown FROM l GROUP BY 1")
def preview_limit(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf_dir, "documents").filter("n_chars < 500").select("source", "doc_id", nth.alias("n"))
    shown = F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.col("doc_id"))))
    return d.groupBy("source").agg(F.count("*").alias("offenders"), F.array_join(shown.cast("array<string>"), ",").alias("shown"))


@query("SELECT conv_id, max_by(md5(text), turn) AS hash FROM conversations GROUP BY 1")
def dict_update_union(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("hash"))
    return policies.latest_per_key(c, ["conv_id"], ["turn"]).select("conv_id", "hash")


@query(f"WITH {BOXES} SELECT image, class_id, count(*) AS n FROM boxes WHERE side = 'A' GROUP BY 1, 2 HAVING count(*) <> (SELECT count(*) FROM boxes b WHERE b.image = boxes.image AND b.class_id = boxes.class_id AND side = 'R')")
def ledger_overlay_check(spark, sf_dir):
    b = boxes(spark, sf_dir)
    n = lambda side, name: b.filter(F.col("side") == side).groupBy("image", "class_id").agg(F.count("*").alias(name))
    return n("A", "n").join(n("R", "m"), ["image", "class_id"], "left").filter(F.col("n") != F.coalesce("m", F.lit(0))).select("image", "class_id", "n")


_QUALITY = f"{_COVER}{_BY_IMAGE} SELECT (SELECT sum(annotated) FROM cov)::BIGINT AS annotated, (SELECT round(sum(residual), 2) FROM cov) AS residual, (SELECT round(avg(score), 4) FROM cov) AS class_score, (SELECT count(*) FROM si) AS images, (SELECT round(avg(score), 4) FROM si) AS image_score, (SELECT count(*) FROM verified) AS verified_cells, (SELECT round(1 - avg(len(wide)) / 23, 4) FROM r) AS masked_fraction"


@query(_QUALITY)
def quality_report(spark, sf_dir):
    b = written_boxes(spark, sf_dir)
    resolved = policies.with_ledger(policies.trusted_list(_box_images(spark, sf_dir, b), _trust(spark, sf_dir, b)), _verified(spark, sf_dir, b))
    return reports.quality(_coverage(spark, sf_dir, b), _coverage_images(spark, sf_dir, b), _verified(spark, sf_dir, b), resolved, N_CLASSES)


@query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS nth FROM documents) SELECT doc_id AS image, source, CASE WHEN doc_id % 10 = 0 THEN 'missing_label' WHEN n_chars < 100 THEN 'filtered' WHEN count(*) FILTER (WHERE doc_id % 10 <> 0 AND n_chars >= 100) OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS disposition FROM d")
def merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("image"), "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 10 != 0).alias("has_label"), F.when(F.col("n_chars") < 100, "too_small").alias("reason"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("flip"))
    return reports.merge(rows).select("image", "source", "disposition")


@query(f"WITH {IMAGES}, g AS (SELECT name AS k, split FROM images) SELECT split, count(*) AS files, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM g GROUP BY split")
def split_report(spark, sf_dir):
    return reports.split_summary(images(spark, sf_dir))

