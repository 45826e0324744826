"""Queries of readers and writers: index documents, label files, archives, manifests and reports, made of the driver tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import labels, merging
from ..operators.dedup import numbered_rows, shared_table
from ..sources import files, sinks
from ..streaming import live
from .base import BOXES, FRAMES, IMAGES, boxes, frames, images, query, table

_COCO = "c AS (SELECT l_orderkey, l_partkey % 5 AS k, l_quantity * 10 AS x, l_discount * 4000 AS y, l_extendedprice / 200 AS w, l_tax * 2000 AS h FROM lineitem WHERE l_linenumber <> 7), e AS (SELECT *, least(greatest(x, 0), 640) AS x1, least(greatest(y, 0), 480) AS y1, least(greatest(x + w, 0), 640) AS x2, least(greatest(y + h, 0), 480) AS y2 FROM c)"


@query(f"WITH {_COCO} SELECT 'f' || l_orderkey || '.jpg' AS file_name, 'c' || k AS class_name, round((x1 + x2) / 2 / 640, 9) AS cx, round((y1 + y2) / 2 / 480, 9) AS cy, round((x2 - x1) / 640, 9) AS w, round((y2 - y1) / 480, 9) AS h FROM e WHERE x2 - x1 > 1 AND y2 - y1 > 1 AND k IN (1, 3)")
def scan_coco_json(spark, sf_dir):
    """Index documents of a fortieth of the orders each."""
    li = table(spark, sf_dir, "lineitem").withColumn("doc", F.col("l_orderkey") % 40)
    number = [F.col("l_quantity") * 10, F.col("l_discount") * 4000, F.col("l_extendedprice") / 200, F.col("l_tax") * 2000]
    note = F.struct(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 5).alias("category_id"), F.array(*[n.cast("double") for n in number]).alias("bbox"), (F.col("l_linenumber") == 7).cast("int").alias("iscrowd"))
    image = F.struct(F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    cats = F.array(*[F.struct(F.lit(k).cast("long").alias("id"), F.lit(f"c{k}").alias("name")) for k in range(5)])
    docs = li.groupBy("doc").agg(F.collect_list(note).alias("annotations"), F.collect_set(image).alias("images")).withColumn("categories", cats)
    b = F.col("box")
    return files.coco_boxes(docs, ["c1", "c3"]).select("file_name", "class_name", *[B.rounded(b[c], 9).alias(c) for c in ("cx", "cy", "w", "h")])


@query("WITH r AS (SELECT l_orderkey AS image, l_partkey % 23 AS k, l_discount * 5 AS x0, l_discount * 5 + l_tax * 3 AS x1, 0.1::DOUBLE AS y0, l_quantity / 51 AS y1 FROM lineitem) SELECT image, 'n' || k AS class_name, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM r WHERE k < 9 AND x1 > x0 AND y1 > y0")
def scan_openimages_csv(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("ImageID"), F.concat(F.lit("/m/"), (c("l_partkey") % 23).cast("string")).alias("LabelName"), (c("l_discount") * 5).alias("XMin"), (c("l_discount") * 5 + c("l_tax") * 3).alias("XMax"), F.lit(0.1).alias("YMin"), (c("l_quantity") / 51).alias("YMax"))
    names = spark.range(9).select(F.concat(F.lit("/m/"), c("id").cast("string")).alias("LabelName"), F.concat(F.lit("n"), c("id").cast("string")).alias("class_name"))
    return files.open_images_boxes(rows, names).select("image", "class_name", F.round("box.cx", 6).alias("cx"), F.round("box.cy", 6).alias("cy"))


@query("SELECT 'i' || l_orderkey AS name, l_quantity::DOUBLE AS x, l_linenumber::DOUBLE AS y, (l_partkey % 40)::DOUBLE AS w, (l_suppkey % 30)::DOUBLE AS h FROM lineitem WHERE l_partkey % 40 >= 8 AND l_suppkey % 30 >= 8 AND l_linenumber <> 3")
def scan_wider_gt(spark, sf_dir):
    """Files of blocks: an order's line items as boxes, the third one flagged."""
    c = F.col
    line = F.concat_ws(" ", *[x.cast("int").cast("string") for x in (c("l_quantity"), c("l_linenumber"), c("l_partkey") % 40, c("l_suppkey") % 30)], F.lit("0 0 0"), (c("l_linenumber") == 3).cast("int").cast("string"))
    blocks = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("\n", F.concat(F.lit("i"), c("l_orderkey").cast("string")), F.count("*").cast("string"), F.array_join(F.collect_list(line), "\n")).alias("block"))
    return files.block_boxes(blocks.groupBy((c("l_orderkey") % 50).alias("f")).agg(F.array_join(F.collect_list("block"), "\n").alias("text")))


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_num FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, line_num, trim(regexp_replace(line, '[\\r\\t]', ' ', 'g'), ' ') AS raw FROM l WHERE trim(regexp_replace(line, '[\\r\\t]', ' ', 'g'), ' ') <> '' AND NOT starts_with(trim(regexp_replace(line, '[\\r\\t]', ' ', 'g'), ' '), '#')""")
def scan_yolo_raw(spark, sf_dir):
    return labels.lines_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


@query("SELECT p_partkey FROM part WHERE (p_partkey % 3 = 0 OR p_partkey % 7 = 0) AND p_partkey % 10 <> 0")
def scan_json_nodup(spark, sf_dir):
    """Keys named twice at the top and three levels down; every tenth text is no JSON."""
    k = F.col("p_partkey")
    key, inner = F.when(k % 3 == 0, "a").otherwise("c"), F.when(k % 7 == 0, "x").otherwise("y")
    text = F.format_string('{"a": 1, "b": {"a": [0, {"x": 1, "%s": 2}]}, "%s": %d%s', inner, key, k, F.when(k % 10 == 0, "").otherwise("}"))
    return files.repeated_keys(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))).select("p_partkey")


@query("""WITH n AS (SELECT n_regionkey AS path, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation), p AS (SELECT 100 + p_partkey AS path, p_partkey % 4 AS k, p_size FROM part)
SELECT path, i AS class_id, n_name AS class_name, NULL AS problem FROM n UNION ALL SELECT path, 0, 'size ' || p_size, NULL FROM p WHERE k = 0 UNION ALL SELECT path, 3, 'it''s', NULL FROM p WHERE k = 0
 UNION ALL SELECT path, NULL, NULL, 'nc is 2, names are 1' FROM p WHERE k = 1 UNION ALL SELECT path, NULL, NULL, 'nc and names are needed' FROM p WHERE k IN (2, 3)""")
def scan_data_config(spark, sf_dir):
    """A region as a data.yaml that lists its nations, and a part as one that is a mapping, or wrong."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("- "), x["n_name"])), "\n")
    regions = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("path")).agg(F.concat(F.lit("nc: "), F.count("*").cast("string"), F.lit("\nnames:\n"), listed).alias("text"))
    k = F.col("p_partkey")
    texts = [F.concat(F.lit("nc: 2\nnames: {3: \"it's\", 0: size "), F.col("p_size").cast("string"), F.lit("}\n")), F.lit("nc: 2\nnames: [a]\n"), F.lit("names: [a]\n"), F.lit("")]
    parts = table(spark, sf_dir, "part").select((k + 100).alias("path"), F.element_at(F.array(*texts), (k % 4 + 1).cast("int")).alias("text"))
    return files.taxonomies(regions.select(F.col("path").cast("long").alias("path"), "text").unionByName(parts))


@query("""SELECT c_nationkey AS path, 'CONSENT-h' || c_custkey || '-2026-001' AS consent_id, 'h' || c_custkey AS house_id, CASE WHEN c_custkey % 3 = 0 THEN '2026-01-02' ELSE '' END AS granted_on, CASE WHEN c_custkey % 3 = 0 THEN 'all' ELSE '' END AS scope,
 c_custkey % 5 = 0 AS withdrawn, NULL AS problem FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT DISTINCT 7, NULL, NULL, NULL, NULL, NULL, 'CONSENT-h0-2026-001: no house_id' FROM customer WHERE c_nationkey = 7""")
def scan_consent(spark, sf_dir):
    """A nation as a registry of its customers' consents; one has an entry without a house."""
    k = F.col("c_custkey").cast("string")
    more = F.concat(F.when(F.col("c_custkey") % 3 == 0, ", granted_on: '2026-01-02', scope: all").otherwise(""), F.when(F.col("c_custkey") % 5 == 0, ", withdrawn: true").otherwise(""))
    entry = F.concat(F.lit("  CONSENT-h"), k, F.lit("-2026-001: {house_id: h"), k, more, F.lit("}"))
    whole = F.concat(F.lit("consents:\n"), F.when(F.col("path") == 7, "  CONSENT-h0-2026-001: {scope: all}\n").otherwise(""), F.array_join(F.collect_list(entry), "\n"))
    return files.consents(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("path")).agg(whole.alias("text")))


def _archives(spark, sf_dir):
    """Zip files of twenty conversations each: names, labels and images."""
    c = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 20").alias("package"), F.concat_ws("_", F.lit("t"), "conv_id", "turn").alias("stem"), F.coalesce("text", F.lit("")).alias("text"))
    label = c.select("package", F.concat(F.lit("d/labels/"), "stem", F.lit(".txt")).alias("name"), "text")
    image = c.select("package", F.concat(F.lit("d/images/"), "stem", F.lit(".jpg")).alias("name"), F.lit("x").alias("text"))
    lists = c.select("package").distinct().select("package", F.explode(F.array(F.struct(F.lit("obj.names").alias("name"), F.lit("cat\ndog\n").alias("text")), F.struct(F.lit("classes.txt").alias("name"), F.lit("other").alias("text")))).alias("f")).select("package", "f.*")
    return files.archive_entries(sinks.packages(label.union(image).union(lists), "package", F.col("name")).select(F.col("package").alias("path"), "content"))


@query("SELECT DISTINCT (conv_id // 20)::VARCHAR AS archive, 't_' || conv_id || '_' || turn AS stem, md5(coalesce(text, '')) AS md5 FROM conversations")
def scan_yolo_export(spark, sf_dir):
    return files.export_labels(_archives(spark, sf_dir)).select("archive", "stem", F.md5("text").alias("md5"))


@query("SELECT a::VARCHAR AS archive, class_id, class_name FROM (SELECT DISTINCT conv_id // 20 AS a FROM conversations) r, (VALUES (0, 'cat'), (1, 'dog')) t(class_id, class_name)")
def export_names(spark, sf_dir):
    return files.export_names(_archives(spark, sf_dir))


@query("SELECT DISTINCT (conv_id // 20)::VARCHAR AS archive, 'd/images/t_' || conv_id || '_' || turn || '.jpg' AS image, 'd/labels/t_' || conv_id || '_' || turn || '.txt' AS label FROM conversations")
def archive_pairs(spark, sf_dir):
    return files.archive_pairs(_archives(spark, sf_dir))


@query("SELECT count(*) AS entries, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM conversations")
def scan_nested_zip(spark, sf_dir):
    """Zips of five zips of twenty conversations: what is in the inner ones."""
    c = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 20").alias("package"), F.concat_ws("_", "conv_id", "turn").alias("stem"), F.coalesce("text", F.lit("")).alias("text"))
    inner = sinks.packages(c, "package", F.concat("stem", F.lit(".txt")))
    outer = inner.select(F.expr("int(package) div 5").alias("outer"), F.concat("package", F.lit(".zip")).alias("name"), F.col("content").alias("text"))
    e = files.archive_entries(sinks.packages(outer, "outer", F.col("name")).select(F.col("package").alias("path"), "content"))
    return e.filter(F.contains("entry", F.lit("!/"))).agg(F.count("*").alias("entries"), F.sum(F.length("content")).alias("bytes"))


def _folder(spark):
    return f"{shared_table(spark.range(1))._written}-{uuid.uuid4().hex}"


def _report(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).orderBy("lang")


_REPORT = "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"


@query(_REPORT)
def sink_json(spark, sf_dir):
    """A report written as JSON, and read as a manifest."""
    path = _folder(spark)
    sinks.write_report(_report(spark, sf_dir), path, "languages")
    return files.read_manifests(spark, f"{path}/json", "lang string, n long, chars long")


@query(_REPORT)
def sink_csv(spark, sf_dir):
    path = _folder(spark)
    sinks.write_report(_report(spark, sf_dir), path, "languages")
    return spark.read.schema("lang string, n long, chars long").option("header", True).csv(f"{path}/csv")


@query("SELECT split, count(*) AS n FROM (SELECT ['train', 'val', 'test'][CAST(doc_id % 3 + 1 AS INT)] AS split FROM documents) x GROUP BY 1")
def sink_split_copy(spark, sf_dir):
    path = _folder(spark)
    sinks.write_by_split(images(spark, sf_dir).select("image", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {FRAMES} SELECT 'events' AS kind, count(*) AS n FROM frames UNION ALL SELECT 'performance', count(*) FROM frames UNION ALL SELECT 'uncertain', count(*) FROM frames WHERE ms / 1000 BETWEEN 0.25 AND 0.55")
def sink_jsonl(spark, sf_dir):
    path = _folder(spark)
    live.routed(frames(spark, sf_dir).withColumn("confs", F.array(F.col("ms") / 1000)), 0, path)
    out = None
    for kind in ("events", "performance", "uncertain"):
        n = spark.read.schema("camera long").json(f"{path}/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query(f"WITH {BOXES} SELECT image, count(*) AS lines FROM (SELECT image, ord FROM boxes WHERE side = 'A' UNION ALL SELECT image, ord FROM boxes b WHERE side = 'R' AND EXISTS (SELECT 1 FROM boxes a WHERE a.image = b.image AND a.side = 'A')) x GROUP BY 1")
def sink_overlay_copy(spark, sf_dir):
    """The overlaid labels as files of one table, read back."""
    path, b = _folder(spark), boxes(spark, sf_dir)
    cols = ["image", "class_id", "box"]
    sinks.label_texts(merging.overlay(b.filter("side = 'A'").select(*cols), b.filter("side = 'R'").select(*cols))).write.parquet(path)
    return labels.lines_of(spark.read.parquet(path)).groupBy("image").agg(F.count("*").alias("lines"))


@query(f"WITH {IMAGES} SELECT name, row_number() OVER (ORDER BY source NULLS FIRST, name) - 1 AS place FROM images")
def merge_order(spark, sf_dir):
    """Numbers with gaps rise in the order asked for; their ranks, put together from sorted ranges, are compared."""
    numbered = shared_table(merging.merge_order(images(spark, sf_dir).select("source", "name"), ["source", "name"]))
    return numbered_rows(numbered, "ord").select("name", (F.col("n") - 1).cast("long").alias("place"))
