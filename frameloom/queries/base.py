"""The driver tables seen as images, boxes, sources and frames, in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.hashes import once
from ..operators.dedup import shared_table
from ..streaming.rules import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
N_CLASSES = 23

#: The taxonomy, in order of class id.
CLASSES = (
    "person", "face", "medicine_strip", "medicine_bottle", "water_bottle", "knife", "stove", "gas_cylinder", "passport", "book", "charger", "wire",
    "laptop", "monitor", "cupboard", "door", "chair", "bed", "toilet", "sink", "wet_floor", "walking_stick", "support_handle",
)
#: Classes that a verifier is asked about first.
PRIORITY = ("charger", "wire", "wet_floor")


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASSES)), "class_id int, class_name string")


TAXONOMY = "taxonomy AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(CLASSES)) + ") t(class_id, class_name))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a box: image, ord, class_id, box, side (an annotator or a backend), conf, split, source."""
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), nth.cast("long").alias("ord"), (F.col("l_partkey") % N_CLASSES).cast("int").alias("class_id"),
        B.box(F.col("l_quantity") / 51, F.col("l_discount") * 5, F.col("l_tax") + 0.02, (F.col("l_linenumber") + 1) / F.lit(20.0)).alias("box"),
        F.col("l_returnflag").alias("side"), (F.floor(F.col("l_extendedprice") / 20) / 10000).alias("conf"),
        F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("split"),
        F.concat(F.lit("s"), (F.col("l_orderkey") % 7).cast("string")).alias("source"),
    )


def written_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes as a table of the shared folder, for a query that reads them several times: the scan and its window run once."""
    return shared_table(boxes(spark, sf_dir))


BOXES = """boxes AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, CAST(l_partkey % 23 AS INT) AS class_id,
 l_quantity / 51 AS cx, l_discount * 5 AS cy, l_tax + 0.02::DOUBLE AS w, (l_linenumber + 1) / 20.0::DOUBLE AS h, l_returnflag AS side, floor(l_extendedprice / 20) / 10000 AS conf,
 ['train', 'val', 'test'][CAST(l_orderkey % 3 + 1 AS INT)] AS split, 's' || (l_orderkey % 7) AS source FROM lineitem)"""


def sql_iou(a: str, b: str) -> str:
    side = lambda c, s: f"greatest(least({a}.{c} + {a}.{s} / 2, {b}.{c} + {b}.{s} / 2) - greatest({a}.{c} - {a}.{s} / 2, {b}.{c} - {b}.{s} / 2), 0)"
    inter = f"({side('cx', 'w')} * {side('cy', 'h')})"
    return f"(CASE WHEN {inter} > 0 THEN {inter} / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}) ELSE 0 END)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as an image file: image, source, sha, split, name (several styles of file name)."""
    d = table(spark, sf_dir, "documents")
    n = F.lpad(F.col("doc_id").cast("string"), 5, "0")
    part = F.lpad((F.col("doc_id") % 12).cast("string"), 2, "0")
    styles = [
        F.concat(F.lit("video"), part, F.lit("_frame_"), n), F.concat(F.lit("h"), part, F.lit("_pooja_room_s001_"), n), F.concat(F.lit("IMG_20240601_1430"), part, F.lit("_"), n),
        F.concat(F.lit("custom_kitchen_"), n), F.concat(F.lit("seq"), part, F.lit("b_"), F.col("doc_id").cast("string")), F.concat(F.lit("plain-"), n),
    ]
    name = F.element_at(F.array(*styles), (F.col("doc_id") % 6 + 1).cast("int"))
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("image"), "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), split.alias("split"), name.alias("name"), "n_chars")


IMAGES = """images AS (SELECT doc_id AS image, source, lang, sha256(coalesce(text, '')) AS sha, ['train', 'val', 'test'][CAST(doc_id % 3 + 1 AS INT)] AS split, n_chars,
 ['video' || lpad((doc_id % 12)::VARCHAR, 2, '0') || '_frame_' || lpad(doc_id::VARCHAR, 5, '0'), 'h' || lpad((doc_id % 12)::VARCHAR, 2, '0') || '_pooja_room_s001_' || lpad(doc_id::VARCHAR, 5, '0'),
  'IMG_20240601_1430' || lpad((doc_id % 12)::VARCHAR, 2, '0') || '_' || lpad(doc_id::VARCHAR, 5, '0'), 'custom_kitchen_' || lpad(doc_id::VARCHAR, 5, '0'),
  'seq' || lpad((doc_id % 12)::VARCHAR, 2, '0') || 'b_' || doc_id, 'plain-' || lpad(doc_id::VARCHAR, 5, '0')][CAST(doc_id % 6 + 1 AS INT)] AS name FROM documents)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a camera's frame: camera, frame_no, ts (of its first event), classes, ms."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    f = e.groupBy(F.col("user_id").alias("camera"), "day").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_set("event_type")).alias("classes"), F.round(F.sum("value"), 2).alias("ms"))
    return f.withColumn("frame_no", F.row_number().over(W.partitionBy("camera").orderBy("day")).cast("long")).drop("day")


FRAMES = """frames AS (SELECT camera, row_number() OVER (PARTITION BY camera ORDER BY day) AS frame_no, ts, classes, ms FROM (
 SELECT user_id AS camera, date_trunc('day', ts) AS day, min(ts) AS ts, list_sort(list(DISTINCT event_type)) AS classes, round(sum(value), 2) AS ms FROM events GROUP BY 1, 2))"""

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
DAY = 86400.0
RULES = (
    Rule("error_at_purchase", "detected(error) AND detected(purchase)", "HIGH", 3 * DAY),
    Rule("views_only", "detected(view) AND absent_for(purchase, 3)", "CRITICAL", 2 * DAY),
    Rule("arrival", "any_of([signup, click])", "INFO", 5 * DAY),
    Rule("odd", "NOT detected(click) AND detected(error) OR detected(signup)", "LOW", DAY),
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a detection: camera, frame_no, ord, class_name, conf."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    no = F.dense_rank().over(W.partitionBy("user_id").orderBy("day"))
    return e.select(F.col("user_id").alias("camera"), no.cast("long").alias("frame_no"), F.col("event_id").alias("ord"), F.col("event_type").alias("class_name"), F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"))


DETECTIONS = """detections AS (SELECT user_id AS camera, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS frame_no, event_id AS ord, event_type AS class_name,
 least(value / 100, 1.0::DOUBLE) AS conf FROM events)"""


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of 64 numbers as an 8 by 8 grid of pixels: vec_id, grid, label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("grid"), "label")


def coarse(grid):
    """The grid with each two by two pixels as the first of them, so that images are near now and then."""
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(i / 16) * 16 + F.floor(i % 8 / 2) * 2)
    return once(grid, lambda g: F.transform(at, lambda i: F.element_at(g, (i + 1).cast("int"))))


_BITS = "list_transform({v}, lambda x: CASE WHEN x::DOUBLE > list_sum(list_transform({v}, lambda y: y::DOUBLE)) / 64 THEN 1 ELSE 0 END)"


def _grids(source: str) -> str:
    return (
        f"grids AS (SELECT vec_id, label, e AS grid, list_transform(range(64), lambda i: e[i - i % 8 + 8 - i % 8]) AS mirror FROM (SELECT vec_id, label, {source} AS e FROM embeddings) x), "
        f"hashes AS (SELECT vec_id, label, {_BITS.format(v='grid')} AS bits, {_BITS.format(v='mirror')} AS flip_bits FROM grids)"
    )


GRIDS, COARSE = _grids("embedding"), _grids("list_transform(range(64), lambda i: embedding[1 + i // 16 * 16 + i % 8 // 2 * 2])")


def sql_hex(bits: str) -> str:
    digit = f"substr('0123456789abcdef', CAST(1 + 8 * {bits}[4 * i + 1] + 4 * {bits}[4 * i + 2] + 2 * {bits}[4 * i + 3] + {bits}[4 * i + 4] AS INT), 1)"
    return f"array_to_string(list_transform(range(16), lambda i: {digit}), '')"


def sql_distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {a}[i] <> {b}[i] THEN 1 ELSE 0 END))"
