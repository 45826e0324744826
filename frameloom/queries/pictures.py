"""Queries over pixels and image files made from the tables: hashes of any size of image, headers, sliced inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import hex64
from ..functions.headers import image_header, image_problem
from ..operators import images as I
from ..plans import annotate
from .base import query, table

#: Images of sliced inference that one task cuts.
IMAGES_A_TASK = 5_000
#: An embedding as an image of 12 to 20 by 10 to 16 pixels, grey or in colours.
_PICTURES = """img AS (SELECT vec_id, 12 + vec_id % 9 AS w, 10 + vec_id % 7 AS h, vec_id % 2 AS coloured, embedding AS e FROM embeddings),
 raw AS (SELECT vec_id, w, h, coloured, x, y, least(greatest(floor(128 + 300 * e[(y * w + x) % 64 + 1]::DOUBLE), 0), 255)::BIGINT AS p FROM (SELECT *, unnest(range(w)) AS x FROM (SELECT *, unnest(range(h)) AS y FROM img))),
 px AS (SELECT vec_id, w, h, x, y, CASE WHEN coloured = 1 THEN (p * 19595 + (p * 7 + x) % 256 * 38470 + (p + y * 3) % 256 * 7471 + 32768) // 65536 ELSE p END AS v FROM raw),
 sides AS (SELECT DISTINCT unnest([w, h]) AS n FROM img)"""
_LANCZOS = "CASE WHEN x = 0 THEN 1 WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0 END"
_BICUBIC = "CASE WHEN abs(x) < 1 THEN (1.5 * abs(x) - 2.5) * x * x + 1 WHEN abs(x) < 2 THEN ((2.5 - 0.5 * abs(x)) * abs(x) - 4) * abs(x) + 2 ELSE 0 END"


def _smaller(tag: str, side: int, reach: int, curve: str) -> str:
    """CTEs of a smaller copy: s{tag} (vec_id, r, c, v)."""
    once = "least(greatest(floor((sum(v * k) + 2097152) / 4194304.0::DOUBLE), 0), 255)::BIGINT"
    return f"""w{tag} AS (SELECT n, c, i, floor(k / sum(k) OVER (PARTITION BY n, c) * 4194304 + 0.5)::BIGINT AS k FROM (SELECT n, c, i, {curve} AS k FROM (
  SELECT n, c, i, (i - mid + 0.5) / wide AS x FROM (SELECT *, unnest(range(greatest(trunc(mid - {reach} * wide + 0.5), 0)::BIGINT, least(trunc(mid + {reach} * wide + 0.5), n)::BIGINT)) AS i
   FROM (SELECT n, c, (c + 0.5::DOUBLE) * (n / {side}.0::DOUBLE) AS mid, greatest(n / {side}.0::DOUBLE, 1) AS wide FROM sides, range({side}) t(c))))) z),
 a{tag} AS (SELECT vec_id, h, y, c, {once} AS v FROM px JOIN w{tag} ON n = w AND i = x GROUP BY 1, 2, 3, 4),
 s{tag} AS (SELECT vec_id, b.c AS r, a.c AS c, {once} AS v FROM a{tag} a JOIN w{tag} b ON n = h AND i = y GROUP BY 1, 2, 3)"""


def _bits(tag: str, side: int) -> str:
    """CTEs of the hashes of a smaller copy: g{tag} (vec_id, hash, flip), hex."""
    digits = "array_to_string(list_transform(range({n}), lambda i: substr('0123456789abcdef', CAST(1 + 8 * {b}[4 * i + 1] + 4 * {b}[4 * i + 2] + 2 * {b}[4 * i + 3] + {b}[4 * i + 4] AS INT), 1)), '')"
    return f"""b{tag} AS (SELECT *, CASE WHEN v * {side * side} > sum(v) OVER (PARTITION BY vec_id) THEN 1 ELSE 0 END AS bit FROM s{tag}),
 l{tag} AS (SELECT vec_id, list(bit ORDER BY r, c) AS b, list(bit ORDER BY r, -c) AS f FROM b{tag} GROUP BY 1),
 g{tag} AS (SELECT vec_id, {digits.format(n=side * side // 4, b='b')} AS hash, {digits.format(n=side * side // 4, b='f')} AS flip FROM l{tag})"""


def _pictures(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image"), (12 + F.col("vec_id") % 9).cast("int").alias("width"), (10 + F.col("vec_id") % 7).cast("int").alias("height"),
        F.when(F.col("vec_id") % 2 == 1, 3).otherwise(1).alias("channels"), F.transform("embedding", lambda v: F.least(F.greatest(F.floor(128 + 300 * v.cast("double")), F.lit(0)), F.lit(255))).alias("e"),
    )
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")

    def pixel(i):
        x, y = i % F.col("width"), F.floor(i / F.col("width"))
        p = F.element_at("e", (i % 64 + 1).cast("int"))
        return F.when(F.col("channels") == 1, byte(p)).otherwise(F.concat(byte(p), byte((p * 7 + x) % 256), byte((p + y * 3) % 256)))

    cells = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), pixel)
    return e.select("image", "width", "height", "channels", F.unhex(F.array_join(cells, "")).alias("pixels"))


_JOINED = f"WITH {_PICTURES}, {_smaller('8', 8, 3, _LANCZOS)}, {_bits('8', 8)}, {_smaller('16', 16, 3, _LANCZOS)}, {_bits('16', 16)}, {_smaller('b', 64, 2, _BICUBIC)}"


@query(f"""{_JOINED}, m AS (SELECT vec_id, round(avg(v), 6) AS brightness FROM sb GROUP BY 1)
SELECT vec_id AS image, brightness, a.hash AS ahash, a.flip AS flip, b.hash AS ahash16, b.flip AS flip16 FROM m JOIN g8 a USING (vec_id) JOIN g16 b USING (vec_id)""")
def picture_hashes(spark, sf_dir):
    """Average hashes of 8 and 16 cells a side, those of the mirror image, and brightness, from pixels of images of unlike sizes."""
    text = lambda c: F.array_join(F.transform(F.reverse(c), hex64), "")
    found = I.hashed(_pictures(spark, sf_dir))
    return found.select("image", F.round("brightness", 6).alias("brightness"), text("h8").alias("ahash"), text("flip8").alias("flip"), text("h16").alias("ahash16"), text("flip16").alias("flip16"))


def _headers(spark, sf_dir) -> DataFrame:
    """A part as an image file: nine kinds of it by its key, some cut short."""
    k = F.col("p_partkey")
    w, h = 16 + k * 37 % 4000, 20 + k * 53 % 3000
    big = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    little = lambda v, n: F.concat(*[F.substring(big(v, n), 2 * n - 1 - 2 * i, 2) for i in range(n)])
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    zeros = lambda n: F.repeat(F.lit("00"), n)
    segment = text("FFE1", big(k % 50 + 2, 2), zeros((k % 50).cast("int")))
    frame = text("FFC2", "0011", "08", big(h, 2), big(w, 2), "03012200021101031101")
    packed = (w - 1) + (h - 1) * 16384
    kinds = [
        text("89504E470D0A1A0A0000000D49484452", big(w, 4), big(h, 4), "0806000000"),
        text("474946383961", little(w, 2), little(h, 2), "F70000"),
        text("424D", zeros(F.lit(12)), "28000000", little(w, 4), little(F.when(k % 2 == 0, (1 << 32) - h).otherwise(h), 4), "01001800"),
        text("FFD8FFE000104A46494600010100000100010000", F.repeat(segment, (k % 40).cast("int")), "FFFF", frame),
        text("52494646", zeros(F.lit(4)), "57454250", "56503858", "0A000000", "10000000", little(w - 1, 3), little(h - 1, 3)),
        text("52494646", zeros(F.lit(4)), "57454250", "56503820", zeros(F.lit(4)), "000000", "9D012A", little(w + 16384, 2), little(h, 2)),
        text("52494646", zeros(F.lit(4)), "57454250", "5650384C", zeros(F.lit(4)), "2F", little(packed, 4)),
        text("FFD8FFE000104A46494600010100000100010000", "FFDA", frame),
        F.lit(""),
    ]
    content = F.unhex(F.element_at(F.array(*kinds), (k % 9 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 11 == 0, F.substring(content, 1, 9)).otherwise(content).alias("content"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 9 AS k, 16 + p_partkey * 37 % 4000 AS w, 20 + p_partkey * 53 % 3000 AS h, p_partkey % 9 < 7 AND (p_partkey % 11 <> 0) AS sound FROM part),
 q AS (SELECT p_partkey, k, CASE WHEN sound THEN ['png', 'gif', 'bmp', 'jpeg', 'webp', 'webp', 'webp'][k + 1] END AS kind, CASE WHEN sound THEN w END AS width, CASE WHEN sound THEN h END AS height FROM p)
SELECT p_partkey, kind, width, height, CASE WHEN k = 8 THEN 'empty' WHEN kind IS NULL THEN 'unreadable' WHEN least(width, height) < 32 THEN 'too_small' END AS problem FROM q""")
def image_headers(spark, sf_dir):
    rows = _headers(spark, sf_dir).select("p_partkey", image_header(F.col("content")).alias("h"), image_problem(F.col("content")).alias("problem"))
    return rows.select("p_partkey", "h.kind", "h.width", "h.height", "problem")


@query("""SELECT p_partkey AS image, (p_partkey % 23)::INT AS class_id, 1.0::DOUBLE AS conf, round((p_partkey * 7 % 92 + 4) / 100.0::DOUBLE, 8) AS cx, round((p_partkey * 13 % 72 + 4) / 80.0::DOUBLE, 8) AS cy, 0.08::DOUBLE AS w, 0.1::DOUBLE AS h
 FROM part WHERE p_partkey % 5 <> 0""")
def sliced_inference(spark, sf_dir):
    """A part as a dark image of 100 by 80 with a bright square, cut into tiles of 40: the backend, which looks at pixels, finds each square once; every fifth image has none."""
    k, keys = F.col("p_partkey"), table(spark, sf_dir, "part").select("p_partkey")
    #: The keys are dealt out before the pixels are made: a key is a few bytes in one file, an image thousands.
    keys = keys.repartition(keys.count() // IMAGES_A_TASK + 1, "p_partkey")
    x0, y0 = k * 7 % 92, k * 13 % 72
    before, row = y0 * 100 + x0, F.concat(F.repeat(F.lit("FF"), 8), F.repeat(F.lit("14"), 92))
    lit = F.concat(F.repeat(F.lit("14"), before.cast("int")), F.repeat(row, 7), F.repeat(F.lit("FF"), 8))
    pixels = F.unhex(F.when(k % 5 == 0, F.repeat(F.lit("14"), 8000)).otherwise(F.rpad(lit, 16000, "14")))
    images = keys.select(k.alias("image"), F.lit(100).alias("width"), F.lit(80).alias("height"), F.lit(1).alias("channels"), pixels.alias("pixels"), F.array((k % 23).cast("int")).alias("class_ids"))
    found = annotate.annotate_tiles(images, "bright", (40, 40), 0.25, threshold=0.999)
    return found.select("image", "class_id", "conf", *[F.round(f"box.{c}", 8).alias(c) for c in ("cx", "cy", "w", "h")])
