"""Pixels, headers and tiles, against plain Python and files put together by hand."""

from __future__ import annotations

import math
import random
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.functions.headers import image_header, image_problem
from frameloom.operators import images as I
from frameloom.plans import annotate
from frameloom.queries import QUERIES
from frameloom.sources import files

PICTURE = "image long, width int, height int, channels int, pixels binary"


def slow_smaller(rows, side, reach, curve):
    """The same by the definition, number by number."""

    def line(values):
        scale = len(values) / side
        wide, out = max(scale, 1.0), []
        for c in range(side):
            middle = (c + 0.5) * scale
            at = range(max(int(middle - reach * wide + 0.5), 0), min(int(middle + reach * wide + 0.5), len(values)))
            part = [curve((i - middle + 0.5) / wide) for i in at]
            whole = [math.floor(p / sum(part) * (1 << 22) + 0.5) for p in part]
            out.append(min(max(sum(values[i] * k for i, k in zip(at, whole, strict=True)) + (1 << 21) >> 22, 0), 255))
        return out

    across = [line(r) for r in rows]
    return [list(x) for x in zip(*[line([r[c] for r in across]) for c in range(side)], strict=True)]


def lanczos(x):
    s = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    return s(x) * s(x / 3) if abs(x) < 3 else 0.0


@pytest.mark.parametrize("width,height,side", [(8, 8, 8), (9, 31, 8), (64, 48, 16), (5, 3, 8), (200, 17, 16), (1, 1, 8)])
def test_smaller_copies(width, height, side):
    rng = random.Random(width * height)
    rows = [[rng.randrange(256) for _ in range(width)] for _ in range(height)]
    got = I.smaller(np.array(rows, np.uint8), side, "lanczos")
    assert got.tolist() == slow_smaller(rows, side, 3, lanczos)


def test_weights_add_up_and_flat_images_stay_flat():
    for name in I.FILTERS:
        for length in (1, 7, 64, 333):
            assert np.abs(I.weights(length, 16, name).sum(0) - (1 << 22)).max() < length
            assert set(I.smaller(np.full((length, 40), 77, np.uint8), 16, name).ravel().tolist()) == {77}


def test_hashes_of_pictures(spark):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (30, 40, 1), np.uint8)
    rows = [(1, 40, 30, 1, grey.tobytes()), (2, 40, 30, 1, grey[:, ::-1].tobytes()), (3, 40, 30, 3, np.repeat(grey, 3, 2).tobytes()), (4, 40, 30, 1, bytes(1200)), (5, 40, 30, 1, b"short"), (6, None, 30, 1, b""), (7, 3, 1, 3, None)]
    got = {r["image"]: r for r in I.hashed(spark.createDataFrame([(i, w, h, c, None if p is None else bytearray(p)) for i, w, h, c, p in rows], PICTURE)).collect()}
    assert len(got) == 7 and (got[1]["h8"], got[1]["h16"]) == (got[2]["flip8"], got[2]["flip16"]) and len(got[1]["h16"]) == 4
    assert got[3]["h16"] == got[1]["h16"] and got[3]["brightness"] == got[1]["brightness"]
    assert got[4]["h8"] == [0] and got[4]["brightness"] == 0 and abs(got[1]["brightness"] - grey.mean()) < 2
    assert all(got[i]["h8"] is None and got[i]["brightness"] is None for i in (5, 6, 7))
    bits = "".join("1" if v * 64 > I.smaller(grey[:, :, 0], 8, "lanczos").sum(dtype=int) else "0" for v in I.smaller(grey[:, :, 0], 8, "lanczos").ravel().tolist())
    assert got[1]["h8"][0] % (1 << 64) == int(bits, 2)


def png(w, h):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def jpeg(w, h, segments=(), frame=0xC0, fill=b""):
    head = b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in segments)
    return head + fill + b"\xff" + bytes([frame]) + struct.pack(">HBHH", 17, 8, h, w) + bytes(10) + b"\xff\xda\0\2"


@pytest.mark.parametrize(
    "content,want",
    [
        (png(70, 41), ("png", 70, 41)),
        (png(70, 41)[:20], None),
        (jpeg(640, 480), ("jpeg", 640, 480)),
        (jpeg(33, 65535, [(0xE0, b"JFIF\0" + bytes(9)), (0xE1, bytes(65533)), (0xC4, bytes(30)), (0xDB, b"\xff\xc0" * 20)], 0xC2, b"\xff\xff"), ("jpeg", 33, 65535)),
        (jpeg(640, 480, [(0xE1, b"")] * 300), ("jpeg", 640, 480)),
        (jpeg(640, 480)[:6], None),
        (b"\xff\xd8\xff\xda" + jpeg(640, 480)[2:], None),
        (b"\xff\xd8\x00\x00", None),
        (b"GIF89a" + struct.pack("<HH", 300, 2) + b"\0\0\0", ("gif", 300, 2)),
        (b"BM" + bytes(12) + struct.pack("<Iii", 40, 50, -60), ("bmp", 50, 60)),
        (b"BM" + bytes(12) + struct.pack("<IHH", 12, 50, 60), ("bmp", 50, 60)),
        (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (16_777_215).to_bytes(3, "little"), ("webp", 100, 16_777_216)),
        (b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 320, 240), ("webp", 320, 240)),
        (b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 319 | 239 << 14), ("webp", 320, 240)),
        (b"RIFF\0\0\0\0WAVEfmt " + bytes(20), None),
        (png(0, 41), None),
        (b"no image at all", None),
        (b"", None),
        (None, None),
    ],
)
def test_headers(spark, content, want):
    row = spark.createDataFrame([(None if content is None else bytearray(content),)], "c binary").select(image_header(F.col("c")).alias("h"), image_problem(F.col("c")).alias("p")).first()
    assert (tuple(row["h"]) if row["h"] and row["h"]["kind"] else None) == want
    assert row["p"] == ("empty" if not content else "unreadable" if want is None else "too_small" if min(want[1:]) < 32 else None)


def test_sizes_of_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(70, 41))
    (tmp_path / "b.jpg").write_bytes(b"broken")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["width"], r["height"]) for r in files.image_sizes(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.png": ("png", 70, 41), "b.jpg": (None, None, None)}


SEEN: list = []


@annotate.backend("centre")
def centre(batches):
    """A box in the middle of whatever it sees."""
    for frame in batches:
        yield pd.DataFrame([(i, 0, c[0], 0.9, 0.5, 0.5, 0.2, 0.2) for i, c in zip(frame["image"], frame["class_ids"], strict=True)], columns=["image", "ord", "class_id", "conf", "cx", "cy", "w", "h"])


@annotate.backend("sums")
def sums(batches):
    """The mean of the pixels as confidence: tells which bytes a tile got."""
    for frame in batches:
        rows = [(r.image, 0, r.width, len(r.content) and np.frombuffer(r.content, np.uint8).mean() / 255, 0.5, 0.5, 1.0, 1.0) for r in frame.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["image", "ord", "class_id", "conf", "cx", "cy", "w", "h"])


def picture(spark, *rows):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], a.shape[2], bytearray(a.tobytes()), [10]) for i, a in rows], PICTURE + ", class_ids array<int>")


def test_places_of_tiles():
    assert I.tile_places(1000, 800, (640, 640), 0.2) == [(0, 0, 640, 640), (360, 0, 1000, 640), (0, 160, 640, 800), (360, 160, 1000, 800)]
    assert I.tile_places(400, 300, (640, 640), 0.2) == [(0, 0, 400, 300)] and I.tile_places(640, 641, (640, 640), 0.0) == [(0, 0, 640, 640), (0, 1, 640, 641)]
    assert I.starts(100, 40, 0.25) == [0, 30, 60] and I.starts(10, 4, 0.99) == list(range(7))
    for w in range(1, 60, 7):
        assert {x for a, _, b, _ in I.tile_places(w, 9, (10, 4), 0.3) for x in range(a, b)} == set(range(w))


def test_tiles_and_the_whole_frame(spark):
    images = picture(spark, (1, np.full((800, 1000, 3), 120, np.uint8)), (2, np.full((300, 400, 1), 120, np.uint8)))
    centres = lambda df, i: sorted((round(r["box"]["cx"], 2), round(r["box"]["cy"], 2)) for r in df.collect() if r["image"] == i)
    with_frame = annotate.annotate_tiles(images, "centre")
    assert centres(with_frame, 1) == [(0.32, 0.4), (0.32, 0.6), (0.5, 0.5), (0.68, 0.4), (0.68, 0.6)] and centres(with_frame, 2) == [(0.5, 0.5)]
    alone = annotate.annotate_tiles(images, "centre", whole=False)
    assert len(centres(alone, 1)) == 4 and centres(alone, 2) == [(0.5, 0.5)]
    assert annotate.annotate_tiles(images, "centre", threshold=0.95).count() == 0
    with pytest.raises(KeyError):
        annotate.annotate_tiles(images, "none")
    with pytest.raises(ValueError):
        annotate.annotate_tiles(images, "centre", overlap=1.0)


def test_a_tile_holds_its_own_pixels(spark):
    """Quarters of 10, 60, 110 and 160: each tile's mean is that of its quarter, the whole frame's that of all."""
    a = np.zeros((20, 20, 1), np.uint8)
    for i, v in enumerate((10, 60, 110, 160)):
        a[i // 2 * 10 : i // 2 * 10 + 10, i % 2 * 10 : i % 2 * 10 + 10] = v
    got = annotate.annotate_tiles(picture(spark, (1, a)), "sums", (10, 10), 0.0, same=2.0).collect()
    assert sorted((r["class_id"], round(r["conf"] * 255)) for r in got) == [(10, 10), (10, 60), (10, 110), (10, 160), (20, 85)]


def test_each_planted_object_is_found_once(spark):
    rng, rows, want = random.Random(6), [], {}
    for i in range(40):
        a = np.full((80, 100, 1), 20, np.uint8)
        x, y = rng.randrange(92), rng.randrange(72)
        if i % 4:
            a[y : y + 8, x : x + 8] = 255
            want[i] = ((x + 4) / 100, (y + 4) / 80)
        rows.append((i, a))
    bad = spark.createDataFrame([(99, 5, 5, 1, bytearray(b"x"), [1])], PICTURE + ", class_ids array<int>")
    got = annotate.annotate_tiles(picture(spark, *rows).union(bad), "bright", (40, 40), 0.25, threshold=0.999).collect()
    assert len(got) == len(want)
    assert {r["image"]: (round(r["box"]["cx"], 6), round(r["box"]["cy"], 6)) for r in got} == {i: (round(x, 6), round(y, 6)) for i, (x, y) in want.items()}


def test_headers_are_walked_once(spark):
    """a file's header was walked anew for each look at its size: 4,000 files of sixty segments took far longer than this."""
    began = time.monotonic()
    content = bytearray(jpeg(640, 480, [(0xE1, bytes(40))] * 60))
    rows = spark.range(0, 4_000, 1, 1).select(F.lit(content).alias("c")).select(image_header(F.col("c")).alias("h"), image_problem(F.col("c")).alias("p"))
    assert rows.filter("h.width = 640 and h.height = 480 and p is null").count() == 4_000
    assert time.monotonic() - began < 15


def test_images_of_one_file_are_dealt_out(spark):
    """all pixels were made and cut by the one task that read the keys' file."""
    plan = QUERIES["sliced_inference"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [p_partkey" in plan.partition("MapInPandas")[2] and ", 5" in plan
