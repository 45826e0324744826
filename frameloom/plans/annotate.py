"""Running a detector over images: tiles, registered backends, and the check that a rerun agrees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, tile_to_full
from ..operators.images import read_pixels, tile_places
from ..operators.matching import suppress

#: A backend gets batches of (image, content, class_ids), of raw pixels with (width, height, channels) too, and yields (image, ord, class_id, conf, cx, cy, w, h). It loads its model once per call, that is per task.
Backend = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
BACKENDS: dict[str, Backend] = {}
DETECTION = "image long, ord int, class_id int, conf double, cx double, cy double, w double, h double"


def backend(name: str) -> Callable[[Backend], Backend]:
    """Register a backend under a name of its own."""

    def add(f: Backend) -> Backend:
        if name in BACKENDS:
            raise ValueError(f"{name} is taken")
        BACKENDS[name] = f
        return f

    return add


@backend("bright")
def bright(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For tests: the box around the pixels above 200, as the first class asked for, as sure as its share of 8 by 8 pixels; nothing in a dark image."""
    for frame in batches:
        rows = []
        for r in frame.itertuples(index=False):
            cells = np.frombuffer(r.content, np.uint8).reshape(r.height, r.width, r.channels).max(2)
            ys, xs = np.nonzero(cells > 200)
            if len(ys):
                x0, x1, y0, y1 = xs.min(), xs.max() + 1, ys.min(), ys.max() + 1
                rows.append((r.image, 0, r.class_ids[0], min(len(ys) / 64, 1.0), (x0 + x1) / 2 / r.width, (y0 + y1) / 2 / r.height, (x1 - x0) / r.width, (y1 - y0) / r.height))
        yield pd.DataFrame(rows, columns=["image", "ord", "class_id", "conf", "cx", "cy", "w", "h"])


@backend("corners")
def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For tests: a quarter of the image for each class asked for, from the top left corner round, as sure as the class id says."""
    for frame in batches:
        rows = [(i, n, c, 1 / (1 + c % 10), 0.25 + n % 2 / 2, 0.25 + n // 2 % 2 / 2, 0.5, 0.5) for i, ids in zip(frame["image"], frame["class_ids"], strict=True) for n, c in enumerate(ids)]
        yield pd.DataFrame(rows, columns=["image", "ord", "class_id", "conf", "cx", "cy", "w", "h"])


def annotate(images: DataFrame, name: str, threshold: Column | float = 0.0) -> DataFrame:
    """Detections of a backend over images (image, content, class_ids) at a confidence or above."""
    if name not in BACKENDS:
        raise KeyError(f"{name}: one of {sorted(BACKENDS)}")
    return images.select("image", "content", "class_ids").mapInPandas(BACKENDS[name], DETECTION).filter(F.col("conf") >= threshold)


def rerun_differences(recorded: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, both cut at the same threshold: side and the row."""
    gone, new = recorded.exceptAll(fresh.select(*recorded.columns)), fresh.select(*recorded.columns).exceptAll(recorded)
    return gone.withColumn("side", F.lit("recorded")).unionByName(new.withColumn("side", F.lit("fresh")))


def _starts(length: Column, size: int, step: int) -> Column:
    """Starts of tiles along a side; the last one ends at the edge."""
    n = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.greatest(F.least(i * step, length - size), F.lit(0)).cast("int")))


def tiles(images: DataFrame, width: Column, height: Column, size: int, overlap: float = 0.0) -> DataFrame:
    """images with x0, y0, x1, y1, a row per tile."""
    step = max(1, round(size * (1 - overlap)))
    rows = images.withColumns({"x0": F.explode(_starts(width, size, step)), "_w": width, "_h": height}).withColumn("y0", F.explode(_starts(F.col("_h"), size, step)))
    return rows.withColumns({"x1": F.least(F.col("x0") + size, F.col("_w")), "y1": F.least(F.col("y0") + size, F.col("_h"))}).drop("_w", "_h")


#: Tiles that a backend gets at once.
TILE_BATCH = 16
#: Boxes of tiles that a task sends on at once.
BOX_BATCH = 2_000


def annotate_tiles(images: DataFrame, name: str, size: tuple[int, int] = (640, 640), overlap: float = 0.2, threshold: float = 0.0, same: float = 0.5, whole: bool = True) -> DataFrame:
    """Sliced inference: a backend sees each image's tiles, cut out of its pixels, and the whole image; boxes are those of the whole, and of the ones that overlap by `same` in a class the surest.

    images: image, width, height, channels, pixels, class_ids. Returns image, class_id, conf, box. An image no larger than a tile is seen once, as it is.
    Tiles are cut inside the task that runs the backend, which gets (image, content, class_ids, width, height, channels) with a number of its own
    as image; an image's pixels travel once. Images that can't be read have no boxes.
    """
    if not 0.0 <= overlap < 1.0:
        raise ValueError(f"overlap {overlap}")
    if name not in BACKENDS:
        raise KeyError(f"{name}: one of {sorted(BACKENDS)}")
    run_backend, kind = BACKENDS[name], images.schema["image"].dataType.simpleString()
    columns = ["image", "content", "class_ids", "width", "height", "channels"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict[int, tuple] = {}

        def cut() -> Iterator[pd.DataFrame]:
            rows, n = [], 0
            for frame in frames:
                for row in frame.itertuples(index=False):
                    pixels = read_pixels(row.pixels, row.width, row.height, row.channels)
                    if pixels is None:
                        continue
                    high, wide, channels = pixels.shape
                    seen = tile_places(wide, high, size, overlap)
                    if whole and len(seen) > 1:
                        seen.append((0, 0, wide, high))
                    for nth, (x0, y0, x1, y1) in enumerate(seen):
                        places[n] = (row.image, nth, x0, y0, x1, y1, wide, high)
                        rows.append((n, pixels[y0:y1, x0:x1].tobytes(), row.class_ids, x1 - x0, y1 - y0, channels))
                        n += 1
                        if len(rows) == TILE_BATCH:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

        seen_as = ["image", "nth", "x0", "y0", "x1", "y1", "_width", "_height", "ord", "class_id", "conf", "cx", "cy", "w", "h"]
        own, out = ["image", "ord", "class_id", "conf", "cx", "cy", "w", "h"], []
        for found in run_backend(cut()):
            out += [(*places[i], *rest) for i, *rest in zip(*[found[c] for c in own], strict=True)]
            if len(out) >= BOX_BATCH:
                yield pd.DataFrame(out, columns=seen_as)
                out = []
        yield pd.DataFrame(out, columns=seen_as)

    schema = f"image {kind}, nth int, x0 int, y0 int, x1 int, y1 int, _width int, _height int, " + DETECTION.partition(", ")[2]
    found = images.select("image", "width", "height", "channels", "pixels", "class_ids").mapInPandas(run, schema).filter(F.col("conf") >= threshold)
    own = tile_to_full(box("cx", "cy", "w", "h"), *[F.col(c) for c in ("x0", "y0", "x1", "y1", "_width", "_height")])
    full = found.select("image", "class_id", "conf", F.struct("nth", "ord").alias("ord"), own.alias("box"))
    return suppress(full, ["image", "class_id"], same).select("image", "class_id", "conf", "box")


def refined(found: Column, mask: Column, width: int) -> Column:
    """The box of a mask (an array of width cells a row, above 0 where the object is), else the box as found: a refinement never drops a detection."""
    cells = F.transform(mask, lambda v, i: F.when(v > 0, i))
    on = F.filter(cells, lambda i: i.isNotNull())
    xs, ys = F.transform(on, lambda i: i % width), F.transform(on, lambda i: F.floor(i / width))
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs) + 1, F.array_min(ys), F.array_max(ys) + 1
    high = F.size(mask) / width
    return F.when(F.size(on) > 0, box((x0 + x1) / 2 / width, (y0 + y1) / 2 / high, (x1 - x0) / width, (y1 - y0) / high)).otherwise(found)


def prompt_fingerprint(prompts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """fingerprint, per run (by) if there are several: sha256 over a run's prompts (class_name, prompt, threshold) as sorted lines; a run's configuration is small."""
    line = F.format_string("%s\t%s\t%.6f", "class_name", "prompt", F.col("threshold").cast("double"))
    return prompts.groupBy(*by or []).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))
