"""Boxes as struct<cx, cy, w, h: double>, normalised to the image: column expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import once

EDGE = 1e-6
BOX = "struct<cx: double, cy: double, w: double, h: double>"


def box(cx, cy, w, h) -> Column:
    return F.struct(*[(F.col(x) if isinstance(x, str) else x).cast("double").alias(n) for n, x in zip(("cx", "cy", "w", "h"), (cx, cy, w, h), strict=True)])


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def corners(b: Column) -> Column:
    """struct<x1, y1, x2, y2>."""
    return F.struct(
        (b["cx"] - b["w"] / 2).alias("x1"), (b["cy"] - b["h"] / 2).alias("y1"), (b["cx"] + b["w"] / 2).alias("x2"), (b["cy"] + b["h"] / 2).alias("y2")
    )


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection, 0 for boxes apart."""
    side = lambda c, s: F.greatest(F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2), F.lit(0.0))
    return side("cx", "w") * side("cy", "h")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where nothing intersects, areas never below 0."""
    clamped = lambda x: F.greatest(x["w"], F.lit(0.0)) * F.greatest(x["h"], F.lit(0.0))
    inter = overlap(a, b)
    union = clamped(a) + clamped(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def from_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A pixel box by its top left corner, clamped to the image and normalised; null where a side is at most one pixel."""
    within = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    x1, y1, x2, y2 = within(x, width), within(y, height), within(x + w, width), within(y + h, height)
    found = box((x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)
    return F.when((x2 - x1 > 1) & (y2 - y1 > 1), found)


def from_polygon(coords: Column) -> Column:
    """Four numbers are a box; an even number of six or more a polygon, whose bounds within the image are taken; else null, as are empty bounds."""
    within = lambda keep: F.transform(F.filter(coords, keep), lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    xs, ys = within(lambda _, i: i % 2 == 0), within(lambda _, i: i % 2 == 1)
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    at = lambda k: F.try_element_at(coords, F.lit(k))
    rounded = box(*[F.round(v, 6) for v in (x0 + (x1 - x0) / 2, y0 + (y1 - y0) / 2, x1 - x0, y1 - y0)])
    polygon = (F.size(coords) >= 6) & (F.size(coords) % 2 == 0) & (x1 > x0) & (y1 > y0)
    return F.when(F.size(coords) == 4, box(at(1), at(2), at(3), at(4))).when(polygon, rounded)


def tile_to_full(b: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box normalised to a tile, normalised to the whole image."""
    return box((x0 + b["cx"] * (x1 - x0)) / width, (y0 + b["cy"] * (y1 - y0)) / height, b["w"] * (x1 - x0) / width, b["h"] * (y1 - y0) / height)


def to_top_left(b: Column) -> Column:
    """struct<x, y, w, h> by the top left corner."""
    return F.struct((b["cx"] - b["w"] / 2).alias("x"), (b["cy"] - b["h"] / 2).alias("y"), b["w"].alias("w"), b["h"].alias("h"))


def from_top_left(b: Column) -> Column:
    return box(b["x"] + b["w"] / 2, b["y"] + b["h"] / 2, b["w"], b["h"])


def problems(class_id: Column, b: Column, n_classes: int) -> Column:
    """Names of the rules that a box breaks: class_id, cx, cy, w, h (each within 0 to 1), area, bounds."""
    c = corners(b)
    broken = [F.when((class_id < 0) | (class_id >= n_classes), F.lit("class_id"))]
    broken += [F.when(~b[n].between(0.0, 1.0), F.lit(n)) for n in ("cx", "cy", "w", "h")]
    broken.append(F.when((b["w"] <= 0) | (b["h"] <= 0), F.lit("area")))
    broken.append(F.when((c["x1"] < -EDGE) | (c["y1"] < -EDGE) | (c["x2"] > 1 + EDGE) | (c["y2"] > 1 + EDGE), F.lit("bounds")))
    return F.array_compact(F.array(*broken))


def label_line(class_id: Column, b: Column) -> Column:
    """The line of a label file: class and box to six places."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id.cast("int"), b["cx"], b["cy"], b["w"], b["h"])


def parse_line(line: Column) -> Column:
    """struct<class_id, box> of a label line; null unless it is five fields, an integer and four finite numbers."""

    def read(parts: Column) -> Column:
        at = lambda k, kind: F.try_element_at(parts, F.lit(k)).try_cast(kind)
        numbers = [at(k, "double") for k in (2, 3, 4, 5)]
        finite = at(1, "int").isNotNull()
        for n in numbers:
            finite = finite & n.isNotNull() & ~F.isnan(n) & (F.abs(n) < 1e308)
        return F.when((F.size(parts) == 5) & finite, F.struct(at(1, "int").alias("class_id"), box(*numbers).alias("box")))

    return once(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), read)


def rounded(value: Column, places: int) -> Column:
    """To so many places by the double itself, halves away from zero; F.round goes by its shortest decimal digits, which a half may only seem to be."""
    scaled = F.abs(value) * float(10**places)
    down = F.floor(scaled)
    return F.signum(value) * (down + (scaled - down >= 0.5).cast("int")) / float(10**places)
