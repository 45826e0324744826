"""Arithmetic on grids of grey pixels (an array of width cells a row), and what a source of frames is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below these an image is blurred, or dark; and endings of video files.
BLURRED, DARK = 100.0, 40.0
VIDEO_ENDINGS = ("mp4", "avi", "mov", "mkv", "webm")


def brightness(grid: Column) -> Column:
    """Mean of the cells; null for none."""
    return F.when(F.size(grid) > 0, F.aggregate(grid, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(grid))


def laplacian(grid: Column, width: int) -> Column:
    """The four neighbours of each cell less four times itself; beyond an edge stands the cell next to the edge's, mirrored."""
    high = F.floor(F.size(grid) / width)

    def cell(row: Column, column: Column) -> Column:
        mirrored = lambda k, n: F.when(k < 0, -k).when(k >= n, 2 * (n - 1) - k).otherwise(k)
        return F.element_at(grid, (mirrored(row, high) * width + mirrored(column, F.lit(width)) + 1).cast("int")).cast("double")

    def around(x: Column, i: Column) -> Column:
        row, column = F.floor(i / width), i % width
        return cell(row - 1, column) + cell(row + 1, column) + cell(row, column - 1) + cell(row, column + 1) - 4 * x.cast("double")

    return F.transform(grid, around)


def sharpness(grid: Column, width: int) -> Column:
    """Variance of the laplacian: low where an image is blurred."""
    edges = laplacian(grid, width)
    n = F.size(edges)
    total, squares = (F.aggregate(edges, F.lit(0.0), lambda s, x: s + x), F.aggregate(edges, F.lit(0.0), lambda s, x: s + x * x))
    return squares / n - (total / n) * (total / n)


def quality_flags(grid: Column, width: int, blurred: float = BLURRED, dark: float = DARK) -> Column:
    """Names of what is wrong with an image: blurry, low_light; null for a grid that could not be read."""
    return F.when(grid.isNotNull(), F.array_compact(F.array(F.when(sharpness(grid, width) < blurred, "blurry"), F.when(brightness(grid) < dark, "low_light"))))


def source_kind(source: Column) -> Column:
    """webcam for a number, video for a file of a video ending, unsupported for another file with an ending, else images (a folder)."""
    ending = F.lower(F.regexp_extract(source, r"[^/.]\.([^./]+)$", 1))
    return F.when(F.trim(source).rlike(r"^[+-]?[0-9]+$"), "webcam").when(ending.isin(*VIDEO_ENDINGS), "video").when(ending != "", "unsupported").otherwise("images")
