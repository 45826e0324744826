"""Kind and size of an image from the bytes of its header, as column expressions: nothing is decoded."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: How files begin, and the least side of an image that is taken for one.
PNG, GIF, BMP, JPEG, RIFF = bytes.fromhex("89504E470D0A1A0A"), (b"GIF87a", b"GIF89a"), b"BM", b"\xff\xd8", b"RIFF"
LEAST_SIDE = 32
#: Segments of a JPEG file before the one with its size; a header with more is taken for broken.
MOST_SEGMENTS = 4096
_HEADER = StructType([StructField("kind", StringType()), StructField("width", LongType()), StructField("height", LongType())])


def _big(content: bytes, at: int, n: int) -> int | None:
    """A number of n bytes, the highest first; None where they are not all there."""
    return int.from_bytes(content[at : at + n]) if at + n <= len(content) else None


def _little(content: bytes, at: int, n: int) -> int | None:
    return int.from_bytes(content[at : at + n], "little") if at + n <= len(content) else None


def _signed(content: bytes, at: int) -> int | None:
    return abs(int.from_bytes(content[at : at + 4], "little", signed=True)) if at + 4 <= len(content) else None


def _jpeg(content: bytes) -> tuple[int | None, int | None]:
    """Segments are walked by their lengths to the first that holds a frame's size. Fill bytes before a marker are passed over one by one."""
    at = 2
    for _ in range(min(max(len(content) // 4, 1), MOST_SEGMENTS)):
        mark = content[at : at + 2]
        code = mark[1] if len(mark) == 2 and mark[0] == 255 else None
        if code is not None and 192 <= code <= 207 and code not in (196, 200, 204):
            return _big(content, at + 7, 2), _big(content, at + 5, 2)
        if code in (217, 218):
            break
        if code == 255:
            at += 1
        elif code is not None and (208 <= code <= 215 or code == 1):
            at += 2
        else:
            length = _big(content, at + 2, 2)
            if length is None:
                break
            at += 2 + length
    return None, None


def _webp(content: bytes) -> tuple[int | None, int | None]:
    """Three kinds of first chunk: a canvas, a lossy frame, a lossless one."""
    chunk = content[12:16]
    if chunk == b"VP8X":
        width, height = _little(content, 24, 3), _little(content, 27, 3)
        return None if width is None else width + 1, None if height is None else height + 1
    if chunk == b"VP8 " and content[23:26] == b"\x9d\x01\x2a":
        width, height = _little(content, 26, 2), _little(content, 28, 2)
        return None if width is None else width & 16383, None if height is None else height & 16383
    packed = _little(content, 21, 4)
    if chunk == b"VP8L" and content[20:21] == b"\x2f" and packed is not None:
        return (packed & 16383) + 1, (packed >> 14 & 16383) + 1
    return None, None


def _read(content: bytes | None) -> tuple[str | None, int | None, int | None]:
    if not content:
        return None, None, None
    kind, width, height = None, None, None
    if content[:8] == PNG and content[12:16] == b"IHDR":
        kind, width, height = "png", _big(content, 16, 4), _big(content, 20, 4)
    elif content[:6] in GIF:
        kind, width, height = "gif", _little(content, 6, 2), _little(content, 8, 2)
    elif content[:2] == BMP:
        old = _little(content, 14, 4) == 12
        kind, width, height = ("bmp", _little(content, 18, 2), _little(content, 20, 2)) if old else ("bmp", _signed(content, 18), _signed(content, 22))
    elif content[:2] == JPEG:
        kind, (width, height) = "jpeg", _jpeg(content)
    elif content[:4] == RIFF and content[8:12] == b"WEBP":
        kind, (width, height) = "webp", _webp(content)
    return (kind, width, height) if width and height else (None, None, None)


@F.pandas_udf(_HEADER)
def _headers(content: pd.Series) -> pd.DataFrame:
    rows = [_read(c) for c in content]
    return pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype="Int64" if i else "object") for i, f in enumerate(_HEADER.fields)})


def image_header(content: Column) -> Column:
    """struct<kind, width, height> of a file's bytes; null fields for what is no image of these kinds, is cut short or has a side of 0.

    Read in Python, once a file: a walk over segments as an expression is evaluated anew wherever its result is looked at.
    """
    return _headers(content)


def image_problem(content: Column, least: int = LEAST_SIDE) -> Column:
    """What is wrong with a file: empty, unreadable (no header that is understood), too_small; null for nothing."""
    h = image_header(content)
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty").when(h["kind"].isNull(), "unreadable").when(F.least(h["width"], h["height"]) < least, "too_small")
