"""Perceptual hashes of pixel grids, fingerprints and digests, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance of hashes of unlike widths; a fixed value.
UNLIKE = 1 << 32


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def average_hash(grid: Column, above: float = 0.0) -> Column:
    """64 cells, row by row, as a long: a bit is set where a cell is above the mean (by so much); the first cell is the highest bit."""

    def bits(g: Column) -> Column:
        mean = F.aggregate(g, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(g)
        mean = mean + above if above else mean
        return once(mean, lambda m: F.aggregate(g, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR((x.cast("double") > m).cast("long"))))

    return once(grid, bits)


def mirrored(grid: Column, width: int = 8) -> Column:
    """The grid with each of its rows reversed."""
    return once(grid, lambda g: F.flatten(F.transform(F.sequence(F.lit(0), (F.size(g) / width).cast("int") - 1), lambda r: F.reverse(F.slice(g, r * width + 1, width)))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def lanes(hex_hash: Column) -> Column:
    """A hex hash of any width as longs of 64 bits each (signed patterns), the lowest first."""
    n = F.ceil(F.length(hex_hash) / 16).cast("int")
    padded = F.lpad(hex_hash, n * 16, "0")
    return F.reverse(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(padded, i * 16 + 1, F.lit(16)), 16, -10).cast("long")))


def hamming_lanes(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of lanes; UNLIKE where the widths differ."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), both).otherwise(F.lit(UNLIKE))


def id_list(ids: Column) -> Column:
    """[1,2,3] as text, of an array of numbers."""
    return F.concat(F.lit("["), F.array_join(F.array_sort(ids).cast("array<string>"), ","), F.lit("]"))


def policy_digest(ids: Column) -> Column:
    """Eight hex digits that name a set of class ids."""
    return F.substring(F.sha2(id_list(ids), 256), 1, 8)


def content_digest(names: Column, shas: Column) -> Column:
    """Aggregate: one digest of a set of (file name, sha256), independent of their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(names, F.lit(":"), shas))), "\n"), 256)


def taxonomy_fingerprint(class_id: Column, class_name: Column) -> Column:
    """Aggregate: sha256 of the taxonomy as JSON without spaces."""
    names = F.array_sort(F.collect_list(F.struct(class_id.alias("i"), class_name.alias("n"))))
    text = F.array_join(F.transform(names, lambda x: F.format_string('[%d,"%s"]', x["i"], x["n"])), ",")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit('{"nc":'), F.size(names).cast("string"), F.lit(',"names":['), text, F.lit("]}")), 256))


def run_id(backend: Column, commit: Column, settings: Column) -> Column:
    """backend_commit_xxxxxxxx, the last part eight hex digits of the settings' sha256."""
    return F.concat_ws("_", backend, commit, F.substring(F.sha2(settings, 256), 1, 8))
