"""Pairs of near hashes of any width: bands wide enough to be rare, probed with the values a few bits away.

A hash is a long of 64 bits, or an array of longs (lanes, the lowest first). Hashes that differ in at most d bits, cut into m bands, differ in at most
d / m bits of some band (rounded down). So with few wide bands, each hash is looked up under its bands' values and those one or two bits off;
with many narrow ones under the values alone. Wide bands cost more lookups and meet fewer strangers: of n random hashes n / 2 ** width a
lookup. `plan_bands` counts both, and takes the cheapest for the n at hand. All ways find the same pairs.

Neighbouring cells of a picture are alike, and so are the bits of its hash: a band of neighbours has few values, and whatever shares one meets. So a
band takes every so many-th bit, from all over the hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import hamming_lanes

#: Bits of a band's value, which is a long that stays positive.
WIDEST = 62
#: Number of the first band. It names this way to cut: bands of neighbouring bits, as before, were numbered from 0.
FIRST = 1000


@dataclass(frozen=True)
class Bands:
    """How hashes of a width are cut: so many bands of `width` bits, looked up with so many errors at most."""

    bits: int
    count: int
    width: int
    errors: int

    @property
    def lookups(self) -> int:
        """Of a hash."""
        return self.count * sum(comb(self.width, k) for k in range(self.errors + 1))

    def met(self, n: int) -> float:
        """Hashes that one meets among n random ones."""
        return self.lookups * n / 2**self.width


def plan_bands(bits: int, threshold: int, n: int) -> Bands:
    """The cheapest cut for hashes that differ in fewer than threshold bits, among n."""
    found = []
    for errors in range(3):
        count = (threshold - 1) // (errors + 1) + 1
        found.append(Bands(bits, count, min(WIDEST, bits // count), errors))
    return min(found, key=lambda b: b.lookups + b.met(n))


def lanes(h: Column, kind: str) -> Column:
    return F.array(h) if kind == "bigint" else h


def _value(plan: Bands, band: int) -> str:
    """A band's bits of the lanes h, packed: those at band, band + count, band + 2 * count and so on."""
    at = [band + k * plan.count for k in range(plan.width)]
    return " | ".join(f"shiftleft(shiftrightunsigned(get(h, {p // 64}), {p % 64}) & 1L, {k})" for k, p in enumerate(at)) or "get(h, 0) & 0L"


def _errors(plan: Bands) -> Column:
    """Masks of all ways to differ."""
    w = plan.width
    one = f"transform(sequence(0, {w - 1}), i -> shiftleft(1L, i))"
    two = f"flatten(transform(sequence(1, {w - 1}), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    ways = ["array(0L)"] + [one] * (plan.errors > 0 and w > 0) + [two] * (plan.errors > 1 and w > 1)
    return F.expr(f"concat({', '.join(ways)})")


def banded(hashes: DataFrame, plan: Bands, probe: bool = False) -> DataFrame:
    """(band, value, h) of hashes (h, lanes): a row per band, or per lookup of each."""
    cuts = [F.struct(F.lit(FIRST + i).alias("band"), F.expr(_value(plan, i)).alias("value")) for i in range(plan.count)]
    rows = hashes.select("h", F.explode(F.array(*cuts)).alias("b")).select(F.col("b.band").alias("band"), F.col("b.value").alias("value"), "h")
    if not probe or not plan.errors:
        return rows
    return rows.select("band", "h", F.col("value"), F.explode(_errors(plan)).alias("_e")).select("band", F.col("value").bitwiseXOR(F.col("_e")).alias("value"), "h")


def _widths(*hashes: DataFrame) -> dict[int, int]:
    """Lanes of the hashes, and how many hashes have them: a row per width."""
    both = reduce(DataFrame.union, [h.select(F.size("h").alias("n")) for h in hashes])
    return dict(both.groupBy("n").count().collect())


def _distance(a: Column, b: Column, n: int) -> Column:
    """Differing bits of two hashes of n lanes."""
    return reduce(Column.__add__, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(n)]).cast("long")


def met(probe: DataFrame, build: DataFrame, threshold: int, width: int | None = None) -> DataFrame:
    """(probe, build, distance) of rows (band, value, h) that meet in a band and are near; the bits are counted inside the join. width: lanes of all of them, if known.

    Spark takes exploded rows for as few as they were made of, and would broadcast lookups a thousand times their estimate. So both sides are sorted, unless the
    caller has counted the probes and marked them.
    """
    p, b = probe.withColumnRenamed("h", "probe"), build.withColumnRenamed("h", "build").hint("merge")
    distance = _distance(F.col("probe"), F.col("build"), width) if width else hamming_lanes(F.col("probe"), F.col("build"))
    found = p.join(b, (p["band"] == b["band"]) & (p["value"] == b["value"]) & (distance < threshold))
    return found.select("probe", "build", distance.alias("distance")).distinct()


def near_hashes(probe: DataFrame, build: DataFrame, threshold: int) -> DataFrame:
    """(probe, build, distance) of hashes that differ in fewer than threshold bits; both sides one column h, long or lanes. Hashes of unlike widths are never near."""
    kind = probe.schema["h"].dataType.simpleString()
    cut = lambda df: df.select(lanes(F.col("h"), kind).alias("h")).filter("h is not null").distinct()
    a, b, out = cut(probe), cut(build), None
    for n, count in sorted(({1: build.count()} if kind == "bigint" else _widths(a, b)).items()):
        plan = plan_bands(64 * n, threshold, count)
        own = [df if kind == "bigint" else df.filter(F.size("h") == n) for df in (a, b)]
        found = met(banded(own[0], plan, probe=True), banded(own[1], plan), threshold, n)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = a.select(F.col("h").alias("probe"), F.col("h").alias("build"), F.lit(0).cast("long").alias("distance")).limit(0)
    return out.withColumns({"probe": F.col("probe")[0], "build": F.col("build")[0]}) if kind == "bigint" else out
