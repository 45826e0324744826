"""Near hashes of any width, keeping in order by rounds and by one task, and the index that outlives a run; against plain Python."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from frameloom.functions.hashes import average_hash, mirrored
from frameloom.operators import dedup
from frameloom.operators.near import banded, lanes, near_hashes, plan_bands
from tests.test_operators import keep_brute

SCHEMA = "ord long, h array<long>, flip array<long>, sha string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def as_lanes(x, n):
    return None if x is None else [signed(x >> 64 * i & (1 << 64) - 1) for i in range(n)]


def made(seed, bits, n=150, most=6):
    rng = random.Random(seed)
    bases = [rng.getrandbits(bits) for _ in range(8)]
    near = lambda: rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(most)))
    return [(o, None, None, rng.choice(["x", "y", None])) if rng.random() < 0.1 else (o, near(), near() if rng.random() < 0.5 else None, "s") for o in range(n)]


def wide_brute(rows, t):
    """keep_brute over whole numbers of any width."""
    kept, out = [], {}
    for o, h, flip, sha in rows:
        if h is None:
            of = next((k for k, kh, ks in kept if kh is None and ks is not None and ks == sha), None)
        else:
            known = [(k, kh) for k, kh, _ in kept if kh is not None]
            of = next((k for k, kh in known if kh == h), None)
            if of is None:
                of = next((k for k, kh in known if any(x is not None and (x ^ kh).bit_count() < t for x in (h, flip))), None)
        out[o] = (of is None, of)
        if of is None:
            kept.append((o, h, sha))
    return out


def fates(df):
    return {r["ord"]: (r["kept"], r["duplicate_of"]) for r in df.collect()}


def table(spark, rows, bits):
    return spark.createDataFrame([(o, as_lanes(h, bits // 64), as_lanes(f, bits // 64), s) for o, h, f, s in rows], SCHEMA)


@pytest.mark.parametrize("bits,threshold,seed", [(256, 5, 1), (256, 9, 2), (128, 3, 3), (64, 5, 4)])
def test_wide_hashes_are_kept_in_order(spark, bits, threshold, seed):
    rows = made(seed, bits)
    assert fates(dedup.keep_in_order(table(spark, rows, bits), threshold)) == wide_brute(rows, threshold)


@pytest.mark.parametrize("task_pairs", [0, 3, 40])
def test_rounds_and_the_last_task_agree(spark, task_pairs):
    rows = made(7, 64, 100)
    assert fates(dedup.keep_in_order(table(spark, rows, 64), 6, task_pairs=task_pairs)) == wide_brute(rows, 6)


@pytest.mark.parametrize("bits,threshold,cuts", [(256, 5, (0, 60, 110, 150)), (64, 5, (0, 5, 150)), (128, 4, (0, 75, 76, 150))])
def test_an_index_gives_what_one_run_gives(spark, tmp_path, bits, threshold, cuts):
    rows = made(11, bits)
    index, got = dedup.KeptIndex(spark, str(tmp_path / "kept"), bits, threshold), {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        got |= fates(dedup.KeptIndex(spark, str(tmp_path / "kept"), bits, threshold).extend(table(spark, rows[a:b], bits)))
    want = wide_brute(rows, threshold)
    assert got == want
    assert len(index.table.versions()) == len(cuts) - 1
    kept = index.table.read().filter("band is null")
    assert {r["ord"] for r in kept.collect()} == {o for o, (k, _) in want.items() if k}
    with pytest.raises(ValueError, match="in the index"):
        index.extend(table(spark, rows[:1], bits))
    with pytest.raises(ValueError, match="width"):
        index.extend(table(spark, [(999, 1, None, "s")], 192))
    assert index.extend(table(spark, [], bits)).collect() == []


def test_a_merge_that_was_overtaken_decides_anew(spark, tmp_path):
    index = dedup.KeptIndex(spark, str(tmp_path / "kept"), 64, 5)
    put, waiting = index.table.put, [1]

    def overtaken(rows, version):
        if waiting:
            waiting.pop()
            dedup.KeptIndex(spark, str(tmp_path / "kept"), 64, 5).extend(table(spark, [(1, 0b111, None, "s")], 64))
        return put(rows, version)

    index.table.put = overtaken
    assert fates(index.extend(table(spark, [(5, 0b110, None, "s"), (6, 0xFF << 40, None, "s")], 64))) == {5: (False, 1), 6: (True, None)}


@pytest.mark.parametrize("bits,threshold", [(64, 5), (64, 2), (64, 12), (128, 7), (256, 20), (256, 5)])
@pytest.mark.parametrize("n", [10, 10**6, 10**11])
def test_every_cut_finds_all_pairs(spark, bits, threshold, n):
    rng = random.Random(bits * threshold)
    base = [rng.getrandbits(bits) for _ in range(20)]
    others = [b ^ sum(1 << i for i in rng.sample(range(bits), k)) for b in base for k in (0, threshold - 1, threshold)]
    plan = plan_bands(bits, threshold, n)
    frame = lambda xs: spark.createDataFrame([(as_lanes(x, bits // 64),) for x in xs], "h array<long>").distinct()
    from frameloom.operators.near import met

    got = {(tuple(r[0]), tuple(r[1])) for r in met(banded(frame(base), plan, True), banded(frame(others), plan), threshold).collect()}
    want = {(tuple(as_lanes(a, bits // 64)), tuple(as_lanes(b, bits // 64))) for a in base for b in others if (a ^ b).bit_count() < threshold}
    assert got == want and len(want) >= 20


def test_random_hashes_meet_few(spark):
    """Candidates per hash stay within what the plan says, and wide bands take over as hashes get many."""
    assert plan_bands(64, 5, 30_000).errors == 0 and plan_bands(64, 5, 30_000_000).errors == 1 and plan_bands(64, 5, 10**11).errors == 2
    assert all(plan_bands(64, 5, n).met(n) < 3_000 for n in (10**3, 10**5, 10**7, 10**8)) and plan_bands(256, 5, 10**9).met(10**9) < 1
    rng = random.Random(2)
    hashes = spark.createDataFrame([([signed(rng.getrandbits(64))],) for _ in range(20_000)], "h array<long>")
    for errors, plan in enumerate([plan_bands(64, 5, 10**4), plan_bands(64, 5, 3 * 10**7)]):
        assert plan.errors == errors
        p, b = banded(hashes, plan, True), banded(hashes, plan)
        pairs = p.withColumnRenamed("h", "a").join(b, ["band", "value"]).filter("a <> h").count()
        assert pairs / 20_000 < 1.2 * plan.met(20_000) + 1


def test_unlike_widths_and_nulls(spark):
    rows = spark.createDataFrame([([5],), ([5, 0],), (None,), ([4],)], "h array<long>")
    assert sorted(tuple(r) for r in near_hashes(rows, rows, 3).filter("probe < build").collect()) == [([4], [5], 1)]
    none = spark.createDataFrame([], "h array<long>")
    assert near_hashes(none, none, 3).collect() == []
    longs = spark.createDataFrame([(5,), (4,), (None,)], "h long")
    assert sorted(tuple(r) for r in dedup.hamming_pairs(longs, 3).collect()) == [(4, 5, 1)]
    assert longs.select(lanes(F.col("h"), "bigint").alias("x")).first()["x"] == [5]


def test_longs_as_before(spark):
    rows = [(o, None if h is None else signed(h), None if f is None else signed(f), s) for o, h, f, s in made(21, 64)]
    got = dedup.keep_in_order(spark.createDataFrame(rows, "ord long, h long, flip long, sha string"), 5)
    assert fates(got) == keep_brute(rows, 5)


def test_hashes_look_at_a_grid_once(spark):
    """the mean was summed anew for each cell, and a mirrored grid made anew for each look at it: 20,000 grids took far longer than this."""
    began = time.monotonic()
    g = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.hash(i, F.col("id")), F.lit(97)).cast("float"))
    rows = spark.range(0, 20_000, 1, 4).select("id", g.alias("g")).select("g", average_hash(F.col("g")).alias("h"), average_hash(mirrored(F.col("g"))).alias("f"), average_hash(mirrored(mirrored(F.col("g")))).alias("same"))
    assert rows.filter("h = same").count() == 20_000 and rows.filter("h <> f").count() > 19_000
    assert time.monotonic() - began < 12


@pytest.mark.parametrize("lanes", [1, 4])
def test_hashes_of_coarse_pictures_meet_few(spark, lanes):
    """Cells that are alike stand side by side, so a band of neighbouring bits had few values, and a hash met a good part of all others."""
    rng = random.Random(5)

    def coarse():
        cells = [rng.getrandbits(1) for _ in range(16 * lanes)]
        return [signed(sum(cells[n * 16 + i // 16 * 4 + i % 8 // 2] << i for i in range(64))) for n in range(lanes)]

    hashes = spark.createDataFrame([(coarse(),) for _ in range(4_000)], "h array<long>").distinct()
    n, plan = hashes.count(), plan_bands(64 * lanes, 5, 4_000)
    pairs = banded(hashes, plan, True).withColumnRenamed("h", "a").join(banded(hashes, plan), ["band", "value"]).filter("a <> h").count()
    assert pairs / n < 40


def test_an_index_of_another_cut_is_refused(spark, tmp_path):
    old = dedup.KeptIndex(spark, str(tmp_path / "kept"), 64, 5)
    old.extend(table(spark, [(1, 0b111, None, "s")], 64))
    moved = old.table.read().withColumn("band", F.col("band") - 1000)
    other = dedup.KeptIndex(spark, str(tmp_path / "other"), 64, 5)
    other.table.append(lambda rows: moved)
    with pytest.raises(ValueError, match="other bands"):
        other.extend(table(spark, [(2, 0b110, None, "s")], 64))


def test_few_bits_and_high_thresholds(spark):
    """More errors than bits: every hash is near every other."""
    rows = spark.createDataFrame([(5,), (-1,), (0,)], "h long")
    assert near_hashes(rows, rows, 70).count() == 9


def test_lookups_are_not_broadcast_by_estimate(spark):
    """F16: Spark takes exploded bands for as few as the hashes they are made of, and broadcast them; an index's lookups, a thousand a hash, did not fit the driver."""
    hashes = spark.range(0, 30_000, 1, 4).select(F.xxhash64("id").alias("h"))
    found = near_hashes(hashes, hashes, 5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("probe = build").count() == 30_000


def test_images_are_joined_once(spark):
    """F16: images met their node by its hashes and then its fate by its ord, and the copies of a hash stood in one task of the second join."""
    rows = spark.createDataFrame([(o, o % 3, None, None) for o in range(30)], "ord long, h long, flip long, sha string")
    found = dedup.keep_in_order(rows, 2)
    step = found._jdf.queryExecution().optimizedPlan().children().head()
    while step.nodeName() != "Join":
        step = step.children().head()
    assert "Join" not in step.left().toString()
    assert fates(found) == keep_brute([tuple(r) for r in rows.collect()], 2)


@pytest.mark.parametrize("per_lookup", [0, 1])
def test_an_index_is_looked_up_or_read(spark, tmp_path, monkeypatch, per_lookup):
    """F16: many images against few that were kept were looked up a thousand times each; both ways find the same."""
    monkeypatch.setattr(dedup.KeptIndex, "PER_LOOKUP", per_lookup, raising=False)
    looked = []
    monkeypatch.setattr(dedup, "met", lambda *a, f=dedup.met, **b: looked.append(1) or f(*a, **b))
    rows, got = made(13, 64), {}
    for a, b in ((0, 60), (60, 150)):
        got |= fates(dedup.KeptIndex(spark, str(tmp_path / "kept"), 64, 5).extend(table(spark, rows[a:b], 64)))
    assert got == wide_brute(rows, 5)
    assert len(looked) == (0 if per_lookup else 2)
