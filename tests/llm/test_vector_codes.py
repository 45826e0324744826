"""Vector codes: against plain integer arithmetic, on random vectors, ties and awkward rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from frameloom.llm import vector_codes
from frameloom.llm.vector_codes import Search, encode_vectors, kd_tree

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plainly(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract in Python integers: rows of (vec_id, vector, label)."""
    ok = [(i, v, x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v) and len(v) % parts == 0]
    ok.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not ok:
        return []
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    w = len(ok[0][1]) // parts
    cut = [[[math.floor(scale * float(np.float32(c))) for c in v[p * w : (p + 1) * w]] for p in range(parts)] for _, v, _ in ok]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [nearest(p, c[p])[1] for c in cut]
            own = [[c[p] for c, a in zip(cut, at, strict=True) if a == e] for e in range(len(books[p]))]
            new.append([[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(own, books[p], strict=True)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, label), c in zip(ok, cut, strict=True):
        got = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    return sorted(((i, code, error, sums[label], sha) for i, code, error, label in out), key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in encode_vectors(df, **more).collect()), key=str)


def test_random_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(700)]
    assert found(spark, rows, entries=40) == plainly(rows, entries=40)


def test_ties_copies_and_unused_entries(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.001, -0.001]) for _ in range(4)], None if i % 2 else 1) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5], 7) for i in range(60)]
    assert found(spark, rows, entries=100) == plainly(rows, entries=100)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0, 3.0, 4.0], None), (3, [1.0, 2.0, 3.0, 4.0], 1), (1, [0.5, -2.25, 3.0, 4.0], 1), (None, [9.0, 9.0, 9.0, 9.0], 1), (4, None, 1), (5, [1.0, None, 1.0, 1.0], 1)]
    rows += [(6, [1.0, nan, 1.0, 1.0], 1), (7, [inf, 1.0, 1.0, 1.0], 2), (8, [1.0] * 8, 1), (9, [1.0] * 3, 1), (0, [], 1), (10, [-1.0, -0.0001, 0.0, 100.0], 2)]
    assert found(spark, rows) == plainly(rows)
    assert found(spark, rows, entries=2) == plainly(rows, entries=2)
    assert found(spark, rows[4:8]) == [] and found(spark, []) == []


def test_far_components_are_held(spark):
    rows = [(i, [3e38 * (-1) ** i, 1.0, 2.0, -3e38], 0) for i in range(4)]
    got = found(spark, rows, entries=1, rounds=0)
    most = vector_codes.bound(4)
    assert [r[2] for r in got] == [0, (2 * most) ** 2, 0, (2 * most) ** 2] and (2 * most) ** 2 * 4 < 1 << 63


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_search_keeps_lower_index_and_prunes(spread):
    rng = np.random.default_rng(spread)
    book, points = rng.integers(-spread, spread + 1, (256, 3)), rng.integers(-spread, spread + 1, (500, 3))
    search = Search(book, kd_tree(book))
    index, best = search.nearest(points)
    far = ((points[:, None] - book) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()
    if spread == 1000:
        assert search.taken < far.size / 2
