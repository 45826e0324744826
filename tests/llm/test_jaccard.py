"""The pipeline's near copies against brute-force shares of five-word shingles."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from frameloom.llm import exact_dedup, jaccard, simhash


def brute(rows):
    """doc_ids that stay, and the number of pairs of unlike texts at a share of 0.8 or more; fingerprints within 4 bits are linked too."""
    sets, holders = {}, defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    meet = {(a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :]}
    pairs = [(a, b) for a, b in meet if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    fps = sorted((i, simhash.fingerprint((t or "").encode(), 5)) for i, t in rows if sets[i])
    for n, (a, x) in enumerate(fps):
        for b, y in fps[n + 1 :]:
            if (x ^ y).bit_count() <= 4:
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {i for i in sets if find(i) == i}, len(pairs)


@pytest.mark.parametrize("seed", [8, 9])
def test_every_pair_at_four_fifths_is_linked(spark, seed):
    """Up to one word in fifteen of base texts, and one more, is another: shares on both sides of 0.8; chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, line = [], " ".join(word() for _ in range(12))
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 6, 40, 100, 200]))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, len(base) // 15 + 2)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text) + f" {line}" * rng.randrange(2)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", "One two", "one  TWO"])]
    keep, pairs = brute(rows)
    assert pairs > 100
    got = {r["doc_id"] for r in jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == keep


def test_every_near_copy_of_the_documents_goes(spark):
    docs = exact_dedup.drop_exact_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    keep, _ = brute(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    got = {r["doc_id"] for r in jaccard.drop_near_copies(docs).collect()}
    assert got == keep


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(str(k) for k in range(100))
    rows = [(None, text), (7, text + " x"), (7, text + " x"), (9, text + " y"), (8, "other words here")]
    got = jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(7, text + " x"), (8, "other words here")]
    assert jaccard.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_repeat_an_id_have_each_their_own_fate(spark):
    base = " ".join(str(k) for k in range(100))
    rows = [(1, base), (5, base + " more"), (5, "nothing like it at all in any way"), (5, ""), (5, None), (None, base + " end"), (None, "a null id of its own kind and words"), (None, "")]
    got = jaccard.drop_near_copies(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, node int, least int, row int"))
    assert got.columns == ["doc_id", "text", "node", "least", "row"]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, (rows[0], *rows[2:5], *rows[6:])))


def test_keys_and_sketches_meet_at_four_fifths():
    """Sets at 0.8 share a key and have like sketches, whatever their size; sets at 0.3 hardly ever do."""
    rng = np.random.default_rng(1)
    unlike = lambda a, b: int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    for size in (5, 20, 100, 3000):
        whole, alone = rng.integers(-(1 << 62), 1 << 62, (2, 60, size))
        for a, b in zip(whole, alone, strict=True):
            (ka, sa), (kb, sb) = jaccard.band_keys(np.unique(a)), jaccard.band_keys(np.unique(np.concatenate([a[: size - size // 9], b[: size // 9]])))
            assert set(ka) & set(kb) and unlike(sa, sb) <= jaccard.UNLIKE
    far = [(jaccard.band_keys(np.unique(a)), jaccard.band_keys(np.unique(np.concatenate([a[:1380], b[1380:]])))) for a, b in zip(whole, alone, strict=True)]
    assert sum(bool(set(a[0]) & set(b[0])) for a, b in far) < 12 and all(unlike(a[1], b[1]) > jaccard.UNLIKE for a, b in far)
    assert all(len(x) == 0 for x in jaccard.band_keys(np.empty(0, np.int64)))


def test_a_large_group_whose_copies_only_resemble_their_base(spark):
    """Copies with own edits are below 0.8 to each other; the base alone links them."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        text = list(base)
        for k in rng.sample(range(300), 6):
            text[k] = f"x{i}"
        rows.append((i, " ".join(text)))
    keep, pairs = brute(rows)
    got = {r["doc_id"] for r in jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == keep and len(keep) < 10
