"""Phrase mining: against a count of everything in plain Python, whatever the size of shards and bitmap."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from frameloom.llm import phrases

SCHEMA = "text string, lang string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, depth=5, least=100, top=2000, share=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, depth + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        held = Counter()
        for p, c in counts.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], c)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (held[p] >= least and 100 * held[p] >= share * a):
                s, _, le, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), le, r))
        for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "City", "é", "a\x01b", "日本", "x-y", "\xa0", "Ünder"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "! ", "\x0b"]) for _ in range(rng.randint(0, 30)))
        rows.append((text + "new york city hall" * (i % 3 == 0), rng.choice(["en", "en", "fr", None, "und"]), str(i)))
    return rows


def found(spark, rows, parts=6, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in phrases.collocations(df, **more).collect())


@pytest.mark.parametrize("more", [{}, {"shard_words": 200}, {"bits": 8}, {"shard_words": 50, "bits": 64}])
def test_counts_scores_and_ranks(spark, more):
    rows = made(1)
    expected = plainly(rows, least=5)
    assert len(expected) > 50
    assert found(spark, rows, least=5, **more) == expected


@pytest.mark.parametrize("depth,top,share", [(2, 5, 100), (3, 2000, 60), (4, 7, 100)])
def test_parameters(spark, depth, top, share):
    rows = made(2)
    assert found(spark, rows, least=6, depth=depth, top=top, share=share) == plainly(rows, depth, 6, top, share)


def test_ties_repeats_and_long_texts(spark):
    rows = [("b a b a b a", "en", ""), ("b a. b a; a b", "en", "")] * 4 + [("q r " * 5_000, "fr", ""), ("w" * 30_000 + " q", "fr", "")]
    expected = plainly(rows, least=4)
    assert found(spark, rows, least=4) == expected and len({r[0] for r in expected}) == 2


def test_awkward_rows(spark):
    rows = [(None, "en", "1"), ("", None, "1"), (" . , ", "de", "1"), ("one two", None, "2"), ("one two", "und", "2"), ("\xa0 only", "x", None)]
    assert found(spark, rows, least=2) == plainly(rows, least=2) == [("und", 1, "one two", 2, 2, 2, 4, 2000)]
    assert found(spark, rows, least=100) == [] and found(spark, []) == []


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big)], "lang string, phrase string, a long")
    two = spark.createDataFrame([("en", "a b", big - 1)], "lang string, phrase string, a long")
    rows = phrases.scored(phrases.phrase_parts([one, two]), spark.createDataFrame([("en", 10**14)], "lang string, n long"))
    r = rows.first()
    assert (r["l"], r["r"], r["score"]) == (big, big, 1000 * (big - 1) * 10**14 // (big * big))


def test_bitmap_knows_every_path(spark):
    rng = random.Random(5)
    table = [(rng.choice(["en", "fr"]), " ".join(rng.choice("abcdefgh") * 3 for _ in range(3))) for _ in range(300)]
    df = spark.createDataFrame(table, "lang string, phrase string")
    bits = 1 << 17
    bitmap = np.frombuffer(phrases._bitmap(df, bits), np.uint8)
    assert len(bitmap) == bits // 8
    assert int(np.unpackbits(bitmap).sum()) == len(set(table))
