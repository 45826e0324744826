"""SimHash near-dedup with Golay-code keys.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints within 4 bits are linked:
the 64 bits are cut into segments of 22, 21 and 21 bits, and 4 errors leave one of two cases.

* Some segment has no error. Of the two others one has at most 2: it shares a Golay key. Key: the bits of the first, a key
  of the second (33 bits, six ordered pairs of segments).
* Each has one at least, so two have exactly 1 each. There one side's nearest codeword is among the other's keys. Key: those of
  both segments (24 bits, three pairs); rows come in two kinds and only unlike kinds meet.

Distinct fingerprints alone are joined, on these keys, and each meeting is checked by counting bits inside the join. For groups
a star of each key comes first, and of the pairs only those that stars do not connect are sent on. The links then go through
distributed components. Copies never meet as pairs: they share a fingerprint.

Defined results: a null or empty text has fingerprint zero, linked like any other; a null doc_id takes part, and is a
component's id only where all of its ids are null; repeated rows get one result each; empty tables give empty results;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import golay
from .common import discard, join_groups, materialize
from .components import components

#: The contract of op3: words of a shingle, seed of its hash, and bits that may differ.
SHINGLE, SEED, MOST = 4, 42, 4
#: Words of a shingle in the pipeline, whose near copies are found by jaccard: at a share of 0.8 about ten of 64 bits differ, too many for these keys.
PIPELINE_SHINGLE = 5
#: Segments as (lowest bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_STEP = 1 << 16
#: Set bits of each byte value, by bit.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of a UTF-8 text."""
    words = data.lower().split()
    if not words:
        return 0
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    ends = stop[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    starts, digest = start.tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(ends), _STEP):
        part = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP], strict=False)], np.uint64)
        octets = part.view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(ends)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _key_rows(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(fp, key, kind) for all keys; kinds: 0 meets itself, 1 meets 2."""
    bits = fp.view(np.uint64)
    part = [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    found = [golay.keys(p, n) for p, (_, n) in zip(part, SEGMENTS, strict=True)]
    near = [golay.decode(p) for p in part]
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        key = np.where(found[j] < 0, -1, ((tag << 22 | part[i]) << golay.DATA)[:, None] | found[j])
        row, column = np.nonzero(key >= 0)
        yield fp[row], key[row, column], 0
    for tag, (i, j) in enumerate(combinations(range(3), 2)):
        top = (8 + tag) << 40
        yield fp, top | near[i] << golay.DATA | near[j], 1
        for column in range(found[i].shape[1]):
            a = found[i][:, column : column + 1]
            row, other = np.nonzero((found[j] >= 0) & (a >= 0))
            yield fp[row], top | a[row, 0] << golay.DATA | found[j][row, other], 2


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """(fp, key, kind) of distinct fingerprints."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fp, key, kind in _key_rows(frame["fp"].to_numpy(np.int64)):
                yield pd.DataFrame({"fp": fp, "key": key, "kind": np.full(len(fp), kind, np.int8)})

    return fps.select("fp").mapInPandas(run, "fp long, key long, kind byte")


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def _meetings(keyed: DataFrame, extra: Column, most: int) -> DataFrame:
    """Pairs (u, v) of keyed rows a and b that share a key and lie within `most` bits, where extra holds."""
    near = (F.col("a.key") == F.col("b.key")) & extra & _near("a.fp", "b.fp", most)
    meet = lambda left, right, order: keyed.filter(left).alias("a").join(keyed.filter(right).alias("b"), near & order)
    same = meet("kind = 0", "kind = 0", F.col("a.fp") < F.col("b.fp"))
    unlike = meet("kind = 1", "kind = 2", F.col("a.fp") != F.col("b.fp"))
    return same.union(unlike).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that differ in at most `most` (up to 4) bits; a pair may come more than once."""
    if most > MOST:
        raise ValueError(f"keys are safe up to {MOST} bits")
    return _meetings(materialize(fuzzy_keys(fps), "golay-keys"), F.lit(True), most)


def group_links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints within `most` bits, enough of them to connect all that such pairs connect.

    First each fingerprint is compared with the smallest one of each of its keys only, which links most of a large group. Of the pairs
    that meet then, those that are connected already are not sent on.
    """
    if most > MOST:
        raise ValueError(f"keys are safe up to {MOST} bits")
    keyed = materialize(fuzzy_keys(fps), "golay-keys")
    hub = F.min("fp").over(W.partitionBy("key"))
    stars = keyed.withColumn("hub", hub).filter(F.col("fp") != F.col("hub")).filter(_near("fp", "hub", most))
    stars = materialize(stars.select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct(), "golay-stars")
    roots = materialize(components(stars), "golay-roots")
    named = keyed.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "key", "kind", F.coalesce("root", "fp").alias("root"))
    more = materialize(_meetings(named, F.col("a.root") != F.col("b.root"), most).distinct(), "golay-links")
    discard(keyed, roots)
    return stars.union(more)


def near_groups(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (smallest doc_id reachable by links)."""
    marked = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(group_links(distinct, most))
    placed = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    sizes = materialize(placed.join(least, "root").select("fp", "component_id", "n"), "component-ids")
    return join_groups(marked, sizes, ["fp"], "n").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
