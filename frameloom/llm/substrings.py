"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte that lies in a WIDTH-byte string which also starts in a document of smaller doc_id is removed; matches do not cross
documents, and strings are judged on the input.

1. The leftmost smallest hash among the SEED-byte seeds of a string is its anchor, a function of the string's own bytes:
   equal strings have equal anchors at equal offsets. Runs of string starts with one anchor make segments; only anchors are
   shuffled at first, packed by batch and bucket, to find those that occur in more than one document.
2. Segments of these anchors send their bytes to the anchor's bucket. There the suffixes that start at the same
   offset from the anchor are sorted by a mergesort that compares two suffixes by binary search for their common length over
   prefix polynomial hashes. Neighbours equal over the whole width are equal strings, checked byte by byte; the smallest
   doc_id of each run of equal ones decides. Equal segments are folded into one before the sort.
3. The spans go back to their documents.

An anchor that a hundredth of the texts share would gather its segments in one bucket. Such anchors, found in a sample that bears on the
route alone, take no part in 1 and 2: each string at them is named by 128 hash bits, the smallest ord of a name is found by an
aggregation that begins inside each batch, so that a batch sends a frequent passage once. No task holds what all its documents have.

Exact copies are found by digest, take no part in 2 and are removed whole. Texts are compressed where they are shuffled.

Defined results: null and empty texts have no bytes; a null doc_id is larger than all others (it counts as the largest long); rows
of equal doc_id remove nothing from each other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, join_groups, materialize

WIDTH, SEED = 50, 18
WINDOW = WIDTH - SEED + 1
#: Anchors per bucket, about, with one anchor in every WINDOW / 2 bytes.
BUCKET_ANCHORS = 1_000_000
#: Parts of a bucket once segments carry their bytes: what a task then holds is some tens of megabytes.
PARTS = 8
#: Segments of a batch in which equal ones are folded before the shuffle.
FOLD_SEGMENTS = 40_000
BATCH_BYTES, PIECE = 4 << 20, 1 << 20
#: The sample for frequent anchors: so many texts, or this part of them if that is more; the part of it that makes an anchor frequent; and the most of them.
SAMPLE_TEXTS, SAMPLE_PART, FREQUENT_PART, FREQUENT = 4000, 1 / 64, 1 / 100, 1 << 16
LAST = (1 << 63) - 1
HASH_SEED = 42
_BASE = 0x9E3779B97F4A7C15
_BASES = (_BASE, 0xBF58476D1CE4E5B9)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash's base and of its inverse, modulo 2^64."""
    out = []
    for base in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _room(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, int(n).bit_length()), base)


def prefix_hashes(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """h with h[i] the polynomial hash of the first i bytes; a substring's is (h[b] - h[a]) / base^a."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _room(len(data), base)[0][: len(data)], out=out[1:])
    return out


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash of 48 bits, its place, first and last string start) of each segment of a text's bytes."""
    parts = []
    for at in range(0, max(0, len(data) - WIDTH + 1), PIECE):
        piece = data[at : at + PIECE + WIDTH - 1]
        h = prefix_hashes(piece)
        h = (h[SEED:] - h[:-SEED]) * _room(len(piece))[1][: len(piece) - SEED + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        value = h >> np.uint64(16)
        place = np.arange(len(value))
        least, where, span = value, place, 1
        while span < WINDOW:
            step = min(span, WINDOW - span)
            left = least[:-step] <= least[step:]
            least, where, span = np.where(left, least[:-step], least[step:]), np.where(left, where[:-step], where[step:]), span + step
        lo = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        hi = np.r_[lo[1:], len(where)] - 1
        parts.append((least[lo], where[lo] + at, lo + at, hi + at))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes(scalar) -> bytes:
    return scalar.as_buffer().to_pybytes() if scalar.is_valid else b""


def _with_order(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(ord, doc_id, th, body): th hashes the text, body is the text compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [_bytes(t) for t in batch.column(2)]
            th = np.array([xxhash.xxh64_intdigest(t, HASH_SEED) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(th), pa.array([pack.compress(t) for t in texts], pa.binary())], names=["ord", "doc_id", "th", "body"])

    return docs.mapInArrow(run, f"ord long, doc_id {kind}, th long, body binary")


def _among(anchor: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which anchors are in a sorted array."""
    if not len(known):
        return np.zeros(len(anchor), bool)
    return known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor


def frequent_anchors(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted anchors that many of n texts share, by a sample."""
    part = min(1.0, max(SAMPLE_PART, SAMPLE_TEXTS / max(n, 1)))
    some = docs.filter(F.pmod(F.xxhash64("ord"), F.lit(1 << 20)) < int(part * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(segments(np.frombuffer(_bytes(t), np.uint8))[0]) for t in batch.column(0)]
            anchor, times = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(times.astype(np.int64))], names=["anchor", "n"])

    counted = some.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= max(3, FREQUENT_PART * part * n)).orderBy(F.desc("n"), "anchor").limit(FREQUENT).collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(np.uint64))


def _frequent_strings(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Of the strings at frequent anchors: (ord, th, lo, hi, a, b). a and b name a string that starts at lo; without them, lo to hi goes whatever else there is.

    Of equal strings of a batch only those of the smallest ord are sent by name.
    """
    names = ["ord", "th", "lo", "hi", "a", "b"]

    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        order, th, lo, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((order, b, a))
        order, th, lo, a, b = order[by], th[by], lo[by], a[by], b[by]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        least = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        keep = order == least
        yield pa.RecordBatch.from_arrays([*map(pa.array, (order[keep], th[keep], lo[keep], lo[keep] + WIDTH, a[keep], b[keep]))], names=names)
        order, th, lo = order[~keep], th[~keep], lo[~keep]
        by = np.lexsort((lo, th, order))
        order, th, lo = order[by], th[by], lo[by]
        if len(lo):
            cut = np.r_[True, (order[1:] != order[:-1]) | (th[1:] != th[:-1]) | (lo[1:] > lo[:-1] + 1)]
            last = np.r_[cut[1:], True]
            none = pa.nulls(int(cut.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, (order[cut], th[cut], lo[cut], lo[last] + WIDTH)), none, none], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = [], 0
        for batch in batches:
            for order, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                raw = _bytes(text)
                data = np.frombuffer(raw, np.uint8)
                anchor, _, lo, hi = segments(data)
                use = np.flatnonzero(_among(anchor, frequent))
                if len(use):
                    n = hi[use] - lo[use] + 1
                    at = np.repeat(lo[use], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    name = []
                    for base in _BASES:
                        h = prefix_hashes(data, base)
                        name.append(((h[at + WIDTH] - h[at]) * _room(len(data), base)[1][at]).view(np.int64))
                    th = np.uint64(xxhash.xxh64_intdigest(raw, HASH_SEED)).view(np.int64)
                    found.append((np.full(len(at), order), np.full(len(at), th), at, *name))
                    total += len(at)
                if total >= BATCH_BYTES // 4:
                    yield from flush(found)
                    found, total = [], 0
        if found:
            yield from flush(found)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _packed_anchors(docs: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Rows of (bucket, anchors, docs, places): a batch's anchors of a bucket, six bytes each, with their documents' (ord, th) and number."""

    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        anchor, place = (np.concatenate([f[i] for f in found]) for i in (2, 3))
        doc = np.repeat(np.arange(len(found), dtype=np.uint32), [len(f[2]) for f in found])
        names = np.array([(f[0], f[1]) for f in found], np.int64)
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        anchor, place, doc, bucket = anchor[order], place[order].astype(np.uint32), doc[order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(bucket)] if len(bucket) else [0]
        rows = []
        for a, b in zip(cut, cut[1:], strict=False):
            met, number = np.unique(doc[a:b], return_inverse=True)
            rows.append((int(bucket[a]), anchor[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), names[met].tobytes(), number.astype(np.uint32).tobytes(), place[a:b].tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "anchors", "names", "number", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = [], 0
        for batch in batches:
            for order, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                data = _bytes(text)
                if len(data) >= WIDTH:
                    anchor, place, _, _ = segments(np.frombuffer(data, np.uint8))
                    rare = ~_among(anchor, frequent)
                    anchor, place = anchor[rare], place[rare]
                    anchor, first = np.unique(anchor, return_index=True)  # an anchor's other places in the text are found again later
                    found.append((order, np.uint64(xxhash.xxh64_intdigest(data, HASH_SEED)).view(np.int64), anchor, place[first]))
                    total += len(data)
                if total >= BATCH_BYTES:
                    yield from flush(found)
                    found, total = [], 0
        yield from flush(found)

    return docs.mapInArrow(run, "bucket long, anchors binary, names binary, number binary, places binary")


def _repeated(group: pa.Table) -> pa.Table:
    """A bucket's anchors that more than one document has, as (ord, th, place); of equal texts only the first is looked at."""
    anchor, order, th, place = [], [], [], []
    for a, n, d, p in zip(*(group[c].to_pylist() for c in ("anchors", "names", "number", "places")), strict=True):
        raw = np.zeros((len(a) // 6, 8), np.uint8)
        raw[:, :6] = np.frombuffer(a, np.uint8).reshape(-1, 6)
        names = np.frombuffer(n, np.int64).reshape(-1, 2)[np.frombuffer(d, np.uint32)]
        anchor.append(raw.view(np.uint64).ravel())
        order.append(names[:, 0])
        th.append(names[:, 1])
        place.append(np.frombuffer(p, np.uint32))
    anchor, order, th, place = (np.concatenate(x) for x in (anchor, order, th, place))
    #: Anchors met once are most; they go before the sort by three keys.
    by = np.argsort(anchor)
    same = anchor[by][1:] == anchor[by][:-1]
    many = by[np.r_[False, same] | np.r_[same, False]]
    anchor, order, th, place = anchor[many], order[many], th[many], place[many]
    by = np.lexsort((order, th, anchor))
    anchor, order, th, place = anchor[by], order[by], th[by], place[by]
    if len(anchor):
        run = np.r_[True, (anchor[1:] != anchor[:-1]) | (th[1:] != th[:-1])]
        keep = order == order[np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))]
        anchor, order, th, place = anchor[keep], order[keep], th[keep], place[keep]
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        differ = np.minimum.reduceat(order, start) < np.maximum.reduceat(order, start)
        keep = np.repeat(differ, np.diff(np.r_[start, len(anchor)]))
        order, th, place = order[keep], th[keep], place[keep]
    return pa.table({"ord": order, "th": th, "place": place.astype(np.int64)})


def _contexts(texts: DataFrame, buckets: int) -> DataFrame:
    """For rows (ord, th, body, places): the bytes of the segments at anchors that repeat.

    Equal segments of a batch are folded here: those of a larger ord than the least are removed whole whatever else there is. They
    carry no bytes, have their size as off, and go to other buckets, spread evenly; so a passage of a third of all documents
    sends few segments to its anchor's bucket.
    """

    names = ["bucket", "anchor", "ord", "th", "lo", "off", "cut"]

    def flush(found: list[tuple], cuts: list[bytes]) -> pa.RecordBatch:
        anchor, order, th, lo, off = (np.concatenate(x) for x in zip(*found, strict=True))
        which, least = _folded(anchor, order, off, cuts)
        whole = order > least[which]
        size = np.fromiter(map(len, cuts), np.int64, len(cuts))
        bucket = np.where(whole, buckets + (order ^ lo) % buckets, anchor % buckets)
        cut = pa.array([None if w else c for w, c in zip(whole.tolist(), cuts, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket), *map(pa.array, (anchor, order, th, lo, np.where(whole, size, off))), cut], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, found, cuts = zstandard.ZstdDecompressor(), [], []
        for batch in batches:
            for order, th, body, places in zip(*(batch.column(c).to_pylist() for c in ("ord", "th", "body", "places")), strict=True):
                data = unpack.decompress(body)
                anchor, place, lo, hi = segments(np.frombuffer(data, np.uint8))
                anchor = anchor.astype(np.int64)
                wanted = np.sort(anchor[np.searchsorted(place, places)])  # places rise with the text
                use = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor)
                found.append((anchor[use], np.full(len(use), order), np.full(len(use), th), lo[use], place[use] - lo[use]))
                cuts += [data[a : b + WIDTH] for a, b in zip(lo[use].tolist(), hi[use].tolist(), strict=True)]
                if len(cuts) >= FOLD_SEGMENTS:
                    yield flush(found, cuts)
                    found, cuts = [], []
        if cuts:
            yield flush(found, cuts)

    return texts.mapInArrow(run, "bucket long, anchor long, ord long, th long, lo long, off long, cut binary")


def _folded(anchor: np.ndarray, order: np.ndarray, off: np.ndarray, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each segment's class of equal ones, least ord of each class)."""
    numbers: dict[tuple, int] = {}
    which = np.array([numbers.setdefault(x, len(numbers)) for x in zip(anchor.tolist(), off.tolist(), cuts, strict=True)], np.int64)
    least = np.full(len(numbers), LAST)
    np.minimum.at(least, which, order)
    return which, least


class Suffixes:
    """Suffixes of joined bytes, compared over WIDTH bytes by binary search over prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.hash, self.inverse = data, prefix_hashes(data), _room(len(data))[1]

    def repeated(self, at: np.ndarray) -> np.ndarray:
        """Which of the suffixes share the hash of their first WIDTH bytes with another."""
        h = (self.hash[at + WIDTH] - self.hash[at]) * self.inverse[at]
        by = np.argsort(h)
        same = h[by][1:] == h[by][:-1]
        return np.sort(by[np.r_[False, same] | np.r_[same, False]])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes at a and b, WIDTH at most."""
        lo, step = np.zeros(len(a), np.int64), 1 << (WIDTH.bit_length() - 1)
        while step:
            n = np.minimum(lo + step, WIDTH)
            equal = (self.hash[a + n] - self.hash[a]) * self.inverse[a] == (self.hash[b + n] - self.hash[b]) * self.inverse[b]
            lo, step = np.where(equal, n, lo), step >> 1
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        equal, n = n >= WIDTH, np.minimum(n, WIDTH - 1)
        return np.where(equal, or_equal, self.data[a + n] < self.data[b + n])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order that sorts suffixes within runs of equal group, by merging runs of one, two, four and so on."""
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        base, end = np.repeat(first, size), np.repeat(first + size, size)
        order, width, most = np.arange(len(at)), 1, int(size.max(initial=0))
        while width < most:
            active = np.flatnonzero(end - base > width)
            run = (active - base[active]) // width
            lo = base[active] + (run ^ 1) * width
            hi = np.minimum(lo + width, end[active])
            lo = np.minimum(lo, hi)
            start, right, own = lo.copy(), run % 2 == 1, at[order[active]]
            while (open_ := np.flatnonzero(lo < hi)).size:  # how many of the other run go before
                mid = (lo[open_] + hi[open_]) // 2
                before = self.less(at[order[mid]], own[open_], right[open_])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            target = base[active] + (run & ~1) * width + (active - base[active]) % width + (lo - start)
            merged = order.copy()
            merged[target] = order[active]
            order, width = merged, 2 * width
        return order


def _equal_runs(suffixes: Suffixes, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the run of equal strings) of suffixes; equal hashes are checked by their bytes."""
    order = suffixes.sort(at, group)
    a, b = at[order][:-1], at[order][1:]
    near = group[order][1:] == group[order][:-1]
    equal = near & (suffixes.common(a, b) >= WIDTH)
    which = np.flatnonzero(equal)
    for k in range(0, len(which), 200_000):
        w = which[k : k + 200_000]
        same = (suffixes.data[a[w][:, None] + np.arange(WIDTH)] == suffixes.data[b[w][:, None] + np.arange(WIDTH)]).all(1)
        if not same.all():  # a hash collision: number these groups' strings by their bytes instead
            numbers: dict[tuple[int, bytes], int] = {}
            order = np.arange(len(at))
            run = np.array([numbers.setdefault((g, suffixes.data[p : p + WIDTH].tobytes()), len(numbers)) for g, p in zip(group.tolist(), at.tolist(), strict=True)])
            order = np.argsort(run, kind="stable")
            return order, run[order]
    return order, np.cumsum(np.r_[True, ~equal]) - 1


def _spans(group: pa.Table) -> pa.Table:
    """A bucket's removed ranges of string starts, as (ord, th, lo, hi) in bytes."""
    anchor, order, th, lo, off = (group[c].to_numpy() for c in ("anchor", "ord", "th", "lo", "off"))
    if group["cut"].null_count:  # a bucket of segments that are removed whole
        return pa.table({"ord": order, "th": th, "lo": lo, "hi": lo + off})
    cuts = group["cut"].to_pylist()
    size = np.fromiter(map(len, cuts), np.int64, len(cuts))
    # Equal segments are one, that of the smallest document; in any other one's document every start is removed.
    which, least = _folded(anchor, order, off, cuts)
    whole = order > least[which]
    first = np.zeros(len(least), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    by_anchor = np.argsort(anchor[first], kind="stable")
    alone = np.ones(len(first), bool)
    a = anchor[first][by_anchor]
    same = a[1:] == a[:-1]
    alone[by_anchor] = ~(np.r_[False, same] | np.r_[same, False])
    use = np.flatnonzero(~alone)
    out = [(order[whole], th[whole], lo[whole], lo[whole] + size[whole])]
    if len(use):
        part = size[first[use]]
        data = np.frombuffer(b"".join([cuts[i] for i in first[use]]), np.uint8)
        starts = part - WIDTH + 1
        seg = np.repeat(np.arange(len(use)), starts)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = (np.cumsum(part) - part)[seg] + nth
        lowest = least[use][seg]
        suffixes = Suffixes(data)
        maybe = suffixes.repeated(at)  # the others are equal to none
        if len(maybe):
            key = np.stack([anchor[first[use]][seg[maybe]], off[first[use]][seg[maybe]] - nth[maybe]], 1)
            by = np.lexsort((key[:, 1], key[:, 0]))
            group_no = np.cumsum(np.r_[True, (key[by][1:] != key[by][:-1]).any(1)]) - 1
            sorted_, run = _equal_runs(suffixes, at[maybe[by]], group_no)
            smallest = np.full(run.max() + 1, LAST)
            np.minimum.at(smallest, run, least[use][seg[maybe[by]][sorted_]])
            lowest[maybe[by[sorted_]]] = smallest[run]
        # Every occurrence that is not removed whole asks for its segment's starts.
        place = np.full(len(least), -1)
        place[use] = np.arange(len(use))
        ask = np.flatnonzero(~whole & (place[which] >= 0))
        p = place[which[ask]]
        begin, n = (np.cumsum(starts) - starts)[p], starts[p]
        who = np.repeat(ask, n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        gone = lowest[np.repeat(begin, n) + step] < order[who]
        edge = gone & np.r_[True, ~gone[:-1] | (who[1:] != who[:-1])]
        last = gone & np.r_[~gone[1:] | (who[1:] != who[:-1]), True]
        out.append((order[who[edge]], th[who[edge]], lo[who[edge]] + step[edge], lo[who[edge]] + step[last] + WIDTH))
    return pa.table(dict(zip(("ord", "th", "lo", "hi"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(ord, th, spans): byte ranges to remove, overlapping and in any order, of texts that have any."""
    base = _with_order(docs)
    total, n = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(8, int(2 * total / WINDOW / BUCKET_ANCHORS) + 1)
    frequent = frequent_anchors(base, n)
    repeated = _packed_anchors(base, buckets, frequent).groupBy("bucket").applyInArrow(_repeated, "ord long, th long, place long")
    places = materialize(repeated.groupBy("ord", "th").agg(F.collect_list("place").alias("places")), "anchor-places")
    joined = _packed_texts(base).select("ord", "th", "body").join(places, ["ord", "th"])
    spans = _contexts(joined, buckets * PARTS).groupBy("bucket").applyInArrow(_spans, "ord long, th long, lo long, hi long")
    used = [places]
    if len(frequent):
        strings = materialize(_frequent_strings(base, frequent), "frequent-strings")
        #: A name comes once from each batch at most, so a window holds as many rows of it as there are batches, and spills.
        least = F.min("ord").over(W.partitionBy("a", "b"))
        gone = strings.filter("a is not null").withColumn("least", least).filter("ord > least").select("ord", "th", "lo", "hi")
        spans = spans.union(gone).union(strings.filter("a is null").select("ord", "th", "lo", "hi"))
        used.append(strings)
    digests = base.select("ord", F.xxhash64("text").alias("th"), F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    firsts = digests.groupBy("sha").agg(F.min("ord").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    firsts = materialize(firsts, "equal-texts")
    copies = join_groups(digests.filter(F.col("n") >= WIDTH), firsts, ["sha"], "rows").filter("ord > least").select("ord", "th", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")).distinct()
    out = materialize(spans.union(copies).groupBy("ord", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(*used, firsts)
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the bytes that remain."""
    spans = removed_spans(docs)
    texts = _packed_texts(_with_order(docs)).join(spans, ["ord", "th"], "left").select("doc_id", "body", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, kept = unpack.decompress(body), 0, []
                merged = merge_spans([(s["lo"], s["hi"]) for s in found or ()])
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The contract in DuckDB: every 50-byte string of every text, as hex digits.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT s.doc_id, i FROM s JOIN f ON f.x = s.x AND first < s.doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT d.doc_id, h, n_removed, n_spans, cuts FROM d LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list({'a': a, 'b': b} ORDER BY a) AS cuts FROM r GROUP BY 1) USING (doc_id))
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN cuts IS NULL THEN h ELSE array_to_string(list_transform(range(len(cuts) + 1), lambda k: substr(h, 2 * CASE WHEN k = 0 THEN 0 ELSE cuts[k].b END + 1, 2 * (CASE WHEN k = len(cuts) THEN len(h) // 2 ELSE cuts[k + 1].a END - CASE WHEN k = 0 THEN 0 ELSE cuts[k].b END))), '') END)) AS kept_sha256 FROM k
"""
