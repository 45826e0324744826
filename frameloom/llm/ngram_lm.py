"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are counted first; their 64-bit hashes, sorted, are the vocabulary, and a word's place there is its id. Pairs of ids
are then counted, dealt to shards by a hash of the whole pair, so that what follows a frequent word is spread like
everything else. Every shard is written to the shared folder as arrays sorted by that hash. What the shards know of a word (the
totals of the pairs it begins, the number of different pairs that end in it) is summed up in a second aggregation, and written as
arrays by id. Scoring tasks map these files into memory and look up the distinct keys of a batch by binary search: what a
worker touches is paged in, nothing is loaded whole, and nothing passes through the driver but a row per shard and a dozen sums.

p(w | v) = max(c(v, w) - D(c), 0) / c(v) + g(v) * p(w), where p(w) does the same with the number of different words that w
follows, above 1 / (V + 1) for each word, known or not. After an unknown word p(w) alone counts.

Counts are of 64 bits, files as narrow as their largest count allows; ids may be as many as hashes. A pair's key is a hash of 64 bits:
of 10^12 pairs some tens of thousands share a key with another and count together.

Defined results: null and empty texts are one end token; a null doc_id hashes as the empty text; rows that repeat are counted and
scored as often as they come; with no training text every token has probability 1; other columns are not looked at.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, materialize, scratch_path

#: A held-out document's remainder of crc32(doc_id), and the modulus.
FOLD, FOLDS = 1, 5
#: Bytes of text that a task works on at a time.
BATCH_BYTES = 4 << 20
#: Words in a shard of the vocabulary, tokens for a shard of pairs, and the least number of the latter.
VOCABULARY_SHARD, PAIR_SHARD, LEAST_SHARDS = 1 << 20, 1_500_000, 32
#: The end of a text; no word has a space.
END = np.uint64(xxhash.xxh64_intdigest(b" end")).view(np.int64)


# ---- files of sorted arrays in the shared folder


def write_array(uri: str, values: np.ndarray) -> None:
    """Written aside and moved, so that a task that runs twice or dies leaves a whole file or none."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(np.ascontiguousarray(values))
    fs.move(aside, path)


def map_array(uri: str, dtype: str) -> np.ndarray:
    """Mapped into memory where the folder is mounted, else through an unnamed local copy."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as f:
        while part := f.read(8 << 20):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, dtype, "r")


def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of asked keys in a sorted array, -1 where they are not there."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


# ---- texts to hashes


def _batches(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of the rows' tokens, tokens per row), some megabytes of text at a time; a longer text alone."""
    column = batch.column(at)
    hashes, sizes, total, first = [], [], 0, 0
    for i, t in enumerate(column):
        data = t.as_buffer().to_pybytes().lower() if t.is_valid else b""
        words = data.split()
        hashes += map(xxhash.xxh64_intdigest, words)
        hashes.append(int(END) & (1 << 64) - 1)
        sizes.append(len(words) + 1)
        total += len(data)
        if total >= BATCH_BYTES or i + 1 == len(column):
            yield first, i + 1, np.array(hashes, np.uint64).view(np.int64), np.array(sizes)
            hashes, sizes, total, first = [], [], 0, i + 1


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes in shards; a word's id is its place over all of them."""

    root: str
    firsts: tuple[int, ...]  # the shards' first hashes
    starts: tuple[int, ...]  # and first ids
    size: int
    tokens: int

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1)
        bounds = np.searchsorted(hashes, np.array(self.firsts, np.int64)).tolist() + [len(hashes)]
        for k, start in enumerate(self.starts):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                at = _places(_mapped(f"{self.root}/hash-{k}", "i8"), hashes[a:b])
                out[a:b] = np.where(at >= 0, at + start, -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids; 0 for -1."""
        return _gather(self.root, "count", self.starts, ids, ["i8"] * len(self.starts))


def _gather(root: str, name: str, starts: Iterable[int], ids: np.ndarray, kinds: Sequence[str]) -> np.ndarray:
    out, starts = np.zeros(len(ids), np.int64), np.array(list(starts), np.int64)
    shard = np.searchsorted(starts, ids, side="right") - 1
    for k in np.unique(shard[ids >= 0]).tolist():
        own = (shard == k) & (ids >= 0)
        out[own] = _mapped(f"{root}/{name}-{k}", kinds[k])[ids[own] - starts[k]]
    return out


@lru_cache(maxsize=4096)
def _mapped(uri: str, dtype: str) -> np.ndarray:
    return map_array(uri, dtype)


def _chunk_counts(keys: np.ndarray, name: str) -> pa.RecordBatch:
    key, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=[name, "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, n) of the tokens of texts; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, _ in _batches(batch, 0):
                yield _chunk_counts(hashes, "hash")

    return texts.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def build_vocabulary(texts: DataFrame, root: str) -> Vocabulary:
    words = materialize(count_words(texts), "lm-words")
    size, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if parts:
            k = TaskContext.get().partitionId()
            table = pa.Table.from_batches(parts)
            hashes, n = (table[c].to_numpy() for c in ("hash", "n"))
            write_array(f"{root}/raw-hash-{k}", hashes)
            write_array(f"{root}/raw-count-{k}", n)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(n)]), pa.array([hashes[0]])], names=["k", "n", "first"])

    shards = max(1, -(-size // VOCABULARY_SHARD))
    written = words.repartitionByRange(shards, "hash").sortWithinPartitions("hash").mapInArrow(write, "k long, n long, first long")
    found = sorted(map(tuple, written.collect()))  # a row per shard of four million words
    fs, path = pafs.FileSystem.from_uri(root)
    for place, (k, _, _) in enumerate(found):
        for kind in ("hash", "count"):
            fs.move(f"{path}/raw-{kind}-{k}", f"{path}/{kind}-{place}")
    starts = np.cumsum([0, *(n for _, n, _ in found)]).tolist()[:-1]
    return Vocabulary(root, tuple(f for _, _, f in found), tuple(starts), size, tokens)


# ---- pairs


def _pairs(vocabulary: Vocabulary, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id of the word before, own id) of each token; before the first stands the number of words, and -1 is unknown."""
    distinct, back = np.unique(hashes, return_inverse=True)
    ids = vocabulary.ids(distinct)[back]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = vocabulary.size
    return before, ids


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney's three discounts from the numbers of keys that came once, twice, three and four times."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05 * k), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """64 hash bits of each pair, without a sign."""
    out = np.zeros(len(ids), np.uint64)
    for part in (before, ids):
        out += part.astype(np.uint64) + np.uint64(1)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def _narrow(n: np.ndarray) -> str:
    """The narrowest kind of number that holds all counts."""
    most = int(n.max(initial=0))
    return next(kind for kind, bits in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if most < 1 << bits)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    root: str
    shards: int
    kinds: tuple[str, ...] = ()  # of the shards' counts, empty for a shard without pairs
    word_shards: tuple[int, ...] = ()  # first ids
    word_kinds: dict[str, tuple[str, ...]] = field(default_factory=dict)
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    pairs: int = 0  # distinct ones
    word_rest: float = 1.0  # what the words' discounts leave to unknown ones

    def _of_words(self, name: str, ids: np.ndarray) -> np.ndarray:
        return _gather(self.root, name, self.word_shards, ids, self.word_kinds.get(name, ()))

    def word_p(self, ids: np.ndarray) -> np.ndarray:
        """p(w) of sorted ids."""
        rest = self.word_rest / (self.vocabulary.size + 1)
        if not self.pairs:
            return np.full(len(ids), rest)
        after = self._of_words("follows", ids)
        return _discounted(after, self.word_discounts) / self.pairs + rest

    def pair_parts(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """max(c - D, 0) / c(v) and g(v) of pairs sorted by their first word; 0 and 1 after an unknown word."""
        totals = [self._of_words(name, before) for name in ("total", "once", "twice", "more")]
        total, d = np.maximum(totals[0], 1), self.pair_discounts
        rest = np.where(totals[0] > 0, (d[0] * totals[1] + d[1] * totals[2] + d[2] * totals[3]) / total, 1.0)
        c, both = np.zeros(len(ids), np.int64), np.flatnonzero((before >= 0) & (ids >= 0))
        key = pair_keys(before[both], ids[both])
        order = np.argsort(key)
        key, both = key[order], both[order]
        shard = (key % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1)).tolist()
        for k in np.unique(shard).tolist():
            at = order[bounds[k] : bounds[k + 1]]
            if self.kinds[k]:
                place = _places(_mapped(f"{self.root}/pair-{k}", "u8"), key[at])
                c[both[at]] = np.where(place >= 0, _mapped(f"{self.root}/paircount-{k}", self.kinds[k])[np.maximum(place, 0)], 0)
        return np.where(totals[0] > 0, _discounted(c, d) / total, 0.0), rest


#: Rows of what the shards know: a word's sums; or, under ids below 0, counts of counts and the kind of a shard's counts.
_SUMS = ("total", "once", "twice", "more", "follows")
_OF_COUNTS, _OF_SHARDS = -2, -10


def build_model(texts: DataFrame) -> Model:
    """The model of texts (column text), its arrays written below the shared folder."""
    root = scratch_path(texts.sparkSession, "lm")
    vocabulary = build_vocabulary(texts, root)
    if not vocabulary.size:
        return Model(vocabulary, root, 1)
    shards = max(LEAST_SHARDS, vocabulary.tokens // PAIR_SHARD)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, sizes in _batches(batch, 0):
                before, ids = _pairs(vocabulary, hashes, sizes)
                order = np.lexsort((ids, before))
                before, ids = before[order], ids[order]
                start = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (ids[1:] != ids[:-1])])
                n, before, ids = np.diff(np.r_[start, len(ids)]), before[start], ids[start]
                shard = (pair_keys(before, ids) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (shard, before, ids, n)], names=["shard", "v", "w", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, and _SUMS) of each shard."""
        names = ["id", *_SUMS]
        rows = lambda ids, *sums: pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (ids, *sums)], names=names)
        for k, v, w, n in _by_shard(batches):
            key = pair_keys(v, w)
            order = np.argsort(key)
            kind = _narrow(n)
            write_array(f"{root}/pair-{k}", key[order])
            write_array(f"{root}/paircount-{k}", n[order].astype(kind))
            order = np.argsort(v, kind="stable")
            v, sorted_n = v[order], n[order]
            start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            sums = [np.add.reduceat(x.astype(np.int64), start) for x in (sorted_n, sorted_n == 1, sorted_n == 2, sorted_n >= 3)]
            word, follows = np.unique(w, return_counts=True)
            ids = np.union1d(v[start], word)
            columns = np.zeros((5, len(ids)), np.int64)
            columns[:4, np.searchsorted(ids, v[start])] = sums
            columns[4, np.searchsorted(ids, word)] = follows
            for a in range(0, len(ids), 500_000):
                yield rows(ids[a : a + 500_000], *columns[:, a : a + 500_000])
            few, none = np.bincount(n[n <= 4], minlength=5)[1:], np.zeros(4, np.int64)
            yield rows(_OF_COUNTS - np.arange(4), few, none, none, none, none)
            yield rows([_OF_SHARDS - k], [int(kind[1])], *[[0]] * 4)

    counted = texts.select("text").mapInArrow(count, "shard int, v long, w long, n long").repartition(shards, "shard")
    counted = counted.groupBy("shard", "v", "w").agg(F.sum("n").alias("n")).sortWithinPartitions("shard")
    sums = counted.mapInArrow(write, ", ".join(f"{c} long" for c in ("id", *_SUMS))).groupBy("id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    sums = materialize(sums, "lm-sums")
    marks = dict(sums.filter("id < 0").select("id", "total").collect())  # a row per shard, and four
    kinds = tuple(f"u{marks[_OF_SHARDS - k]}" if _OF_SHARDS - k in marks else "" for k in range(shards))
    f = F.col("follows")
    stats = sums.filter("id >= 0").agg(F.sum(f), *(F.count_if(f == k) for k in range(1, 5)), F.count_if(f >= 3)).first()
    d = _discounts(list(stats[1:5]))

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, ids, *columns in _by_shard(batches):
            kinds = [_narrow(c) for c in columns]
            for name, values, kind in zip(_SUMS, columns, kinds, strict=True):
                dense = np.zeros(int(ids.max()) % VOCABULARY_SHARD + 1, kind)
                dense[ids % VOCABULARY_SHARD] = values
                write_array(f"{root}/{name}-{k}", dense)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (k, *kinds)], names=["k", *_SUMS])

    block = F.shiftright("id", VOCABULARY_SHARD.bit_length() - 1).alias("shard")
    blocks = vocabulary.size // VOCABULARY_SHARD + 1  # the start of a text has an id of its own, after all words
    done = sums.filter("id >= 0").select(block, "id", *_SUMS).repartition(blocks, "shard").sortWithinPartitions("shard").mapInArrow(write_words, ", ".join(["k long", *(f"{c} string" for c in _SUMS)]))
    done = sorted(map(tuple, done.collect()))  # a row per million words
    if len(done) != blocks:
        raise RuntimeError(f"{len(done)} of {blocks} blocks of words were written")
    return Model(
        vocabulary, root, shards, kinds, tuple(k * VOCABULARY_SHARD for k in range(blocks)), {c: tuple(r[i + 1] for r in done) for i, c in enumerate(_SUMS)}, _discounts([marks.get(_OF_COUNTS - k, 0) for k in range(4)]), d,
        int(stats[0]), (d[0] * stats[1] + d[1] * stats[2] + d[2] * stats[5]) / stats[0],
    )


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, column, ...) of batches sorted by shard, their first column."""
    shard, parts = None, []
    for batch in batches:
        s, *columns = (c.to_numpy() for c in batch.columns)
        cut = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else [0]
        for a, b in zip(cut, cut[1:], strict=False):
            if parts and s[a] != shard:
                yield int(shard), *map(np.concatenate, zip(*parts, strict=True))
                parts = []
            shard = s[a]
            parts.append([c[a:b] for c in columns])
    if parts:
        yield int(shard), *map(np.concatenate, zip(*parts, strict=True))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, sizes in _batches(batch, 1):
                before, ids = _pairs(words, hashes, sizes)
                distinct, back = np.unique(ids, return_inverse=True)
                c, p = words.counts(distinct), model.word_p(distinct)
                base = np.log10((c + 0.5) / (words.tokens + 0.5 * (words.size + 1)))
                order = np.lexsort((ids, before))
                new = np.r_[True, (before[order][1:] != before[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
                which = np.empty(len(order), np.int64)
                which[order] = np.cumsum(new) - 1
                own, rest = model.pair_parts(before[order][new], ids[order][new])
                score = np.log10(own[which] + rest[which] * p[back])
                start = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(sizes), pa.array(np.add.reduceat((c > 0)[back].astype(np.int64), start)), pa.array(np.add.reduceat(base[back], start)), pa.array(np.add.reduceat(score, start))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (doc_remainder(F.col("doc_id"), FOLDS) == FOLD).alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_by_own_model(docs: DataFrame) -> DataFrame:
    """Train on all documents outside the held-out fold, then score every document."""
    return score_documents(docs, build_model(docs.filter(doc_remainder(F.col("doc_id"), FOLDS) != FOLD)))
