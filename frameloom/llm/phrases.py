"""Phrase collocation mining: phrases of several words that stand together more often than their parts would by chance.

A shard (a task's documents, in runs of SHARD_WORDS words) is counted in a trie of words. A node is a pair (node of the level above, word),
so a level is one sort of integers, and comes out in path order. Tries are written as sorted runs (lang, phrase, n); runs are dealt out
by ranges of their paths, where those of all shards are merged and summed. A path appears once per shard, so a phrase that makes up
a third of a language is no hot key, and ranges cut through the phrases of a frequent first word like through any others.

Tries are limited in depth by what can still count: no phrase is more frequent than its parts. So words are merged first, then pairs of
frequent words, then all longer phrases of frequent pairs in one go. Shards know the frequent ones by a bitmap of fixed size
(FILTER_BITS, whatever the input) over hashes of their paths. It lets through all that are frequent and few others, which cost a
row in a run and are dropped by the merge; counts and results never depend on it.

What stays are nodes that are frequent. A node's left parts are its parent and what the parent's walk to the root collects; its right
parts are its suffix link (the phrase without its first word) and the suffix's right parts. Both are joins by path, level by level,
in which parents with many children are broadcast (join_groups). A longer phrase tells parent and suffix link its own count.

Defined results: null texts are empty, null languages `und`; repeated rows count each; text without words, and an empty table, give
nothing; phrases less frequent than `least` are no candidates; rows of a language are in order of score, count and phrase, so ties are
settled; other columns are not looked at. Scores are exact: products are decimals of 38 digits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, join_dimension, join_groups, materialize

DEPTH, LEAST, FACTOR, TOP, SHARE = 5, 100, 1000, 2000, 100
#: Words of a shard's trie, and bits of the bitmap of frequent paths.
SHARD_WORDS, FILTER_BITS = 2_000_000, 1 << 27
#: Bytes that end a piece, and those between words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLDED = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")
#: Stands between pieces; no byte of UTF-8.
_END = b"\xff"
#: Runs hold a path as language, tab, phrase: no word holds a tab, so the last one parts them. They are written front-coded, for they are sorted.
_RUN = "path string, n long"
_CODED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words in order, _END after each piece."""
    return (text.lower().translate(_FOLDED) + b"\n").replace(b"\n", b" \xff ").split()


def _fold(path: np.ndarray | int, word: np.ndarray | int):
    """Hash of a path from that of the path above and the word's, both 64-bit."""
    with np.errstate(over="ignore"):
        x = (np.asarray(path, np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(word, np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _bit(path: np.ndarray, bits: int) -> np.ndarray:
    return (path % np.uint64(bits)).astype(np.int64)


class Shard:
    """Words of a run of documents by language, and the tries over them."""

    def __init__(self):
        self.code: dict[bytes, int] = defaultdict(count().__next__)
        self.code[_END]
        self.runs: dict[str, list[np.ndarray]] = defaultdict(list)
        self.words = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        found = words_of(b"\n".join(texts))
        self.runs[lang].append(np.fromiter(map(self.code.__getitem__, found), np.int32, len(found)))
        self.words += len(found)

    def tries(self, low: int, high: int, known: np.ndarray | None, bits: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        """(lang, phrases, counts) of each level from low to high, in path order.

        known: the bitmap of frequent paths of low - 1 words; only such paths are extended, and only by words that end another of them.
        """
        names = [_END, *sorted(w for w in self.code if w != _END)]
        rank = np.empty(len(names), np.int32)
        rank[[self.code[w] for w in names]] = np.arange(len(names))
        text = pa.array(["", *(w.decode() for w in names[1:])], pa.string())
        word_hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names)) if known is not None else None
        for lang in list(self.runs):
            word = rank[np.concatenate(self.runs.pop(lang))]
            if low == 1:
                n = np.bincount(word, minlength=len(names))
                at = np.flatnonzero(n)
                at = at[at > 0]
                yield lang, text.take(pa.array(at)), n[at]
                continue
            node, phrase, path, frequent = word, text, _fold(xxhash.xxh64_intdigest(lang), word_hash), None
            for level in range(2, high + 1):
                if level == low:  # nodes are those of the level above: look each up
                    bit = _bit(path, bits)
                    ok = (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                    frequent = (node > 0) & ok[node].astype(bool)
                    node = np.where(frequent, node, 0)
                span = level - 1
                start = np.flatnonzero(node[: len(word) - span] > 0) if len(word) > span else np.empty(0, np.int64)
                start = start[(word[start + span] > 0) if frequent is None else frequent[start + level - low + 1]]
                key = node[start].astype(np.int64) << 32 | word[start + span]
                if level < high:
                    key, at, n = np.unique(key, return_inverse=True, return_counts=True)
                    node = np.zeros(len(word), np.int32)
                    node[start] = at + 1
                else:
                    key, n = np.unique(key, return_counts=True)
                parent, end = key >> 32, key & 0xFFFFFFFF
                phrase = pyarrow.compute.binary_join_element_wise(phrase.take(pa.array(parent)), text.take(pa.array(end)), " ")
                if level >= low:
                    yield lang, phrase, n
                elif level + 1 == low:
                    path = np.concatenate([np.zeros(1, np.uint64), _fold(path[parent], word_hash[end])])
                phrase = pa.concat_arrays([pa.array([""], pa.string()), phrase])


def _runs(docs: DataFrame, low: int, high: int, known: Broadcast | None, shard_words: int, bits: int) -> DataFrame:
    """The sorted runs of all shards, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(known.value, np.uint8) if known else None

        def flushed(shard: Shard) -> Iterator[pa.RecordBatch]:
            for lang, phrase, n in shard.tries(low, high, bitmap, bits):
                for at in range(0, len(n), 50_000):
                    path = pyarrow.compute.binary_join_element_wise(lang, phrase.slice(at, 50_000), "\t")
                    yield pa.RecordBatch.from_arrays([path, pa.array(n[at : at + 50_000], pa.int64())], names=["path", "n"])

        shard = Shard()
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, own in texts.items():
                shard.add(lang, own)
            if shard.words >= shard_words:
                yield from flushed(shard)
                shard = Shard()
        yield from flushed(shard)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(run, _RUN), f"phrase-runs-{low}", **_CODED)


def _lang() -> Column:
    return F.expr("substr(path, 1, length(path) - length(substring_index(path, '\\t', -1)) - 1)").alias("lang")


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Runs merged by ranges of paths: lang, phrase, a of those that reach least."""
    merged = runs.repartitionByRange("path").groupBy("path").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    return merged.select(_lang(), F.substring_index("path", "\t", -1).alias("phrase"), "a")


def _bitmap(frequent: DataFrame, bits: int) -> bytes:
    """A bit per path of the table (others may share it): pages are put together by Spark, so what is collected has `bits` bits, however long the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = np.zeros(len(batch), np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                path = xxhash.xxh64_intdigest(lang)
                for w in phrase.encode().split(b" "):
                    path = _fold(path, xxhash.xxh64_intdigest(w))
                paths[i] = path
            yield pa.RecordBatch.from_arrays([pa.array(_bit(paths, bits) + 1, pa.int64())], names=["bit"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "bit long")
    pages = found.groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bytes")).collect()
    out = bytearray(max(bits // 8, 4096))
    for p in pages:
        out[(p["page"] - 1) * 4096 : p["page"] * 4096] = p["bytes"]
    return bytes(out)


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, shard_words: int = SHARD_WORDS, bits: int = FILTER_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, a) of the frequent phrases of 1, 2, ... depth words, and (lang, n) with the number of words; all written."""
    context = docs.sparkSession.sparkContext
    runs = _runs(docs, 1, 1, None, shard_words, bits)
    total = materialize(runs.groupBy(_lang()).agg(F.sum("n").alias("n")), "phrase-words")
    levels = [materialize(_merged(runs, least), "phrases-1")]
    discard(runs)
    for low, high in ((2, 2), (3, depth)):
        if low > high or low > depth:
            continue
        known = context.broadcast(_bitmap(levels[-1], bits))
        runs = _runs(docs, low, high, known, shard_words, bits)
        found = materialize(_merged(runs, least).withColumn("level", F.size(F.split("phrase", " "))), f"phrases-{low}")
        levels += [found.filter(F.col("level") == level).drop("level") for level in range(low, high + 1)]
        discard(runs)
        known.unpersist()
    return levels, total


def _linked(rows: DataFrame, above: DataFrame, link: str) -> DataFrame:
    """rows joined to the node of the level above that link names; a node with many rows is joined by broadcast."""
    n = rows.groupBy("lang", link).agg(F.count("*").alias("n_rows"))
    groups = n.join(above.withColumnRenamed("phrase", link), ["lang", link])
    return join_groups(rows, groups, ["lang", link], "n_rows", rows.count()).drop("n_rows")


def phrase_parts(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, lefts, rights, longer of the phrases of two and more words.

    lefts[k] and rights[k] are the counts of the parts of a cut after k + 1 words; longer is the largest count of a phrase one word longer around it.
    """
    none = F.array().cast("array<bigint>")
    above, out = levels[0].select("lang", "phrase", "a", none.alias("lefts"), none.alias("rights")), []
    for level in levels[1:]:
        rows = level.select(
            "lang", "phrase", "a", F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)").alias("parent"), F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("suffix")
        )
        left = above.select("lang", "phrase", F.array_append("lefts", F.col("a")).alias("lefts"))
        right = above.select("lang", "phrase", F.array_prepend("rights", F.col("a")).alias("rights"))
        rows = materialize(_linked(_linked(rows, left, "parent"), right, "suffix"), "phrase-links")
        out.append(rows)
        above = rows.select("lang", "phrase", "a", "lefts", "rights")
    nodes = []
    for i, rows in enumerate(out):
        rows = rows.drop("parent", "suffix")
        if i + 1 == len(out):
            nodes.append(rows.withColumn("longer", F.lit(0).cast("long")))
            continue
        told = out[i + 1].select("lang", F.col("parent").alias("phrase"), "a").union(out[i + 1].select("lang", F.col("suffix").alias("phrase"), "a"))
        nodes.append(rows.join(told.groupBy("lang", "phrase").agg(F.max("a").alias("longer")), ["lang", "phrase"], "left").fillna(0, ["longer"]))
    found = nodes[0]
    for more in nodes[1:]:
        found = found.unionByName(more)
    return found


def scored(rows: DataFrame, total: DataFrame, factor: int = FACTOR) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrase_parts' rows: the cut of lowest score, the first of equals."""
    rows = join_dimension(rows, total, "lang", total.count(), F.col("phrase"))
    wide = lambda x: f"cast({x} as decimal(19, 0))"
    cuts = f"""transform(lefts, (l, k) -> struct(
        ({factor} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('rights[k]')}) as score, k as k, l as l, rights[k] as r))"""
    return rows.withColumn("cut", F.expr(f"array_min({cuts})")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, factor: int = FACTOR, share: int = SHARE, shard_words: int = SHARD_WORDS, bits: int = FILTER_BITS
) -> DataFrame:
    """Per language the first `top` phrases by score: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer one around it has `share` per cent of its count: then one of a single word more has it too, for counts fall along the way.
    """
    levels, total = frequent_phrases(docs, depth, least, shard_words, bits)
    rows = scored(phrase_parts(levels).filter(f"100 * longer < {share} * a"), total, factor)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_spread", F.pmod(F.xxhash64("phrase"), F.lit(spread)))
    first = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_spread").orderBy(*order))).filter(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
 FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, m, words[i : i + m - 1] AS path FROM w, range(1, {DEPTH + 1}) t(m), LATERAL (SELECT unnest(range(1, len(words) - m + 2)) AS i)),
f AS MATERIALIZED (SELECT lang, m, path, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
o AS MATERIALIZED (SELECT * FROM f WHERE c >= {LEAST}),
cut AS (SELECT x.lang, x.m, x.path, x.c AS a, n.n, l.c AS l, r.c AS r, k, ({FACTOR}::HUGEINT * x.c * n.n) // (l.c::HUGEINT * r.c) AS score
 FROM o x, range(1, {DEPTH}) t(k), o l, o r, n WHERE k < x.m AND l.lang = x.lang AND r.lang = x.lang AND n.lang = x.lang AND l.path = x.path[1 : k] AND r.path = x.path[k + 1 :]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, path ORDER BY score, k) = 1),
inner_of AS (SELECT DISTINCT lang, path[i : i + m - 1] AS path, m, c FROM (SELECT lang, path, c, len(path) AS whole FROM o) y, range(2, {DEPTH}) t(m), LATERAL (SELECT unnest(range(1, whole - m + 2)) AS i) WHERE m < whole),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_of i WHERE i.lang = b.lang AND i.path = b.path AND 100 * i.c >= {SHARE} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(path, ' ')) AS rank, array_to_string(path, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
