"""Near copies by the share of shingles in common, for the pipeline: pairs at SHARE or above are found, each checked exactly.

A text is the set of its shingles, as 64-bit hashes. Equal sets are folded to one node. Of each set the least values under BANDS * ROWS
multiplications are taken, and each ROWS of them make a key: two sets with a share s in common have one such value in common with
probability s, and some key with 1 - (1 - s ** ROWS) ** BANDS. At a share of 0.8 a pair goes unseen once in 2.7e8, at 0.9 once in 1e21.
What meets in a key is compared by a sketch first, a bit of each least value: sets at 0.8 differ in a tenth of these bits, and in over a
fifth (UNLIKE) once in 1e10; texts that merely share a passage differ in more. What is left is checked by the sets themselves, made
anew from the two texts.

A group of many copies is not checked pair by pair. First each node is checked against one node only, of those that stand in its keys the one that
meets most others, for that is what copies were made of. Then only nodes are left that still meet one of another component in a key. They are
compared in cells, two blocks of a key's nodes each, whatever the size of the key; a pair is compared in the first of its keys, and only
links leave a cell. No meeting is left out.

SimHash's links within 4 bits, found by Golay keys as in operator 3, count as well, whatever the share of such a pair.

Rows are told apart by doc_id and 128 hash bits of their text, so rows that repeat an id have each their own fate.

Defined results: texts without a word (null, empty) resemble nothing, so those rows stay; a text shorter than a shingle is one
shingle; of a group the row of smallest doc_id stays, null ids last, and of equal ids the text of the smaller hash; rows that
repeat both id and text are one; an empty table gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, materialize, release
from .components import components
from .simhash import _BYTE_BITS, PIPELINE_SHINGLE, SEED, group_links

#: Two sets are linked where common shingles are at least SHARE[0] / SHARE[1] of all of both.
SHARE = (4, 5)
#: Keys of a set, and the least values in each.
BANDS, ROWS = 64, 6
#: Odd multipliers, one per least value; and the most shingles that are multiplied at once.
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 2048
#: A sketch's longs, the bit of a value that it takes, and the most bits in which sketches of a pair may differ.
SKETCH, _BIT, UNLIKE = BANDS * ROWS // 64, np.uint64(20), BANDS * ROWS // 5
#: Shingles of a block, on average; a longer text is as long as it is.
BLOCK = 200_000


def hashes(data: bytes, shingle: int = PIPELINE_SHINGLE) -> np.ndarray:
    """Of each shingle of a UTF-8 text, in the text's order."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.int64)
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    ends = stop[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    starts, digest = (stop - size).tolist(), xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64).view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a text's hashes as a signed long, the same as simhash.fingerprint."""
    octets = found.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def _node(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.empty(0, np.int64), *found])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat, pa.int64()))


def _hashes(batch: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    return [hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column("text")]


def _sets(batch: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    return [np.unique(h) for h in _hashes(batch, shingle)]


def band_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BANDS keys and the sketch (as longs) of a set that is not empty; the empty one has none."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, least = found.view(np.uint64), None
    for at in range(0, len(x), _STEP):
        own = np.multiply.outer(x[at : at + _STEP], _TIMES).min(0)
        least = own if least is None else np.minimum(least, own)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        key = (key ^ value) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64), np.packbits((least >> _BIT & np.uint64(1)).astype(np.uint8)).view(np.int64)


#: A row's identity beside doc_id.
_TEXT = ("__ta", "__tb")


def _with_hashes(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.xxhash64(F.lit(k), F.col("text")) for k, c in enumerate(_TEXT)})


def _mark(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row of docs (doc_id, text, text hashes): doc_id, text hashes, fp, node (hash of its set), size, keys, sketch."""
    passed = ("doc_id", *_TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _hashes(batch, shingle)
            fps, found = pa.array([fingerprint(h) for h in every], pa.int64()), [np.unique(h) for h in every]
            nodes, sizes = pa.array([_node(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32())
            keyed = [band_keys(s) for s in found]
            columns = [*(batch.column(c) for c in passed), fps, nodes, sizes, _lists([k for k, _ in keyed]), _lists([k for _, k in keyed])]
            yield pa.RecordBatch.from_arrays(columns, names=[*passed, "fp", "node", "size", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*passed, "text").mapInArrow(run, f"doc_id {kind}, {_TEXT[0]} long, {_TEXT[1]} long, fp long, node long, size int, keys array<long>, sketch array<long>")


def _alike(a: str, b: str) -> Column:
    """Whether sets of these sizes can have SHARE in common."""
    return F.least(a, b) * SHARE[1] >= F.greatest(a, b) * SHARE[0]


def _likely(a: Column, b: Column) -> Column:
    """Whether sketches differ in no more bits than those of a pair do."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH)), F.lit(0)) <= UNLIKE


def _texts_of(nodes: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of some nodes (node); written."""
    one = distinct.join(nodes.distinct(), "node", "left_semi").select("node", F.col("least.doc_id").alias("__id"), *[F.col(f"least.{c}").alias(f"{c}x") for c in _TEXT])
    same = docs["doc_id"].eqNullSafe(one["__id"])
    for c in _TEXT:
        same &= docs[c] == one[f"{c}x"]
    return materialize(docs.join(one, same).select("node", "text").dropDuplicates(["node"]), "near-texts")


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have SHARE in common; written. Rows of one v come in a row, so its set is made once for them."""
    side = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, np.empty(0, np.int64)
        for batch in batches:
            u, v, found = batch.column("u").to_pylist(), batch.column("v").to_pylist(), []
            for k in range(len(batch)):
                if v[k] != last:
                    last, other = v[k], np.unique(hashes(batch.column("text_v")[k].as_buffer().to_pybytes(), shingle))
                own = np.unique(hashes(batch.column("text_u")[k].as_buffer().to_pybytes(), shingle))
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common * sum(SHARE) >= (len(own) + len(other)) * SHARE[0]:
                    found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in found], pa.int64()) for x in (u, v)], names=["u", "v"])

    out = materialize(both.mapInArrow(run, "u long, v long"), "near-links")
    release(out.sparkSession)
    return out


def _met_in_cells(rows: DataFrame, distinct: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) of nodes (key, node, root, size) that share a key, are of unlike roots and have SHARE in common; written.

    A key's nodes are dealt to blocks by their sizes, and each two blocks are a cell, which gets its nodes' texts. Sets are made of those that are compared.
    """
    blocks = rows.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("first"), F.greatest(x, "block").alias("second")))
    dealt = rows.join(blocks, "key").withColumn("block", own).withColumn("cell", F.explode(cells))
    held = dealt.select("key", "cell.first", "cell.second", "block", "node", "root").join(distinct.select("node", "keys", "sketch").join(texts, "node"), "node")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = np.flatnonzero(frame["block"] == frame["first"]), np.flatnonzero(frame["block"] == frame["second"])
        node, root, same = frame["node"].to_numpy(), frame["root"].to_numpy(), frame["first"].iloc[0] == frame["second"].iloc[0]
        sketch, keys, text = np.stack(frame["sketch"].to_numpy()).view(np.uint64), np.stack(frame["keys"].to_numpy()), frame["text"].to_numpy()
        here, sets, found = int(np.flatnonzero(keys[0] == frame["key"].iloc[0])[0]), {}, []

        def made(i: int) -> frozenset:
            if i not in sets:
                sets[i] = frozenset(hashes(text[i].encode(), shingle).tolist())
            return sets[i]

        for i in left.tolist():
            others = right[(root[right] != root[i]) & ((node[right] > node[i]) | (not same))]
            others = others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(1) <= UNLIKE]
            others = others[(keys[others] == keys[i]).argmax(1) == here]
            for j in others.tolist():
                a, b = made(i), made(j)
                if min(len(a), len(b)) * SHARE[1] >= max(len(a), len(b)) * SHARE[0] and len(a & b) * sum(SHARE) >= (len(a) + len(b)) * SHARE[0]:
                    found.append((node[i], node[j]))
        return pd.DataFrame(found, columns=["u", "v"], dtype=np.int64)

    out = materialize(held.groupBy("key", "first", "second").applyInPandas(cell, "u long, v long"), "near-cells")
    release(out.sparkSession)
    return out


def _foremost(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(u, v): of each node's hubs (node, size, hub, hub_size) that are alike in size the one that it meets in most keys, if their sketches are alike."""
    met = pairs.filter(F.col("node") != F.col("hub")).filter(_alike("size", "hub_size")).groupBy("node", "hub").agg(F.count("*").alias("common"))
    best = met.groupBy("node").agg(F.max_by("hub", F.struct("common", "hub")).alias("hub")).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    side = lambda name: distinct.select(F.col("node").alias(name), F.col("sketch").alias(f"sketch_{name}"))
    return best.join(side("u"), "u").join(side("v"), "v").filter(_likely(F.col("sketch_u"), F.col("sketch_v"))).select("u", "v")


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, node, size, root) of keys that hold several components; written."""
    roots = components(links)
    named = members.select("key", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    mixed = materialize(mixed, "near-mixed")
    rows = materialize(named.join(mixed, "key"), "near-apart")
    discard(mixed)
    release(rows.sparkSession)
    return rows


def near_links(distinct: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Pairs (u, v) of nodes with SHARE in common, enough of them to connect all that such pairs connect."""
    spark = distinct.sparkSession
    keys = distinct.select("node", "size", F.explode("keys").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-keys")
    #: Joins of keys' rows to a row per key: adaptive execution splits the keys of large groups.
    found = materialize(keys.join(shared, "key"), "near-found")
    met = found.groupBy("node").agg(F.sum(F.col("n") - 1).alias("met"))
    members = materialize(found.join(met, "node"), "near-members")
    discard(shared, found)
    release(spark)
    texts = _texts_of(members.select("node"), distinct, docs)
    release(spark)

    hubs = members.groupBy("key").agg(F.max(F.struct("met", "node", "size")).alias("h"))
    hubs = materialize(hubs.select("key", F.col("h.node").alias("hub"), F.col("h.size").alias("hub_size")), "near-hubs")
    links = _checked(_foremost(members.join(hubs, "key"), distinct), texts, shingle)
    rows = _apart(members, links)
    discard(hubs, members)

    drawn = materialize(rows.join(distinct.select("node", "sketch"), "node"), "near-drawn")
    one, other = drawn.alias("a"), drawn.alias("b")
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _alike("a.size", "b.size") & _likely(F.col("a.sketch"), F.col("b.sketch"))
    meeting = materialize(one.join(other, meet, "left_semi").drop("sketch"), "near-meeting")
    rest = _met_in_cells(meeting, distinct, texts, shingle)
    discard(rows, drawn, meeting, texts)
    return links.union(rest)


def bit_links(marked: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that connect what fingerprints within 4 bits connect."""
    known = marked.select("node", "fp").distinct()
    first = materialize(known.groupBy("fp").agg(F.min("node").alias("rep")), "near-fingerprints")
    same = known.join(first, "fp").select(F.col("node").alias("u"), F.col("rep").alias("v")).filter("u <> v")
    near, a, b = group_links(first.select("fp")), first.toDF("u", "a"), first.toDF("v", "b")
    return same.union(near.distinct().join(a, "u").join(b, "v").select("a", "b"))


def drop_near_copies(docs: DataFrame, shingle: int = PIPELINE_SHINGLE) -> DataFrame:
    """docs without the rows that have a near copy which goes before them; its columns as they are."""
    own = _with_hashes(docs)
    worded = own.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "text", *_TEXT)
    whole = materialize(_mark(worded, shingle), "near-marked")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *_TEXT)
    alike = whole.groupBy("node").agg(F.min(row).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count("*").alias("n"))
    distinct, marked = materialize(alike, "near-distinct"), whole.drop("size", "keys", "sketch")
    release(docs.sparkSession)
    links = near_links(distinct, worded, shingle)
    more = materialize(bit_links(marked), "near-bits")
    release(docs.sparkSession)
    roots = components(links.union(more))
    placed = materialize(distinct.select("node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    best = placed.groupBy("root").agg(F.min("least").alias("best"))
    groups = materialize(placed.join(best, "root").select("node", "best", "n"), "near-groups")
    discard(distinct, placed)
    release(docs.sparkSession)
    placed_rows = join_groups(marked.select("doc_id", *_TEXT, "node"), groups, ["node"], "n").select(row.alias("row"), "best")
    dropped = placed_rows.filter("row <> best").select(F.col("row.doc_id").alias("__id"), *[F.col(f"row.{c}").alias(f"{c}x") for c in _TEXT]).distinct()
    same = own["doc_id"].eqNullSafe(dropped["__id"])
    for c in _TEXT:
        same &= own[c] == dropped[f"{c}x"]
    out = own.join(dropped, same, "left_anti")
    if not marked.groupBy("doc_id", *_TEXT).count().filter("count > 1").isEmpty():
        bare = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
        out = out.filter(bare).unionByName(out.filter(~bare).dropDuplicates(["doc_id", *_TEXT]))
    return out.drop(*_TEXT)
