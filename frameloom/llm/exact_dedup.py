"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts (white-space runs replaced by one space) are cut into blocks of fixed size. The distinct blocks are sorted by their keys and
numbered, so that a block's name is its rank, whatever the number of partitions; then adjacent names are paired and the
distinct pairs sorted and numbered again, until each document has one name. Equal names mean equal texts, and nothing else does.

The blocks themselves are shuffled once, deduplicated before the shuffle, to find the distinct ones. Rows refer to a block by
its key of 128 hash bits, which is safe only while no two distinct blocks share one: that is counted on every run over all the
blocks, and the hash is drawn again with another salt should it ever happen, so identities stay free of collisions. Blocks,
pairs and texts that make up over a thousandth of all rows are joined by broadcast, so that none of them is a hot key.

Defined results: null and empty texts are equal; rows repeating both doc_id and text are copies of which one stays; a null
doc_id is last among the candidates to stay; empty tables give empty results; other columns are not looked at, and
drop_exact_copies passes them through whatever their names.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, join_groups, materialize, numbered

BLOCK_CHARS = 8192


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _blocks(text: Column, size: int) -> Column:
    """The text's blocks of size characters; the empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _keys(block: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * salt), block), F.xxhash64(F.lit(2 * salt + 1), block)]


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: uid, doc_id, text_sha256 (of the normalised text), level, name. Texts are equal when level and name are."""
    text = docs.select("doc_id", normalized(F.col("text")).alias("text"))
    for salt in count():
        blocks = text.select(F.explode(_blocks(F.col("text"), block_chars)).alias("block"))
        a, b = _keys(F.col("block"), salt)
        distinct = blocks.groupBy("block").agg(F.first(a).alias("a"), F.first(b).alias("b"), F.count("*").alias("rows"))
        names = numbered(distinct.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")), "a", "b", tag="block-names")
        if names.filter("n > 1").isEmpty():
            break
    keys = F.transform(_blocks(F.col("text"), block_chars), lambda x: F.struct(*[k.alias(c) for k, c in zip(_keys(x, salt), "ab", strict=True)]))
    rows = materialize(text.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2("text", 256).alias("text_sha256"), keys.alias("keys")), "block-keys")

    at = rows.select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("i", "key")).select("uid", "n", "i", F.col("key.a"), F.col("key.b"))
    level, named = 0, materialize(join_groups(at, names.drop("n"), ["a", "b"], "rows").select("uid", "n", "i", "name"), "block-level")
    done = []
    while True:
        done.append(named.filter("n = 1").select("uid", F.lit(level).alias("level"), "name"))
        if named.filter("n > 1").isEmpty():
            break
        pairs = named.filter("n > 1").groupBy("uid", F.expr("i div 2").cast("int").alias("i")).agg(
            F.expr("int((max(n) + 1) div 2)").alias("n"), F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        pairs = materialize(pairs, "block-pairs")
        names = numbered(pairs.groupBy("left", "right").agg(F.count("*").alias("rows")), "left", "right", tag="pair-names")
        level, named = level + 1, materialize(join_groups(pairs, names, ["left", "right"], "rows").select("uid", "n", "i", "name"), "block-level")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return rows.drop("keys").join(found, "uid")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    named = materialize(identities(docs, block_chars), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    groups = materialize(named.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("group_size")), "text-groups")
    return join_groups(named, groups, ["level", "name"], "group_size").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that exact_groups does not keep; its columns as they are.

    Kept rows are found by id; rows that repeat an id with one text collapse to one, and rows with null ids are compared
    by text among themselves.
    """
    kept = exact_groups(docs, block_chars).filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha")).distinct()
    sha = F.sha2(normalized(docs["text"]), 256)
    out = docs.withColumn("__sha", sha)
    out = out.join(kept, out["doc_id"].eqNullSafe(kept["__kept_id"]) & (out["__sha"] == kept["__kept_sha"]), "left_semi")
    repeats = docs.groupBy("doc_id").count().filter("count > 1")
    if not repeats.isEmpty():
        out = out.dropDuplicates(["doc_id", "__sha"])
    return out.drop("__sha")


OP7_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
 doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
