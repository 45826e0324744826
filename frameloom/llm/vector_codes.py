"""Vector code compression: each of a vector's parts becomes the index of its nearest codebook entry, found in a kd-tree.

Components are scaled to integers and vectors cut into equal parts, each with a codebook of its own. A round broadcasts one kd-tree per
codebook (a codebook has at most ENTRIES entries, whatever the input), assigns every part, and sums the parts of each entry as
integers: a task adds up what it has read, so it sends one row per entry and part. Integer sums don't depend on the order of rows, so reruns agree.

The search is branch and bound, for all of a batch's parts at once. Each part first goes down to its home leaf; then leaves are swept,
and a part visits every node whose box is no farther than its best entry so far. A box just as far is visited too, for an entry of
lower index may stand at the same distance.

Rounds read the input again; nothing but codebooks passes from one to the next, so a lost executor costs its tasks of one round.

Defined results: vectors that are null or hold null or non-finite components take no part. Of the others, the row with the smallest id
(a null id is last) and a length that can be cut sets the length; vectors of another length take no part. Fewer rows than
entries make smaller codebooks; rows that repeat an id are rows each, the smaller vector first in the codebook; equal entries stay, and
the lower index wins. Scaled components beyond the bound that keeps distances in 64 bits (2 ** 27 at 64 components) are held there.
No rows, no result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_dimension, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a kd-tree's leaf.
LEAF = 8


@dataclass
class Node:
    """A box around entries; a leaf holds them, an inner node has two halves, cut at a value of one dimension."""

    low: np.ndarray
    high: np.ndarray
    axis: int = -1
    cut: int = 0
    halves: tuple[Node, Node] | None = None
    entries: np.ndarray | None = None


def kd_tree(codebook: np.ndarray, members: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """The tree over a codebook's entries, cut at the median of the widest dimension; entries alike in all dimensions stay together."""
    members = np.arange(len(codebook)) if members is None else members
    own = codebook[members]
    node = Node(own.min(0), own.max(0))
    width = node.high - node.low
    if len(members) <= leaf or not width.any():
        node.entries = members
        return node
    node.axis = int(width.argmax())
    values = np.sort(own[:, node.axis])
    node.cut = int(values[np.searchsorted(values, values[len(values) // 2])])
    if node.cut == values[0]:
        node.cut = int(values[np.searchsorted(values, node.cut, side="right")])
    below = own[:, node.axis] < node.cut
    node.halves = (kd_tree(codebook, members[below], leaf), kd_tree(codebook, members[~below], leaf))
    return node


class Search:
    """Nearest entries of a codebook, ties to the lower index, and a count of the distances that were taken."""

    def __init__(self, codebook: np.ndarray, tree: Node):
        self.codebook, self.tree, self.taken = codebook, tree, 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) per row of points."""
        self.points = points
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.index = np.full(len(points), len(self.codebook))
        rows = np.arange(len(points))
        self._home(self.tree, rows)
        self._sweep(self.tree, rows)
        return self.index, self.best

    def _look(self, node: Node, rows: np.ndarray) -> None:
        for e in node.entries:
            off = self.points[rows] - self.codebook[e]
            far = np.einsum("ij,ij->i", off, off)
            better = (far < self.best[rows]) | ((far == self.best[rows]) & (e < self.index[rows]))
            self.best[rows[better]], self.index[rows[better]] = far[better], e
        self.taken += len(rows) * len(node.entries)

    def _home(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.halves is None:
            self._look(node, rows)
            return
        below = self.points[rows, node.axis] < node.cut
        self._home(node.halves[0], rows[below])
        self._home(node.halves[1], rows[~below])

    def _sweep(self, node: Node, rows: np.ndarray) -> None:
        own = self.points[rows]
        off = np.maximum(node.low - own, 0) + np.maximum(own - node.high, 0)
        rows = rows[np.einsum("ij,ij->i", off, off) <= self.best[rows]]
        if not len(rows):
            return
        if node.halves is None:
            self._look(node, rows)
            return
        for half in node.halves:
            self._sweep(half, rows)


def bound(length: int) -> int:
    """The largest component of which the squared distances of a vector of this length stay in 64 bits."""
    return 1 << ((62 - (length - 1).bit_length()) // 2 - 1)


def scaled(vectors: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as integers) of a batch of vectors."""
    sizes = pyarrow.compute.fill_null(pyarrow.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(right)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    finite = np.isfinite(values).all(1)
    most = bound(length)
    return right[finite], np.floor(np.clip(values[finite] * scale, -most, most)).astype(np.int64)


def _usable(vector: Column) -> Column:
    """Whether a vector takes part, its length aside."""
    bad = F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce(~bad, F.lit(False))


def first_vectors(vectors: DataFrame, entries: int, parts: int) -> list[list[float]]:
    """The usable vectors of the smallest ids, all as long as the first of them: at most `entries` rows, whatever the table."""
    v, i = F.col("embedding"), F.col("vec_id")
    rows = vectors.select("vec_id", "embedding").filter(_usable(v) & (F.size(v) > 0) & (F.size(v) % parts == 0))
    order = [i.isNull(), i, v]
    first = rows.orderBy(*order).select(F.size(v).alias("n")).first()
    if first is None:
        return []
    return [r["embedding"] for r in rows.filter(F.size(v) == first["n"]).orderBy(*order).limit(entries).collect()]


def _sums(vectors: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """A round: the codebooks after every part was assigned and each entry replaced by the floored mean of its parts."""
    spark, parts, width = vectors.sparkSession, len(books), books[0].shape[1]
    shared = spark.sparkContext.broadcast([(b, kd_tree(b)) for b in books])
    names = [f"s{d}" for d in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Search(b, t) for b, t in shared.value]
        total = np.zeros((parts, *search[0].codebook.shape), np.int64)
        n = np.zeros(total.shape[:2], np.int64)
        high = np.zeros_like(total)
        for batch in batches:
            _, points = scaled(batch.column(0), parts * width, scale)
            for p, s in enumerate(search):
                own = points[:, p * width : (p + 1) * width]
                at, _ = s.nearest(own)
                np.add.at(total[p], at, own)
                n[p] += np.bincount(at, minlength=len(n[p]))
            carry = total >> 40
            high += carry
            total -= carry << 40
        p, e = np.nonzero(n)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64())]
        columns += [pa.array(x[p, e, d], pa.int64()) for x in (total, high) for d in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *names, *[f"h{x}" for x in names]])

    schema = "part int, entry int, n long, " + ", ".join(f"{x} long" for x in [*names, *[f"h{x}" for x in names]])
    sent = vectors.select("embedding").mapInArrow(run, schema)
    rows = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in sent.columns[3:]]).collect()  # a row per entry and part
    out = [b.copy() for b in books]
    for r in rows:
        out[r["part"]][r["entry"]] = [(r[x] + (r[f"h{x}"] << 40)) // r["n"] for x in names]
    shared.unpersist()
    return out


def _assigned(vectors: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """vec_id, label, code, error of the rows that take part."""
    parts, width = len(books), books[0].shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast([(b, kd_tree(b)) for b in books])
    ids, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Search(b, t) for b, t in shared.value]
        for batch in batches:
            rows, points = scaled(batch.column(2), parts * width, scale)
            found = [s.nearest(points[:, p * width : (p + 1) * width]) for p, s in enumerate(search)]
            code = [bytes(x).hex() for x in np.stack([f[0] for f in found], 1).astype(np.uint8).tolist()]
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
            keep = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {ids}, label {label}, code string, error long")


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The fitted codebooks, one per part: arrays of integers, a row per entry. Empty if no vector takes part."""
    first = first_vectors(vectors, entries, parts)
    if not first:
        return []
    _, start = scaled(pa.array(first, pa.list_(pa.float64())), len(first[0]), scale)
    books = np.split(start, parts, axis=1)
    for _ in range(rounds):
        books = _sums(vectors, books, scale)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label) that takes part: vec_id, code, error, label_error, codebooks_sha256.

    At most 256 entries, for an index is two hex digits of the code.
    """
    books = codebooks(vectors, parts, entries, rounds, scale)
    if not books:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(_assigned(vectors, books, scale), "vector-codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    rows = join_dimension(coded, sums, "label", sums.count(), F.col("vec_id"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(r: int) -> str:
    """The assignment of round r over codebooks b{r}, and the codebooks after it."""
    return f"""
a{r} AS MATERIALIZED (SELECT vec_id, p, part, min({{'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS best
 FROM x JOIN b{r} USING (p) GROUP BY ALL),
t{r} AS (SELECT p, best.e AS e, generate_subscripts(part, 1) AS i, unnest(part) AS c FROM a{r}),
m{r} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM t{r} GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(got, entry) AS entry FROM b{r} LEFT JOIN
 (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS got FROM m{r} GROUP BY ALL) g USING (p, e))"""


OP13_SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, c[p * (len(c) // {PARTS}) + 1 : (p + 1) * (len(c) // {PARTS})] AS part FROM v, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM x
 QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}),
{",".join(_round_sql(r) for r in range(ROUNDS + 1))},
o AS (SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), h
"""
