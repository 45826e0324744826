"""Exact top-k search by inner product, with the three phases of a uniform threshold.

A vector is cut into LISTS slices; a pair's score is the sum of its slices' scores, and each slice has a local score list per
query. Phase 1 takes every list's local best and resolves them exactly: the (k+1)-th best of these is a safe cutoff t, for so
many pairs reach it. Phase 2 sends t to every list, which answers with its entries of t / LISTS and more: a pair that
reaches t must be among them in one list at least. Phase 3 resolves the pairs that answered exactly, and keeps those that reach t.

Lists are computed in cells of a bounded number of queries and candidates, each a task's matrix products. All lists of a block of
candidates stand in one cell, so what phases 1 and 2 gather is summed there, before any shuffle: phase 1 sends k+1 rows
a query and cell at most, and phase 2 only pairs whose whole score reaches the cutoff, k+1 a query and its ties, whatever the number of
candidates. The products themselves grow with queries times candidates, as the stated query set has it.

Equal vectors are one candidate that carries its k+1 smallest ids, and one query, so a vector that makes up a third of the table
is compared once.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; components whose scaled floor
leaves 64 bits are held at its ends; vectors of another length than the query's are no candidates of it; ties go to smaller ids,
equal ids among them by place; repeated rows are candidates each; no candidates, no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

TOP, LISTS, SCALE, QUERY_EVERY = 5, 2, 256, 50
#: Rows of a block's matrix, and its columns.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _valid(vector: Column) -> Column:
    big = F.lit(1.7976931348623157e308)
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= big))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), np.int64).reshape(len(rows), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles, which are faster, where they are exact."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _slices(size: int, lists: int) -> list[slice]:
    return [slice(i * size // lists, (i + 1) * size // lists) for i in range(lists)]


def _cells(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt to cells of (dim, query block, candidate block)."""
    qs, cs = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_candidates // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", block(qs)).withColumn("cb", every(cs))
    right = candidates.withColumn("cb", block(cs)).withColumn("qb", every(qs))
    keys = ["dim", "qb", "cb"]
    return left.select(*keys, F.col("cid").alias("query"), "cutoff", "q"), right.select(*keys, "cid", "q"), keys


def _answers(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, lists: int, best: int | None) -> DataFrame:
    """(query, cid, score): of each cell the `best` resolved pairs of a query among its lists' `best` entries; or all that reach the query's cutoff."""

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query", "cid", "score")})
        a, b = _matrix(left["q"]), _matrix(right["q"])
        parts = [_products(a[:, s], b[:, s]) for s in _slices(a.shape[1], lists)]
        whole = sum(parts[1:], parts[0])
        if best is None:
            cutoff = left["cutoff"].to_numpy(np.int64)[:, None]
            named = np.zeros(whole.shape, bool)
            for part in parts:  # a list answers with what is at its share of the cutoff
                named |= part >= -(-cutoff // lists)
            row, column = np.nonzero(named & (whole >= cutoff))
        else:
            named = np.concatenate([np.argpartition(-part, best - 1, axis=1)[:, :best] if part.shape[1] > best else np.tile(np.arange(part.shape[1]), (len(part), 1)) for part in parts], 1)
            named.sort(1)
            twice = np.zeros(named.shape, bool)
            twice[:, 1:] = named[:, 1:] == named[:, :-1]
            resolved = np.where(twice, np.iinfo(np.int64).min, np.take_along_axis(whole, named, 1))
            order = np.argsort(-resolved.astype(np.float64), axis=1, kind="stable")[:, :best]
            row = np.repeat(np.arange(len(whole)), order.shape[1])
            column, fresh = np.take_along_axis(named, order, 1).ravel(), ~np.take_along_axis(twice, order, 1).ravel()
            row, column = row[fresh], column[fresh]
        return pd.DataFrame({"query": left["query"].to_numpy()[row], "cid": right["cid"].to_numpy()[column], "score": whole[row, column]})

    left, right, keys = _cells(queries, candidates, n_queries, n_candidates)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query long, cid long, score long")


def top_scores(rows: DataFrame, is_query: Column, k: int = TOP, lists: int = LISTS, scale: int = SCALE) -> DataFrame:
    """For rows (vec_id, embedding): query_id, rank, vec_id, score of the k best other rows of each row that is_query picks."""
    good = rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), quantized(F.col("embedding"), scale).alias("q"))
    nth = F.row_number().over(W.partitionBy("q").orderBy("vec_id"))
    few = good.withColumn("n", nth).filter(F.col("n") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    #: A class is named by its smallest id and its vector's hash: ids may repeat over unlike vectors.
    classes = materialize(few.select(F.xxhash64("q", F.element_at("ids", 1)).alias("cid"), "ids", "q", F.size("q").alias("dim")), "vector-classes")
    asking = materialize(good.filter("asks").join(classes, "q").select(F.col("vec_id").alias("query_id"), "cid"), "asking-rows")
    queries = materialize(classes.join(asking.select("cid").distinct(), "cid", "left_semi").select("cid", "q", "dim"), "query-classes")
    n_queries, n_candidates = queries.count(), classes.count()

    bare = queries.withColumn("cutoff", F.lit(0).cast("long"))
    tried = _answers(bare, classes, n_queries, n_candidates, lists, k + 1)
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cid"))
    safe = tried.withColumn("n", place).filter(F.col("n") == k + 1).select(F.col("query").alias("cid"), F.col("score").alias("cutoff"))
    lowest = F.lit(-(1 << 61))  # fewer candidates than asked for: all of them
    bounded = materialize(queries.join(safe, "cid", "left").withColumn("cutoff", F.coalesce("cutoff", lowest)), "cutoffs")
    resolved = _answers(bounded, classes, n_queries, n_candidates, lists, None)

    ranked = resolved.withColumn("n", F.dense_rank().over(W.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("n") <= k + 1)
    entries = ranked.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.col("vec_id")]
    entries = entries.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("n") <= k + 1)
    #: A query's own row is among its class's ids, or beyond the k + 1 smallest and then no entry.
    own = asking.withColumn("at", F.row_number().over(W.partitionBy("cid", "query_id").orderBy(F.lit(0)))).join(entries.withColumnRenamed("query", "cid"), "cid")
    mine = F.row_number().over(W.partitionBy("query_id", "cid", "at", "vec_id").orderBy("n"))
    own = own.withColumn("same", mine).filter(~((F.col("vec_id") == F.col("query_id")) & (F.col("same") == 1)))
    rank = F.row_number().over(W.partitionBy("query_id", "cid", "at").orderBy(*order))
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP2_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
