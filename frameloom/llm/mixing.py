"""Mixing sources to target weights, in DataFrame operations only.

Word counts are aggregated per source, each source gets a target by water-filling, and the target over the source's size is
its repetition rate. A document is taken floor(rate) times, plus once more with probability equal to the fraction, decided by
a hash of its id: reruns agree, and no state leaves the row.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that repeat a doc_id share
one decision; with no words at all every target is 0 and nothing is taken; an empty table gives an empty result; further
columns pass through mix_documents untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_dimension, materialize, numbered, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source of (source, source_size) with its target and rate.

    Weights repeat along the sources in code-point order, null last. Targets share the total by weight and stop at cap times
    the source's size; what that frees goes to the others by weight until none is above. Each round is one aggregation over the
    sources: the level that is left for those not stopped yet; it only rises, and a round that stops none is the last. Sources may be as many as
    sites: they are numbered by ranges, and no task sees all of them.
    """
    order = F.struct(F.col("source").isNull().alias("none"), "source")
    ranked = numbered(sizes.withColumn("__by", order), "__by", tag="mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("name") % len(weights) + 1).cast("int"))
    most = F.lit(float(cap)) * F.col("source_size")
    known = materialize(ranked.select("source", "source_size", weight.alias("weight"), most.alias("most")), "mix-weights")
    level, before = 0.0, -1
    while True:
        held = F.col("most") < level * F.col("weight")
        total, stopped, rest, n = known.agg(F.sum("source_size"), F.sum(F.when(held, F.col("most")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))), F.count_if(held)).first()
        if n == before or not rest:
            break
        level, before = (total - stopped) / rest, n
    target = F.least("most", F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return known.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) drawn from 52 bits of a hash of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _copies(doc_id: Column, rate: Column, seed: int) -> Column:
    return (F.floor(rate) + (uniform(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mixing_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    planned = join_dimension(sized, targets, "source", targets.count(), F.col("doc_id"))
    return planned.withColumn("copies", _copies(F.col("doc_id"), F.col("rate"), seed)).withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs, all its columns, as often as its source's rate takes it."""
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets").select("source", F.col("rate").alias("__mix_rate"))
    planned = join_dimension(docs, targets, "source", targets.count(), F.col("doc_id"))
    copies = _copies(F.col("doc_id"), F.col("__mix_rate"), seed).cast("int")
    return planned.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(True), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


OP1_SQL = """
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
 per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
 ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth, 3.0::DOUBLE * source_size AS most FROM per),
 weighed AS (SELECT *, CAST([5, 2, 1][CAST(nth % 3 AS INT) + 1] AS DOUBLE) AS weight FROM ranked),
 levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
   FROM weighed WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 targets AS (SELECT source, source_size, least(most, weight * max(CASE WHEN level * weight <= most THEN level END) OVER ()) AS target FROM levels),
 rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
 CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""
