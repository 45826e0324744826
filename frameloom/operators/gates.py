"""Checks as rows: issues of a corpus, gates over figures, verdicts over gates, consent and capture sessions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import CONSENT_ID, session_parts

#: Fixed order of severities, and of verdicts.
SEVERITY = {"info": 0, "warning": 1, "critical": 2}
VERDICT = {"PASS": 0, "WARN": 1, "FAIL": 2}


def rank_of(name: Column, order: Mapping[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in order.items() for x in (k, v)]), name)


def issues(*found: tuple[DataFrame, str, str, Column]) -> DataFrame:
    """Union of checks (rows, check, severity, message) as (check, severity, message)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message")) for df, check, severity, message in found])


def qa_summary(found: DataFrame, checks: DataFrame) -> DataFrame:
    """Per check, those without an issue too: issues, criticals, warnings, and status by the worst severity."""
    n = found.groupBy("check").agg(F.count("*").alias("issues"), *[F.count_if(F.col("severity") == s).alias(k) for k, s in (("criticals", "critical"), ("warnings", "warning"))], F.max(rank_of(F.col("severity"), SEVERITY)).alias("_worst"))
    status = F.when(F.col("_worst") == 2, "FAIL").when(F.col("_worst") == 1, "WARN").otherwise("PASS")
    none = F.lit(0).cast("long")
    return checks.select("check").join(n, "check", "left").select("check", *[F.coalesce(c, none).alias(c) for c in ("issues", "criticals", "warnings")], status.alias("status"))


def top_issues(found: DataFrame, n: int = 50) -> DataFrame:
    """The n worst, in order of severity, then of discovery (seq): a report's limit."""
    return found.orderBy(rank_of(F.col("severity"), SEVERITY).desc(), "seq").limit(n)


def exit_code(summary: DataFrame) -> DataFrame:
    """One row: 1 if anything is critical, 2 if there are warnings, else 0."""
    return summary.agg(F.when(F.coalesce(F.sum("criticals"), F.lit(0)) > 0, 1).when(F.coalesce(F.sum("warnings"), F.lit(0)) > 0, 2).otherwise(0).alias("code"))


def gate(figures: DataFrame, gate_id: str, passes: Column, value: Column, warn: Column | None = None) -> DataFrame:
    """One row (gate_id, verdict, value) from a table of one row of figures; unknown figures fail."""
    verdict = F.when(F.coalesce(passes, F.lit(False)), "PASS")
    verdict = verdict if warn is None else verdict.when(F.coalesce(warn, F.lit(False)), "WARN")
    return figures.select(F.lit(gate_id).alias("gate_id"), verdict.otherwise("FAIL").alias("verdict"), value.cast("double").alias("value"))


def fold_verdicts(gates: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """One row: FAIL over WARN over PASS, skipped gates left out, of the required gates only if they are named."""
    own = gates if required is None else gates.filter(F.col("gate_id").isin(*required))
    worst = F.coalesce(F.max(rank_of(F.col("verdict"), VERDICT)), F.lit(0))
    return own.filter(F.col("verdict").isin(*VERDICT)).agg(F.count("*").alias("gates"), F.element_at(F.array(*[F.lit(v) for v in VERDICT]), worst + 1).alias("verdict"))


def consent_problems(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    """(session, problem), all that apply: missing, malformed, unknown, withdrawn, house. sessions: session, house_id, consent_id; registry: consent_id, house_id, withdrawn.

    An empty registry is no ground to call an id unknown.
    """
    filled = registry.limit(1).select(F.lit(True).alias("_filled"))
    known = registry.select("consent_id", F.col("house_id").alias("_house"), "withdrawn", F.lit(True).alias("_known"))
    both = sessions.join(known, "consent_id", "left").join(F.broadcast(filled), F.lit(True), "left")
    given = F.coalesce(F.col("consent_id"), F.lit("")) != ""
    found = F.array_compact(
        F.array(
            F.when(~given, "missing"), F.when(given & ~F.col("consent_id").rlike(CONSENT_ID), "malformed"),
            F.when(given & F.col("_known").isNull() & F.col("_filled").isNotNull(), "unknown"), F.when(F.col("withdrawn"), "withdrawn"),
            F.when(F.col("_house") != F.col("house_id"), "house"),
        )
    )
    return both.select("session", F.explode(found).alias("problem"))


def withdrawn_sessions(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    return sessions.join(registry.filter("withdrawn").select("consent_id"), "consent_id").select("session", "consent_id")


def bad_session_names(sessions: DataFrame, rooms: Sequence[str]) -> DataFrame:
    """Sessions whose name is none, or names a room that is not known."""
    parts = session_parts(F.col("session"))
    return sessions.select("session", F.when(parts.isNull(), "name").when(~parts["room"].isin(*rooms), "room").alias("problem")).filter("problem is not null")


def session_rollup(sessions: DataFrame, counts: DataFrame) -> DataFrame:
    """Per class over sessions: boxes in all and sessions that have it. sessions: session, images; counts: session, class_id, n."""
    return counts.join(sessions.select("session"), "session", "left_semi").groupBy("class_id").agg(F.sum("n").alias("boxes"), F.countDistinct("session").alias("sessions"))


def capture_progress(sessions: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target (class_id, target): count, pending, met. sessions: class_id, n."""
    n = sessions.groupBy("class_id").agg(F.sum("n").alias("count"))
    both = targets.join(n, "class_id", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    return both.select("class_id", "target", "count", F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("count")).alias("pending"), (F.col("count") >= F.col("target")).alias("met"))


def sequence_numbers(files: DataFrame, existing: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """files with number: after the session's existing ones (session, existing), in order. A window by session, which is a visit's worth of files."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(session).orderBy(*order))
    return files.join(existing, session, "left").withColumn("number", nth + F.coalesce("existing", F.lit(0))).drop("existing")


def missing_objects(lock: DataFrame, store: DataFrame) -> DataFrame:
    """Locked objects (md5) that the store does not list, each once."""
    return lock.select("md5").dropDuplicates(["md5"]).join(store.select("md5"), "md5", "left_anti")
