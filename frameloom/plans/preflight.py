"""Gates before a training run and before a full build, over tables of facts: one row per run or machine, whose facts were gathered where they are true.

A gate's verdict is PASS, WARN, FAIL, or SKIPPED where what it looks at is not there. Facts that are unknown fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.gates import VERDICT, rank_of

#: Versions of the training library from and below which it is supported; a folder that is synchronised, as a part of a path.
SUPPORTED, SYNCED = ((8, 3), (9, 0)), r"(?i)(^|[/\\])onedrive([ -][^/\\]*)?([/\\]|$)"


def _gates(facts: DataFrame, key: str, gates: dict[str, Column]) -> DataFrame:
    """(key, gate_id, verdict); a verdict that is null fails."""
    rows = F.array(*[F.struct(F.lit(g).alias("gate_id"), F.coalesce(v, F.lit("FAIL")).alias("verdict")) for g, v in gates.items()])
    return facts.select(key, F.explode(rows).alias("g")).select(key, "g.gate_id", "g.verdict")


def _verdict(passes: Column, warns: Column | None = None) -> Column:
    out = F.when(passes, "PASS")
    return (out if warns is None else out.when(warns, "WARN")).otherwise("FAIL")


def training_preflight(facts: DataFrame, key: str) -> DataFrame:
    """G1 to G9. facts: key, loaded (the completeness artefact), config_problems, artefact_fingerprint, live_fingerprint, images, missing, split_mismatch, stale,
    artefact_problems, unused_policies, stale_inputs, library (its version, null if it is absent), library_fits, mixing (sum of mixing augmentations), mixing_policy, ledger_problems."""
    c = F.col
    parts = F.split("library", r"\.")
    version = F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("a"), F.get(parts, F.lit(1)).try_cast("int").alias("b"))
    low, high = (F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SUPPORTED)
    readable = version["a"].isNotNull() & version["b"].isNotNull()
    loaded = F.coalesce(c("loaded"), F.lit(False))
    of_artefact = lambda v: F.when(loaded, F.coalesce(v, F.lit("FAIL"))).otherwise("SKIPPED")
    covered = (c("images") > 0) & (c("missing") + c("split_mismatch") == 0)
    return _gates(
        facts, key,
        {
            "G1": _verdict(loaded), "G2": of_artefact(_verdict(c("artefact_fingerprint") == c("live_fingerprint"))), "G3": of_artefact(_verdict(covered & (c("stale") == 0), covered)),
            "G4": of_artefact(_verdict((c("artefact_problems") == 0) & (c("unused_policies") == 0), c("artefact_problems") == 0)),
            "G5": _verdict(readable & (version >= low) & (version < high) & c("library_fits")), "G6": _verdict(c("config_problems") == 0), "G7": of_artefact(_verdict(c("stale_inputs") == 0)),
            "G8": _verdict((c("mixing") <= 0) | (c("mixing_policy") == "ignore"), c("mixing_policy") == "warn"), "G9": _verdict(c("ledger_problems") == 0),
        },
    )


def build_preflight(facts: DataFrame, key: str, least_gb: float) -> DataFrame:
    """FB1 to FB6. facts: key, free_gb, remote (its address, null if there is none), remote_there, remote_free_gb, downloads (whether the source is on), datasets (how many are named), has_key, gpu, repo (its path), cache (the store's), mode."""
    c, least = F.col, F.lit(float(least_gb))
    synced = lambda p: F.coalesce(c(p).rlike(SYNCED), F.lit(False))
    remote = (
        F.when(c("remote").isNull() | (c("remote") == ""), "FAIL").when(c("remote").contains("://"), "WARN").when(synced("remote"), "FAIL")
        .when(~F.coalesce(c("remote_there"), F.lit(False)), "FAIL").when(c("remote_free_gb") < least, "WARN").when(c("remote_free_gb") >= least, "PASS")
    )
    on = F.coalesce(c("downloads"), F.lit(False)) & (F.coalesce(c("datasets"), F.lit(0)) > 0)
    return _gates(
        facts, key,
        {
            "FB1": _verdict(c("free_gb") >= least), "FB2": remote, "FB3": F.when(~on, "WARN").when(c("has_key"), "PASS").otherwise("FAIL"),
            "FB4": F.when(c("gpu"), "PASS").otherwise("WARN"), "FB5": F.when(synced("repo") | synced("cache"), "WARN").otherwise("PASS"), "FB6": F.when(c("mode") == "full", "PASS").otherwise("WARN"),
        },
    )


def verdicts(gates: DataFrame, key: str) -> DataFrame:
    """Per run: gates that were looked at, and FAIL over WARN over PASS among them."""
    own = gates.filter(F.col("verdict").isin(*VERDICT))
    worst = F.max(rank_of(F.col("verdict"), VERDICT))
    return own.groupBy(key).agg(F.count("*").alias("gates"), F.element_at(F.array(*[F.lit(v) for v in VERDICT]), worst + 1).alias("verdict"))
