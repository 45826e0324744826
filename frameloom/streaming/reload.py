"""Rules that change while frames come in: versions of a configuration, each in force from its time on.

A version's row holds the time from which it counts and its rules as JSON. Frames are joined to the version in force at their own time, by
the days that it covers, so a replay gives the same alerts, and an edit needs no restart of what the rules remember: when a rule
last fired is kept by its id, in the stream's state and in the scan over a table alike.

A running stream reads the versions when it starts. `run_reloading` therefore runs it over what has arrived, again and again, and reads
the versions anew each time; the checkpoint carries offsets and clocks across.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.dedup import small
from .live import live_alerts
from .memory import WINDOW, scanned, since_map
from .rules import compile_condition, parsed_rules
from .runs import run_available

#: A version counts from `since` until the next one does.
VERSIONS = "since timestamp, rules string"
_END = "9999-12-31 00:00:00"


def spans(versions: DataFrame) -> DataFrame:
    """(since, until, rules); of versions with one time the last text counts. A configuration's history, which one task puts in order."""
    one = versions.select(F.col("since").cast("timestamp").alias("since"), "rules").groupBy("since").agg(F.max("rules").alias("rules"))
    until = F.coalesce(F.lead("since").over(W.orderBy("since")), F.lit(_END).cast("timestamp"))
    return one.select("since", until.alias("until"), "rules")


def with_rules(frames: DataFrame, versions: DataFrame, first: str, last: str) -> DataFrame:
    """frames (with ts, a table or a stream) with rules, the version in force at ts; frames before the first version are left out.

    first, last: the days between which frames may lie. A version is a row per day that it covers of them, so that the join is by day.
    """
    day = F.explode(F.sequence(F.greatest(F.to_date("since"), F.lit(first).cast("date")), F.least(F.to_date("until"), F.lit(last).cast("date"))))
    covered = spans(versions).filter((F.to_date("since") <= F.lit(last).cast("date")) & (F.to_date("until") >= F.lit(first).cast("date")))
    by_day = covered.select(day.alias("_day"), F.col("since").alias("_since"), F.col("until").alias("_until"), "rules")
    met = frames.withColumn("_ts", F.col("ts").cast("timestamp")).withColumn("_day", F.to_date("_ts")).join(small(by_day), "_day")
    return met.filter((F.col("_since") <= F.col("_ts")) & (F.col("_ts") < F.col("_until"))).drop("_day", "_since", "_until", "_ts")


def versioned_fires(frames: DataFrame, versions: DataFrame, classes: Sequence[str], fps: float = 15.0, window: int = WINDOW) -> DataFrame:
    """(camera, frame_no, rule_id, severity) over a table of frames (camera, frame_no, ts, classes): rules by the version in force, silent until
    their cooldown, as that version has it, has passed since they last fired under whichever version."""
    seen, hits = since_map(frames, classes).withColumn("_ts", F.col("ts").cast("timestamp")), []
    for v in spans(versions).orderBy("since").collect():  # a configuration's history
        valid = (F.col("_ts") >= F.lit(v["since"])) & (F.col("_ts") < F.lit(v["until"]))
        for i, r in enumerate(parsed_rules(v["rules"])):
            row = F.struct(F.lit(i).alias("rule_no"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("severity"), F.lit(int(r.cooldown * 1_000_000)).cast("long").alias("wait"))
            hits.append(F.when(valid & compile_condition(r.condition, F.col("classes"), F.col("since"), fps, window), row))
    if not hits:
        return frames.select("camera", "frame_no", F.lit("").alias("rule_id"), F.lit(0).alias("severity")).limit(0)
    matches = seen.select("camera", "frame_no", F.unix_micros("_ts").alias("us"), F.explode(F.array_compact(F.array(*hits))).alias("r")).select("camera", "frame_no", "us", "r.*")

    def step(last: list, row: tuple) -> Iterator[tuple]:
        us, wait, frame_no, severity = row
        if not last or us - last[0] >= wait:
            last[:] = [us]
            yield frame_no, severity

    kind = frames.schema["camera"].dataType.simpleString()
    rows = matches.select("camera", "rule_id", "us", "wait", "frame_no", "severity")
    return scanned(rows, ["camera", "rule_id"], ["frame_no"], f"camera {kind}, rule_id string, frame_no long, severity int", list, step, lambda s: ()).select("camera", "frame_no", "rule_id", "severity")


def run_reloading(frames: DataFrame, load: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, first: str, last: str, fps: float = 15.0, window: int = WINDOW) -> None:
    """Run a stream of frames over what has arrived, under the versions that load() reads now. Called again, it goes on, with the rules' clocks as they were."""
    run_available(live_alerts(with_rules(frames, load(), first, last), None, fps, window), sink, checkpoint)
