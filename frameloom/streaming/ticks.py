"""Health ticks: a snapshot of every camera's counters at each full interval, whether it sent anything or not, over a table and over a stream.

A camera's first tick ends the interval of its first frame. On a stream ticks are timers of event time: one is due when the
watermark has passed it, so that no frame that may still come belongs before it, and it registers the next. Frames: camera, ts,
classes (array).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .buckets import BucketProcessor, by_key, in_buckets

#: tick: the end of the interval, in milliseconds. frames, detections: since the start. lately: frames of the interval.
TICKS = "camera long, tick_ms long, frames long, detections long, lately long"


_COLUMNS = ["camera", "tick_ms", "frames", "detections", "lately"]


def ticks(frames: DataFrame, every_ms: int, until_ms: int) -> DataFrame:
    """The ticks of a table of frames up to a time: camera, tick_ms, frames, detections, lately.

    Each camera's intervals are counted first; a tick then sums the counts of those that have ended, in a window over the camera's own ticks.
    """
    no = F.expr(f"unix_millis(cast(ts as timestamp)) div {every_ms} + 1")
    met = frames.select("camera", no.alias("no"), F.size("classes").alias("n")).groupBy("camera", "no").agg(F.count("*").alias("lately"), F.sum("n").alias("seen"))
    span = met.groupBy("camera").agg(F.min("no").alias("first")).filter(F.col("first") <= until_ms // every_ms)
    due = span.select("camera", F.explode(F.sequence(F.col("first"), F.lit(until_ms // every_ms).cast("long"))).alias("no"))
    upto = W.partitionBy("camera").orderBy("no")
    both = due.join(met, ["camera", "no"], "left").fillna(0, ["lately", "seen"])
    return both.select("camera", (F.col("no") * every_ms).alias("tick_ms"), F.sum("lately").over(upto).alias("frames"), F.sum("seen").over(upto).alias("detections"), "lately")


class TickProcessor(BucketProcessor):
    """State of a camera: counters up to its last tick, the tick that is next, whether one was, and counters of the intervals that have not ended, as many as the watermark's delay spans.

    A bucket has one timer that counts, for the earliest next tick of its cameras (held under None); one that was overtaken finds nothing to do.
    """

    def __init__(self, every_ms: int):
        self.every = every_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.load()
        due = held.pop(None, None)
        earliest = due
        for camera, frames in by_key(rows, ("camera",), ("ms", "n"), ()).items():
            met: dict[int, list[int]] = {}
            for ms, n in frames:
                one = met.setdefault((ms // self.every + 1) * self.every, [0, 0])
                one[0], one[1] = one[0] + 1, one[1] + n
            first = min(met)
            one = held.setdefault(camera, [0, 0, first, False, {}])
            if not one[3] and first < one[2]:
                one[2] = first
            for tick, (frames_met, n) in met.items():
                before = one[4].get(tick, (0, 0))
                one[4][tick] = (before[0] + frames_met, before[1] + n)
            earliest = one[2] if earliest is None else min(earliest, one[2])
        if earliest != due:
            self.handle.registerTimer(earliest)
        self.save(held | {None: earliest})
        yield pd.DataFrame(columns=_COLUMNS, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now, out = self.load(), timerValues.getCurrentWatermarkInMs(), []
        if held.pop(None) <= now:
            for camera, one in held.items():
                frames, detections, tick = one[:3]
                while tick <= now:
                    lately, seen = one[4].pop(tick, (0, 0))
                    frames, detections = frames + lately, detections + seen
                    out.append((camera, tick, frames, detections, lately))
                    tick += self.every
                    one[3] = True
                one[:3] = frames, detections, tick
            earliest = min(one[2] for one in held.values())
            self.handle.registerTimer(earliest)
            self.save(held | {None: earliest})
        yield pd.DataFrame(out, columns=_COLUMNS)


def live_ticks(frames: DataFrame, every_ms: int, late: str = "10 minutes") -> DataFrame:
    """ticks over a stream of frames, as far as its watermark comes; frames later than that are dropped. Needs the RocksDB state store."""
    rows = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col("camera").cast("long").alias("camera"), "ts", F.unix_millis("ts").alias("ms"), F.size("classes").cast("long").alias("n"))
    return in_buckets(rows.filter("camera is not null"), "camera").transformWithStateInPandas(statefulProcessor=TickProcessor(every_ms), outputStructType=TICKS, outputMode="Append", timeMode="EventTime")
