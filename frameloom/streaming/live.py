"""The same memory, rules and cooldowns on a stream: a stateful operator keyed by buckets of cameras, and its sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from .buckets import BucketProcessor, by_key, in_buckets
from .memory import MOVE, WINDOW
from .rules import Rule, holds, parsed_rules

ALERTS = StructType(
    [StructField("camera", LongType()), StructField("frame_no", LongType()), StructField("ts", TimestampType()), StructField("rule_no", IntegerType()), StructField("rule_id", StringType()), StructField("severity", IntegerType())]
)
_ENTRY = StructType([StructField("first_frame", LongType()), StructField("last_frame", LongType()), StructField("n", LongType()), StructField("avg_conf", DoubleType())])


class CameraRules(BucketProcessor):
    """State of a camera: frames so far, an entry per class (never expiring), and when each rule last fired. Bounded by classes and rules; cameras share a bucket's value.

    Without rules of its own, each frame brings those in force, as its column `rules`. When a rule last fired is kept by its id, so an edited rule goes
    on with its clock, and one that is gone for a while comes back with it.
    """

    def __init__(self, rules: Sequence[Rule] | None, fps: float = 15.0, window: int = WINDOW):
        self.rules, self.fps, self.window = rules if rules is None else list(rules), fps, window

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.load(), []
        brought = () if self.rules is not None else ("rules",)
        for camera, frames in by_key(rows, ("camera",), ("us", "frame_id"), ("ts", "classes", "confs", *brought)).items():
            frames.sort(key=lambda r: r[:2])
            frame_no, seen, fired = held.get(camera, (0, {}, {}))
            for us, _, ts, names, confs, *text in frames:
                frame_no += 1
                for name, conf in zip(names, confs, strict=True):
                    entry = seen.setdefault(name, [frame_no, frame_no, 0, float(conf)])
                    if entry[2]:
                        entry[3] = entry[3] * (1 - MOVE) + float(conf) * MOVE
                    entry[1], entry[2] = frame_no, entry[2] + 1
                since, now = {n: frame_no - e[1] for n, e in seen.items()}, set(names)
                for i, rule in enumerate(parsed_rules(text[0]) if self.rules is None else self.rules):
                    if us - fired.get(rule.rule_id, -(1 << 62)) < rule.cooldown * 1_000_000 or not holds(rule.condition, now, since, self.fps, self.window):
                        continue
                    fired[rule.rule_id] = us
                    out.append((camera, frame_no, ts, i, rule.rule_id, rule.level))
            held[camera] = (frame_no, seen, fired)
        self.save(held)
        yield pd.DataFrame(out, columns=[f.name for f in ALERTS.fields])


def live_alerts(frames: DataFrame, rules: Sequence[Rule] | None, fps: float = 15.0, window: int = WINDOW) -> DataFrame:
    """Alerts of a stream of frames (camera, frame_id, ts, classes, confs). Frames of a micro-batch are taken in order of (ts, frame_id); those without a camera are left out.

    rules: None if the frames bring them (reload.with_rules).

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    rows = frames.filter("camera is not null").withColumn("us", F.unix_micros("ts"))
    return in_buckets(rows, "camera").transformWithStateInPandas(statefulProcessor=CameraRules(rules, fps, window), outputStructType=ALERTS, outputMode="Append", timeMode="None")


class MemoryProcessor(BucketProcessor):
    """State of a class before a camera: its memory entry, which is sent whenever it changes."""

    def __init__(self, move: float = MOVE):
        self.move = move

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.load(), []
        for name, found in by_key(rows, ("camera", "class_name"), ("frame_no", "ord"), ("conf",)).items():
            entry = held.get(name)
            for frame_no, _, conf in sorted(found):
                if entry is None:
                    entry = (frame_no, frame_no, 1, float(conf))
                else:
                    entry = (entry[0], frame_no, entry[2] + 1, entry[3] * (1 - self.move) + float(conf) * self.move)
            held[name] = entry
            out.append((*name, *entry))
        self.save(held)
        sent = pd.DataFrame(out, columns=["camera", "class_name", *(f.name for f in _ENTRY.fields)])
        yield sent.astype({"camera": "Int64"})


def live_entries(detections: DataFrame, move: float = MOVE) -> DataFrame:
    """memory.entries over a stream of detections (camera, frame_no, ord, class_name, conf): each batch sends the entries that it changed. Needs the RocksDB state store."""
    rows = detections.select(F.col("camera").cast("long").alias("camera"), "class_name", "frame_no", "ord", F.col("conf").cast("double").alias("conf"))
    schema = "camera long, class_name string, first_frame long, last_frame long, n long, avg_conf double"
    return in_buckets(rows, "camera", "class_name").transformWithStateInPandas(statefulProcessor=MemoryProcessor(move), outputStructType=schema, outputMode="Update", timeMode="None")


def watermarked(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Frames with ts as a timestamp under a watermark; later ones than that are dropped by windowed operators."""
    return frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def routed(batch: DataFrame, batch_id: int, path: str, most_bytes: int | None = None) -> None:
    """A foreachBatch sink: events, performance and frames worth learning from, each to its own folder of JSON lines.

    A batch has a folder of its number, which it writes over if it is run again. A cap counts the bytes of the batches before; beyond it nothing
    more is written there.
    """
    from ..sources.sinks import folder_bytes

    spark = batch.sparkSession
    kinds = {"events": batch, "performance": batch.select("camera", "frame_no", "ms"), "uncertain": batch.filter(F.exists("confs", lambda c: c.between(0.25, 0.55)))}
    for name, rows in kinds.items():
        own = f"{path}/{name}/batch={batch_id}"
        if most_bytes is None or folder_bytes(spark, f"{path}/{name}") - folder_bytes(spark, own) < most_bytes:
            rows.write.mode("overwrite").json(own)


def with_reloaded_rules(load: Callable[[], Sequence[Rule]], evaluate: Callable[[DataFrame, Sequence[Rule]], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that reads the rules anew for each micro-batch, so that an edit takes effect with the next one, and never within one.

    While the rules can't be read or parsed, those of the batch before stay in force; the first batch needs them.
    """
    held: list[Sequence[Rule]] = []

    def run(batch: DataFrame, _: int) -> None:
        try:
            held[:] = [load()]
        except (OSError, ValueError, KeyError, AnalysisException):
            if not held:
                raise
        evaluate(batch, held[0])

    return run
