"""A camera's bounded queue of alerts, with puts and takes in between, over a table and over a stream.

A put enters a full queue only in place of an alert of lower severity; of the lowest the oldest goes. A take gets the alert of highest severity,
the oldest of equals, or nothing. Rows: camera, at (the order within the camera), kind (put or take), frame_no, rule_id, severity. Rows without a camera
belong to no queue and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BucketProcessor, by_key, in_buckets
from .memory import scanned

SIZE = 10
#: One row per take; of an empty queue with nulls. waiting: alerts left.
TAKEN = "camera long, at long, frame_no long, rule_id string, severity int, waiting int"


class Queue:
    """What is held, as (nth, severity, frame_no, rule_id), in order of arrival; nth counts the puts."""

    def __init__(self, size: int, nth: int = 0, held: list[tuple] | None = None):
        self.size, self.nth, self.held = size, nth, held or []

    def put(self, severity: int, frame_no: int, rule_id: str) -> bool:
        self.nth += 1
        if len(self.held) >= self.size:
            lowest = min(range(len(self.held)), key=lambda i: (self.held[i][1], i))
            if self.held[lowest][1] >= severity:
                return False
            del self.held[lowest]
        self.held.append((self.nth, severity, frame_no, rule_id))
        return True

    def take(self) -> tuple | None:
        if not self.held:
            return None
        return self.held.pop(min(range(len(self.held)), key=lambda i: (-self.held[i][1], i)))

    def act(self, at: int, kind: str, frame_no, rule_id, severity) -> Iterator[tuple]:
        """The row of a take, none of a put."""
        if kind == "put":
            self.put(int(severity), int(frame_no), rule_id)
            return
        got = self.take()
        yield (at, *((got[2], got[3], got[1]) if got else (None, None, None)), len(self.held))


def _rows(events: DataFrame) -> DataFrame:
    return events.filter("camera is not null").select("camera", "at", "kind", "frame_no", "rule_id", F.col("severity").cast("int").alias("severity"))


def taken(events: DataFrame, size: int = SIZE) -> DataFrame:
    """What each take of a table of events gets: a scan per camera that holds at most `size` alerts."""
    kind = events.schema["camera"].dataType.simpleString()
    schema = TAKEN.replace("camera long", f"camera {kind}")
    # long and int columns with nulls reach Python as floats
    rows = _rows(events).fillna(-1, ["frame_no", "severity"])
    return scanned(rows, ["camera"], ["at"], schema, lambda: Queue(size), lambda q, row: q.act(*row), lambda q: ())


class QueueProcessor(BucketProcessor):
    """The same as a stateful operator: at most `size` alerts of state a camera."""

    def __init__(self, size: int = SIZE):
        self.size = size

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.load(), []
        for camera, found in by_key(rows, ("camera",), ("at",), ("kind", "frame_no", "rule_id", "severity")).items():
            queue = Queue(self.size, *held.get(camera, ()))
            out += [(camera, *x) for row in sorted(found, key=lambda r: r[0]) for x in queue.act(*row)]
            held[camera] = (queue.nth, queue.held)
        self.save(held)
        yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate(_DTYPES.items())})


#: Columns of TAKEN with types that hold nulls.
_DTYPES = {"camera": "Int64", "at": "Int64", "frame_no": "Int64", "rule_id": "object", "severity": "Int32", "waiting": "Int32"}


def live_taken(events: DataFrame, size: int = SIZE) -> DataFrame:
    """taken over a stream; a batch's events of a camera are acted on in order of `at`. Needs the RocksDB state store."""
    rows = _rows(events).fillna(-1, ["frame_no", "severity"]).withColumn("camera", F.col("camera").cast("long"))
    return in_buckets(rows, "camera").transformWithStateInPandas(statefulProcessor=QueueProcessor(size), outputStructType=TAKEN, outputMode="Append", timeMode="None")
