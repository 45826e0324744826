"""What a camera remembers of its frames, over a table of frames: windows by camera, and scans that stream over its rows in order.

Frames: camera, frame_no (from 1, without gaps), classes (array of names), ts. Detections: camera, frame_no, ord, class_name, conf. A camera is the key
throughout, so cameras spread over the cluster and each is read in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rules import Rule, compile_condition

#: Frames of the sliding window, and how a new confidence moves the average.
WINDOW, MOVE = 150, 0.1


def _upto(rows: int | None = None):
    w = W.partitionBy("camera").orderBy("frame_no")
    return w.rowsBetween(W.unboundedPreceding if rows is None else 1 - rows, W.currentRow)


def window_classes(frames: DataFrame, window: int = WINDOW) -> DataFrame:
    """frames with in_window: the class names of the last `window` frames, sorted."""
    return frames.withColumn("in_window", F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes").over(_upto(window))))))


def presence(frames: DataFrame, classes: Sequence[str], window: int = WINDOW, fps: float = 15.0) -> DataFrame:
    """Per frame and class: present, frames_since (window if never seen), seconds_since, run (frames in a row up to now, window at most).

    One sort per camera: each class is a column of the same window, unpivoted afterwards.
    """
    w = _upto()
    out = frames
    for i, c in enumerate(classes):
        has = F.array_contains("classes", c)
        out = out.withColumns({f"p{i}": has, f"s{i}": F.max(F.when(has, F.col("frame_no"))).over(w), f"g{i}": F.max(F.when(~has, F.col("frame_no"))).over(w)})
    first = F.min("frame_no").over(W.partitionBy("camera"))
    out = out.withColumn("first", first)
    per = F.array(
        *[
            F.struct(
                F.lit(c).alias("class_name"), F.col(f"p{i}").alias("present"), F.coalesce(F.col("frame_no") - F.col(f"s{i}"), F.lit(window)).cast("long").alias("frames_since"),
                F.when(F.col(f"p{i}"), F.least(F.col("frame_no") - F.coalesce(f"g{i}", F.col("first") - 1), F.lit(window))).otherwise(0).cast("long").alias("run"),
            )
            for i, c in enumerate(classes)
        ]
    )
    rows = out.select("camera", "frame_no", F.explode(per).alias("c")).select("camera", "frame_no", "c.*")
    return rows.withColumn("seconds_since", F.col("frames_since") / F.lit(max(fps, 1.0)))


def scanned(rows: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, start: Callable[[], list], step: Callable[[list, tuple], Iterator[tuple]], end: Callable[[list], Iterator[tuple]]) -> DataFrame:
    """A fold over each key's rows in order that streams: a task holds one key's state and a batch of rows, never a key's history.

    rows: keys, then what step gets of a row. start makes a state, which step changes; step and end yield rows of the schema without the keys.
    """
    n, names = len(keys), [f.strip().rpartition(" ")[0] for f in schema.split(",")]
    # by a hash, since Spark 4.1 leaves out a repartition by the keys above a union of sides dealt by them, and then does not bring their parts together
    dealt = rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False, name=None):
                if row[:n] != key:
                    if key is not None:
                        out += [(*key, *x) for x in end(state)]
                    key, state = row[:n], start()
                out += [(*key, *x) for x in step(state, row[n:])]
            yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame([(*key, *x) for x in end(state)], columns=names)

    return dealt.mapInPandas(run, schema)


def _nothing(*_) -> tuple:
    return ()


def entries(detections: DataFrame, move: float = MOVE) -> DataFrame:
    """Per camera and class: first and last frame, count, and the moving average of confidence in order of detection. Entries never expire."""

    def step(state: list, row: tuple) -> tuple:
        frame_no, _, conf = row
        first, n, average = state[:3] or (frame_no, 0, conf)
        state[:] = [first, n + 1, average * (1 - move) + conf * move if n else conf, frame_no]
        return ()

    rows = detections.select("camera", "class_name", "frame_no", "ord", F.col("conf").cast("double").alias("conf"))
    kind = detections.schema["camera"].dataType.simpleString()
    schema = f"camera {kind}, class_name string, first_frame long, last_frame long, n long, avg_conf double"
    return scanned(rows, ["camera", "class_name"], ["frame_no", "ord"], schema, list, step, lambda s: [(s[0], s[3], s[1], s[2])])


def snapshot(detections: DataFrame, at: DataFrame, window: int = WINDOW) -> DataFrame:
    """What a camera's memory holds at a frame (camera, frame_no): camera, class_name, frames_since, n (detections of the window). Cleared cameras start anew after `cleared`, if at has it."""
    upto = at.select("camera", F.col("frame_no").alias("_at"), (F.col("cleared") if "cleared" in at.columns else F.lit(0)).alias("_from"))
    seen = detections.join(upto, "camera").filter((F.col("frame_no") <= F.col("_at")) & (F.col("frame_no") > F.col("_from")))
    return seen.groupBy("camera", "class_name").agg((F.max("_at") - F.max("frame_no")).alias("frames_since"), F.count_if(F.col("frame_no") > F.col("_at") - window).alias("n"))


def since_map(frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """frames with since: a map from each class seen so far to the frames since then."""
    w = _upto()
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), (F.col("frame_no") - F.max(F.when(F.array_contains("classes", c), F.col("frame_no"))).over(w)).cast("int").alias("v")) for c in classes])
    return frames.withColumn("since", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())))


def rule_matches(frames: DataFrame, rules: Sequence[Rule], classes: Sequence[str], fps: float = 15.0, window: int = WINDOW) -> DataFrame:
    """(camera, frame_no, ts, rule_no, rule_id, severity) of frames where a rule's condition holds, cooldown aside."""
    seen = since_map(frames, classes)
    hit = [F.when(compile_condition(r.condition, F.col("classes"), F.col("since"), fps, window), F.struct(F.lit(i).alias("rule_no"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("severity"))) for i, r in enumerate(rules)]
    return seen.select("camera", "frame_no", "ts", F.explode(F.array_compact(F.array(*hit))).alias("r")).select("camera", "frame_no", "ts", "r.*")


def fired(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Of rule_matches, those off cooldown: a rule is silent until its cooldown has passed since it last fired for the camera.

    A scan per (camera, rule) over its matches in order. Time is that of the events; a rule that never fired is ready.
    """
    waits = [int(r.cooldown * 1_000_000) for r in rules]

    def step(last: list, row: tuple) -> Iterator[tuple]:
        rule_no, us = row[:2]
        if not last or us - last[0] >= waits[rule_no]:
            last[:] = [us]
            yield row[2:]

    rows = matches.select("camera", F.col("rule_no").alias("rule"), "rule_no", F.expr("unix_micros(cast(ts as timestamp))").alias("us"), "frame_no", F.col("rule_no").alias("no"), "rule_id", "severity")
    kind = matches.schema["camera"].dataType.simpleString()
    schema = f"camera {kind}, rule int, frame_no long, rule_no int, rule_id string, severity int"
    found = scanned(rows, ["camera", "rule"], ["frame_no"], schema, list, step, _nothing)
    when = matches.select("camera", "frame_no", "ts").distinct()
    return found.drop("rule").join(when, ["camera", "frame_no"]).select("camera", "frame_no", "ts", "rule_no", "rule_id", "severity")


def spoken_alert(alerts: DataFrame) -> DataFrame:
    """Per frame the alert of highest severity, the first rule of equals."""
    best = F.max(F.struct("severity", (-F.col("rule_no")).alias("early"), "rule_id"))
    return alerts.groupBy("camera", "frame_no").agg(best.alias("b")).select("camera", "frame_no", F.col("b.rule_id").alias("rule_id"), F.col("b.severity").alias("severity"))


def queued(alerts: DataFrame, size: int = 10) -> DataFrame:
    """Per camera, what a bounded queue holds after all alerts were put and none taken, in the order they would be taken.

    A new alert enters a full queue only in place of one of lower severity; of the lowest the oldest goes. As nothing is taken in between, an alert is
    in the end there if it is among the first `size` by severity: of equals the early ones came in, but of the severity at the edge those put
    out were the oldest. So this is folded in order, over at most `size` held.
    """

    def put(held: list, alert: tuple) -> tuple:
        if len(held) < size:
            held.append(alert)
        else:
            lowest = min(range(size), key=lambda i: (held[i][2], i))
            if held[lowest][2] < alert[2]:
                del held[lowest]
                held.append(alert)
        return ()

    def taken(held: list) -> Iterator[tuple]:
        for place, (frame_no, _, severity, rule_id) in enumerate(sorted(held, key=lambda x: (-x[2], x[0], x[1]))):
            yield place + 1, frame_no, rule_id, severity

    kind = alerts.schema["camera"].dataType.simpleString()
    rows = alerts.select("camera", "frame_no", "rule_no", F.col("severity").cast("int").alias("severity"), "rule_id")
    return scanned(rows, ["camera"], ["frame_no", "rule_no"], f"camera {kind}, place int, frame_no long, rule_id string, severity int", list, put, taken)


def rolling(frames: DataFrame, ms: str, n: int = 30) -> DataFrame:
    """frames with rolling_ms and rolling_fps: the mean of the last n latencies."""
    mean = F.avg(ms).over(_upto(n))
    return frames.withColumns({"rolling_ms": F.round(mean, 6), "rolling_fps": F.round(F.when(mean > 0, 1000 / mean).otherwise(F.lit(0.0)), 6)})


def every_nth_with_detections(frames: DataFrame, n: int = 5) -> DataFrame:
    """The frames that a scene model looks at."""
    return frames.filter((F.col("frame_no") % n == 0) & (F.size("classes") > 0))


def health(frames: DataFrame, length: str = "1 minute") -> DataFrame:
    """Counters per camera and tumbling window of event time; with a watermark on ts this is the streaming form too."""
    return frames.groupBy("camera", F.window("ts", length).alias("w")).agg(F.count("*").alias("frames"), F.sum(F.size("classes")).alias("detections")).select("camera", F.col("w.start").alias("start"), "frames", "detections")
