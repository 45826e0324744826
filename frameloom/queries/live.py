"""Queries that run a stream: the tables' frames arrive in slices of time, a stream runs over the first ones and stops, and goes on when the others are there.

Each must give the rows of its twin over the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import rounded
from ..operators.dedup import shared_folder, shared_table
from ..sources.commits import CommittedTable
from ..streaming import live, queues, reload, ticks
from ..streaming.rules import Rule, rules_text
from ..streaming.runs import arrive, arriving, run_available, use_state_store
from .base import DAY, DETECTIONS, EVENT_TYPES, FRAMES, RULES, detections, frames, query
from .streams import _FIRED, _HITS, _fired

#: Slices in which rows arrive, and how many are there before the first run.
SLICES, BEFORE = 4, 2
PARTITIONS = "spark.sql.shuffle.partitions"


def _in_slices(spark, rows: DataFrame, by: str, key: str, run, schema: str, files: int = 5) -> CommittedTable:
    """Let rows arrive in slices of a number (by), half before and half after a restart; run(stream, sink, checkpoint) is called for each half. files: of a batch.

    The rows are written first, for each slice reads them.
    """
    use_state_store(spark)
    root, rows = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", shared_table(rows)
    out = CommittedTable(spark, f"{root}/out", schema)
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return out
    width = (high - low) // SLICES + 1
    #: A stream's state has as many partitions as its first run shuffles to, and each is a Python worker a batch: no more than twice the cores, here.
    held = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(held), 2 * spark.sparkContext.defaultParallelism)))
    try:
        for i in range(SLICES):
            own = rows.filter((F.col(by) >= low + i * width) & (F.col(by) < low + (i + 1) * width))
            arrive(own, f"{root}/in", key)
            if i + 1 in (BEFORE, SLICES):
                run(arriving(spark, f"{root}/in", rows.schema, files), out.sink, f"{root}/checkpoint")
    finally:
        spark.conf.set(PARTITIONS, held)
    return out


def _frames(spark, sf_dir) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumns({"frame_id": F.col("frame_no"), "us": F.unix_micros("ts"), "confs": F.transform("classes", lambda _: F.lit(0.5))})


_ALERTS = "camera long, frame_no long, rule_no int, rule_id string, severity int"


@query(f"{_FIRED} SELECT * FROM fired")
def stream_rule_fires(spark, sf_dir):
    run = lambda s, sink, at: run_available(live.live_alerts(s, RULES, fps=1.0).drop("ts"), sink, at)
    return _in_slices(spark, _frames(spark, sf_dir), "us", "camera", run, _ALERTS).read()


@query(f"""WITH {DETECTIONS} SELECT camera, class_name, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS n,
 round(list_reduce(list(conf ORDER BY frame_no, ord), lambda a, x: a * 0.9::DOUBLE + x * 0.1::DOUBLE), 8) AS avg_conf FROM detections GROUP BY 1, 2""")
def stream_memory_entry(spark, sf_dir):
    run = lambda s, sink, at: run_available(live.live_entries(s), sink, at, "update")
    schema = "camera long, class_name string, first_frame long, last_frame long, n long, avg_conf double"
    sent = _in_slices(spark, detections(spark, sf_dir), "frame_no", "camera", run, schema).read(numbered=True)
    last = sent.groupBy("camera", "class_name").agg(F.max_by(F.struct("first_frame", "last_frame", "n", "avg_conf"), "version").alias("e"))
    return last.select("camera", "class_name", "e.*").withColumn("avg_conf", rounded(F.col("avg_conf"), 8))


@query(f"WITH {FRAMES} SELECT camera, frame_no, round(ms, 2) AS ms, (ms / 1000) BETWEEN 0.25 AND 0.55 AS uncertain FROM frames")
def stream_events(spark, sf_dir):
    """Frames through the sink of JSON lines: what its three folders hold in the end."""
    path = f"{shared_folder(spark)}/routed-{uuid.uuid4().hex}"
    rows = _frames(spark, sf_dir).select("camera", "frame_no", "us", "ms", F.array(F.col("ms") / 1000).alias("confs"))
    run = lambda s, _, at: run_available(s.drop("us"), lambda batch, n: live.routed(batch, n, path), at)
    _in_slices(spark, rows, "us", "camera", run, "camera long")
    read = lambda name: spark.read.schema("camera long, frame_no long, ms double").json(f"{path}/{name}")
    both = read("events").join(read("performance").select("camera", "frame_no"), ["camera", "frame_no"])
    marked = read("uncertain").select("camera", "frame_no", F.lit(True).alias("uncertain"))
    return both.join(marked, ["camera", "frame_no"], "left").select("camera", "frame_no", F.round("ms", 2).alias("ms"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))


#: Every third frame of a camera, after its alerts were put, one is taken. The queue is small, so that it overflows.
_SIZE, _EVERY = 3, 3
_TAKES = f"""{_FIRED}, a AS (SELECT camera, frame_no * 100 + rule_no AS pos, 1 AS put, frame_no, rule_id, severity::INT AS s FROM fired
 UNION ALL SELECT camera, frame_no * 100 + 99, 0, -1, '', -1 FROM frames WHERE frame_no % {_EVERY} = 0),
 e AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY pos) AS nth FROM a),
 q AS (SELECT DISTINCT camera, 0::BIGINT AS nth, 1 AS put, 0::BIGINT AS pos, []::STRUCT(s INT, nth BIGINT, frame_no BIGINT, rule_id VARCHAR)[] AS held, NULL::STRUCT(s INT, nth BIGINT, frame_no BIGINT, rule_id VARCHAR) AS got FROM e
 UNION ALL SELECT camera, nth, put, pos, CASE WHEN put = 0 THEN list_filter(held, lambda k: k.nth <> coalesce(best.nth, -1)) WHEN len(held) < {_SIZE} THEN list_append(held, x)
   WHEN low.s < x.s THEN list_append(list_filter(held, lambda k: k.nth <> low.nth), x) ELSE held END, CASE WHEN put = 0 THEN best END
  FROM (SELECT e.camera, e.nth, e.put, e.pos, held, {{'s': e.s, 'nth': e.nth, 'frame_no': e.frame_no, 'rule_id': e.rule_id}} AS x,
    list_min(list_transform(held, lambda k: {{'s': k.s, 'nth': k.nth}})) AS low,
    list_filter(held, lambda k: k.nth = list_min(list_transform(held, lambda j: {{'s': -j.s, 'nth': j.nth}})).nth)[1] AS best
   FROM q JOIN e ON e.camera = q.camera AND e.nth = q.nth + 1) y)
SELECT camera, pos AS at, got.frame_no AS frame_no, got.rule_id AS rule_id, got.s AS severity, len(held)::INT AS waiting FROM q WHERE put = 0"""


def _events(spark, sf_dir) -> DataFrame:
    puts = _fired(spark, sf_dir).select("camera", (F.col("frame_no") * 100 + F.col("rule_no")).alias("at"), F.lit("put").alias("kind"), "frame_no", "rule_id", "severity")
    none = [F.lit(None).cast("long").alias("frame_no"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("int").alias("severity")]
    takes = frames(spark, sf_dir).filter(F.col("frame_no") % _EVERY == 0).select("camera", (F.col("frame_no") * 100 + 99).alias("at"), F.lit("take").alias("kind"), *none)
    return puts.union(takes)


@query(_TAKES)
def alert_takes(spark, sf_dir):
    return queues.taken(_events(spark, sf_dir), _SIZE)


@query(_TAKES)
def stream_alert_takes(spark, sf_dir):
    run = lambda s, sink, at: run_available(queues.live_taken(s, _SIZE), sink, at)
    return _in_slices(spark, _events(spark, sf_dir), "at", "camera", run, queues.TAKEN).read()


#: Ticks every 12 hours, as far as a watermark of two days behind the last frame.
_EVERY_MS, _LATE_MS = 43_200_000, 172_800_000
_TICKS = f"""WITH {FRAMES}, e AS (SELECT camera, epoch_ms(ts) AS ms, len(classes) AS n FROM frames), w AS (SELECT max(ms) - {_LATE_MS} AS wm FROM e),
 f AS (SELECT camera, min(ms) // {_EVERY_MS} + 1 AS first FROM e GROUP BY 1), t AS (SELECT camera, unnest(range(first, wm // {_EVERY_MS} + 1)) * {_EVERY_MS} AS tick_ms FROM f, w)
SELECT t.camera, tick_ms, count(ms) AS frames, coalesce(sum(n), 0)::BIGINT AS detections, count(ms) FILTER (WHERE ms >= tick_ms - {_EVERY_MS}) AS lately
 FROM t LEFT JOIN e ON e.camera = t.camera AND e.ms < tick_ms GROUP BY 1, 2"""


@query(_TICKS)
def health_ticks(spark, sf_dir):
    rows = frames(spark, sf_dir)
    last = rows.agg(F.max(F.expr("unix_millis(cast(ts as timestamp))"))).first()[0] or 0
    return ticks.ticks(rows, _EVERY_MS, last - _LATE_MS)


@query(_TICKS)
def stream_health_ticks(spark, sf_dir):
    run = lambda s, sink, at: run_available(ticks.live_ticks(s, _EVERY_MS, f"{_LATE_MS} milliseconds"), sink, at)
    #: All files at once, since a camera's file that waits while the others move the watermark is late.
    return _in_slices(spark, _frames(spark, sf_dir), "us", "camera", run, ticks.TICKS, files=1_000_000).read()


#: The rules, edited twice: other waits and severities, one gone and back, one new.
_VERSIONS = (
    ("2020-01-01", RULES),
    ("2024-01-11", (Rule("error_at_purchase", "detected(error)", "MEDIUM", 6 * DAY), Rule("views_only", "detected(view) AND absent_for(purchase, 2)", "CRITICAL", DAY), Rule("quiet", "NOT detected(click)", "LOW", 4 * DAY))),
    ("2024-01-20 12:00:00", (RULES[2], Rule("views_only", "detected(view) AND absent_for(purchase, 3)", "LOW", 3 * DAY), Rule("error_at_purchase", "detected(error) AND detected(purchase)", "HIGH", DAY))),
)
_EDITED = f"""WITH RECURSIVE {_HITS.partition(', hit AS')[0]}, c AS (SELECT *, list_contains(classes, 'click') AS click, list_contains(classes, 'error') AS error, list_contains(classes, 'purchase') AS purchase,
  list_contains(classes, 'signup') AS signup, list_contains(classes, 'view') AS view, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-20 12:00:00' THEN 2 ELSE 3 END AS v FROM s),
 hit AS (SELECT camera, frame_no, ts, 'error_at_purchase' AS rule_id, [3, 2, 3][v] AS severity, [3, 6, 1][v] AS days FROM c WHERE error AND (purchase OR v = 2)
  UNION ALL SELECT camera, frame_no, ts, 'views_only', [4, 4, 1][v], [2, 1, 3][v] FROM c WHERE view AND since >= [3, 2, 3][v]
  UNION ALL SELECT camera, frame_no, ts, 'arrival', 0, 5 FROM c WHERE (signup OR click) AND v <> 2
  UNION ALL SELECT camera, frame_no, ts, 'odd', 1, 1 FROM c WHERE NOT click AND (error OR signup) AND v = 1
  UNION ALL SELECT camera, frame_no, ts, 'quiet', 1, 4 FROM c WHERE NOT click AND v = 2),
 h AS (SELECT *, row_number() OVER (PARTITION BY camera, rule_id ORDER BY frame_no) AS n FROM hit),
 f AS (SELECT camera, rule_id, n, ts AS last, true AS fires FROM h WHERE n = 1 UNION ALL
  SELECT h.camera, h.rule_id, h.n, CASE WHEN h.ts - f.last >= to_days(h.days::INT) THEN h.ts ELSE f.last END, h.ts - f.last >= to_days(h.days::INT) FROM f JOIN h ON h.camera = f.camera AND h.rule_id = f.rule_id AND h.n = f.n + 1)
SELECT h.camera, h.frame_no, h.rule_id, h.severity FROM h JOIN f ON h.camera = f.camera AND h.rule_id = f.rule_id AND h.n = f.n WHERE fires"""


def _versions(spark, upto: int = len(_VERSIONS)) -> DataFrame:
    return spark.createDataFrame([(t, rules_text(r)) for t, r in _VERSIONS[:upto]], "since string, rules string")


@query(_EDITED)
def rule_versions(spark, sf_dir):
    return reload.versioned_fires(frames(spark, sf_dir), _versions(spark), EVENT_TYPES, fps=1.0)


@query(_EDITED)
def stream_rule_reload(spark, sf_dir):
    """The last version is written only after the stream has run over the first half and stopped."""
    known = [2, len(_VERSIONS)]
    run = lambda s, sink, at: reload.run_reloading(s, lambda: _versions(spark, known.pop(0)), lambda b, n: sink(b.drop("ts"), n), at, "2024-01-01", "2024-12-31", fps=1.0)
    return _in_slices(spark, _frames(spark, sf_dir), "us", "camera", run, _ALERTS).read().drop("rule_no")
