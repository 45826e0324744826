"""Queries of a camera's memory, rules and alerts, over the table of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import rounded
from ..streaming import memory
from .base import DETECTIONS, EVENT_TYPES, FRAMES, RULES, detections, frames, query

_SIZE = 10
_TYPES = ", ".join(f"('{t}')" for t in EVENT_TYPES)
_SEEN = f"""seen AS (SELECT f.camera, f.frame_no, t.c AS class_name, list_contains(classes, t.c) AS present, max(CASE WHEN list_contains(classes, t.c) THEN frame_no END) OVER w AS last, max(CASE WHEN NOT list_contains(classes, t.c) THEN frame_no END) OVER w AS gap
 FROM frames f CROSS JOIN (VALUES {_TYPES}) t(c) WINDOW w AS (PARTITION BY camera, t.c ORDER BY frame_no))"""


@query(f"WITH {FRAMES} SELECT camera, frame_no, array_to_string(list_sort(list_distinct(flatten(list(classes) OVER (PARTITION BY camera ORDER BY frame_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))), ',') AS in_window FROM frames")
def frame_window(spark, sf_dir):
    return memory.window_classes(frames(spark, sf_dir), 5).select("camera", "frame_no", F.array_join("in_window", ",").alias("in_window"))


@query(f"WITH {FRAMES}, {_SEEN} SELECT camera, frame_no, class_name, present, coalesce(frame_no - last, {_SIZE}) AS frames_since, coalesce(frame_no - last, {_SIZE}) / 2.0::DOUBLE AS seconds_since, CASE WHEN present THEN least(frame_no - coalesce(gap, 0), {_SIZE}) ELSE 0 END AS run FROM seen")
def frames_since(spark, sf_dir):
    return memory.presence(frames(spark, sf_dir), EVENT_TYPES, _SIZE, 2.0)


@query(f"""WITH {DETECTIONS} SELECT camera, class_name, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS n,
 round(list_reduce(list(conf ORDER BY frame_no, ord), lambda a, x: a * 0.9::DOUBLE + x * 0.1::DOUBLE), 8) AS avg_conf FROM detections GROUP BY 1, 2""")
def memory_entry(spark, sf_dir):
    return memory.entries(detections(spark, sf_dir)).withColumn("avg_conf", rounded(F.col("avg_conf"), 8))


def _since(c: str) -> str:
    return f"coalesce(frame_no - max(CASE WHEN list_contains(classes, '{c}') THEN frame_no END) OVER (PARTITION BY camera ORDER BY frame_no), 150)"


_HITS = f"""{FRAMES}, s AS (SELECT *, {_since('purchase')} AS since FROM frames), hit AS (
 SELECT camera, frame_no, ts, 0 AS rule_no, 'error_at_purchase' AS rule_id, 3 AS severity, 3 AS days FROM s WHERE list_contains(classes, 'error') AND list_contains(classes, 'purchase')
 UNION ALL SELECT camera, frame_no, ts, 1, 'views_only', 4, 2 FROM s WHERE list_contains(classes, 'view') AND since >= 3
 UNION ALL SELECT camera, frame_no, ts, 2, 'arrival', 0, 5 FROM s WHERE list_contains(classes, 'signup') OR list_contains(classes, 'click')
 UNION ALL SELECT camera, frame_no, ts, 3, 'odd', 1, 1 FROM s WHERE NOT list_contains(classes, 'click') AND (list_contains(classes, 'error') OR list_contains(classes, 'signup')))"""
_FIRED = f"""WITH RECURSIVE {_HITS}, h AS (SELECT *, row_number() OVER (PARTITION BY camera, rule_no ORDER BY frame_no) AS n FROM hit),
 f AS (SELECT camera, rule_no, n, ts AS last, true AS fires FROM h WHERE n = 1 UNION ALL
  SELECT h.camera, h.rule_no, h.n, CASE WHEN h.ts - f.last >= to_days(h.days::INT) THEN h.ts ELSE f.last END, h.ts - f.last >= to_days(h.days::INT) FROM f JOIN h ON h.camera = f.camera AND h.rule_no = f.rule_no AND h.n = f.n + 1),
 fired AS (SELECT h.camera, h.frame_no, h.rule_no, h.rule_id, h.severity FROM h JOIN f ON h.camera = f.camera AND h.rule_no = f.rule_no AND h.n = f.n WHERE fires)"""


def _matches(spark, sf_dir):
    return memory.rule_matches(frames(spark, sf_dir), RULES, EVENT_TYPES, fps=1.0)


def _fired(spark, sf_dir):
    return memory.fired(_matches(spark, sf_dir), RULES)


@query(f"WITH {_HITS} SELECT camera, frame_no, rule_no, rule_id, severity FROM hit")
def rule_dsl(spark, sf_dir):
    return _matches(spark, sf_dir).drop("ts")


@query(f"{_FIRED} SELECT * FROM fired")
def rule_fires(spark, sf_dir):
    return _fired(spark, sf_dir).drop("ts")


@query(f"{_FIRED} SELECT camera, frame_no, rule_id, severity FROM fired QUALIFY row_number() OVER (PARTITION BY camera, frame_no ORDER BY severity DESC, rule_no) = 1")
def alert_pick(spark, sf_dir):
    return memory.spoken_alert(_fired(spark, sf_dir))


_QUEUE = f"""{_FIRED}, a AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY frame_no, rule_no) AS nth FROM fired),
 q AS (SELECT DISTINCT camera, 0::BIGINT AS nth, []::STRUCT(s INT, nth BIGINT, frame_no BIGINT, rule_no INT, rule_id VARCHAR)[] AS held FROM a UNION ALL
  SELECT camera, nth, CASE WHEN len(held) < 10 THEN list_append(held, x) WHEN low.s < x.s THEN list_append(list_filter(held, lambda k: k.nth <> low.nth), x) ELSE held END
  FROM (SELECT a.camera, a.nth, held, {{'s': a.severity::INT, 'nth': a.nth, 'frame_no': a.frame_no, 'rule_no': a.rule_no::INT, 'rule_id': a.rule_id}} AS x, list_min(list_transform(held, lambda k: {{'s': k.s, 'nth': k.nth}})) AS low FROM q JOIN a ON a.camera = q.camera AND a.nth = q.nth + 1) y),
 e AS (SELECT camera, unnest(held) AS x FROM q QUALIFY row_number() OVER (PARTITION BY camera ORDER BY nth DESC) = 1)
SELECT camera, row_number() OVER (PARTITION BY camera ORDER BY x.s DESC, x.frame_no, x.rule_no) AS place, x.frame_no AS frame_no, x.rule_id AS rule_id, x.s AS severity FROM e"""


@query(_QUEUE)
def alert_topk_queue(spark, sf_dir):
    return memory.queued(_fired(spark, sf_dir), 10)


@query(f"WITH {FRAMES}, a AS (SELECT camera, frame_no, avg(ms) OVER (PARTITION BY camera ORDER BY frame_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m FROM frames) SELECT camera, frame_no, round(m, 6) AS rolling_ms, round(CASE WHEN m > 0 THEN 1000 / m ELSE 0 END, 6) AS rolling_fps FROM a")
def rolling_fps(spark, sf_dir):
    return memory.rolling(frames(spark, sf_dir), "ms").select("camera", "frame_no", "rolling_ms", "rolling_fps")


@query(f"WITH {FRAMES} SELECT camera, frame_no FROM frames WHERE frame_no % 5 = 0 AND len(classes) > 0")
def vlm_every_n(spark, sf_dir):
    return memory.every_nth_with_detections(frames(spark, sf_dir)).select("camera", "frame_no")


@query(f"WITH {FRAMES} SELECT camera, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS frames, sum(len(classes))::BIGINT AS detections FROM frames GROUP BY 1, 2")
def health_tick(spark, sf_dir):
    return memory.health(frames(spark, sf_dir), "1 hour")

