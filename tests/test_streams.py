"""Streams that break off and go on, tables of versions, and stateful operators against plain Python."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from frameloom.operators import captures, verification
from frameloom.queries import QUERIES
from frameloom.sources.commits import CommittedTable, claim
from frameloom.streaming import live, memory, queues, reload, ticks
from frameloom.streaming.rules import Rule, parsed_rules, rules_text
from frameloom.streaming.runs import arrive, arriving, run_available

RULES = [Rule("ab", "detected(a) AND detected(b)", "HIGH", 40), Rule("gone", "detected(a) AND absent_for(c, 2)", "CRITICAL", 25), Rule("any", "any_of([b, c])", "INFO", 10)]
ALERTS = "camera long, frame_no long, rule_no int, rule_id string, severity int"


def made_frames(spark, seed=5, cameras=3, n=40):
    rng = random.Random(seed)
    rows = [(cam, i, f"2024-01-01 00:{i // 6:02d}:{i % 6 * 10:02d}", sorted(rng.sample("abc", rng.randrange(4)))) for cam in range(1, cameras + 1) for i in range(n)]
    df = spark.createDataFrame(rows, "camera long, frame_id long, t string, classes array<string>")
    return df.select("camera", "frame_id", F.col("t").cast("timestamp").alias("ts"), "classes", F.transform("classes", lambda _: F.lit(0.5)).alias("confs"))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def batch_fires(raw):
    frames = raw.withColumn("frame_no", F.col("frame_id") + 1)
    return memory.fired(memory.rule_matches(frames, RULES, ["a", "b", "c"], fps=5.0, window=20), RULES)


@pytest.mark.parametrize("after_write", [False, True])
def test_a_batch_that_breaks_off_is_run_again_and_counts_once(spark, tmp_path, after_write):
    raw, out = made_frames(spark), CommittedTable(spark, str(tmp_path / "out"), ALERTS)
    for part in range(4):
        arrive(raw.filter(F.expr(f"frame_id div 10 = {part}")).coalesce(1), str(tmp_path / "in"), "camera")
    calls = []

    def breaking(batch, n):
        calls.append(n)
        if after_write:
            out.sink(batch, n)
        if len(calls) == 3:
            raise RuntimeError("lost")
        out.sink(batch, n)

    def run():
        run_available(live.live_alerts(arriving(spark, str(tmp_path / "in"), raw.schema, 1), RULES, fps=5.0, window=20).drop("ts"), breaking, str(tmp_path / "checkpoint"))

    with pytest.raises(StreamingQueryException):
        run()
    run()
    assert calls[2] in calls[3:] and len(set(calls)) > 3
    want = batch_fires(raw)
    assert rows_of(out.read(), "camera", "frame_no", "rule_id") == rows_of(want, "camera", "frame_no", "rule_id")


def test_routed_batches_are_written_over(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 300.0), (1, 2, 900.0)], "camera long, frame_no long, ms double").withColumn("confs", F.array(F.col("ms") / 1000))
    path = str(tmp_path / "routed")
    for n in (0, 0, 1, 1):
        live.routed(rows, n, path)
    assert spark.read.json(f"{path}/events").count() == 4 and spark.read.json(f"{path}/uncertain").count() == 2
    live.routed(rows, 2, path, most_bytes=1)
    assert spark.read.json(f"{path}/events").count() == 4
    live.routed(rows, 0, str(tmp_path / "other"), most_bytes=1)
    live.routed(rows, 0, str(tmp_path / "other"), most_bytes=1)
    assert spark.read.json(str(tmp_path / "other/events")).count() == 2


def test_a_claim_is_made_once(spark, tmp_path):
    path, won = str(tmp_path / "claims" / "7"), []

    def one(i):
        if claim(spark, path, f"writer {i}"):
            won.append(i)

    threads = [threading.Thread(target=one, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and (tmp_path / "claims" / "7").read_text() == f"writer {won[0]}"
    assert [p.name for p in (tmp_path / "claims").iterdir() if "draft" in p.name] == []


def test_versions_of_a_table(spark, tmp_path):
    t = CommittedTable(spark, str(tmp_path / "t"), "a long")
    assert t.read().count() == 0 and t.read(numbered=True).columns == ["a", "version"]
    assert t.put(spark.range(2).toDF("a"), 3) and not t.put(spark.range(5).toDF("a"), 3)
    assert t.append(lambda known: known.agg(F.sum("a").alias("a"))) == 4
    assert t.append(lambda known: None) is None
    assert rows_of(t.read(numbered=True), "version", "a") == [(3, 0), (3, 1), (4, 1)] and t.read(upto=3).count() == 2


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "image long, class_id int, source string, status string, boxes long, supersedes string")


def test_two_writers_of_a_ledger(spark, tmp_path):
    """The second writer claims while the first is at work: the first judges anew, so numbers don't repeat and a conflict is told."""
    path = str(tmp_path / "log")

    class Slow(CommittedTable):
        def put(self, rows, version):
            if other := waiting.pop() if waiting else None:
                verification.append(verification.ledger(spark, path), other)
            return super().put(rows, version)

    slow = Slow(spark, path, verification.ledger(spark, path).schema)
    waiting = [entries(spark, (1, 1, "s", "verified_absent", 0, None), (2, 1, "s", "present_labeled", 2, None))]
    assert verification.append(slow, entries(spark, (3, 1, "s", "verified_absent", 0, None))) == 1
    log = rows_of(slow.read(), "image", "seq")
    assert [i for i, _ in log] == [1, 2, 3] and log[2][1] > log[0][1] == log[1][1]
    waiting = [entries(spark, (9, 1, "s", "present_labeled", 1, None))]
    with pytest.raises(ValueError, match="conflict"):
        verification.append(slow, entries(spark, (9, 1, "s", "verified_absent", 0, None)))
    assert slow.read().count() == 4


def test_many_writers_of_a_ledger(spark, tmp_path):
    errors = []

    def write(i):
        try:
            verification.append(verification.ledger(spark, str(tmp_path / "log")), entries(spark, (i, 1, "s", "verified_absent", 0, None)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert rows_of(verification.ledger(spark, str(tmp_path / "log")).read(), "seq") == [(1,), (2,), (3,), (4,)]


def test_an_evaluation_set_is_locked_by_one_writer(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("v1", "a.jpg", "x"), ("v1", "b.jpg", "y")], "set string, name string, sha string")
    put, first = CommittedTable.put, []

    def late(self, rows, version):
        if not first:
            first.append(1)
            captures.lock_eval_set(files, "v1", str(tmp_path / "locks"))
        return put(self, rows, version)

    monkeypatch.setattr(CommittedTable, "put", late)
    with pytest.raises(ValueError, match="locked"):
        captures.lock_eval_set(files, "v1", str(tmp_path / "locks"))
    assert CommittedTable(spark, str(tmp_path / "locks"), captures.LOCKS).read().count() == 1


def model_takes(events, size):
    """A plain list that is searched."""
    held, out = [], []
    for cam, at, kind, frame, rule, severity in events:
        if kind == "put":
            if len(held) >= size:
                lowest = min(s for s, *_ in held)
                if lowest >= severity:
                    continue
                held.remove(next(h for h in held if h[0] == lowest))
            held.append((severity, frame, rule))
            continue
        got = None
        if held:
            got = next(h for h in held if h[0] == max(s for s, *_ in held))
            held.remove(got)
        out.append((cam, at, *((got[1], got[2], got[0]) if got else (None, None, None)), len(held)))
    return out


def test_queue_with_takes(spark, tmp_path):
    rng, schema = random.Random(3), "camera long, at long, kind string, frame_no long, rule_id string, severity int"
    rows = []
    for cam in (1, 2, 3):
        share = (0.2, 0.5, 0.8)[cam - 1]
        rows += [(cam, i, *(("take", None, None, None) if rng.random() < share else ("put", i, f"r{rng.randrange(4)}", rng.randrange(5)))) for i in range(60)]
    want = sorted(x for cam in (1, 2, 3) for x in model_takes([r for r in rows if r[0] == cam], 4))
    events = spark.createDataFrame(rows, schema)
    assert rows_of(queues.taken(events.repartition(5), 4), "*") == want
    assert any(w[2] is None for w in want) and any(w[5] == 3 for w in want)
    out = CommittedTable(spark, str(tmp_path / "out"), queues.TAKEN)
    for part in range(3):
        arrive(events.filter(F.expr(f"at div 20 = {part}")), str(tmp_path / "in"), "camera")
        run_available(queues.live_taken(arriving(spark, str(tmp_path / "in"), events.schema, 2), 4), out.sink, str(tmp_path / "checkpoint"))
    assert rows_of(out.read(), "*") == want and len(out.versions()) >= 3


def test_ticks_of_silent_and_late_cameras(spark, tmp_path):
    """Camera 2 falls silent, camera 3 comes late, camera 4's first frame is overtaken by a later one; a frame beyond the watermark is dropped."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    slices = [
        [(1, at(5)), (1, at(61)), (2, at(30)), (4, at(75))],
        [(1, at(130)), (4, at(50)), (1, at(200))],
        [(3, at(400)), (1, at(390)), (2, at(100))],
        [(1, at(900))],
    ]
    schema, out = "camera long, t string", CommittedTable(spark, str(tmp_path / "out"), ticks.TICKS)
    shown = lambda rows: spark.createDataFrame(rows, schema).select("camera", F.col("t").cast("timestamp").alias("ts"), F.array(F.lit("a"), F.lit("b")).alias("classes"))
    for rows in slices:
        arrive(shown(rows), str(tmp_path / "in"), "camera")
        run_available(ticks.live_ticks(arriving(spark, str(tmp_path / "in"), shown(rows).schema, 100), 60_000, "30 seconds"), out.sink, str(tmp_path / "checkpoint"))
    kept = shown([r for s in slices for r in s if r != (2, at(100))])
    zero = 1_704_067_200_000
    want = ticks.ticks(kept, 60_000, zero + 870_000)
    got = rows_of(out.read(), "camera", "tick_ms", "frames", "detections", "lately")
    assert got == rows_of(want, "camera", "tick_ms", "frames", "detections", "lately")
    silent = [(t - zero) // 60_000 for c, t, n, _, lately in got if c == 2 and not lately]
    assert silent == list(range(2, 15)) and (4, zero + 60_000, 1, 2, 1) in got


def test_an_edited_rule_keeps_its_clock(spark, tmp_path):
    v1, v2 = [Rule("r", "detected(a)", "LOW", 100), Rule("gone", "detected(a)", "LOW", 30)], [Rule("new", "detected(b)", "INFO", 0), Rule("r", "detected(b)", "HIGH", 60)]
    assert list(parsed_rules(rules_text(v1))) == v1
    frames = spark.createDataFrame([(1, i, f"2024-01-01 00:0{i // 6}:{i % 6 * 10:02d}", ["a", "b"]) for i in range(18)], "camera long, frame_id long, t string, classes array<string>")
    frames = frames.select("camera", "frame_id", F.col("t").cast("timestamp").alias("ts"), "classes", F.array(F.lit(0.5), F.lit(0.5)).alias("confs"))
    versions = spark.createDataFrame([("2023-01-01", rules_text(v1)), ("2024-01-01 00:00:50", rules_text(v2))], "since string, rules string")
    got = rows_of(reload.versioned_fires(frames.withColumn("frame_no", F.col("frame_id") + 1), versions, ["a", "b"]), "rule_id", "frame_no", "severity")
    assert [x for x in got if x[0] == "r"] == [("r", 1, 1), ("r", 7, 3), ("r", 13, 3)]
    assert [x for x in got if x[0] == "gone"] == [("gone", 1, 1), ("gone", 4, 1)] and len([x for x in got if x[0] == "new"]) == 13
    out = CommittedTable(spark, str(tmp_path / "out"), ALERTS)
    for part, known in ((0, 1), (1, 2)):
        arrive(frames.filter(F.expr(f"frame_id div 5 >= 1 = {bool(part)}")), str(tmp_path / "in"), "camera")
        loaded = versions.orderBy("since").limit(known)
        reload.run_reloading(arriving(spark, str(tmp_path / "in"), frames.schema), lambda v=loaded: v, lambda b, n: out.sink(b.drop("ts"), n), str(tmp_path / "checkpoint"), "2024-01-01", "2024-01-02")
    assert rows_of(out.read(), "rule_id", "frame_no", "severity") == got


def test_events_without_a_camera_have_no_queue(spark):
    """a take of no camera gave a row, though no put of one can come."""
    rows = [(1, 1, "put", 1, "a", 3), (1, 2, "take", None, None, None), (None, 3, "take", None, None, None), (None, 6, "take", None, None, None)]
    events = spark.createDataFrame(rows, "camera long, at long, kind string, frame_no long, rule_id string, severity int")
    assert [tuple(r) for r in queues.taken(events).collect()] == [(1, 2, 1, "a", 3, 0)]


def test_cameras_share_the_state_of_buckets(spark, tmp_path):
    """each camera was a call of the operator and several looks into its state; now a bucket of them is."""
    rows = spark.range(1500).select(F.col("id").alias("camera"), F.lit(1).cast("long").alias("frame_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.array(F.lit("a")).alias("classes"), F.array(F.lit(0.5)).alias("confs"))
    arrive(rows, str(tmp_path / "in"), "camera")
    alerts, out = live.live_alerts(arriving(spark, str(tmp_path / "in"), rows.schema, 100), [Rule("r", "detected(a)", "LOW", 100)]), CommittedTable(spark, str(tmp_path / "out"), ALERTS)
    run = alerts.drop("ts").writeStream.foreachBatch(out.sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert out.read().select("camera").distinct().count() == 1500
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 256


def test_puts_and_takes_of_a_camera_meet(spark, tmp_path):
    """with both sides of the union dealt by camera already, a late broadcast made Spark leave out the scan's shuffle, and takes got nothing."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "200")
    shift = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")
    events = own.read.parquet("/root/testdata/sf0.1/events.parquet").select("*", shift).withColumn("user_id", F.col("user_id") + F.col("k") * 1500).drop("k")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["alert_takes"](own, str(tmp_path)).agg(F.count("*"), F.count("frame_no")).first()
    assert tuple(got) == (77_190, 77_124)
