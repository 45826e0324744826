"""Greedy, ordered and stateful operators against plain Python."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from frameloom.functions.boxes import rounded
from frameloom.functions.names import percent
from frameloom.operators import captures, dedup, gates, labels, matching, merging, policies, splits, verification
from frameloom.plans import annotate, plugins
from frameloom.queries import QUERIES
from frameloom.sources import files, sinks
from frameloom.streaming import live, memory
from frameloom.streaming.rules import Rule, compile_condition, holds, load_rules

BOX = "struct<cx: double, cy: double, w: double, h: double>"


def iou(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    inter = max(w, 0.0) * max(h, 0.0)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter) if inter > 0 else 0.0


def some_boxes(rng, n):
    return [(round(rng.uniform(0.3, 0.6), 2), round(rng.uniform(0.3, 0.6), 2), round(rng.uniform(0.2, 0.5), 2), round(rng.uniform(0.2, 0.5), 2)) for _ in range(n)]


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(7)
    return {k: (some_boxes(rng, rng.randrange(5)), some_boxes(rng, rng.randrange(5))) for k in range(150)}


def sides(spark, groups):
    rows = [[(k, i, b) for k, g in groups.items() for i, b in enumerate(g[s])] for s in (0, 1)]
    return [spark.createDataFrame(r, f"k long, ord int, box {BOX}") for r in rows]


def test_match_in_order(spark, groups):
    got = {r["k"]: (r["tp"], r["fp"], r["fn"], round(r["iou_sum"], 6)) for r in matching.match_in_order(*sides(spark, groups), ["k"], 0.3).collect()}
    for k, (a, b) in groups.items():
        left, tp, total = list(range(len(b))), 0, 0.0
        for x in a:
            best = max(left, key=lambda j: (iou(x, b[j]), -j), default=None)
            if best is not None and iou(x, b[best]) >= 0.3:
                left.remove(best)
                tp, total = tp + 1, total + iou(x, b[best])
        if a or b:
            assert got[k] == (tp, len(a) - tp, len(b) - tp, round(total, 6))


def test_match_by_overlap(spark, groups):
    got = {r["k"]: (r["matched"], r["only_a"], r["only_b"]) for r in matching.match_by_overlap(*sides(spark, groups), ["k"], 0.3).collect()}
    for k, (a, b) in groups.items():
        used_a, used_b = set(), set()
        for s, i, j in sorted((-iou(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)):
            if -s >= 0.3 and i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
        if a or b:
            assert got[k] == (len(used_a), len(a) - len(used_a), len(b) - len(used_a))


def keep_brute(rows, t):
    kept, out = [], {}
    for o, h, flip, sha in rows:
        if h is None:
            of = next((k for k, kh, ks in kept if kh is None and ks is not None and ks == sha), None)
        else:
            known = [(k, kh) for k, kh, _ in kept if kh is not None]
            of = next((k for k, kh in known if kh == h), None)
            if of is None:
                of = next((k for k, kh in known if any(x is not None and bin((x ^ kh) & (1 << 64) - 1).count("1") < t for x in (h, flip))), None)
        out[o] = (of is None, of)
        if of is None:
            kept.append((o, h, sha))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keep_in_order(spark, seed):
    rng, rows = random.Random(seed), []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bases = [rng.getrandbits(64) for _ in range(6)]
    for o in range(120):
        if rng.random() < 0.1:
            rows.append((o, None, None, rng.choice(["x", "y", None])))
            continue
        near = lambda: signed(rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
        rows.append((o, near(), near() if rng.random() < 0.5 else None, "s"))
    got = dedup.keep_in_order(spark.createDataFrame(rows, "ord long, h long, flip long, sha string"), 5)
    assert {r["ord"]: (r["kept"], r["duplicate_of"]) for r in got.collect()} == keep_brute(rows, 5)


def test_keep_in_order_of_nothing(spark):
    assert dedup.keep_in_order(spark.createDataFrame([], "ord long, h long, flip long, sha string")).collect() == []


def test_greedy_caps(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.randrange(4)) for s in "ab" for i in range(60) for _ in range(rng.randrange(1, 5))]
    caps = {1: 20, 2: 12}
    got = {tuple(r) for r in merging.greedy_caps(spark.createDataFrame(rows, "s string, image long, class_id int"), ["s"], "image", caps, most=25).collect()}
    want = set()
    for s in "ab":
        n, taken = dict.fromkeys(caps, 0), 0
        for i in range(60):
            own = [c for x, y, c in rows if (x, y) == (s, i)]
            if taken < 25 and not any(c in caps and n[c] >= caps[c] for c in own):
                want.add((s, i))
                taken += 1
                for c in own:
                    if c in n:
                        n[c] += 1
    assert got == want


def test_splits_keep_groups_whole(spark):
    df = spark.range(300).select(F.concat(F.lit("g"), F.expr("id div 5")).alias("group_key"))
    got = splits.group_aware(df).collect()
    assert len({r["group_key"] for r in got}) == len(got) == 60
    assert [sum(r["split"] == s for r in got) for s in splits.NAMES] == [48, 6, 6]
    assert sorted(map(tuple, got)) == sorted(map(tuple, splits.group_aware(df.repartition(3)).collect()))
    with pytest.raises(NotImplementedError):
        splits.strategy("kfold")


def test_stratified_balances(spark):
    hist = spark.range(100).select(F.col("id").alias("group_key"), (F.col("id") % 3).cast("int").alias("class_id"), (F.col("id") % 7 + 1).alias("n"))
    got = {r["group_key"]: r["split"] for r in splits.stratified(hist, spark.range(100).select(F.col("id").alias("group_key"), F.lit(1).alias("images"))).collect()}
    assert len(got) == 100 and set(got.values()) == set(splits.NAMES)
    assert 60 <= sum(s == "train" for s in got.values()) <= 90


def test_conditions(spark):
    frame = spark.createDataFrame([(["knife", "person"], {"stove": 40})], "c array<string>, s map<string, int>")
    cases = {
        "detected(knife) AND detected(person)": True, "NOT detected(knife)": False, "absent_for(stove, 3)": False, "absent_for(stove, 2)": True, "absent_for(door, 9)": True, "absent_for(door, 11)": False,
        "any_of([bed, knife]) AND detected(nothing)": True, "detected(bed) AND detected(bed) OR detected(knife)": False, "detected(knife) AND detected(bed) OR detected(person)": True, "near(a, b)": False, "": False,
    }
    row = frame.select(*[compile_condition(c, F.col("c"), F.col("s"), 15.0).alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert list(row) == list(cases.values())
    assert [holds(c, {"knife", "person"}, {"stove": 40}, 15.0) for c in cases] == list(cases.values())
    assert [r.rule_id for r in load_rules([{"condition": "x"}, {"id": "a"}])] == ["a"]


RULES = [Rule("ab", "detected(a) AND detected(b)", "HIGH", 40), Rule("gone", "detected(a) AND absent_for(c, 2)", "CRITICAL", 25), Rule("any", "any_of([b, c])", "INFO", 10)]


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(cam, i, f"2024-01-01 00:{i // 6:02d}:{i % 6 * 10:02d}", sorted(rng.sample("abc", rng.randrange(4)))) for cam in (1, 2, 3) for i in range(40)]
    raw = spark.createDataFrame(rows, "camera long, frame_id long, t string, classes array<string>").select("camera", "frame_id", F.col("t").cast("timestamp").alias("ts"), "classes", F.transform("classes", lambda _: F.lit(0.5)).alias("confs"))
    for part in range(4):
        raw.filter(F.expr(f"frame_id div 10 = {part}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.live_alerts(stream, RULES, fps=5.0, window=20)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r["camera"], r["frame_no"], r["rule_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = raw.withColumn("frame_no", F.col("frame_id") + 1)
    want = memory.fired(memory.rule_matches(batch, RULES, ["a", "b", "c"], fps=5.0, window=20), RULES)
    assert got == sorted((r["camera"], r["frame_no"], r["rule_id"]) for r in want.collect()) and got


def test_queue(spark):
    rng = random.Random(9)
    rows = [(1, i, 0, rng.randrange(5), f"r{i}") for i in range(40)]
    held = []
    for _, i, _, s, name in rows:
        if len(held) >= 4:
            low = min(held)
            if low[0] >= s:
                continue
            held.remove(low)
        held.append((s, i, name))
    want = [n for s, i, n in sorted(held, key=lambda x: (-x[0], x[1]))]
    got = memory.queued(spark.createDataFrame(rows, "camera long, frame_no long, rule_no int, severity int, rule_id string"), 4).orderBy("place")
    assert [r["rule_id"] for r in got.collect()] == want


def test_ledger_append_is_idempotent(spark, tmp_path):
    log = verification.ledger(spark, str(tmp_path / "log"))
    log.put(spark.createDataFrame([(1, 2, "s", "present_labeled", 1, 1)], log.schema), 0)
    new = spark.createDataFrame([(1, 2, "s", "present_labeled", 1, None), (3, 2, "s", "verified_absent", 0, None)], "image long, class_id int, source string, status string, boxes long, supersedes string")
    assert verification.append(log, new) == 1
    assert verification.append(log, new) == 0 and list(log.versions()) == [0, 1]
    changed = new.withColumn("boxes", F.lit(5).cast("long"))
    with pytest.raises(ValueError, match="conflict"):
        verification.append(log, changed)


def test_sources_and_sinks(spark, tmp_path):
    block = "a/x.jpg\n2\n1 2 30 40 0 0 0 0\n5 5 3 9 0 0 0 0\nb/y.jpg\n0\n0 0 0 0\nc/z.jpg\n1\n1 1 9 9 0 0 0 1\n"
    got = files.block_boxes(spark.createDataFrame([(block,), (None,), ("",)], "text string")).collect()
    assert [tuple(r) for r in got] == [("a/x.jpg", 1.0, 2.0, 30.0, 40.0)]
    texts = spark.createDataFrame([("p", "obj.names", "cat\ndog\n"), ("p", "data/i.txt", "0 0.5 0.5 0.1 0.1"), ("p", "data/i.jpg", "")], "package string, name string, text string")
    packed = sinks.packages(texts, "package", F.col("name"))
    entries = files.archive_entries(packed.select(F.col("package").alias("path"), "content"))
    assert [tuple(r)[1:] for r in files.export_names(entries).orderBy("class_id").collect()] == [(0, "cat"), (1, "dog")]
    assert [r["stem"] for r in files.export_labels(entries).collect()] == ["i"]
    assert files.scan_images(spark, str(tmp_path / "none")).count() == 0
    assert files.load_taxonomy(spark, "nc: 2\nnames: [a, b]").count() == 2
    several = spark.createDataFrame([(1, "nc: 1\nnames: {4: x}"), (2, "nc: [\n"), (3, None), (4, "nc: 3\nnames: [a]")], "path long, text string")
    assert sorted(map(tuple, files.taxonomies(several).collect()))[0] == (1, 4, "x", None)
    assert [(r["path"], r["problem"][:8]) for r in files.taxonomies(several).orderBy("path").collect() if r["problem"]] == [(2, "no YAML:"), (3, "nc and n"), (4, "nc is 3,")]
    kept = files.consents(spark.createDataFrame([("a", "consents: {C: {house_id: h, withdrawn: true}}"), ("b", "consents: {C: {}}"), ("c", "")], "path string, text string")).orderBy("path").collect()
    assert [tuple(r) for r in kept] == [("a", "C", "h", "", "", True, None), ("b", None, None, None, None, None, "C: no house_id")]
    with pytest.raises(ValueError):
        files.load_json_strict('{"a": {"b": 1, "b": 2}}')
    texts = ['{"a":1,"a":2}', '{"a":1}', '{"a":{"b":1,"b":2}}', '[{"a":[{"c":1,"c":1}]}]', '[{"a":1},{"a":1}]', '{"a":1,"a":', "", None, '{"a":{"a":{"a":1}}}']
    broken = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["text"] for r in files.repeated_keys(broken).collect()] == [texts[0], texts[2], texts[3]]
    assert sinks.as_markdown(spark.createDataFrame([(1, "x")], "a int, b string"), "T").endswith("| 1 | x |\n")


def test_backends(spark):
    images = spark.createDataFrame([(1, None, [3, 5])], "image long, content binary, class_ids array<int>")
    found = annotate.annotate(images, "corners", 0.2)
    assert [(r["class_id"], r["conf"]) for r in found.collect()] == [(3, 0.25)]
    assert annotate.rerun_differences(found, annotate.annotate(images, "corners", 0.2)).count() == 0
    with pytest.raises(KeyError):
        annotate.annotate(images, "none")


def test_policies_and_gates(spark):
    images = spark.createDataFrame([(1, "a"), (2, "b")], "image long, source string")
    assert {r["image"]: len(r["ids"]) for r in policies.verified_absence(images, 23).collect()} == {1: 23, 2: 23}
    slugged = policies.per_slug(images, spark.createDataFrame([(1, "x")], "image long, slug string"), spark.createDataFrame([("x", [2, 1])], "slug string, ids array<int>"))
    assert [tuple(r) for r in slugged.collect()] == [(1, "a/x", [1, 2])]
    with pytest.raises(ValueError):
        merging.require_empty(merging.without_provenance(images, images.filter("image = 1")), "unknown images")
    assert gates.exit_code(spark.createDataFrame([("x", 0, 2)], "check string, criticals int, warnings int")).first()[0] == 2
    assert labels.lines_of(spark.createDataFrame([(1, "# c\n\n0 1 1 1 1\r\n")], "image int, text string")).collect()[0]["line_num"] == 3


def test_conditions_that_are_not_understood(spark):
    from frameloom.streaming.rules import terms

    assert terms("detected(a b)") == terms("seen(a)") == terms("absent_for(a)") == terms("absent_for(a, soon)") == terms("") == [[("never", ())]]
    assert terms(" NOT  detected( knife ) OR absent_for(stove,2.5) AND detected(person)") == [[("lacks", ("knife",)), ("absent", ("stove", 2.5))], [("has", ("person",))]]
    assert terms("detected(x) AND any_of([a, b])") == [[("has", ("a",)), ("has", ("b",))]] and terms("any_of([])") == [[("never", ())]]


def test_rules_are_read_anew_for_each_batch(spark):
    texts, seen = ["[rule", "detected(a)", "?", "detected(b)"], []

    def load():
        if (t := texts.pop(0)).startswith("?"):
            raise ValueError(t)
        return load_rules([{"id": "r", "condition": t}])

    run = live.with_reloaded_rules(load, lambda batch, rules: seen.append((batch.count(), rules[0].condition)))
    for n in range(4):
        run(spark.range(n), n)
    assert seen == [(0, "[rule"), (1, "detected(a)"), (2, "detected(a)"), (3, "detected(b)")]
    with pytest.raises(ValueError):
        live.with_reloaded_rules(lambda: load_rules([{"id": "r", "cooldown_seconds": "x"}]), print)(spark.range(1), 0)


def test_labels_are_staged_and_made_final(spark, tmp_path):
    path, final = str(tmp_path / "staged"), str(tmp_path / "final")
    schema = "session string, annotator string, stem string, text string"
    captures.stage_labels(spark.createDataFrame([("s1", "ann", "i", "0 0.5 0.5 0.1 0.1"), ("s1", "bob", "i", "1 0.5 0.5 0.1 0.1\nbad")], schema), path)
    captures.stage_labels(spark.createDataFrame([("s1", "bob", "i", "2 0.5 0.5 0.1 0.1\n2 0.4 0.5 0.1 0.1"), ("s2", "ann", "j", "")], schema), path)
    staged = spark.read.parquet(path)
    chosen = spark.createDataFrame([("s1", "bob")], "session string, annotator string")
    assert [tuple(r) for r in captures.finalize_labels(staged, chosen, final).collect()] == [("s1", 2, 2)]
    assert spark.read.parquet(final).count() == 1
    with pytest.raises(FileNotFoundError):
        captures.finalize_labels(staged, spark.createDataFrame([("s9", "bob")], "session string, annotator string"), final)


def test_an_evaluation_set_is_locked_once(spark, tmp_path):
    files_ = spark.createDataFrame([("v1", "a.jpg", "x"), ("v1", "b.jpg", "y")], "set string, name string, sha string")
    path = str(tmp_path / "locks")
    digest = captures.lock_eval_set(files_, "v1", path)
    assert digest == hashlib.sha256(b"a.jpg:x\nb.jpg:y").hexdigest()
    with pytest.raises(ValueError, match="locked"):
        captures.lock_eval_set(files_, "v1", path)
    with pytest.raises(ValueError, match="empty"):
        captures.lock_eval_set(files_, "v2", path)


def test_plugins_keep_their_contract(spark):
    bad = plugins.Plugin("bad", "1", lambda f: f)
    with pytest.raises(ValueError, match="bad returns"):
        plugins.analyze(spark.range(1), [bad])
    with pytest.raises(ValueError, match="no plugin"):
        plugins.analyze(spark.range(1), [plugins.Plugin("late", "1", lambda f: f, ready=lambda: "no")])
    plugins.register(bad)
    with pytest.raises(ValueError, match="taken"):
        plugins.register(bad)


def test_ledger_entries_of_one_append_are_numbered(spark, tmp_path):
    log = verification.ledger(spark, str(tmp_path / "log"))
    log.put(spark.createDataFrame([(1, 2, "s", "present_labeled", 1, 4)], log.schema), 0)
    new = spark.createDataFrame([(3, 2, "s", "verified_absent", 0, None), (3, 2, "s", "present_labeled", 2, None)], "image long, class_id int, source string, status string, boxes long, supersedes string")
    assert verification.append(log, new) == 2
    assert sorted(r["seq"] for r in log.read().filter("image = 3").collect()) == [5, 6]


def test_percent_is_rounded_by_the_double(spark):
    """6.25 is a half and goes to 6.2, as C prints it; 0.15 is below one."""
    pairs = [(a, b) for b in (1, 7, 16, 80, 112, 400, 560, 2000, 20_000) for a in range(0, min(b, 120) + 1)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r["a"], r["b"]) for r in got if r["p"] != f"{100.0 * r['a'] / r['b']:.1f}%"] == []
    assert spark.range(1).select(percent(F.lit(1), F.lit(0))).first()[0] == "0.0%"


def test_index_documents_keep_their_numbers(spark):
    """documents numbered anew in each of three readings met those of other documents, and nine boxes of ten were lost at sf0.1."""
    assert QUERIES["scan_coco_json"](spark, "/root/testdata/sf0.1").count() == 193_072


def test_rounded_goes_by_the_double(spark):
    """0.5171365625 is a double below that half."""
    xs = [0.5171365625, 0.3195254687500000, 2.5e-9, 0.0, -0.5, 123.4, *[k / 1024 for k in range(0, 2000, 37)], *[k * 3.90625e-8 for k in range(200)]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(rounded(F.col("x"), 9)).collect()]
    half_up = lambda y: float(int(y)) + (y - int(y) >= 0.5)
    assert got == [(-1 if x < 0 else 1) * half_up(abs(x) * 1e9) / 1e9 for x in xs]


def test_a_label_line_is_parted_once(spark):
    """a line was parted anew for each look at its fields, 33 times in this plan."""
    lines = spark.range(3).select(F.concat(F.col("id").cast("string"), F.lit(" 0.5 0.5 0.1 0.1")).alias("raw"))
    a = labels.annotations_of(lines).select("class_id", F.round("box.cx", 6), F.round("box.h", 6))
    assert a.count() == 3
    assert a._jdf.queryExecution().optimizedPlan().toString().count("\\s+") <= 2


def test_classes_are_distinct_before_they_are_joined(spark):
    """all boxes of a class were sent to one task to find whether there is one."""
    plan = QUERIES["empty_missing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") >= 2


def test_rows_of_readers_leave_in_bounded_batches():
    """archive_entries handed on a frame an entry; F19, F22, F23: other readers one of all rows of a file."""
    taken = []
    rows = ((taken.append(i), ("p", i, b"x" * size))[1] for i, size in enumerate([1] * 10_000 + [3 << 20] * 4))
    found, seen = files._batches(rows, ["a", "b", "c"]), []
    for frame in found:
        seen.append(len(frame))
        assert len(taken) == sum(seen) and frame["c"].map(len).sum() < files.OUT_BYTES + (3 << 20)
    assert max(seen) == files.OUT_ROWS and sum(seen) == 10_004 and len(seen) == 4


def test_blocks_are_read_a_line_at_a_time(spark):
    """the lines of a file and all its boxes were lists."""
    assert next(files._lines("a\n" * 9, 3)) == "a"
    texts = ["", "a", "a\n", "\n\na\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j ", "\r\n\r\n", "\n\r"]
    assert all(list(files._lines(t, n)) == t.splitlines() for t in texts for n in (0, 1, 2, 5, 99))
    many = "".join(f"n{i}\n{i % 3}\n" + "1 2 9 9 0 0 0 0\n" * max(i % 3, 1) for i in range(9_000))
    odd = "n\nx\nm\n1\n1 2 8 8\n\nk\n3\n1 2 9 9\n1 2 7 9"
    got = [tuple(r) for r in files.block_boxes(spark.createDataFrame([(many,), (odd,)], "text string").coalesce(1)).collect()]
    assert got == [(f"n{i}", 1.0, 2.0, 9.0, 9.0) for i in range(9_000) for _ in range(i % 3)] + [("m", 1.0, 2.0, 8.0, 8.0), ("k", 1.0, 2.0, 9.0, 9.0)]


def test_long_registries_are_read_an_entry_at_a_time():
    """a registry's nodes and values were held whole. Any form of document gives what the whole reading gives."""
    long = "a: [1]\nconsents:\n" + "".join(f"  k{i}: {{house_id: h{i}}}\n" for i in range(20_000)) + "z: {b: c}\n"
    first = files._entries(long + "bad: [", "consents")
    assert next(first) == ("k0", {"house_id": "h0"}) and next(first)[0] == "k1"
    assert files._consent_rows(long) == sorted((f"k{i}", f"h{i}", "", "", False) for i in range(20_000))
    texts = [
        "", "# none", "a: 1", "consents:", "consents: {}", "consents: null", "consents: {a: {house_id: h}, a: {house_id: i}}", "consents: {a: {house_id: h}}\nconsents: {b: {house_id: i}}", "consents: {b: {}, a: }",
        "x: &d {house_id: q}\nconsents:\n  a: *d\n  b:\n    <<: *d\n    scope: s\n", "x: &d {a: {house_id: q}}\nconsents: *d", "x: &d {a: {house_id: q}}\nconsents:\n  <<: *d\n  b: {house_id: 'r'}\n", "x: &d {consents: {a: {house_id: q}}}\n<<: *d",
        "consents: &c {a: {house_id: h, granted_on: 2026-01-02, withdrawn: yes}}", "--- {consents: {a: &e {house_id: h}, b: *e}}\n...\n", "consents: {a: {house_id: h}}\n---\nb: 1", "consents: {a: {house_id: h}}\nb: !what 1", "consents: {a: {house_id: h}", "consents: {a: {house_id: *no}}", "consents:\n\ta: 1",
    ]

    def whole(text):
        rows = []
        for key, entry in sorted((files._yaml(text).get("consents") or {}).items()):
            if not (entry or {}).get("house_id"):
                raise ValueError(f"{key}: no house_id")
            rows.append((key, entry["house_id"], str(entry.get("granted_on", "")), entry.get("scope", ""), bool(entry.get("withdrawn", False))))
        return rows

    def said(read, text):
        try:
            return read(text)
        except ValueError as e:
            return str(e)[:7] if str(e).startswith("no YAML") else str(e)

    assert [said(files._consent_rows, t) for t in texts] == [said(whole, t) for t in texts]


def test_small_files_are_dealt_out_before_they_are_parsed(spark):
    """a table in one partition was parsed by one task."""
    rows = spark.range(2_000).select("id", F.concat(F.lit("nc: 1\nnames: [a"), "id", F.lit("]")).alias("text")).withColumnRenamed("id", "path").coalesce(1)
    got = files.taxonomies(rows)
    assert got.count() == 2_000 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_archives_without_content_have_no_entries(spark):
    """archives are taken from Arrow one at a time; a null one was an error."""
    packed = sinks.packages(spark.createDataFrame([(7, "a.txt", "x"), (7, "b.txt", None)], "package long, name string, text string"), "package", F.col("name"))
    rows = packed.select("package", "content").union(spark.createDataFrame([("null", None), ("broken", bytearray(b"PK"))], "package string, content binary"))
    got = files.archive_entries(rows.select(F.col("package").alias("path"), "content")).collect()
    assert [(r["archive"], r["entry"], bytes(r["content"])) for r in got] == [("7", "a.txt", b"x"), ("7", "b.txt", b"")]
