"""A whole merge against plain Python, and quality checks over files with one fault each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import dedup
from frameloom.plans import qa
from frameloom.plans.merge import merge_sources, salvaged
from tests.test_dedup import as_lanes, wide_brute

IMAGES = "image long, source string, ord long, sha string, h array<long>, flip array<long>, reason string, allow_empty boolean"
BOXES = "image long, ord long, class_id int, box struct<cx: double, cy: double, w: double, h: double>"


def overlap(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    return 0.0 if w <= 0 or h <= 0 else w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def made(seed, n=80):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(12)]
    images, boxes = [], []
    for i in range(n):
        base = rng.randrange(12)
        h = bases[base] ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0)
        images.append((i, f"s{i % 3}", 1000 + i, f"{base}-{rng.randrange(2)}", as_lanes(h, 1), None, rng.choice([None] * 8 + ["dark"]), rng.random() < 0.2))
        for k in range(rng.randrange(4)):
            boxes.append((i, k, rng.randrange(4), (rng.choice([0.3, 0.32, 0.6]), 0.5, 0.2, 0.2)))
    return images, boxes, [(f"s{s}", c) for s in range(3) for c in range(4) if (s + c) % 2]


def plainly(images, boxes, trusted, same):
    own = {i: [(k, c, b) for j, k, c, b in boxes if j == i] for i, *_ in images}
    fate = {i: "missing_label" if not own[i] and not ok else "filtered" if why else None for i, _, _, _, _, _, why, ok in images}
    kept = wide_brute([(o, h[0] % (1 << 64), None, sha) for i, _, o, sha, h, _, _, _ in images if fate[i] is None], 5)
    by_ord, labels, links = {r[2]: r for r in images}, [], []
    for i, source, o, *_ in images:
        if fate[i] is None:
            fate[i] = "accepted" if kept[o][0] else "duplicate"
            if fate[i] == "accepted":
                labels += [(i, c, b, source, False) for _, c, b in own[i]]
    for i, source, o, sha, *_ in images:
        if fate[i] != "duplicate":
            continue
        of = by_ord[kept[o][1]]
        worth = [(c, b) for _, c, b in own[i] if (source, c) in trusted]
        if of[3] == sha:
            there = [(c, b) for j, c, b, _, _ in labels if j == of[0]]
            labels += [(of[0], c, b, source, True) for c, b in worth if all(c != d or overlap(b, e) < same for d, e in there)]
        elif worth:
            links.append((of[0], i, source, sorted((c, *b) for c, b in worth)))
    return fate, sorted(labels), sorted(links)


@pytest.mark.parametrize("seed,same", [(1, 0.9), (2, 0.5)])
def test_a_merge_from_end_to_end(spark, seed, same):
    images, boxes, trusted = made(seed)
    fate, labels, links = plainly(images, boxes, set(trusted), same)
    m = merge_sources(spark.createDataFrame(images, IMAGES), spark.createDataFrame(boxes, BOXES), spark.createDataFrame(trusted, "source string, class_id int"), 5, same)
    assert {r["image"]: r["disposition"] for r in m.images.collect()} == fate
    assert sorted((r["image"], r["class_id"], tuple(r["box"]), r["source"], r["salvaged"]) for r in m.labels.collect()) == labels
    assert sorted((r["image"], r["of_image"], r["source"], [tuple(b) for b in r["boxes"]]) for r in m.links.collect()) == links
    assert any(x[4] for x in labels) and links
    per = {r["source"]: r for r in m.sources().collect()}
    assert sum(r["salvaged"] for r in per.values()) == sum(x[4] for x in labels) and sum(r["linked"] for r in per.values()) == sum(len(x[3]) for x in links)
    assert all(r["accepted"] + r["duplicates"] + r["filtered_out"] + r["missing_labels"] == r["total"] for r in per.values())
    assert {r["image"] for r in m.provenance().collect()} == {i for i, f in fate.items() if f == "accepted"}
    assert sum(r["n"] for r in m.class_counts().collect()) == len(labels)


def test_a_later_merge_knows_the_earlier_one(spark, tmp_path):
    images, boxes, trusted = made(3)
    whole = merge_sources(spark.createDataFrame(images, IMAGES), spark.createDataFrame(boxes, BOXES), spark.createDataFrame(trusted, "source string, class_id int"))
    got = {}
    for part in (images[:50], images[50:]):
        index = dedup.KeptIndex(spark, str(tmp_path / "kept"), 64)
        m = merge_sources(spark.createDataFrame(part, IMAGES), spark.createDataFrame(boxes, BOXES), spark.createDataFrame(trusted, "source string, class_id int"), index=index)
        got |= {r["image"]: r["disposition"] for r in m.images.collect()}
    assert got == {r["image"]: r["disposition"] for r in whole.images.collect()}


def test_copies_add_in_order_and_boxes_of_one_copy_do_not_meet(spark):
    kept = spark.createDataFrame([(1, 0, (0.5, 0.5, 0.2, 0.2))], "image long, class_id int, box struct<cx: double, cy: double, w: double, h: double>")
    b = [(0.5, 0.5, 0.2, 0.2), (0.1, 0.1, 0.1, 0.1), (0.1, 0.1, 0.1, 0.1), (0.1, 0.1, 0.1, 0.1), (0.8, 0.8, 0.1, 0.1)]
    rows = [(1, 0, b[0], "s", 7, 0), (1, 0, b[1], "s", 7, 1), (1, 0, b[2], "s", 7, 2), (1, 0, b[3], "t", 9, 0), (1, 0, b[4], "t", 9, 1), (1, 1, b[0], "t", 9, 2)]
    copies = spark.createDataFrame(rows, "image long, class_id int, box struct<cx: double, cy: double, w: double, h: double>, source string, copy long, ord long")
    got = sorted((r["class_id"], tuple(r["box"]), r["source"]) for r in salvaged(kept, copies).collect())
    assert got == [(0, b[1], "s"), (0, b[2], "s"), (0, b[4], "t"), (1, b[0], "t")]
    assert salvaged(kept, copies.limit(0)).collect() == []


def test_every_named_check(spark):
    images = [("train", "a.jpg", "a", "1", None), ("train", "b.jpg", "b", "1", None), ("val", "c.jpg", "c", "1", "unreadable"), ("test", "d.jpg", "d", "2", None), ("test", "e.jpg", "e", None, "empty"), ("val", "f.jpg", "f", "2", None)]
    labels = [("train", "a.txt", "a", "0 .5 .5 .1 .1\n# no line\n\n0 .5 .5 .1 .1\r\n0  .5 .5 .1 .1"), ("train", "b.txt", "b", "7 .5 .5 .1 .1\n5 .5 .5 .1 .1\n0 .5 .5 0 .1\n0 .5 1.5 .1 -1"), ("val", "x.txt", "x", "0 .5 .5 .1\n0 .5 .5 .1 wide\n0 .5 .5 .1 inf\n0.5 .5 .5 .1 .1"), ("test", "d.txt", "d", " \n\t"), ("test", "e.txt", "e", None), ("val", "f.txt", "f", "-1 .5 .5 .1 .1")]
    found = qa.annotation_qa(spark.createDataFrame(images, "split string, file string, stem string, sha string, problem string"), spark.createDataFrame(labels, "split string, file string, stem string, text string"), spark.range(5).select(F.col("id").cast("int").alias("class_id")), 7)
    got = sorted(((r["check"], r["file"], r["line"]) for r in found.collect()), key=str)
    assert got == sorted(
        [
            ("duplicate_annotations", "a.txt", 4), ("invalid_class_ids", "b.txt", 1), ("unknown_class_names", "b.txt", 2), ("zero_area_boxes", "b.txt", 3), ("zero_area_boxes", "b.txt", 4), ("bbox_out_of_bounds", "b.txt", 4),
            ("invalid_yolo_format", "x.txt", 1), ("invalid_yolo_format", "x.txt", 2), ("invalid_yolo_format", "x.txt", 3), ("invalid_yolo_format", "x.txt", 4), ("invalid_class_ids", "f.txt", 1),
            ("empty_label_files", "d.txt", None), ("empty_label_files", "e.txt", None), ("missing_label_files", "c.jpg", None), ("missing_image_files", "x.txt", None), ("corrupted_images", "c.jpg", None), ("corrupted_images", "e.jpg", None),
            ("duplicate_images", "b.jpg", None), ("train_val_leakage", "a.jpg", None), ("val_test_leakage", "f.jpg", None),
        ],
        key=str,
    )
    status = {r["check"]: (r["issues"], r["status"]) for r in qa.qa_status(found).collect()}
    assert len(status) == 15 and status["train_test_leakage"] == (0, "PASS") and status["inconsistent_pairs"] == (0, "PASS") and status["duplicate_images"] == (1, "WARNING")
    assert qa.qa_exit_code(found).first()["code"] == 1 and qa.qa_exit_code(found.filter("severity = 'WARNING'")).first()["code"] == 2 and qa.qa_exit_code(found.limit(0)).first()["code"] == 0
    uneven = qa.file_issues(spark.createDataFrame(images[:1], "split string, file string, stem string, sha string, problem string"), spark.createDataFrame(labels[1:3], "split string, file string, stem string, text string"))
    assert sorted((r["split"], r["severity"]) for r in uneven.filter("check = 'inconsistent_pairs'").collect()) == [("val", "INFO")]


def test_review_packages(spark):
    import hashlib
    import io
    import zipfile

    from frameloom.sources import sinks

    images = spark.createDataFrame([(1, "b.jpg"), (1, "a.x.png"), (2, "c.jpg")], "batch long, image string")
    base = spark.createDataFrame([("b.jpg", "3 0.1 0.1 0.1 0.1\r\n \n\n1 0.5 0.5 0.1 0.1"), ("z.jpg", "0 0 0 0 0")], "image string, text string")
    found = [("b.jpg", 2, (0.5, 0.5, 0.1, 0.1)), ("b.jpg", 0, (0.9, 0.5, 0.1, 0.1)), ("b.jpg", 2, (0.25, 0.5, 0.1, 0.1)), ("a.x.png", 1, (0.5, 0.5, 0.1, 0.1))]
    candidates = spark.createDataFrame(found, "image string, class_id int, box struct<cx: double, cy: double, w: double, h: double>")
    packed = sinks.review_packages(sinks.review_texts(images, base, candidates), ["x", "y", "z", "w"])
    first = {r["batch"]: bytes(r["content"]) for r in packed.collect()}
    again = {r["batch"]: r for r in sinks.review_packages(sinks.review_texts(images.repartition(3), base, candidates.repartition(2)), ["x", "y", "z", "w"]).collect()}
    assert all(bytes(again[b]["content"]) == c and again[b]["sha"] == hashlib.sha256(c).hexdigest() for b, c in first.items()) and len(first) == 2
    with zipfile.ZipFile(io.BytesIO(first[1])) as z:
        assert z.namelist() == ["obj.names", "obj.data", "train.txt", "obj_train_data/a.x.txt", "obj_train_data/b.txt"]
        assert z.read("obj_train_data/b.txt").decode() == "3 0.1 0.1 0.1 0.1\n1 0.5 0.5 0.1 0.1\n0 0.900000 0.500000 0.100000 0.100000\n2 0.250000 0.500000 0.100000 0.100000\n2 0.500000 0.500000 0.100000 0.100000\n"
        assert z.read("train.txt") == b"data/obj_train_data/a.x.png\ndata/obj_train_data/b.jpg\n" and z.read("obj.names") == b"x\ny\nz\nw\n"
        assert all(i.date_time == (1980, 1, 1, 0, 0, 0) and i.external_attr >> 16 == 0o644 for i in z.infolist())
    with zipfile.ZipFile(io.BytesIO(first[2])) as z:
        assert z.read("obj_train_data/c.txt") == b""


def test_gates_on_unknown_facts(spark):
    from frameloom.plans import preflight

    training = "run long, loaded boolean, config_problems int, artefact_fingerprint string, live_fingerprint string, images int, missing int, split_mismatch int, stale int, artefact_problems int, unused_policies int, stale_inputs int, library string, library_fits boolean, mixing double, mixing_policy string, ledger_problems int"
    rows = [(1, *[None] * 16), (2, True, 0, "a", "a", 1, 0, 0, 0, 0, 0, 0, "8.3.1", True, 0.0, "forbid", 0), (3, True, *[None] * 15)]
    gates = preflight.training_preflight(spark.createDataFrame(rows, training), "run")
    got = {(r["run"], r["gate_id"]): r["verdict"] for r in gates.collect()}
    assert [got[1, f"G{i}"] for i in range(1, 10)] == ["FAIL", "SKIPPED", "SKIPPED", "SKIPPED", "FAIL", "FAIL", "SKIPPED", "FAIL", "FAIL"]
    assert {got[2, f"G{i}"] for i in range(1, 10)} == {"PASS"} and {got[3, f"G{i}"] for i in range(2, 10)} == {"FAIL"} and got[3, "G1"] == "PASS"
    assert {r["run"]: (r["gates"], r["verdict"]) for r in preflight.verdicts(gates, "run").collect()} == {1: (5, "FAIL"), 2: (9, "PASS"), 3: (9, "FAIL")}
    machine = "run long, free_gb double, remote string, remote_there boolean, remote_free_gb double, downloads boolean, datasets int, has_key boolean, gpu boolean, repo string, cache string, mode string"
    found = preflight.build_preflight(spark.createDataFrame([(1, *[None] * 11), (2, 99.0, "/r", True, 99.0, True, 1, True, True, "/a/onedriver", "/b", "full"), (3, 1.0, "/OneDrive", True, 99.0, True, 1, None, False, "x\\onedrive-y\\z", None, "")], machine), "run", 50.0)
    got = {(r["run"], r["gate_id"]): r["verdict"] for r in found.collect()}
    assert [got[1, f"FB{i}"] for i in range(1, 7)] == ["FAIL", "FAIL", "WARN", "WARN", "PASS", "WARN"] and {got[2, f"FB{i}"] for i in range(1, 7)} == {"PASS"}
    assert [got[3, f"FB{i}"] for i in range(1, 7)] == ["FAIL", "FAIL", "FAIL", "WARN", "WARN", "WARN"]


def test_lines_are_dealt_out_by_their_count(spark, monkeypatch):
    """a task put in order a share of the lines that grew with the table."""
    labels = spark.createDataFrame([("train", f"{i}.txt", str(i), "0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1 0.1\n0 0.5 0.5 0.1 0.1") for i in range(40)], "split string, file string, stem string, text string")
    names = spark.range(5).select(F.col("id").cast("int").alias("class_id"))
    monkeypatch.setattr(qa, "TASK_LINES", 5)
    assert qa._dealt(qa.shared_table(labels.select("split", "file")), "file").rdd.getNumPartitions() == max(9, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert sorted((r["check"], r["file"], r["line"]) for r in qa.line_issues(labels, names, 7).collect()) == sorted(("duplicate_annotations", f"{i}.txt", 3) for i in range(40))
