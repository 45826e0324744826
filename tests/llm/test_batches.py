"""Batches of texts are bounded by bytes where an application asks for it, and whole texts arrive whatever their length; tables of the shared folder go when they are done with."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest

from frameloom.llm.common import BATCH_BYTES, bound_batches, discard, materialize, numbered

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes]), pa.array([sum(len(t.as_py() or "") for t in batch.column(1))])], names=["n", "bytes", "chars"])


@pytest.fixture
def setting(spark):
    before = spark.conf.get(NAME)
    yield spark.conf
    spark.conf.set(NAME, before)


def test_batches_stay_near_the_bound_and_lose_nothing(spark, setting):
    texts = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN NULL WHEN id = 9 THEN '' WHEN id = 11 THEN repeat('x', 12000000) ELSE repeat('y', 100000) END AS text")
    bound_batches(spark)
    rows = texts.mapInArrow(sizes, "n long, bytes long, chars long").collect()
    assert sum(r.n for r in rows) == 400
    assert sum(r.chars for r in rows) == 397 * 100_000 + 12_000_000
    assert max(r.bytes for r in rows if r.chars < 12_000_000) < BATCH_BYTES + 200_000


def test_a_smaller_bound_is_kept_and_a_larger_one_is_not(spark, setting):
    setting.set(NAME, "1024")
    bound_batches(spark)
    assert setting.get(NAME).lower().removesuffix("b") == "1024"
    setting.set(NAME, "1g")
    bound_batches(spark)
    assert setting.get(NAME).lower().removesuffix("b") == str(BATCH_BYTES)


def test_discarded_tables_leave_the_folder(spark):
    t = materialize(spark.range(10), "some")
    path = t._frameloom_path.removeprefix("file://")
    assert t.count() == 10 and os.path.isdir(path)
    discard(t)
    assert not os.path.exists(path)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_names_are_ranks_whatever_the_partitions(spark, partitions):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS a").repartition(partitions)
    got = sorted((r["name"], r["a"]) for r in numbered(rows, "a", tag="ranks").collect())
    assert got == [(k, k) for k in range(1000)]
    assert numbered(rows.limit(0), "a", tag="ranks").collect() == []
