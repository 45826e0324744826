"""State of many keys under one: stateful operators that a batch calls once per bucket of keys, not once per key.

A call of a stateful operator, and each look into its state, costs milliseconds whatever it does. So cameras are dealt by their hash to a
fixed number of buckets; a bucket's state is one value, read and written once a batch, and holds each of its keys' own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

#: Buckets that keys are dealt to. A bucket's keys are in one task's memory at a time: raise it with millions of cameras, before a checkpoint's first run.
BUCKETS = 256


def in_buckets(rows: DataFrame, *keys: str, buckets: int = BUCKETS) -> GroupedData:
    """rows grouped by the bucket of their keys."""
    return rows.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(buckets))).groupBy("_bucket")


def whole(column: pd.Series) -> list:
    """A column of whole numbers, which comes as floats where some are missing."""
    return column.tolist() if column.dtype.kind == "i" else [None if pd.isna(x) else int(x) for x in column]


class BucketProcessor(StatefulProcessor):
    """held: what the bucket's keys hold, by key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", StructType([StructField("held", BinaryType())]))

    def load(self) -> dict:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}

    def save(self, held: dict) -> None:
        self.state.update((pickle.dumps(held, pickle.HIGHEST_PROTOCOL),))

    def close(self) -> None:
        pass


def by_key(parts: Iterator[pd.DataFrame], keys: tuple[str, ...], numbers: tuple[str, ...], others: tuple[str, ...]) -> dict:
    """Rows as tuples (numbers, then others), by key (its value, or a tuple of several). numbers and keys named camera are whole numbers."""
    found: dict = {}
    for part in parts:
        key = [whole(part[k]) if k == "camera" else part[k].tolist() for k in keys]
        for k, row in zip(key[0] if len(keys) == 1 else zip(*key, strict=True), zip(*[whole(part[c]) for c in numbers], *[part[c] for c in others], strict=True), strict=True):
            found.setdefault(k, []).append(row)
    return found
