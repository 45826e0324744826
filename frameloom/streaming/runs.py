"""Running streams: over what has arrived, in steps that may break off and go on, into tables that hold each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """For an application that runs stateful operators: keep their state in RocksDB, in this session, unless it names another store that can hold them."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


def run_available(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream until all that has arrived went through sink(batch, batch_id).

    The checkpoint, a folder that all executors share, holds the offsets and the state: a later call goes on after the last batch that was
    finished, and runs one that broke off again, with the same rows and number.
    """
    run = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def arrive(rows: DataFrame, folder: str, key: str) -> None:
    """Add rows to a folder that a stream reads, all of a key in one file, so that whichever files a batch takes, it takes a key's rows of one arrival together."""
    rows.repartition(key).write.mode("append").parquet(folder)


def arriving(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """The stream of a folder's files, oldest first, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
