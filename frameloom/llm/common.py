"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators define it, and its complement.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A dimension of at most this many rows may be broadcast; above it the join is salted.
BROADCAST_ROWS = 20_000
SALTS = 64

#: Bytes of an Arrow batch of texts. Spark's own bound is 64 MB, which each task holds twice outside the heap and once more in Python.
BATCH_BYTES = 4 << 20
#: Paths in the shared folder that this process has written and not deleted.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a local session gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frameloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation of what came before.

    options: those of Spark's writer.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._frameloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that no result reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._frameloom_path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that are done with, between the steps of a long operator.

    Spark deletes them once the driver's JVM finds that nothing refers to their plans; with room on its heap it may not look for half an hour,
    and the files of all steps so far would stay on the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard_all(spark: SparkSession) -> None:
    """Delete every table that this process wrote to the shared folder: for an application that has consumed its results."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def bound_batches(spark: SparkSession) -> None:
    """For an application that passes long texts to Python: Arrow batches of about BATCH_BYTES, a longer text alone, for the rest of the session.

    Operators never change a session's settings; the registered queries and the pipeline are applications, and call this. A smaller bound is kept.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(name).lower().removesuffix("b")
    if not (known.isdigit() and int(known) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def join_dimension(rows: DataFrame, dim: DataFrame, key: str, n_dim: int, spread: Column) -> DataFrame:
    """Left join of rows to a dimension with one row per key, nulls matching nulls.

    The dimension is broadcast only when its counted size is within BROADCAST_ROWS.
    Beyond that both sides carry a salt, so that a key with a third of the rows is dealt to SALTS tasks.
    """
    other = dim.withColumnRenamed(key, "__dim_key")
    if n_dim <= BROADCAST_ROWS:
        return rows.join(F.broadcast(other), rows[key].eqNullSafe(other["__dim_key"]), "left").drop("__dim_key")
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    other = other.withColumn("__dim_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = rows[key].eqNullSafe(other["__dim_key"]) & (rows["__salt"] == other["__dim_salt"])
    return rows.join(other, on, "left").drop("__dim_key", "__dim_salt", "__salt")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """Inner join of rows to a table of their groups, of which n counts the rows; total: their sum, if it is known.

    Groups of more than a thousandth of all rows are fewer than a thousand, whatever the input: these are broadcast, so that a
    group of a third of the rows stays where its rows are. The other rows are shuffled.
    """
    most = (groups.agg(F.sum(n)).first()[0] or 0) / 1000 if total is None else total / 1000
    large, small = groups.filter(F.col(n) > most), groups.filter(F.col(n) <= most)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys)
    return rows.join(F.broadcast(large), keys).unionByName(rest)


def numbered(df: DataFrame, *by: str, tag: str) -> DataFrame:
    """df with name, its rank from 0 in the order of `by` (distinct rows), whatever the number of partitions.

    Ranges are sorted in parallel and written; a partition's ranks follow those before it, so one small row per partition is all that is put together.
    """
    n, df = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), materialize(df, f"{tag}-rows")
    dealt = materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), tag)
    discard(df)
    part = F.shiftright("__at", 33)
    sizes = dict(dealt.groupBy(part.alias("p")).count().collect())  # a row per partition
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return dealt.withColumnRenamed("__at", "name")
    known = df.sparkSession.createDataFrame(sorted(starts.items()), "__p long, __start long")
    placed = dealt.join(F.broadcast(known), part == known["__p"])
    return placed.withColumn("name", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__start")
