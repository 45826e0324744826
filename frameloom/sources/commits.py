"""Tables of numbered versions: what is written counts from the moment its number is claimed, and a number is claimed once.

A version is a folder of rows beside a claim, a small file that names the folder. A claim appears whole or not at all, and only if there
was none: by a hard link on a local file system, by a rename that does not overwrite elsewhere. So a stream's batch that is run again
adds nothing, readers never see half a version, and of two writers of one number the second learns that it lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _place(spark: SparkSession, path: str):
    """(file system, qualified path) on whatever file system a path is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file that holds text; False if there is one already, which stays as it is."""
    jvm = spark._jvm
    fs, to = _place(spark, path)
    _, draft = _place(spark, f"{path}.{uuid.uuid4().hex}.draft")
    fs.mkdirs(to.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            paths = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(paths.get(to.toUri()), paths.get(draft.toUri()))
        else:
            keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, to, keep)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True


class CommittedTable:
    """A table at a path, in versions numbered from 0; any number may be missing."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self) -> dict[int, str]:
        """Claimed numbers and the folders that hold their rows."""
        fs, claims = _place(self.spark, f"{self.path}/claims")
        if not fs.exists(claims):
            return {}
        found = {}
        for status in fs.listStatus(claims):
            name = status.getPath().getName()
            if name.isdigit():
                stream = fs.open(status.getPath())
                found[int(name)] = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
        return dict(sorted(found.items()))

    def read(self, numbered: bool = False, upto: int | None = None) -> DataFrame:
        """The rows of all versions (up to a number), with their number as `version` if asked for."""
        out = None
        held: dict[str, int] = {folder: v for v, folder in self.versions().items() if upto is None or v <= upto}
        if held:
            out = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}" for folder in held])
            if numbered:
                folder = F.regexp_extract(F.col("_metadata.file_path"), "/rows-([0-9]+)-[0-9a-f]+/", 1)
                out = out.select("*", folder.cast("long").alias("version"))
            return out
        out = self.spark.createDataFrame([], self.schema)
        return out.withColumn("version", F.lit(None).cast("long")) if numbered else out

    def put(self, rows: DataFrame, version: int) -> bool:
        """Write rows as a version; False, and nothing written, if its number is taken."""
        if version in self.versions():
            return False
        folder = f"rows-{version:012d}-{uuid.uuid4().hex}"
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*cast).write.parquet(f"{self.path}/{folder}")
        if claim(self.spark, f"{self.path}/claims/{version:012d}", folder):
            return True
        fs, lost = _place(self.spark, f"{self.path}/{folder}")
        fs.delete(lost, True)
        return False

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: a batch is the version of its number, however often it is run.

        One that is run again after it was claimed, but before its stream knew, still has to go through its operators, whose state is not committed yet.
        """
        if batch_id in self.versions():
            batch.write.format("noop").mode("overwrite").save()
        else:
            self.put(batch, batch_id)

    def append(self, build: Callable[[DataFrame], DataFrame | None], tries: int = 20) -> int | None:
        """Add the rows that `build` makes of the table as it stands, as the next version; returns that number, or None if build has no rows to add.

        If another writer claims the number first, build is asked again over what that one wrote; what it raises is passed on.
        """
        for _ in range(tries):
            last = max(self.versions(), default=-1)
            rows = build(self.read(upto=last))
            if rows is None:
                return None
            if self.put(rows, last + 1):
                return last + 1
        raise TimeoutError(f"{self.path}: other writers were first {tries} times")
