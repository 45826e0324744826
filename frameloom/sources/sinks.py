"""Writers: label files, packages, splits and reports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import label_line

#: Zip entries carry this time, so that equal contents make equal archives; a fixed value.
ZIP_TIME = (1980, 1, 1, 0, 0, 0)


def label_texts(boxes: DataFrame, image: str = "image") -> DataFrame:
    """(image, text): an image's boxes as sorted lines."""
    return boxes.groupBy(image).agg(F.array_join(F.array_sort(F.collect_list(label_line(F.col("class_id"), F.col("box")))), "\n").alias("text"))


def packages(texts: DataFrame, package: str, entry: Column) -> DataFrame:
    """(package, content): zip files, one per package of a bounded number of texts; equal inputs give equal bytes."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(frame["entry"], frame["text"], strict=True)):
                z.writestr(zipfile.ZipInfo(name, ZIP_TIME), text or "")
        return pd.DataFrame({"package": [frame["package"].iloc[0]], "content": [out.getvalue()]})

    rows = texts.select(F.col(package).cast("string").alias("package"), entry.alias("entry"), "text")
    return rows.groupBy("package").applyInPandas(pack, "package string, content binary")


#: Entries of a package for review that come before its label files, and where these stand; fixed values of the format.
DATA_TEXT, LABEL_FOLDER = "classes = {n}\ntrain = train.txt\nnames = obj.names\nbackup = backup/\n", "obj_train_data"
FILE_MODE = 0o644 << 16


def review_texts(images: DataFrame, base: DataFrame, candidates: DataFrame) -> DataFrame:
    """(batch, image, text) of a batch's images (batch, image): the lines of their base label files (image, text), blank ones left out, then their candidates (image, class_id, box) in order of class and box."""
    order = F.struct("class_id", F.col("box.cx").alias("cx"), F.col("box.cy").alias("cy"), F.col("box.w").alias("w"), F.col("box.h").alias("h"), label_line(F.col("class_id"), F.col("box")).alias("line"))
    found = candidates.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]).alias("found"))
    kept = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    none = F.array().cast("array<string>")
    both = images.select("batch", "image").join(base.select("image", "text"), "image", "left").join(found, "image", "left")
    lines = F.concat(kept, F.coalesce("found", none))
    return both.select("batch", "image", F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("").alias("text"))


def review_packages(texts: DataFrame, names: list[str]) -> DataFrame:
    """(batch, content, sha): a zip per batch of label texts (batch, image, text): the names, the data file, the list of images, then a label file an image, in order.

    Equal inputs give equal bytes. A batch is what a person reviews at once, so a task holds it whole.
    """
    kind = texts.schema["batch"].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame["image"], frame["text"], strict=True))
        entries = [("obj.names", "".join(f"{n}\n" for n in names)), ("obj.data", DATA_TEXT.format(n=len(names))), ("train.txt", "".join(f"data/{LABEL_FOLDER}/{i}\n" for i, _ in rows))]
        entries += [(f"{LABEL_FOLDER}/{i.rpartition('.')[0] or i}.txt", t) for i, t in rows]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in entries:
                info = zipfile.ZipInfo(name, ZIP_TIME)
                info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, FILE_MODE
                z.writestr(info, text)
        return pd.DataFrame({"batch": [frame["batch"].iloc[0]], "content": [out.getvalue()]})

    packed = texts.groupBy("batch").applyInPandas(pack, f"batch {kind}, content binary")
    return packed.withColumn("sha", F.sha2("content", 256))


def review_labels(names: list[str]) -> str:
    """The label list that a review task is made with: every class a rectangle, in order of id."""
    return json.dumps([{"name": n, "type": "rectangle", "attributes": []} for n in names])


def write_by_split(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path on any file system; 0 if there is none."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def _plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else [_plain(x) for x in v] if isinstance(v, list) else v


def report_rows(report: DataFrame, most: int = 10_000) -> list[dict]:
    """A report's rows, which are aggregates: more than `most` is an error, not a cut."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows; write it as a table")
    return [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in rows]


def as_json(report: DataFrame) -> str:
    return json.dumps(report_rows(report), indent=2, ensure_ascii=False) + "\n"


def as_csv(report: DataFrame) -> str:
    import csv

    rows, out = report_rows(report), io.StringIO()
    if rows:
        w = csv.DictWriter(out, list(rows[0]), extrasaction="ignore", lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
    return out.getvalue()


def as_markdown(report: DataFrame, title: str) -> str:
    rows, names = report_rows(report), report.columns
    line: Iterator = ("| " + " | ".join(str(r[c]) for c in names) + " |" for r in rows)
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *line, ""])


def write_report(report: DataFrame, path: str, title: str) -> None:
    """The report as .json, .csv and .md in one folder, through Spark's file systems."""
    spark = report.sparkSession
    for kind, text in (("json", as_json(report)), ("csv", as_csv(report)), ("md", as_markdown(report, title))):
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{kind}")
