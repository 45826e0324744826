"""Readers of images, label files, manifests, index files and archives, as DataFrames. Paths are read by Spark, so any file system it knows will do."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions.headers import image_header
from ..functions.names import IMAGE_ENDINGS, ending, file_name, stem
from ..operators.dedup import numbered_rows, shared_table, small


#: A reader in Python hands its rows on in batches that end at so many rows or bytes: a batch a row is slow, one of all rows is unbounded.
OUT_ROWS, OUT_BYTES = 4_096, 4 << 20


def _batches(rows: Iterable[tuple], names: list[str], dtype=None) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size, each handed on as soon as it is full; bytes are those of the last column."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[-1] or "")
        if len(out) >= OUT_ROWS or held >= OUT_BYTES:
            yield pd.DataFrame(out, columns=names, dtype=dtype)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=names, dtype=dtype)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def scan_images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """path, filename, stem, length of the image files below a folder, their content and sha256 if asked; a missing folder has none."""
    found = _binary(spark, path).filter(ending(F.col("path")).isin(*IMAGE_ENDINGS))
    more = [F.col("content"), F.sha2("content", 256).alias("sha")] if content else []
    return found.select("path", file_name(F.col("path")).alias("filename"), stem(F.col("path")).alias("stem"), "length", *more)


def scan_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, text of the .txt files below a folder; a missing folder has none."""
    found = _binary(spark, path).filter(ending(F.col("path")) == "txt")
    return found.select("path", stem(F.col("path")).alias("stem"), F.decode("content", "utf-8").alias("text"))


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, width, height of the image files below a folder, by their headers; nulls for files that are none."""
    found = scan_images(spark, path, content=True)
    return found.select("path", image_header(F.col("content")).alias("h")).select("path", "h.*")


def read_manifests(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON documents of known fields: unknown ones are ignored, missing ones get a default, broken files are an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()})


def repeated_keys(documents: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose JSON names a key twice in one object, at any depth.

    A variant refuses such objects. What is no JSON at all is refused too, and told apart by the readers that take the last of equal keys. A document
    must fit a variant (16 MB).
    """
    sound = F.coalesce(F.size(F.json_object_keys(text)) >= 0, F.json_array_length(text) >= 0, F.lit(False))
    return documents.filter(sound & F.try_parse_json(text).isNull())


def load_json_strict(text: str) -> dict:
    """A small JSON document of configuration; a key named twice at any depth is an error."""

    def unique(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError(f"a key is named twice: {sorted(k for k, _ in pairs)}")
        return out

    return json.loads(text, object_pairs_hook=unique)


def _parsed(files: DataFrame, rows_of: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows of files (path, text) that a parser of one small file makes; a file that it refuses is a row with its problem, and nulls."""
    kind = files.schema["path"].dataType.simpleString()
    names = [f.strip().partition(" ")[0] for f in schema.split(",")]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    yield from [(path, *r, None) for r in rows_of(text or "")]
                except ValueError as e:
                    yield path, *[None] * len(names), str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _batches(rows(frames), ["path", *names, "problem"], object)

    dealt = files.select("path", "text").repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(run, f"path {kind}, {schema}, problem string")


@cache
def _loader() -> type:
    """A safe loader over libyaml's parser, where there is one, whose nodes can be composed one by one."""
    import yaml

    if not yaml.__with_libyaml__:
        return yaml.SafeLoader

    class Loader(yaml.composer.Composer, yaml.CSafeLoader):
        def __init__(self, text: str):
            yaml.CSafeLoader.__init__(self, text)
            yaml.composer.Composer.__init__(self)

    return Loader


def _yaml(text: str) -> dict:
    import yaml

    try:
        return yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"no YAML: {e}".splitlines()[0]) from e


def _entries(text: str, key: str) -> Iterator[tuple]:
    """What _yaml(text)[key].items() has, an entry at a time, so that a long document's nodes are never held together; of equal keys all come, the last one counts.

    Documents of another form than a plain mapping with one plain mapping under key (merged keys, anchors on either, aliases in their place) are read whole.
    """
    import yaml
    from yaml.events import MappingEndEvent, MappingStartEvent, StreamEndEvent

    load, found = _loader()(text), 0

    def plain_mapping() -> bool:
        return load.check_event(MappingStartEvent) and load.peek_event().anchor is None and load.peek_event().tag is None

    def key_of() -> object:
        node = load.compose_node(None, None)
        if node.tag == "tag:yaml.org,2002:merge":
            raise _Whole
        name = load.construct_document(node)
        if not isinstance(name, str):
            raise _Whole
        return name

    try:
        load.get_event()  # of the stream
        if load.check_event(StreamEndEvent):
            return
        load.get_event()  # of the document
        if not plain_mapping():
            raise _Whole
        load.get_event()
        while not load.check_event(MappingEndEvent):
            if key_of() != key:
                load.construct_document(load.compose_node(None, None))
                continue
            found += 1
            if found > 1 or not plain_mapping():
                raise _Whole
            load.get_event()
            while not load.check_event(MappingEndEvent):
                yield key_of(), load.construct_document(load.compose_node(None, None))
            load.get_event()
        load.get_event()
        load.get_event()  # of the document's end
        if not load.check_event(StreamEndEvent):
            raise _Whole
    except yaml.YAMLError as e:
        raise ValueError(f"no YAML: {e}".splitlines()[0]) from e
    finally:
        load.dispose()


class _Whole(Exception):
    """A document that has to be read whole."""


def _taxonomy_rows(text: str) -> list[tuple]:
    spec = _yaml(text)
    if not isinstance(spec, dict) or "nc" not in spec or "names" not in spec:
        raise ValueError("nc and names are needed")
    names = spec["names"] or []
    rows = sorted((int(k), str(v)) for k, v in (names.items() if isinstance(names, dict) else enumerate(names)))
    if len(rows) != spec["nc"]:
        raise ValueError(f"nc is {spec['nc']}, names are {len(rows)}")
    return rows


def _consent_rows(text: str) -> list[tuple]:
    def row(key: str, entry: dict | None) -> tuple | None:
        if not (entry or {}).get("house_id"):
            return None
        return key, entry["house_id"], str(entry.get("granted_on", "")), entry.get("scope", ""), bool(entry.get("withdrawn", False))

    try:
        rows = {k: row(k, entry) for k, entry in _entries(text, "consents")}
    except _Whole:
        rows = {k: row(k, entry) for k, entry in (_yaml(text).get("consents") or {}).items()}
    for key in sorted(rows):
        if rows[key] is None:
            raise ValueError(f"{key}: no house_id")
    return [rows[key] for key in sorted(rows)]


def taxonomies(files: DataFrame) -> DataFrame:
    """path, class_id, class_name, problem of data.yaml files (path, text), whose names are a list or a mapping; nc and names must be there and agree."""
    return _parsed(files, _taxonomy_rows, "class_id int, class_name string")


def consents(files: DataFrame) -> DataFrame:
    """path, consent_id, house_id, granted_on, scope, withdrawn, problem of registries in YAML (path, text); each entry needs a house."""
    return _parsed(files, _consent_rows, "consent_id string, house_id string, granted_on string, scope string, withdrawn boolean")


def load_taxonomy(spark: SparkSession, text: str) -> DataFrame:
    """(class_id, class_name) of one data.yaml; what is wrong with it is an error."""
    return spark.createDataFrame(_taxonomy_rows(text), "class_id int, class_name string")


def load_consents(spark: SparkSession, text: str) -> DataFrame:
    """The entries of one registry; what is wrong with it is an error."""
    return spark.createDataFrame(_consent_rows(text), "consent_id string, house_id string, granted_on string, scope string, withdrawn boolean")


def coco_boxes(coco: DataFrame, wanted: list[str]) -> DataFrame:
    """(file_name, class_name, box) of index documents with arrays images, annotations, categories; crowds and other classes are left out.

    The documents are written with their numbers first: three readings of them, each numbered anew, need not agree.
    """
    doc = shared_table(coco.withColumn("_doc", F.monotonically_increasing_id()))
    cats = doc.select("_doc", F.explode("categories").alias("c")).select("_doc", F.col("c.id").alias("category_id"), F.col("c.name").alias("class_name"))
    images = doc.select("_doc", F.explode("images").alias("i")).select("_doc", F.col("i.id").alias("image_id"), "i.file_name", F.col("i.width").cast("double").alias("W"), F.col("i.height").cast("double").alias("H"))
    notes = doc.select("_doc", F.explode("annotations").alias("a")).select("_doc", "a.image_id", "a.category_id", "a.bbox", "a.iscrowd").filter("coalesce(iscrowd, 0) = 0")
    met = notes.join(cats.filter(F.col("class_name").isin(*wanted)), ["_doc", "category_id"]).join(images, ["_doc", "image_id"])
    box = B.from_pixels(*[F.col("bbox")[i].cast("double") for i in range(4)], F.col("W"), F.col("H"))
    return met.select("file_name", "class_name", box.alias("box")).filter("box is not null")


def open_images_boxes(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(image, class_name, box) of an index by label id (ImageID, LabelName, XMin, XMax, YMin, YMax), sides above 0 only; names: LabelName, class_name, small."""
    found = rows.join(small(names), "LabelName")
    x0, x1, y0, y1 = (F.col(c).cast("double") for c in ("XMin", "XMax", "YMin", "YMax"))
    return found.filter((x1 > x0) & (y1 > y0)).select(F.col("ImageID").alias("image"), "class_name", B.box((x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0).alias("box"))


def _lines(text: str, piece: int = 1 << 20) -> Iterator[str]:
    """text.splitlines(), of a piece that ends with a line at a time."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + piece) + 1 or len(text)
        yield from text[at:end].splitlines()
        at = end


def block_boxes(files: DataFrame, text: str = "text", least: float = 8.0) -> DataFrame:
    """(name, x, y, w, h) of files of blocks: a name, a count, then so many lines (one even for none).

    A box flagged invalid (eighth field) or under `least` pixels is left out, and so are blocks whose count can't be read. The grammar has state, so a file is read in
    Python, one at a time, and a piece at a time: beside the batch that Spark hands over, a task holds a file's text and OUT_ROWS boxes.
    """

    def parse(lines: Iterator[str]) -> Iterator[tuple]:
        line = next(lines, None)
        while line is not None:
            name, line = line.strip(), next(lines, None)
            if not name or line is None or not line.strip().isdigit():
                continue
            count = int(line)
            for box in islice(lines, max(count, 1)):
                if count:
                    parts = box.split()
                    x, y, w, h = map(float, parts[:4])
                    if w >= least and h >= least and not (len(parts) > 7 and int(parts[7])):
                        yield name, x, y, w, h
            line = next(lines, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for t in batch.column(0) for row in parse(_lines(t.as_py() or "")))
        while found := list(islice(rows, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["name", "x", "y", "w", "h"])

    return files.select(F.col(text).alias("t")).mapInArrow(run, "name string, x double, y double, w double, h double")


def archive_entries(archives: DataFrame, depth: int = 2) -> DataFrame:
    """(archive, entry, content) of zip files (path, content), of zips within them too; broken archives have none."""

    def walk(data: bytes, prefix: str, left: int) -> Iterator[tuple[str, bytes]]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in sorted(z.infolist(), key=lambda i: i.filename):
                    if info.is_dir():
                        continue
                    if info.filename.lower().endswith(".zip") and left > 1:
                        yield from walk(z.read(info), f"{prefix}{info.filename}!/", left - 1)
                    else:
                        yield prefix + info.filename, z.read(info)
        except zipfile.BadZipFile:
            return

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                archive = path.as_py()
                for entry, content in walk(data.as_py() or b"", "", depth):
                    yield archive, entry, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _batches(rows(batches), ["archive", "entry", "content"]):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    out = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("content", pa.binary())])
    return archives.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, "archive string, entry string, content binary")


#: Files of an export that list its class names, the first of these that is there, and those that are no labels.
NAME_FILES = ("obj.names", "classes.txt", "names.txt")
NOT_LABELS = ("train.txt", "valid.txt", "test.txt", "classes.txt", "names.txt")


def export_labels(entries: DataFrame) -> DataFrame:
    """(archive, stem, text) of the label files of archive_entries."""
    name = file_name(F.col("entry"))
    return entries.filter((ending(F.col("entry")) == "txt") & ~name.isin(*NOT_LABELS)).select("archive", stem(F.col("entry")).alias("stem"), F.decode("content", "utf-8").alias("text"))


def export_names(entries: DataFrame) -> DataFrame:
    """(archive, class_id, class_name) of the names file that comes first in NAME_FILES."""
    rank = F.array_position(F.array(*[F.lit(n) for n in NAME_FILES]), file_name(F.col("entry")))
    lists = entries.withColumn("_r", rank).filter("_r > 0").groupBy("archive").agg(F.min_by("content", "_r").alias("content"))
    lines = F.filter(F.split(F.decode("content", "utf-8"), r"\r?\n"), lambda x: F.trim(x) != "")
    return lists.select("archive", F.posexplode(lines).alias("class_id", "class_name")).withColumn("class_name", F.trim("class_name"))


def archive_pairs(entries: DataFrame) -> DataFrame:
    """(archive, image, label): each image entry and the entry of its stem in the sibling labels folder, if there is one."""
    images = entries.filter(ending(F.col("entry")).isin(*IMAGE_ENDINGS)).select("archive", F.col("entry").alias("image"))
    wanted = F.regexp_replace(F.regexp_replace("image", r"(^|/)images/([^/]*)$", "$1labels/$2"), r"\.[^.]*$", ".txt")
    labels = entries.filter(ending(F.col("entry")) == "txt").select("archive", F.col("entry").alias("label"))
    return images.withColumn("_l", wanted).join(labels.withColumn("_l", F.col("label")), ["archive", "_l"], "left").drop("_l")


def frames_of_folder(images: DataFrame, decodable: str = "ok") -> DataFrame:
    """Images of a folder as frames, numbered by path from 1; one that can't be read is left out but its number is used up."""
    return numbered_rows(images, "path").withColumnRenamed("n", "frame_id").filter(F.col(decodable))


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """A folder that images are put into, as a stream of frames (path, ts, content) in order of arrival; a camera or video is cut into such a folder by its reader."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return rows.filter(ending(F.col("path")).isin(*IMAGE_ENDINGS)).select("path", F.col("modificationTime").alias("ts"), "content")
