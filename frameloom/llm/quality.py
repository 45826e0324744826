"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled text, one good, one bad. A text is cut into blocks of BLOCK bytes over its whole
length, and each block is compressed with either; the difference of the two sums over the text's own size tells which it
resembles, whatever its length. A logistic curve over it and the compressed share of the text, fitted on labelled texts that
were held back from the dictionaries, turns it into a score between 0 and 1.

The model is fitted on the driver from a bounded sample of labelled rows: at most SAMPLE_ROWS of them, those of the lowest hash of
their id, one row of an id, whole texts. The corpus itself is scored whole, in one pass without a shuffle.

Defined results: null and empty texts have a score too (the curve at 0); a null label or id is no label; of rows that repeat a
sampled id the smallest text is learned from, and all of them are scored one by one; with under six labelled texts of either class
every score is the share of label 1 (0.5 if there are none); an empty table gives an empty result; other columns are not looked
at, and keep_good passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder

#: The bound on labelled rows that are learned from.
SAMPLE_ROWS = 5000
DICT_BYTES = 64 << 10
BLOCK = 8 << 10
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Curve:
    """score = 1 / (1 + exp(-(a * difference + b * ratio + c)))."""

    a: float
    b: float
    c: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array([self.a, self.b]) + self.c, -40, 40)))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: Curve


class Measure:
    """Of a text: (size with the bad dictionary - size with the good one) / own size, and size with the good one / own size.

    The second tells a text that hardly resembles either but repeats itself. A few bytes are added below the line, lest
    a byte's difference decide on a text of two words.
    """

    def __init__(self, model: Model):
        self.good, self.bad = (self._compressor(d) for d in (model.good, model.bad))

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

    def __call__(self, texts: Iterable) -> np.ndarray:
        """For buffers of texts; None stands for the empty one."""
        out = []
        for t in texts:
            n, good, bad = len(t) if t is not None else 0, 0, 0
            for at in range(0, n, BLOCK):
                part = t[at : at + BLOCK] if n > BLOCK else t
                good, bad = good + len(self.good.compress(part)), bad + len(self.bad.compress(part))
            out.append(((bad - good) / (n + 100), good / (n + 20)))
        return np.array(out).reshape(-1, 2)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    parts = [t[a : a + 2000] for t in texts for a in range(0, len(t), 2000)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(parts)


def fit_curve(x: np.ndarray, y: np.ndarray) -> Curve:
    """Logistic regression by Newton's steps, with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(3), np.diag([0.3, 0.3, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    a, b = w[:2] / scale
    return Curve(float(a), float(b), float(w[2] - (w[:2] * mean / scale).sum()))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Of rows (text, label), two in three may go to the dictionaries and every third goes to the curve."""
    texts = [((t or "").encode(), int(y)) for t, y in rows]
    good, bad = ([t for t, y in texts if y == label and t] for label in (1, 0))
    if len(good) < 6 or len(bad) < 6:
        share = min(max(sum(y for _, y in texts) / len(texts), 1e-6), 1 - 1e-6) if texts else 0.5
        return Model(b"", b"", Curve(0.0, 0.0, float(np.log(share / (1 - share)))))
    train = lambda x: _dictionary([t for i, t in enumerate(x) if i % 3])
    model = Model(train(good), train(bad), Curve(0.0, 0.0, 0.0))
    x = Measure(model)(good[::3] + bad[::3])
    return Model(model.good, model.bad, fit_curve(x, np.repeat([1.0, 0.0], [len(good[::3]), len(bad[::3])])))


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """The bounded sample of labelled training rows. Its ids are chosen from the labels alone; they are few, so the texts are found without a shuffle of all."""
    own = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label"))
    own = own.filter("__id is not null and __label in (0, 1)").filter(doc_remainder(F.col("__id"), 5) != 0)
    own = own.groupBy("__id").agg(F.min("__label").cast("int").alias("__label"))
    ids = [tuple(r) for r in own.orderBy(F.xxhash64("__id"), "__id").limit(rows).collect()]
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame(ids, "__id long, __label int")
    found = docs.join(F.broadcast(few), docs["doc_id"] == few["__id"]).select("__id", F.coalesce(docs["text"], F.lit("")).alias("__text"), "__label")
    seen = {i: (t, y) for i, y, t in found.groupBy("__id", "__label").agg(F.min("__text")).collect()}
    return [seen[i] for i, _ in ids if i in seen]


def _scores(model: Model, batch: pa.RecordBatch, at: int, measure: Measure) -> np.ndarray:
    return model.curve(measure(t.as_buffer() for t in batch.column(at)))


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch, 1, measure))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (doc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, all columns as they are."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(model)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch, at, measure) >= threshold))

    return docs.mapInArrow(run, schema)
