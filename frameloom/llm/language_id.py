"""Language identification by a linear-chain conditional random field over words.

Each word has features: the word itself (a lexicon entry), its first and last bytes (affixes) and its byte n-grams, all hashed
into one table of weights per language. Learned transitions tie neighbouring words, so that forward-backward labels every
word of a text, of mixed languages too; a document's language is the one with the largest share of its words.

Documents are in one language each, so moves between languages are learned from spliced texts: runs of words of the sampled texts, of other languages in
turn, in random order and length, a fixed share of the sample.

The field is fitted on the driver from a bounded sample of whole texts: PER_LANGUAGE documents of each language, those of the lowest
hash of their id, and SAMPLE_ROWS in all (beyond that languages share evenly, one row each of up to SAMPLE_ROWS languages). The
corpus is then labelled whole, in one pass without a shuffle.
Forward-backward runs over all chunks of a batch's texts at a time: the chunks' transfer matrices first, then the texts'
chunk ends, then the words within; long texts cost no more per word than short ones.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text where nothing could be
learned; words without a letter carry no evidence; rows that repeat an id are labelled one by one; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_remainder

FOLD, FOLDS = 1, 3
#: The bound on labelled rows that are learned from: so many of a language, and in all.
PER_LANGUAGE, SAMPLE_ROWS = 150, 30_000
TABLE_BITS = 16
EPOCHS, RATE, RIDGE = 25, 0.15, 1e-4
#: Fitting ends early where an epoch improves the mean log posterior of the words' languages by less.
LEAST_GAIN = 5e-4
#: Spliced texts: their words, as a share of the sample's, the runs of a text, and the words of a run.
SPLICED, RUNS, RUN_WORDS = 0.25, 6, (5, 30)
CHUNK = 64
BATCH_CHARS = 1 << 20
UND = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    """Table places of packed byte strings."""
    x = (x ^ np.uint64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1)) * _MIX
    x ^= x >> np.uint64(29)
    return ((x * _MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, first feature of each word) of words, all at once over their joined bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.uint64)
    stop = np.cumsum(size)
    start = stop - size
    word = np.repeat(np.arange(len(words)), size)
    rolled = np.cumsum((data + np.uint64(1)) * _powers(len(data)), dtype=np.uint64)
    whole = (rolled[stop - 1] - np.where(start > 0, rolled[start - 1], np.uint64(0))) * _powers(len(data), inverse=True)[start]
    slots, values, owner = [_slot(whole, 1)], [np.ones(len(words))], [np.arange(len(words))]
    padded = np.r_[data, np.zeros(4, np.uint64)]
    pack = lambda at, n: sum(padded[at + k] << np.uint64(8 * k) for k in range(n))
    for n in (3, 4):
        for salt, at in ((10 + n, start), (20 + n, stop - n)):
            ok = size >= n
            slots.append(_slot(pack(at[ok], n), salt))
            values.append(np.ones(ok.sum()))
            owner.append(np.flatnonzero(ok))
    place = np.arange(len(data))
    for n in (2, 3):
        at = place[place + n <= stop[word]]
        slots.append(_slot(pack(at, n), 30 + n))
        values.append(1 / np.sqrt(size[word[at]] - n + 1))
        owner.append(word[at])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order], np.concatenate(values)[order], np.searchsorted(owner[order], np.arange(len(words)))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = int(_MIX) if not inverse else pow(int(_MIX), -1, 1 << 64)
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass(frozen=True)
class Field:
    languages: tuple[str, ...]
    weights: np.ndarray  # table places x languages
    moves: np.ndarray  # language before x language, as logarithms


def forward_backward(psi: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word, and expected moves in all.

    psi: words x languages, exponentials of the words' own scores. sizes: words of each text, at least one. moves: their
    exponentials, languages x languages.
    """
    n = psi.shape[1]
    chunks = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = np.repeat(np.cumsum(sizes) - sizes, chunks) + nth * CHUNK
    length = np.minimum(CHUNK, np.repeat(sizes, chunks) - nth * CHUNK)
    steps = int(length.max())
    place = first[:, None] + np.arange(steps)
    here = (np.arange(steps) < length[:, None]).T  # step x chunk
    own = psi[np.minimum(place, len(psi) - 1)].transpose(1, 0, 2)  # step x chunk x language
    enter = nth == 0  # no move leads to a text's first word

    carry = np.broadcast_to(np.eye(n), (len(text), n, n)).copy()
    for t in range(steps):
        moved = carry @ moves
        if t == 0:
            moved[enter] = carry[enter]
        moved = moved * own[t][:, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        carry = np.where(here[t][:, None, None], moved, carry)
    at_start, at_end = np.full((len(text), n), 1.0 / n), np.ones((len(text), n))
    by_nth = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[by_nth], np.arange(int(nth.max()) + 2))
    for k in range(1, int(nth.max()) + 1):
        c = by_nth[bounds[k] : bounds[k + 1]]
        a = np.einsum("ci,cij->cj", at_start[c - 1], carry[c - 1])
        at_start[c] = a / a.sum(1, keepdims=True)
    for k in range(int(nth.max()), 0, -1):
        c = by_nth[bounds[k] : bounds[k + 1]]
        b = np.einsum("cij,cj->ci", carry[c], at_end[c])
        at_end[c - 1] = b / b.sum(1, keepdims=True)

    alpha, ahead = np.empty((steps, len(text), n)), np.empty((steps, len(text), n))
    a = at_start
    for t in range(steps):
        moved = a @ moves
        if t == 0:
            moved[enter] = a[enter]
        ahead[t] = moved
        now = moved * own[t]
        now /= now.sum(1, keepdims=True)
        a = np.where(here[t][:, None], now, a)
        alpha[t] = a
    out, expected = np.empty((len(psi), n)), np.zeros((n, n))
    b = at_end
    for t in range(steps - 1, -1, -1):
        p = alpha[t] * b
        p /= p.sum(1, keepdims=True)
        own_here = here[t]
        out[place[own_here, t]] = p[own_here]
        before = alpha[t - 1] if t else at_start
        pull = own[t] * b
        z = (ahead[t] * pull).sum(1)
        use = own_here & ~enter if t == 0 else own_here
        expected += np.einsum("ci,cj->ij", before[use] / z[use, None], pull[use]) * moves
        back = pull @ moves.T
        if t == 0:
            back[enter] = pull[enter]
        b = np.where(own_here[:, None], back / back.sum(1, keepdims=True), b)
    return out, expected


class _Words:
    """Distinct words of some texts, and each text's words as their numbers; words without a letter are number 0."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.each = [np.array([number.setdefault(w, len(number) + 1) for w in t.lower().split()], np.int64) for t in texts]
        letters = np.array([False, *(any(map(str.isalpha, w)) for w in number)])
        self.words = [b""] + [w.encode("utf-8", "surrogatepass") for w in number]
        self.each = [np.where(letters[x], x, 0) if len(x) else x for x in self.each]
        self.letters = letters


def _scores(field_weights: np.ndarray, features: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    slots, values, first = features
    out = np.stack([np.add.reduceat(field_weights[slots, k] * values, first) for k in range(field_weights.shape[1])], 1)
    out[0] = 0
    return out


def _exp(scores: np.ndarray) -> np.ndarray:
    """Word scores as factors, within 30 powers of e of the best language."""
    return np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))


def spliced(texts: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts (words, languages) put together from runs of the given ones, which are in one language each; the same for the same texts."""
    rng = np.random.default_rng(7)
    by = [[t for t in texts if t[1][0] == k] for k in range(n)]
    there, left, out = [k for k in range(n) if by[k]], SPLICED * sum(len(x) for x, _ in texts), []
    while left > 0 and len(there) > 1:
        words, languages, last = [], [], -1
        for _ in range(RUNS):
            last = int(rng.choice([k for k in there if k != last]))
            x, y = by[last][int(rng.integers(len(by[last])))]
            size = min(int(rng.integers(RUN_WORDS[0], RUN_WORDS[1] + 1)), len(x))
            at = int(rng.integers(len(x) - size + 1))
            words.append(x[at : at + size])
            languages.append(y[at : at + size])
        out.append((np.concatenate(words), np.concatenate(languages)))
        left -= len(out[-1][0])
    return out


def fit(rows: list[tuple[str, str]]) -> Field | None:
    """Rows of (text, language): maximum conditional likelihood with a ridge, by Adam over the whole sample."""
    languages = tuple(sorted({lang for _, lang in rows}))
    if not languages:
        return None
    n = len(languages)
    words = _Words([t for t, _ in rows])
    kept = [(x, languages.index(lang)) for x, (_, lang) in zip(words.each, rows, strict=True) if x.any()]
    weights, moves = np.zeros((1 << TABLE_BITS, n)), np.eye(n)
    if not kept or n == 1:
        return Field(languages, weights.astype(np.float32), moves)
    texts = [(x, np.full(len(x), y)) for x, y in kept]
    texts += spliced(texts, n)
    tokens, sizes, gold = np.concatenate([x for x, _ in texts]), np.array([len(x) for x, _ in texts]), np.concatenate([y for _, y in texts])
    slots, values, first = features = word_features(words.words)
    owner = np.repeat(np.arange(len(words.words)), np.diff(np.r_[first, len(slots)]))
    inside = np.ones(len(gold), bool)
    inside[np.cumsum(sizes) - 1] = False
    at = np.flatnonzero(inside)
    taken = np.bincount(gold[at] * n + gold[at + 1], minlength=n * n).reshape(n, n).astype(float)
    total, params, before = len(tokens), [weights, moves], -np.inf
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, EPOCHS + 1):
        post, expected = forward_backward(_exp(_scores(weights, features))[tokens], sizes, np.exp(moves))
        now = float(np.log(np.maximum(post[np.arange(total), gold], 1e-12)).mean())
        if epoch > 5 and now - before < LEAST_GAIN:
            break
        before = now
        post[np.arange(total), gold] -= 1
        by_word = np.stack([np.bincount(tokens, post[:, k], len(words.words)) for k in range(n)], 1)
        by_word[0] = 0
        grad = np.stack([np.bincount(slots, by_word[owner, k] * values, 1 << TABLE_BITS) for k in range(n)], 1) / total + RIDGE * weights
        for i, g in enumerate((grad, (expected - taken) / total + RIDGE * moves)):
            one[i] = 0.9 * one[i] + 0.1 * g
            two[i] = 0.99 * two[i] + 0.01 * g * g
            params[i] -= RATE * (one[i] / (1 - 0.9**epoch)) / (np.sqrt(two[i] / (1 - 0.99**epoch)) + 1e-8)
    return Field(languages, weights.astype(np.float32), moves)


def fit_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """The bounded training sample: ids first, from the narrow columns, then their whole texts without a shuffle of all. Of rows that repeat an id and language the smallest text counts."""
    narrow = docs.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")).filter("__id is not null and __lang is not null")
    narrow = narrow.filter(doc_remainder(F.col("__id"), FOLDS) != FOLD).withColumn("__h", F.xxhash64("__id"))
    nth = F.dense_rank().over(W.partitionBy("__lang").orderBy("__h", "__id"))
    drawn = narrow.withColumn("__n", nth).filter(F.col("__n") <= per_language).distinct().orderBy("__n", "__lang").limit(rows)
    ids = sorted({(r["__id"], r["__lang"]) for r in drawn.collect()})
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame(ids, "__id long, __lang string")
    found = docs.join(F.broadcast(few), (docs["doc_id"] == few["__id"]) & (docs["lang"] == few["__lang"])).select("__id", F.coalesce(docs["text"], F.lit("")).alias("__text"), "__lang")
    return [(t, lang) for _, lang, t in sorted(map(tuple, found.groupBy("__id", "__lang").agg(F.min("__text")).collect()))]


def label_words(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of every word of a text."""
    posts = _posteriors(field, [text])[0]
    return [(w, field.languages[int(p.argmax())], float(p.max())) for w, p in zip(text.lower().split(), posts, strict=True)]


def _posteriors(field: Field, texts: list[str]) -> list[np.ndarray]:
    words = _Words(texts)
    sizes = np.array([len(x) for x in words.each])
    if not sizes.sum():
        return [np.zeros((0, len(field.languages)))] * len(texts)
    scores = _exp(_scores(field.weights, word_features(words.words)))
    post, _ = forward_backward(scores[np.concatenate(words.each)], sizes[sizes > 0], np.exp(field.moves))
    return np.split(post, np.cumsum(sizes)[:-1])


def predict(field: Field, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and its share of the words, for texts that may be empty."""
    langs, shares = [], []
    for text, post in zip(texts, _posteriors(field, texts), strict=True):
        if not len(post) or not any(map(str.isalpha, text)):
            langs.append(UND)
            shares.append(0.0)
        else:
            share = post.mean(0)
            langs.append(field.languages[int(share.argmax())])
            shares.append(float(min(1.0, share.max())))
    return langs, shares


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= BATCH_CHARS):
                    chars += len(texts[b])
                    b += 1
                langs, shares = predict(field, texts[a:b]) if field else ([UND] * (b - a), [0.0] * (b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score"])
                a = b

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (doc_remainder(F.col("doc_id"), FOLDS) == FOLD).alias("held_out"), "lang_pred", "score")
