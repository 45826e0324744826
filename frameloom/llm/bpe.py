"""BPE encoding and decoding with a public vocabulary, merges found by segment tree.

A word's symbols stand in a row; leaf i of a segment tree holds (rank, i) of the pair that starts at i. The root is then the
leftmost pair of lowest rank. A merge changes three leaves, each renewed up to the root in logarithmic steps, and the word is
done when the root holds no pair. Short words of a batch are merged together, a tree per row of a matrix; a long one
(an unbroken run of letters may be a whole document) has a tree of its own, so that n symbols cost n log n.

Spark deals the documents; a task reads the vocabulary from the given path, keeps the words it has met (at most MEMO_WORDS)
and passes over its batches once. Nothing is shuffled.

Defined results: a null text is encoded as the empty one, with 0 tokens; special tokens spelled out in a text become their
ids, as the vocabulary file's own settings say; repeated rows give repeated results; an empty table an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words kept per worker, the first it meets, among which the frequent ones are; longer ones are never kept.
MEMO_WORDS, MEMO_CHARS = 40_000, 40
#: Words of up to so many symbols are merged as rows of one matrix.
ROW_SYMBOLS = 64
NONE = np.int64(1) << 60

#: White space as the vocabulary's pattern language defines it (Unicode White_Space); a fixed value.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where Latin-1 prints it, else the next from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class WordBpe:
    """Encoder for vocabulary files with word ends, lower case and byte letters; see the module's text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, self.end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or ""
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token = [""] * self.size
        for t, i in vocab.items():
            self.token[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.token[i] = t
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.end] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {vocab[a] * self.size + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        known = sorted(self.rank)
        self.pair_keys, self.pair_rank = np.array(known, np.int64), np.array([self.rank[k] for k in known], np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        #: The same on ASCII text, which is most of it.
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.id_text = [str(i) for i in range(self.size)]
        self.memo: dict[str, tuple[int, str, str]] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge; a symbol of -1 pairs with nothing."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], NONE)

    def merge_rows(self, sym: np.ndarray) -> np.ndarray:
        """Merge all rows of a matrix of symbols (-1 after the end, at least one such column); gone symbols become -1."""
        n, width = sym.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        sym = np.hstack([sym, np.full((n, leaves + 1 - width), -1, np.int64)])
        nxt = np.tile(np.arange(1, leaves + 2, dtype=np.int64), (n, 1)).clip(max=leaves)
        prv = np.tile(np.arange(-1, leaves, dtype=np.int64), (n, 1))
        tree = np.full((n, 2 * leaves), NONE, np.int64)
        ranks = self._ranks(sym[:, :-1], sym[:, 1:])
        tree[:, leaves:] = np.where(ranks < NONE, ranks * leaves + np.arange(leaves), NONE)
        at = leaves
        while at > 1:
            tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
            at //= 2

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray | np.int64) -> None:
            i = i + leaves
            tree[rows, i] = value
            for _ in range(leaves.bit_length() - 1):
                i = i >> 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            i, new = root % leaves, self.into[root // leaves]
            j = nxt[rows, i]
            k = nxt[rows, j]
            sym[rows, i], sym[rows, j] = new, -1
            nxt[rows, i], prv[rows, k] = k, i
            put(rows, j, NONE)
            r = self._ranks(new, sym[rows, k])
            put(rows, i, np.where(r < NONE, r * leaves + i, NONE))
            h = prv[rows, i]
            left = h >= 0
            r = self._ranks(sym[rows[left], h[left]], new[left])
            put(rows[left], h[left], np.where(r < NONE, r * leaves + h[left], NONE))
            rows = rows[tree[rows, 1] < NONE]
        return sym

    def merge_long(self, sym: list[int]) -> list[int]:
        """The same for one word of any length, with lists."""
        n, size, rank_of, into = len(sym), self.size, self.rank, self.into
        leaves = 1 << max(1, (n - 1).bit_length())
        none = float("inf")
        tree: list[float] = [none] * (2 * leaves)
        for i in range(n - 1):
            if (r := rank_of.get(sym[i] * size + sym[i + 1])) is not None:
                tree[leaves + i] = r * leaves + i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: float) -> None:
            i += leaves
            tree[i] = value
            while i > 1:
                i >>= 1
                now = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == now:
                    return
                tree[i] = now

        nxt, prv = [*range(1, n + 1)], [*range(-1, n - 1)]
        while tree[1] < none:
            rank, i = divmod(int(tree[1]), leaves)
            j = nxt[i]
            k = nxt[j]
            sym[i], sym[j], nxt[i] = int(into[rank]), -1, k
            put(j, none)
            if k < n:
                prv[k] = i
                r = rank_of.get(sym[i] * size + sym[k])
            else:
                r = None
            put(i, none if r is None else r * leaves + i)
            if (h := prv[i]) >= 0:
                r = rank_of.get(sym[h] * size + sym[i])
                put(h, none if r is None else r * leaves + h)
        return [x for x in sym if x >= 0]

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words."""
        words = list(words)
        if not words:
            return {}
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        data, stop = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(size)
        ids = self.inner[data]
        ids[stop - 1] = self.last[data[stop - 1]]
        out = {words[r]: self.merge_long(ids[stop[r] - size[r] : stop[r]].tolist()) for r in np.flatnonzero(size > ROW_SYMBOLS)}
        width = 4
        while width // 2 < ROW_SYMBOLS:
            group = np.flatnonzero((size <= width) & (size > (width // 2 if width > 4 else 0)))
            for at in range(0, len(group), 8192):
                rows = group[at : at + 8192]
                i = np.arange(width + 1)
                sym = np.where(i < size[rows, None], ids[np.minimum((stop - size)[rows, None] + i, len(ids) - 1)], -1)
                sym = self.merge_rows(sym)
                flat, ends = sym[sym >= 0].tolist(), np.cumsum((sym >= 0).sum(1)).tolist()
                for r, x, y in zip(rows.tolist(), [0, *ends], ends, strict=False):
                    out[words[r]] = flat[x:y]
            width *= 2
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand for themselves."""
        out: list[str] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                if part.isascii():
                    out += self.ascii_words.findall(part.lower())
                else:  # a capital sigma has one lower case here, final or not
                    out += self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def _learn(self, words: Iterable[str]) -> dict[str, tuple[int, str, str]]:
        text, token = self.id_text, self.token
        return {w: (len(ids), " ".join([text[i] for i in ids]), " ".join([token[i] for i in ids])) for w, ids in self.encode_words(words).items()}

    def encode_batch(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """For each text its words as (number of ids, ids as text, tokens as text)."""
        if not self.memo:
            self.memo = {t: (1, str(i), t) for t, i in self.special.items()}
        parts = [self.pieces(t) for t in texts]
        met = set().union(*parts) if parts else set()
        new = self._learn(met - self.memo.keys())
        known = self.memo | new
        if (room := MEMO_WORDS - len(self.memo)) > 0:
            self.memo |= dict(islice(((w, x) for w, x in new.items() if len(w) <= MEMO_CHARS), room))
        for words in parts:
            yield [known[w] for w in words]

    def encode(self, text: str) -> list[int]:
        words = next(iter(self.encode_batch([text])))
        return [int(i) for _, ids, _ in words for i in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, word ends shown: the vocabulary file names no decoder."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[pa.Array, list[str]]]:
    """Runs of rows of about `most` bytes of text, a longer text alone."""
    ids, column = batch.column(0), batch.column(1).fill_null("")
    sizes = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, side="right")))
        yield ids.slice(a, b - a), column.slice(a, b - a).to_pylist()
        a = b


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if with_ids. path: the vocabulary file, there on every worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for ids, texts in _slices(batch):
                n, a, b, full = [], [], [], []
                for words in bpe.encode_batch(texts):
                    n.append(sum([w[0] for w in words]))
                    joined = " ".join([w[1] for w in words])
                    a.append(hashlib.sha256(joined.encode()).hexdigest())
                    b.append(hashlib.sha256(" ".join([w[2] for w in words]).encode()).hexdigest())
                    if with_ids:
                        full.append(np.array(joined.split(), np.int32))
                columns = [ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(full, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
