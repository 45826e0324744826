"""Encoding and decoding with a public vocabulary of merge-type pieces, by backtracking.

The vocabulary's rule: of all adjacent symbols whose concatenation is a piece, the pair whose piece scores best is merged, the
leftmost of equals, until none is left. A sequence of pieces is the result of that on its text exactly if every two adjacent ones
are the result on theirs: up to the first merge across a border, both sides have merged as they would alone. So no text is merged as a
whole. Candidates at a place are the pieces that an Aho-Corasick automaton found there, the longest first; one is taken if it is
compatible with the piece before it, which re-merging the two tells (remembered by pair). Where no candidate is left, the place can
be no border, for the encoding of what stands before it is unique: its bit is cleared, and the piece before it is given up.

A text is cut first where no piece of the vocabulary reaches across: before a white-space mark after another character, around ASCII
characters that no piece holds, and between letters or digits and other characters. Each cut is taken only if the vocabulary bears it out.
Words met lately are remembered (at most twice MEMO_WORDS: a full memory becomes the old one, whose words return to the new one when they
are met again). A word may be a whole document.
Spark deals the documents and nothing is shuffled; a task reads the vocabulary from the given path.

Defined results: a null text is encoded as the empty one, which has the begin and the end id only; control pieces spelled out in a
text are ordinary characters; characters without a piece become their UTF-8 bytes' pieces; repeated rows give repeated results; an
empty table an empty result; other columns are not looked at.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .bpe import _slices

#: Words of a worker's memory; longer ones than MEMO_CHARS are never kept. Pairs of pieces kept.
MEMO_WORDS, MEMO_CHARS, MEMO_PAIRS = 200_000, 40, 600_000
#: The mark that stands for a space, and the kinds of a piece in the vocabulary file; fixed values of the format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

codecs.register_error("bytewise", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


class PieceBpe:
    """Encoder for vocabulary files of merge type with identity normalisation; see the module's text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.piece: list[str] = []
        self.kind: list[int] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for _, body in (x for x in model if x[0] == 1):
            got = dict(_fields(body))
            name, kind, at = got[1].decode(), got.get(3, NORMAL), len(self.piece)
            self.piece.append(name)
            self.kind.append(kind)
            if kind == NORMAL:
                self.id[name], self.score[name] = at, struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            elif kind == BYTE:
                self.byte[int(name[1:-1], 16)] = at
        trainer, normal = (dict(_fields(next((v for k, v in model if k == n), b""))) for n in (2, 3))
        self.unknown, self.begin, self.end = trainer.get(40, 0), trainer.get(41, 1), trainer.get(42, 2)
        self.dummy = bool(normal.get(3, 1))
        if trainer.get(3, 1) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or {USER, UNUSED} & {*self.kind}:
            raise ValueError(f"{path}: not a vocabulary of merge type with identity normalisation")
        self.found = ahocorasick.Automaton()
        #: Where a path of the automaton ends: its longest prefix that is a candidate. And of a candidate, the next shorter one.
        self.ends: dict[str, str] = {}
        self.shorter: dict[str, str] = {}
        self.most = max(map(len, self.id))
        for name in sorted(self.id, key=len):
            self.found.add_word(name, name)
            for i in range(1, len(name) + 1):
                path = name[:i]
                if i == 1 or path in self.id:
                    self.ends[path] = path
                    if i > 1:
                        self.shorter[path] = self.ends[path[:-1]]
                else:
                    self.ends[path] = self.ends[path[:-1]]
        self.found.make_automaton()
        self._cut_rules()
        self.raw = [self._meaning(i) for i in range(len(self.piece))]
        self.packed = [struct.pack("<I", i) for i in range(len(self.piece))]
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0

    def _cut_rules(self) -> None:
        """Patterns of words: coarse ones, and fine ones for texts without a character that some piece joins to another kind."""
        letters = set().union(*self.id)
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in letters)
        across = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        inner = f"[^{alone}]" if across else f"[^{alone}{MARK}]"
        self.coarse = re.compile(f"[{alone}]|{MARK}*{inner}+|{MARK}+", re.S)
        self.fine = re.compile(rf"{MARK}*[^\W_]+|{MARK}*(?:[^\w{alone}{MARK}]|_)+|[{alone}]|{MARK}+", re.S)
        plain = lambda c: c.isalnum()  # noqa: E731  as \\w has it
        odd = {a if plain(a) else b for p in self.id for a, b in zip(p, p[1:], strict=False) if plain(a) != plain(b) and a != MARK}
        self.odd = re.compile("" if across else f"[{re.escape(''.join(sorted(odd)))}]" if odd else r"(?!)")

    def merged(self, text: str) -> list[str]:
        """The vocabulary's rule on a short text, step by step."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two pieces side by side stay as they are, told by merging both again; left may be empty."""
        get, none = self.score.get, -float("inf")
        parts, border = [*left, *right], len(left)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            if i + 1 == border:
                return False
            border -= i + 1 < border
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return len(parts) == 1 + (left != "")

    def pieces(self, word: str) -> list[str]:
        """The pieces of a word in order; a character without a piece stands for itself."""
        n, most, path, ends, pairs, shorter = len(word), self.most, self.found.longest_prefix, self.ends, self.pairs, self.shorter
        border = bytearray(b"\1") * (n + 1)
        out: list[str] = []
        pos, before, row = 0, "", pairs[""]
        piece: str | None = ends.get(word[: path(word[:most])], word[0])
        while True:
            while piece is not None:
                if border[pos + len(piece)]:
                    fits = row.get(piece)
                    if fits is None:
                        fits = self.compatible(before, piece)
                        if self.n_pairs < MEMO_PAIRS:
                            row[piece] = fits
                            self.n_pairs += 1
                    if fits:
                        break
                piece = shorter.get(piece)
            if piece is None:
                border[pos] = 0
                last = out.pop()
                pos -= len(last)
                before = out[-1] if out else ""
                piece = shorter.get(last)
            else:
                out.append(piece)
                pos += len(piece)
                if pos == n:
                    return out
                before, ahead = piece, word[pos : pos + most]
                piece = ends.get(ahead[: path(ahead)], ahead[0])  # the longest candidate: what the automaton's longest path ends in
            row = pairs[before]

    def word_ids(self, word: str) -> list[int]:
        ids: list[int] = []
        for p in self.pieces(word):
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]
        return ids

    def split(self, text: str) -> list[str]:
        """The text's words, the spaces as marks and one before the first."""
        if not text:
            return []
        marked = (MARK if self.dummy else "") + text.replace(" ", MARK)
        return (self.coarse if self.odd.search(marked) else self.fine).findall(marked)

    def _meaning(self, i: int) -> bytes:
        """Bytes that an id stands for, marks as spaces."""
        if self.kind[i] == BYTE:
            return bytes([int(self.piece[i][1:-1], 16)])
        if self.kind[i] == UNKNOWN:
            return b" \xe2\x81\x87 "
        return b"" if self.kind[i] == CONTROL else self.piece[i].replace(MARK, " ").encode()

    def encode(self, text: str) -> list[int]:
        return [self.begin, *(i for w in self.split(text) for i in self.word_ids(w)), self.end]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: each byte that is no UTF-8 becomes a replacement character, the space before the first word goes."""
        return self._text(b"".join([self.raw[i] for i in ids])).decode()

    def _text(self, raw: bytes) -> bytes:
        raw = raw[1:] if self.dummy and raw.startswith(b" ") else raw
        return raw.decode("utf-8", "bytewise").encode()

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        memo, packed, meaning = self.memo, self.packed, self.raw
        coded, raw = [packed[self.begin]], []
        for word in self.split(text):
            got = memo.get(word)
            if got is None:
                got = self.old.get(word)
                if got is None:
                    ids = self.word_ids(word)
                    got = b"".join([packed[i] for i in ids]), b"".join([meaning[i] for i in ids])
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        self.old, self.memo = memo, {}
                        memo = self.memo
                    memo[word] = got
            coded.append(got[0])
            raw.append(got[1])
        coded.append(packed[self.end])
        joined = b"".join(coded)
        return len(joined) // 4, hashlib.sha256(joined).hexdigest(), hashlib.sha256(self._text(b"".join(raw))).hexdigest()


@lru_cache(maxsize=2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if with_ids. path: the vocabulary file, there on every worker."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = path or default_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for ids, texts in _slices(batch):
                n, a, b = (list(x) for x in zip(*map(coder.digest, texts), strict=True))
                columns = [ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if with_ids:
                    columns.append(pa.array([coder.encode(t) for t in texts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids"][: len(columns)])

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
