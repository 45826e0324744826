"""Encoding with pieces: against the library that the vocabulary file is for, on whole texts, made texts and awkward rows."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import pieces
from frameloom.llm.queries import QUERIES
from tests.conftest import SF

ODD = ["a", "e", " ", "  ", "\n", "\t", "the", "ing", "▁", "é", "日", "\U0001f600", "\x00", "==", "-", "//", "<s>", "</s>", "<unk>", "<0x0A>", "\xa0", "́", "\r", "1", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_whole_documents(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op11_piece_roundtrip"](spark, SF).collect()
    assert len(found) == len(docs)
    assert all(tuple(r)[1:] == expected(library, docs[r["doc_id"]]) for r in found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=25).map("".join))
def test_odd_texts(library, text):
    coder = pieces.load(pieces.default_path())
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids)


def test_texts_of_pieces(library):
    coder, rng = pieces.load(pieces.default_path()), random.Random(3)
    known = sorted(coder.id)
    for _ in range(3000):
        text = "".join(rng.choice(known) for _ in range(rng.randint(1, 6))).replace("▁", " ")
        assert coder.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_search_equals_the_rule():
    coder, rng = pieces.load(pieces.default_path()), random.Random(4)
    for _ in range(500):
        word = "".join(rng.choice("aeinst▁r") for _ in range(rng.randint(1, 30)))
        assert coder.pieces(word) == coder.merged(word)


@pytest.mark.parametrize("text", ["a" * 50_000, "=" * 30_000, "théing" * 5_000, " " * 40_000, "aab" * 10_000])
def test_long_words(library, text):
    assert pieces.load(pieces.default_path()).encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_decoding_of_any_ids(library):
    coder, rng = pieces.load(pieces.default_path()), random.Random(5)
    for _ in range(500):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(259, 32_000) for _ in range(rng.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids)


def test_awkward_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "x"), (2, "the same", "y"), (2, "the same", "y"), (None, "no id", None), (3, "w" * 20_000 + " end", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted((tuple(r) for r in pieces.encode_documents(docs).collect()), key=str)
    assert found == sorted(((i, *expected(library, t)) for i, t, _ in rows), key=str)
    assert pieces.encode_documents(docs.limit(0)).collect() == []
    ids = pieces.encode_documents(docs, with_ids=True).filter("doc_id = 2").first()["ids"]
    assert ids == library.encode("the same", add_bos=True, add_eos=True)
