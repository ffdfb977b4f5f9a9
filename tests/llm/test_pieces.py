"""Merge vocabularies against the sentencepiece library, text by text and through Spark."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from encore.llm import pieces

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces._pieces(open(MODEL, "rb").read())


def ids_of(own, text: str) -> list[int]:
    chunks = own.chunks(text.encode())
    own.fill(set(chunks))
    return np.frombuffer(b"".join(map(own.lookup.__getitem__, chunks)), "<u4").tolist()


ODD = ["", " ", "  ", "\n", " \n a", "▁", "▁▁a ▁", "<s>", "</s> x", "<0x41>", "a\x00b", "é é", "日本語テキスト", "😀👩‍👩‍👧", "​", "0123 456", "x" * 3000, "ab" * 70, "the\nThe", "don't", " " * 50 + "x", "\t\t", "﻿BOM", "ﬁ", "ÀÉ"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, text):
    assert ids_of(own, text) == LIBRARY.encode(text)
    assert own.decode(np.array(LIBRARY.encode(text), int)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" ▁aehinorst\n.'0"))), max_size=80))
def test_any_text(text):
    own = pieces._pieces(open(MODEL, "rb").read())
    assert ids_of(own, text) == LIBRARY.encode(text)
    assert not own.wrong


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(3, 258)), max_size=20))
def test_any_ids_decode_as_the_library_does(ids):
    own = pieces._pieces(open(MODEL, "rb").read())
    assert own.decode(np.array(ids, int)) == LIBRARY.decode(ids)


def test_side_by_side_and_by_heap_alike(own):
    rng = random.Random(1)
    words = ["▁" + "".join(rng.choice("aeinrstlhdou") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    alone = [b"".join([np.array([own.id[s] for s in own.merge(w)], "<u4").tobytes()]) for w in words]
    assert own.encode_short(words) == alone


def test_lookup_forgets_and_stays_right(own, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 20)
    rng = random.Random(2)
    for _ in range(60):
        text = " ".join(rng.choice(["the", f"w{rng.randrange(500)}"]) for _ in range(15))
        assert ids_of(own, text) == LIBRARY.encode(text)
        assert len(own.lookup) <= 40


def test_through_spark(spark):
    texts = [*ODD, None, "same text here", "same text here", "long words " * 30_000]
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, ids string, agrees int")
    rows = {r["doc_id"]: r for r in pieces.round_trip(df, MODEL).collect()}
    split = {r["doc_id"]: r for r in pieces.decode_pieces(pieces.encode_pieces(df, MODEL), MODEL, "pieces.ids").collect()}
    for k, t in enumerate(texts):
        due = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(rows[k]["pieces"]["ids"], "<u4").tolist() == due
        assert rows[k]["pieces"]["text"] == LIBRARY.decode(due) == split[k]["decoded"]["text"]
        assert rows[k]["pieces"]["agrees"] and split[k]["pieces"]["agrees"] and split[k]["decoded"]["agrees"]
        assert (rows[k]["ids"], rows[k]["agrees"]) == ("x", 7)


def test_empty_table_and_taken_name(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.round_trip(df, MODEL).count() == 0
    for f in (pieces.round_trip, pieces.encode_pieces):
        with pytest.raises(ValueError):
            f(df, MODEL, out="text")


def test_other_models_are_refused():
    with pytest.raises((ValueError, RuntimeError)):
        pieces.Pieces(b"")
