"""Merge-type encoding by backtracking against the sentencepiece library."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from manifoldry.llm import pieces

PATH = P.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLES = pieces.prepare(pieces.read_model(PATH))
CODER = pieces.Coder(TABLES)
ODD = ["", " ", "   ", "a  b", "▁", "▁ x", "tab\t\ty\n\n", "<s> </s> <unk> <0x41>", "\x00\x01", "日本語 \U0001f600‍\U0001f600", "é é", "﻿x�", "//==--, ,,. .", " " * 40 + "x", "x" + " " * 33, "aaaa" * 20_000, "word " * 20_000, "一" * 3000, None]
SCHEMA = "doc_id long, text string, ids string, n_tokens string, key string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "i", "n", "k") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "er", "in", " ", "  ", "▁", "a", "s", "ss", "é", "日", "\x00", "\n", "<s>", "ing", "\U0001f600", "'", ",", ".", "...", "1", "00", "мож", "//", "===="]), max_size=40).map("".join))
def test_coder_equals_the_library(text):
    assert CODER.encode(text) == LIBRARY.encode(text)
    assert CODER.decode(CODER.encode(text)) == LIBRARY.decode(LIBRARY.encode(text))


def test_cut_pieces_of_the_vocabulary():
    rng, vocabulary = random.Random(2), sorted(TABLES["order"])
    for _ in range(5000):
        text = "".join(rng.choice(vocabulary)[: rng.randrange(1, 9)] for _ in range(rng.randrange(12)))
        assert CODER.encode(text) == LIBRARY.encode(text)


def test_any_two_pieces_side_by_side():
    """The check of two pieces against merging them."""
    rng, vocabulary = random.Random(3), sorted(TABLES["halves"])
    seen = set()
    for _ in range(20_000):
        a, b = rng.choice(vocabulary), rng.choice(vocabulary)
        goes = CODER._goes(a, b)
        seen.add(goes)
        assert goes == (pieces.merge(a + b, TABLES["order"])[0] == [a, b])
    assert seen == {True, False}


def test_positions_fail_and_are_left(spark):
    """A vocabulary whose longest matches lead into dead ends."""
    order = {"bc": 0, "ab": 1, "abcd": 2, "dea": 3, "cd": 4, "de": 5, "bcde": 6}
    tables = pieces.prepare({"pieces": [(c, -10.0 - i, i) for i, c in enumerate("abcde")] + [(t, -float(r), 10 + r) for t, r in order.items()], "bytes": list(range(100, 356)), "prefix": False})
    coder, rng = pieces.Coder(tables), random.Random(4)
    assert "abcd" not in tables["halves"]  # bc merges first, and a and d stay alone
    for _ in range(3000):
        text = "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12)))
        assert coder.split(text) == pieces.merge(text, tables["order"])[0]


def test_caches_that_are_full(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    coder = pieces.Coder(TABLES)
    for text in ["one two three four", "five six, seven one two", "one two three unfathomable"] * 3:
        ids = LIBRARY.encode(text)
        assert coder.digests(text)[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_digests_and_round_trip(spark):
    texts = [*ODD, *ODD]
    got = {r.doc_id: r for r in pieces.encode_digests(frame(spark, texts), PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    coded = pieces.encode(frame(spark, ODD), PATH)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: LIBRARY.encode(t or "") for i, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in pieces.decode(coded, PATH).collect()} == {i: LIBRARY.decode(LIBRARY.encode(t or "")) for i, t in enumerate(ODD)}


def test_empty_and_null(spark):
    assert pieces.encode_digests(frame(spark, []), PATH).count() == 0
    none = spark.createDataFrame([(None, None), (None, "x"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in pieces.encode_digests(none, PATH).collect()) == [(None, 0), (None, 1), (None, 1)]


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "m"))
