"""Encoding and decoding with the piece model against the sentencepiece library."""

import random
from array import array

import pytest
from sentencepiece import SentencePieceProcessor

from lakewright.llm.pieces import Units, encode_documents, units
from lakewright.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
BITS = ["a", "b", "th", "the", "ing", "  ", " ", "   ", "\n", "\t", "\r\n", "é", "中", "文字", "한국", "🙂", "▁", "▁▁", "<s>", "</s>",
        "<unk>", "<0x0A>", "1", "22", "aaaa", "zz", "\x00", "\x01", "Ω", "///", "====", "ﬁ", "Ａ", "́", "﻿", "　"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def ids_of(known, text):
    return array("I", known.encode(text)).tolist()


def test_encodes_and_decodes_as_the_library_does(library):
    known, rng = units(PATH), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(16)))
        ids = ids_of(known, text)
        assert ids == library.encode(text), text
        assert known.pieces.decode(ids).decode() == library.decode(ids)


def test_random_letters_need_the_way_back(library):
    known, rng = units(PATH), random.Random(6)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "aeinrst", "ab", "=-_/"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        assert ids_of(known, text) == library.encode(text)


def test_decodes_any_ids(library):
    known, rng = units(PATH), random.Random(7)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 29871, 259, 1, 2, 0]) for _ in range(rng.randrange(8))]
        assert known.pieces.decode(ids).decode() == library.decode(ids), ids
    with pytest.raises(ValueError):
        known.pieces.decode([32000])


def test_pieces_are_checked_by_merging_again():
    pieces = units(PATH).pieces
    the, at, whole = pieces.ids["th"], pieces.ids["e"], pieces.ids["the"]
    assert not pieces.compatible(the, at)
    assert pieces.stands(whole) and pieces.next_shorter(whole) == the


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr("lakewright.llm.pieces.CACHE_UNITS", 3)
    monkeypatch.setattr("lakewright.llm.pieces.CACHE_PAIRS", 3)
    known = Units(units(PATH).pieces)
    for text in ["one two three four five", "six, seven\neight", "one two"]:
        assert ids_of(known, text) == library.encode(text)


def test_a_model_without_word_starts_takes_whole_texts(library, monkeypatch):
    known = Units(units(PATH).pieces)
    monkeypatch.setattr(known.pieces, "by_unit", False)
    for text in ["one  two", " three", "x"]:
        assert ids_of(known, text) == library.encode(text)


def test_documents(spark, frame, library):
    texts = [None, "", " ", "one two", "one two", "long " * 60000, "x" * 50000, "a\nb", "é🙂"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "one two")]
    docs = frame(rows, "doc_id bigint, text string, ids string, decoded int")
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in encode_documents(docs, PATH).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc_id, array("I", ids).tobytes(), library.decode(ids)))
    assert got == sorted(want, key=repr)
    assert encode_documents(docs.limit(0), PATH).count() == 0
    plain = encode_documents(docs.where("doc_id = 7"), PATH, marks=False).first()
    assert array("I", bytes(plain.ids)).tolist() == library.encode("a\nb")
