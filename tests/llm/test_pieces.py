"""SentencePiece: ids and texts of the library, spans and normalisation against it."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quarterdeck.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _texts(seed, count=400):
    rnd = random.Random(seed)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "é", "ﬁ", "①", "ｱﾞ", "中文", "🙂", "　", "▁", "½", "​", "­", "x̧", "№", "word ", "﻿"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(count)]


def test_ids_texts_and_spans(rows):
    docs = [*enumerate(_texts(1)), (1000, None), (1000, ""), (None, " x"), (1001, "very long " * 40_000)]
    frame = rows("doc_id long, text string, ids string, starts string", [(*d, "x", None) for d in docs])
    found = pieces.encode(frame.repartition(3), PATH, at_once=1 << 12)
    found = found.withColumn("decoded", pieces.decode(PATH, found["ids"])).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [(i, [*library.encode(t or ""), 2]) for i, t in docs]
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=str) == sorted(want, key=str)
    assert all(r.decoded == library.decode(list(r.ids)) for r in found)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append((t or "").encode())
    for r in found:
        text = next(t for t in texts[r.doc_id] if len(t) == r.ends[-1])
        # spans follow each other and cover the text
        assert (r.starts[-1], r.ends[-1]) == (len(text), len(text))
        assert all(a <= b for a, b in zip(r.starts, r.ends, strict=True)) and r.starts[0] == 0
        assert all(b == a for a, b in zip(r.starts[1:-1], r.ends[:-2], strict=True))
    assert pieces.encode(rows("doc_id long, text string", []), PATH).collect() == []


def test_spans_are_the_surfaces_of_the_library():
    own, library = pieces.Model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in _texts(2):
        proto = library.encode(text, return_type="proto")
        raw = text.encode()
        starts, ends = own.spans(text, [p.id for p in proto.pieces])
        for start, end, p in zip(starts, ends, proto.pieces, strict=True):
            if own.sizes[p.id] > 1 or not p.piece.startswith("<0x"):  # the library puts a character's bytes on its last one
                assert raw[start:end].decode() == p.surface


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_character_maps_of_the_library(rule, tmp_path):
    for flags in ({}, {"add_dummy_prefix": True}, {"remove_extra_whitespaces": True}, {"escape_whitespaces": True},
                  {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
        own = pieces.Model.__new__(pieces.Model)
        own.read_normaliser(dict(pieces._fields(library.serialized_model_proto())).get(pieces.NORMALISER, b""))
        for text in _texts(3, 300):
            normal, place = own.normalise(text.encode())
            assert normal.decode() == library.normalize(text), (rule, flags, text)
            assert len(place) == len(normal) + 1 and (np.diff(place) >= 0).all() and place[-1] <= len(text.encode())
