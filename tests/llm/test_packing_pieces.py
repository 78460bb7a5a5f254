"""Pieces of words that the packing encoder remembers."""

import pyarrow as pa

from quillon.llm import packing
from quillon.llm.arrow_text import words_of


def test_pieces_that_come_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder, asked = packing.Encoder(packing.tokenizer_json()), []
    model = encoder.model

    class Counted:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    encoder.model = Counted()
    for text in ("alpha beta gamma delta", "alpha, epsilon", "alpha; (beta)", "alpha! Éta"):
        w = words_of(pa.array([text]))
        got = encoder.texts(w, packing.lower_hashes(w))[0].tolist()
        assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x for x in asked if x.isalpha() and x.isascii()] == ["alpha", "beta", "gamma", "delta", "epsilon"]
