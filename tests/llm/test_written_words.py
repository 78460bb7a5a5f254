"""New words of a slice are decoded and lower-cased all at once."""

import numpy as np
import pyarrow as pa

from quillon.llm import arrow_text, packing


def test_words_are_decoded_together_as_one_by_one():
    texts = ["Ünder\tthe ÀB Σας\r\nİx", "", None, " end. ", "東京 a"]
    w = arrow_text.words_of(pa.array(texts))
    got = packing.written(w.data, w.starts, w.ends)
    assert got == [x for t in texts if t for x in t.split()]
    assert packing.written(w.data, w.starts[:0], w.ends[:0]) == []
    encoder = packing.Encoder(packing.tokenizer_json())
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.words(got)] == [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in got]


def test_bytes_by_arithmetic_are_those_by_look_up():
    every = np.arange(256, dtype=np.uint8)
    assert (arrow_text.lower(every) == arrow_text.LOWER).all() and (arrow_text.solid_of(every) == ~arrow_text.SPACE).all()
