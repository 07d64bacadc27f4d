import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from townpulse.llm import words as W


@given(st.lists(st.one_of(st.none(), st.text("ab \n\tÄé\x0b\u00a0😀", max_size=30)), max_size=8))
def test_words_are_those_of_a_plain_split(texts):
    found = W.split_words(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        plain = (text or "").encode().split()
        assert [found.bytes_of(j) for j in range(found.first[i], found.first[i + 1])] == plain


def test_hashes_depend_on_the_word_alone(monkeypatch):
    text = "one two three two " + "y" * 3000 + " one"
    found = W.split_words(pa.array([text, "two", None, "y" * 3000]))
    hashes = found.hashes.tolist()
    assert hashes[1] == hashes[3] == hashes[6] and hashes[0] == hashes[5] and len(set(hashes)) == 4
    monkeypatch.setattr(W, "BLOCK", 64)
    assert W.split_words(pa.array([text, "two", None, "y" * 3000])).hashes.tolist() == hashes


def test_gram_hashes_follow_order():
    h = W.split_words(pa.array(["a b c a b d b a"])).hashes
    g = W.gram_hashes(h, 2)
    assert g[0] == g[3] and len(set(g.tolist())) == 6
    assert len(W.gram_hashes(h, 9)) == 0


def test_slices_cover_all_rows_in_order():
    texts = ["a" * n for n in (5, 0, 900, 3, 3, 3)]
    batch = pa.record_batch([pa.array(texts)], names=["t"])
    parts = [p.column(0).to_pylist() for p in W.row_slices(batch, 0, 10)]
    assert sum(parts, []) == texts and all(sum(map(len, p)) <= 10 or len(p) == 1 for p in parts)
    assert isinstance(parts, list) and np.all([len(p) for p in parts])
