import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from townpulse.llm import merge_dropout as M

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text("abcdeTh  in.,\n\t漢é😀ü▁\x00", max_size=200)


@pytest.fixture(scope="module")
def model():
    return M.load_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_without_dropout_it_is_the_plain_encoding(model, library, text):
    text = text.replace("▁", "")
    assert M.encode_texts([text], 1, model, 0.0)[0].tolist() == library.encode(text)


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=5), key=st.integers(0, 2**60), dropout=st.sampled_from([0.1, 0.5, 1.0]))
def test_dropout_decodes_exactly(model, texts, key, dropout):
    for text, ids in zip(texts, M.encode_texts(texts, key, model, dropout), strict=True):
        assert M.decode_ids(ids.tolist(), model) == text


def test_together_and_agenda_agree(model):
    chunks = [" segmentation", " internationalisation", " the", "  ", " ab\ncd", " straße漢"]
    for dropout in (0.0, 0.2, 0.7):
        pieces, offsets = M.encode_chunks(chunks, 99, model, dropout)
        ids, starts, hashes = M.symbols(chunks, model)
        keys = M.mix(hashes ^ M.np.uint64(99))
        for i in range(len(chunks)):
            own = ids[starts[i] : starts[i + 1]].tolist()
            assert M.encode_agenda(own, int(keys[i]), model, dropout) == pieces[offsets[i] : offsets[i + 1]].tolist()


def test_long_chunks_and_varied_segmentations(model, library):
    long = "internationalisation" * 400
    assert M.encode_texts([long], 1, model, 0.0)[0].tolist() == library.encode(long)
    text = "international organisations segment differently"
    found = {tuple(M.encode_texts([text], key, model, 0.3)[0].tolist()) for key in range(20)}
    assert len(found) > 10
    again = M.encode_texts([text], 3, model, 0.3)[0].tolist()
    assert again == M.encode_texts(["x", text], 3, model, 0.3)[1].tolist()


def test_rows(spark, table, odd_rows):
    docs = table(odd_rows)
    encoded = M.encode(docs, PATH, dropout=0.3)
    rows = encoded.collect()
    assert len(rows) == len(odd_rows) and all(r.lossless for r in rows)
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    one, two = (r.ids for r in rows if r.doc_id == 1)
    assert one == two
    texts = sorted(str((r.doc_id, r.text)) for r in M.decode(encoded, PATH).collect())
    assert texts == sorted(str((i, t or "")) for i, t in odd_rows)
    assert M.encode(table([]), PATH).collect() == []


def test_occurrences_draw_for_themselves(spark, table, model):
    """A word has many segmentations over documents and within one, also in a repeated run."""
    docs = table([(i, " internationalisation") for i in range(300)] + [(300, "internationalisation " * 300)])
    rows = {r.doc_id: r.ids for r in M.encode(docs, PATH, dropout=0.3).collect()}
    assert len({tuple(rows[i]) for i in range(300)}) > 50
    words = M.decode_ids(rows[300], model)
    assert words == "internationalisation " * 300
    one = M.encode_texts(["internationalisation"] * 2, M.np.array([1, 2], M.np.uint64), model, 0.3)
    assert one[0].tolist() != one[1].tolist()
    found, piece = set(), []
    for i in rows[300]:
        if model.texts[i].startswith(b" "):
            found.add(tuple(piece))
            piece = []
        piece.append(i)
    assert len(found) > 50
    again = {r.doc_id: r.ids for r in M.encode(docs.repartition(3), PATH, dropout=0.3).collect()}
    assert again == rows


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_shared_work_gives_what_each_occurrence_gives_alone(model, dropout):
    chunks = [" segmentation", " the", " internationalisation", "  ", " straße漢", " " + "long" * 40]
    rng = M.np.random.default_rng(5)
    of = rng.integers(0, len(chunks), 600)
    keys = rng.integers(0, 2**63, 600).astype(M.np.uint64)
    pieces, offsets = M.encode_chunks(chunks, keys, model, dropout, of)
    ids, starts, hashes = M.symbols(chunks, model)
    own = M.mix(hashes[of] ^ keys)
    for n, i in enumerate(of.tolist()):
        alone = M.encode_agenda(ids[starts[i] : starts[i + 1]].tolist(), int(own[n]), model, dropout)
        assert alone == pieces[offsets[n] : offsets[n + 1]].tolist()
