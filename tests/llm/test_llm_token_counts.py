import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from townpulse.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def tokens(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


PIECES = ["a", "B", "é", "\u0301", "Σ", "1", "'s", "<|startoftext|>", "<|endoftext|>", "<|", " ", "\n", "\t", "\u00a0", "\u2003", "漢", "😀", "İ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_words_count_alone(pieces):
    text = "".join(pieces)
    assert tokens(text) == sum(tokens(w.decode()) for w in text.encode().split())


def test_counts_and_cache(spark, table, odd_rows, tmp_path):
    rows = odd_rows + [(20, "The  cat\nsat."), (21, "The cat sat. "), (22, "<|endoftext|> the end")]
    cache = str(tmp_path / "cache")
    want = sorted(str((i, len((t or "").encode()), tokens(t))) for i, t in rows)

    def got(docs):
        return sorted(str(tuple(r)) for r in T.count_tokens(docs, PATH, cache).collect())

    assert got(table(rows)) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({" ".join((t or "").encode().split() and (t or "").split()) for _, t in rows})
    assert got(table(rows)) == want and spark.read.parquet(cache).count() == stored
    more = rows + [(30, "a new text")]
    assert len(got(table(more))) == len(more) and spark.read.parquet(cache).count() == stored + 1
    assert got(table([])) == []


def test_stored_counts_are_used(spark, table, tmp_path):
    cache = str(tmp_path / "cache")
    T.count_tokens(table([(1, "one two")]), PATH, cache).collect()
    changed = spark.read.parquet(cache).selectExpr("tokenizer", "content", "n_tokens + 100 AS n_tokens")
    changed.write.parquet(str(tmp_path / "other"))
    rows = T.count_tokens(table([(1, "one two"), (2, " one\ttwo")]), PATH, str(tmp_path / "other")).collect()
    assert {r.n_tokens for r in rows} == {tokens("one two") + 100}


def test_a_tokenizer_that_keeps_white_space(spark, table, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    rows = [(1, "a  b\n\nc "), (2, None), (3, "a b c")]
    found = T.count_tokens(table(rows), path, str(tmp_path / "c"), drops_space=False).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(other.encode(t or "").ids) for i, t in rows}
