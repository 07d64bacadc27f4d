import random

import pytest

from townpulse.llm import substring_dedup as S


def plain(rows, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        if i is not None:
            for at in range(len(words) - width + 1):
                w = tuple(words[at : at + width])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        if i is not None:
            for at in range(len(words) - width + 1):
                if first[tuple(words[at : at + width])] < i:
                    gone.update(range(at, at + width))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone).decode()
        out.append((i, len(words), len(gone), kept))
    return sorted(map(str, out))


def found(spark, docs, width, **options):
    rows = S.remove_repeats(docs, width=width, gram=3, **options).collect()
    return sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in rows)


def corpus(odd_rows):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = list(odd_rows)
    for i in range(10, 60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))]
        at = rng.randrange(len(words) + 1)
        cut = rng.randint(5, 30)
        words[at:at] = passage[:cut] if i % 3 else passage[-cut:]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(100 + i, rows[20][1]) for i in range(4)] + [(None, rows[20][1])]
    return rows


@pytest.mark.parametrize("most", [4000, 1])
def test_removed_words_equal_brute_force(spark, table, odd_rows, monkeypatch, most):
    """With ``most`` 1 all shared minimisers go the way of hot ones."""
    monkeypatch.setattr(S, "MOST_PACKS", most)
    rows = corpus(odd_rows)
    assert found(spark, table(rows), 12) == plain(rows, 12)


def test_long_runs_are_cut(spark, table, monkeypatch):
    monkeypatch.setattr(S, "LONGEST_RUN", 8)
    rows = [(1, "a " * 400), (2, "b " + "a " * 100), (3, "a " * 12)]
    assert found(spark, table(rows), 12) == plain(rows, 12)


def test_empty(spark, table):
    assert found(spark, table([]), 12) == []
    rows = [(1, None), (2, "")]
    assert found(spark, table(rows), 12) == plain(rows, 12)


def test_sliding_min():
    import numpy as np

    values = np.random.default_rng(0).integers(0, 50, 40)
    for width in (1, 2, 5, 8, 13, 40):
        assert S.sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(41 - width)]
    assert len(S.sliding_min(values, 41)) == 0
