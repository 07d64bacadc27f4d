import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from townpulse.llm import periodic_runs as P
from townpulse.llm import queries as Q


def plain_runs(words, least_length=6, least_exponent=4):
    """(start, length, period) by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(least_length, least_exponent * q) and (i, length) not in found:
                found[(i, length)] = q
            i = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(text, least_length=6, least_exponent=4):
    words = (text or "").encode().split()
    runs = plain_runs(words, least_length, least_exponent)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def rows_of(df):
    return sorted(
        str((r[0], r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.kept)) for r in df.collect()
    )


def wordy(seed, n=60):
    """Texts of few words with repeated stretches in them, and stretches of stretches."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice("ab" if rng.random() < 0.4 else "abcdefgh") for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))] * rng.randint(2, 6)
            at = rng.randrange(len(words) + 1)
            words[at:at] = unit * rng.choice([1, 1, 2]) + unit[: rng.randint(0, len(unit))]
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("least", [(6, 4), (1, 2), (3, 3)])
def test_runs_equal_brute_force(spark, table, odd_rows, least):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(wordy(5))]
    rows += [(900, "a " * 700), (None, "b c " * 30), (901, "a b " * 9), (902, "a " * 5)]
    found = rows_of(P.find_runs(table(rows), least_length=least[0], least_exponent=least[1]))
    long = {5: (20_000, [(0, 20_000, 977)], " ".join(f"w{i}" for i in range(977)))}
    assert found == sorted(str((i, *(long.get(i) or plain(t, *least)))) for i, t in rows)


def test_slices_of_one_text_and_of_many_agree(spark, table, monkeypatch):
    rows = [(i, t) for i, t in enumerate(wordy(6))]
    together = rows_of(P.find_runs(table(rows).coalesce(1)))
    monkeypatch.setattr(P, "SLICE_BYTES", 1)
    assert rows_of(P.find_runs(table(rows).coalesce(1))) == together


def test_other_keys_names_and_no_rows(spark, table):
    df = spark.createDataFrame([("x", "a " * 8, 1)], "name string, runs string, key int")
    found = P.find_runs(df, key="name", text="runs")
    assert found.columns == ["name", "n_words", "runs", "kept"] and found.first().kept == "a"
    assert P.find_runs(table([])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 3, 300)
    s[100:220] = np.resize(s[:7], 120)
    order, rank = P.suffix_array(s)
    plain_order = sorted(range(300), key=lambda i: s[i:].tolist())
    assert order.tolist() == plain_order and rank[order].tolist() == list(range(300))

    def common(a, b):
        n = 0
        while max(a, b) + n < 300 and s[a + n] == s[b + n]:
            n += 1
        return n

    expected = [-1, *(common(a, b) for a, b in zip(plain_order, plain_order[1:])), -1]
    assert P.common_prefixes(np.append(s, -1), order).tolist() == expected


def test_nearest_smaller_on_stairs():
    values = np.array([-1, 1, *range(500, 1, -1), 1, *range(2, 300), 0, 4, 4, 4, -1])
    at = np.flatnonzero(values > 0)
    for step in (-1, 1):
        near = P.nearest_smaller(values, at, step)
        for i, j in zip(at.tolist(), near.tolist()):
            k = i + step
            while values[k] >= values[i]:
                k += step
            assert j == k


def test_a_very_long_text_of_one_word_and_of_fibonacci_words():
    start, length, period = P.runs_of(np.zeros(300_000, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [1])
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    found = list(zip(*(x.tolist() for x in P.runs_of(np.array(b), 1, 2))))
    assert found == plain_runs(b, 1, 2)


def edited(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return b" ".join(words).decode()


def test_the_query_equals_brute_force(spark, table, odd_rows, tmp_path):
    rows = [r for r in odd_rows if r[0] != 5] + [(100 + i, t) for i, t in enumerate(wordy(7, 80))]
    rows += [(i, " ".join(f"w{j % 50}" for j in range(i % 90))) for i in range(200, 420)]
    assert sum(edited(i, t) != " ".join((t or "").split()) for i, t in rows) > 10
    table(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(str(tuple(r)) for r in Q.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())
    expected = []
    for doc_id, text in rows:
        _, runs, kept = plain(edited(doc_id, text))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = (sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())
        expected.append(str((doc_id, len(runs), *first, *digests)))
    assert found == sorted(expected)
