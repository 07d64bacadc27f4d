import hashlib
import itertools

from townpulse.llm import spot_signatures as S


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for n, (i, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        swap = len(text) // 3
        edited = text[: len(text) - swap] + following[:swap]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(map(str, out))


def test_next_documents_over_ranges(spark, table, odd_rows):
    rows = odd_rows + [(10 * i, f"the {i} river of many towns {i * i} and the sea") for i in range(1, 60)]
    for ranges in (1, 7, 300):
        found = S.compare_with_next(table(rows), ranges=ranges).collect()
        assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in found) == expected(rows)
    assert [r.near_next for r in S.compare_with_next(table([(1, "alone and the sea")])).collect()] == [1.0]
    assert S.compare_with_next(table([])).collect() == []


def test_equal_texts_have_equal_fingerprints(spark, table, odd_rows):
    found = S.fingerprints(table(odd_rows)).collect()
    marks = {}
    for row, (_, text) in zip(found, odd_rows, strict=True):
        marks.setdefault(text or "", set()).add(row.fingerprint)
    assert all(len(v) == 1 for v in marks.values())
    assert marks[""] == {""} and len({v for s in marks.values() for v in s}) == len(marks)


def test_likeness_tells_edits_from_other_texts(spark, table):
    base = [f"the {i} tower of stone{i} and old{i} walls in town{i} was built by mason{i}" for i in range(90)]
    text, other = ". ".join(base[:45]), ". ".join(base[45:])
    anchors = S.anchor_hashes()
    a, b, c = S.signature_sets([text, text[:-200] + other[:200], other], anchors, 2)
    assert S.likeness(a, b) > 0.7 and S.likeness(a, c) < 0.1 and S.likeness(a, a) == 1.0


def test_near_pairs_equal_brute_force(spark, table):
    import random

    rng = random.Random(9)
    texts = []
    for g in range(8):
        words = [f"{rng.choice(['the', 'of', 'and', 'in'])} g{g}w{i}" for i in range(40)]
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts.append(" ".join(copy))
    marks = S.fingerprints(table(list(enumerate(texts)))).select("fingerprint").distinct()
    sets = {
        r.fingerprint: s
        for r in marks.collect()
        for s in [{r.fingerprint[i : i + 8] for i in range(0, len(r.fingerprint), 8)}]
    }
    want = {
        frozenset((a, b))
        for a, b in itertools.combinations(sets, 2)
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    }
    assert {frozenset((r.a, r.b)) for r in S.near_pairs(marks).collect()} == want and len(want) > 3
