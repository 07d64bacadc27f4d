import random

import pytest

from townpulse.llm import ngram_jaccard as J


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        known = [k for k in groups[find(i)] if k is not None]
        least = min(known) if known and sets[i] else key
        out.append((key, len(sets[i]), least))
    return sorted(map(str, out))


def found(spark, docs):
    rows = J.join_sets(docs).collect()
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in rows)


def corpus(seed):
    """Groups of near copies about the threshold, chains, short texts and a passage all share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(12):
        chain[i * 5] = f"c{i}"
        rows.append(" ".join(chain).upper())
    for _ in range(12):
        rows.append(" ".join(passage + [f"own{rng.randrange(10**6)}" for _ in range(rng.randint(1, 14))]))
    rows += ["a b c", "A  b\nc", "a b", "a b c d e", "a b c d e", ""]
    rng.shuffle(rows)
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, table, odd_rows, monkeypatch, seed):
    monkeypatch.setattr(J, "FREQUENT_IN_TASK", 1 + seed)
    rows = corpus(seed) + odd_rows + [(None, "a b c d e"), (None, "zz yy xx ww vv uu")]
    assert found(spark, table(rows)) == plain(rows)


def test_empty_and_small(spark, table):
    assert found(spark, table([])) == []
    rows = [(5, None), (4, ""), (None, None)]
    assert found(spark, table(rows)) == plain(rows)


def test_one_of_each_group_stays(spark, table):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (2, text), (2, text), (9, "other words that stand for themselves here"), (None, text), (4, None)]
    kept = J.keep_one(table(rows)).select("doc_id", "text").collect()
    assert sorted(str(tuple(r)) for r in kept) == sorted(str(r) for r in [rows[1], rows[3], rows[4], rows[5]])


def test_rows_of_one_key_are_told_apart(spark, table):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [
        (3, a + " end"), (5, a), (5, b),  # only the copy goes, not the other text of its id
        (7, c), (7, c + " end"), (7, c),  # near copies under one id
        (None, d), (None, d + " end"), (None, d), (None, ""), (None, ""),
    ]
    kept = [tuple(r) for r in J.keep_one(table(rows)).select("doc_id", "text").collect()]
    assert sorted(t for i, t in kept if i in (3, 5)) == sorted([a + " end", b])
    assert len([t for i, t in kept if i == 7]) == 1
    assert len([t for i, t in kept if i is None and t]) == 1
    assert kept.count((None, "")) == 2 and len(kept) == 6
    assert J.keep_one(table([])).collect() == []


def test_prefix_lengths_are_exact():
    for n in range(1, 300):
        need = min(k for k in range(n + 1) if 5 * k >= 4 * n)
        assert J.prefix_length(n) == n - need + 1


def test_overlap_table_and_links_of_a_list(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.11, rng.integers(0, 1 << 62, 60).astype(np.uint64), base)) for _ in range(40)]
    plain = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for columns in (4096, 7):
        monkeypatch.setattr(J, "COLUMNS", columns)
        table = J.overlap_table(sets)
        assert (table == [[n if i != j else table[i, i] for j, n in enumerate(row)] for i, row in enumerate(plain)]).all()
    sizes = np.array([len(s) for s in sets])

    def classes(pairs):
        root = list(range(40))
        for a, b in pairs:
            root = [root[b] if r == root[a] else r for r in root]
        return [root.index(r) for r in root]

    linked = [
        (i, j) for i in range(40) for j in range(i + 1, 40)
        if 100 * plain[i][j] >= 80 * (sizes[i] + sizes[j] - plain[i][j])
    ]
    assert 0 < len(linked) < 700
    found = J.linked_in_list(sizes, sizes, np.arange(40), np.zeros(40, int), sets)
    assert set(found) <= set(linked) and classes(found) == classes(linked) and len(found) < 40
    sides = np.arange(40) % 2
    across = J.linked_in_list(sizes, sizes, np.arange(40), sides, sets)
    assert classes(across) == classes([(i, j) for i, j in linked if sides[i] != sides[j]])


@pytest.mark.parametrize("rows", [256, 40])
def test_many_sets_about_the_threshold_form_few_pairs(spark, table, monkeypatch, rows):
    """1,700 texts, each with its own words changed: their links are found without forming all pairs."""
    import numpy as np

    monkeypatch.setattr(J, "LIST_ROWS", rows)
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(120)], object)
    docs = []
    for i in range(1700):
        # a few words in a row are changed, the more the farther from the threshold
        own = words.copy()
        for at in rng.integers(0, 116, int(rng.integers(1, 5))).tolist():
            own[at : at + 2] = [f"x{i}a{at}", f"x{i}b{at}"]
        docs.append((i, " ".join(own)))
    formed = []
    whole = J.remaining_pairs

    def counted(entries):
        pairs = whole(entries)
        formed.append((pairs.count(), entries.count()))
        return pairs

    monkeypatch.setattr(J, "remaining_pairs", counted)
    found = {r.doc_id: r.component_id for r in J.join_sets(table(docs, extra=False)).collect()}
    grams = [np.array(sorted({hash(tuple(t.split()[k : k + 5])) for k in range(116)}), np.int64).view(np.uint64) for _, t in docs]
    sizes = np.array([len(g) for g in grams])
    common = J.overlap_table([np.sort(g) for g in grams])
    near = 100 * common >= 80 * (sizes[:, None] + sizes - common)
    np.fill_diagonal(near, True)
    label = np.arange(1700)
    while True:
        least = np.array([label[row].min() for row in near])
        if (least == label).all():
            break
        label = least
    assert len(set(label.tolist())) > 20
    assert [found[i] for i in range(1700)] == label.tolist()
    assert formed[0][0] <= 20_000


def test_frequent_shingles_reach_the_driver_as_arrays(spark, monkeypatch):
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    from townpulse.llm import ngram_jaccard as J

    texts = ["a b c d e f g"] * 9 + ["a b c d e x"] * 7 + ["k l m n o p"] * 4 + ["only once in here at all", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    expected = Counter(int(h) for one in J.shingle_sets(pa.array(texts), 5) for h in one)
    # no list of rows is made, up to 2^17 of them
    monkeypatch.setattr(type(docs), "collect", lambda self: 1 / 0)
    values, logs = J.frequent_shingles(docs, "text", 5)
    often = {h: n for h, n in expected.items() if n >= J.FREQUENT_IN_TASK}
    assert values.tolist() == sorted(often) and len(often) == 6
    assert logs.tolist() == [int(np.log2(often[h])) for h in sorted(often)]
    values, logs = J.frequent_shingles(docs.limit(0), "text", 5)
    assert len(values) == 0 and len(logs) == 0


def counted_corpus():
    """Texts of 200 words: 40 of their own words only, of which pairs share a part, and 6 near copies of one."""
    rng = random.Random(5)
    rows = [" ".join(f"d{i}w{k}" for k in range(200)) for i in range(40)]
    for i in range(0, 20, 2):  # 60 of 196 shingles shared with the next: far from a link
        rows[i + 1] = " ".join(rows[i].split()[:64] + rows[i + 1].split()[64:])
    base = [f"b{k}" for k in range(200)]
    for i in range(6):
        copy = list(base)
        copy[rng.randrange(200)] = f"new{i}"
        rows.append(" ".join(copy))
    rows += [rows[0], rows[40], "", None]
    return list(enumerate(rows))


@pytest.mark.parametrize("sets", [8192, 3])
def test_sets_with_lone_shingles_go_no_further_however_many_there_are(spark, table, monkeypatch, sets):
    """What is written and sent on follows the near copies, also where no bitmap of repeated shingles could
    tell lone ones any more: here it has 2^10 bits for 9,000 shingles."""
    monkeypatch.setattr(J, "CHUNK_SETS", sets)
    monkeypatch.setattr(J, "REPEATED_BITS", 10)
    monkeypatch.setattr(J, "FILL_BITS", 9)
    rows = counted_corpus()
    docs = table(rows, extra=False)
    seen = {}
    needed = J.needed_entries

    def counted(entries):
        seen["nodes"] = entries.select("node").distinct().count()
        return needed(entries)

    monkeypatch.setattr(J, "needed_entries", counted)
    assert found(spark, docs) == plain(rows)
    assert seen["nodes"] == 6


def test_lone_shingles_of_a_set_are_counted_exactly(spark, table, monkeypatch):
    import numpy as np

    rows = counted_corpus()
    for ranges in (1000, 384):
        monkeypatch.setattr(J, "COUNTED_RANGES", ranges)
        monkeypatch.setattr(J, "CHUNK_SETS", 7)
        kept = {r.number for r in J.sets_that_may_link(table(rows, extra=False), "text", 5).collect()}
        import pyarrow as pa

        sets = J.shingle_sets(pa.array([t for _, t in rows]), 5)
        several = {}
        for one in {J.node_of(s): s for s in sets}.values():
            for h in one.tolist():
                several[h] = several.get(h, 0) + 1
        for one in sets:
            if not len(one):
                continue
            number = int.from_bytes(J.node_of(one)[:8], "little", signed=True)
            lone = sum(several[h] == 1 and h >> 54 < ranges for h in one.tolist())
            if sum(np.array_equal(one, other) for other in sets) == 1:
                assert (number in kept) == (lone <= len(one) // 5)
            elif lone <= len(one) // 5:
                assert number in kept
    packed = np.array([0, 3, 70_000, 5])
    assert J.unpacked(J.packed(packed)).tolist() == packed.tolist() and len(J.unpacked(J.packed(packed[:0]))) == 0
