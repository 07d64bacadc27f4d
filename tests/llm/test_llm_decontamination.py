import random
from collections import defaultdict

from townpulse.llm import decontamination as D


def plain_tiles(item, doc, least):
    """Greedy string tiling as published: all matches of the longest length, then shorter ones."""
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        longest, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > longest:
                    longest, found = k, [(i, j)]
                elif k == longest:
                    found.append((i, j))
        if longest < least:
            return tiles
        for i, j in sorted(found):
            if not any(a[i : i + longest]) and not any(b[j : j + longest]):
                a[i : i + longest] = b[j : j + longest] = [True] * longest
                tiles.append((i, j, longest))


def test_tiles_equal_plain_tiling():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abc") for _ in range(rng.randint(3, 12))]
        doc = [rng.choice("abc") for _ in range(rng.randint(3, 30))]
        seeds = [tuple(doc[i : i + 3]) for i in range(len(doc) - 2)]
        where = defaultdict(list)
        for i in range(len(item) - 2):
            where[tuple(item[i : i + 3])].append(i)
        places = [i for i, s in enumerate(seeds) if s in where]
        mine = D.tile(where, places, [seeds[i] for i in places], 3)
        assert sorted(mine) == sorted(plain_tiles(item, doc, 3))


def leaks(spark, table, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in D.find_leaks(table(rows), bench, **options).collect()}


def test_passages_whole_reordered_and_clean(spark, table):
    item = "what is the capital city of the largest country that lies south of the equator today"
    words = item.split()
    swapped = " ".join(words[8:] + ["then"] + words[:8])
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, f"{filler} {item.upper()}! {filler}"),
        (2, f"{filler} {swapped} {filler}"),
        (3, filler),
        (4, f"{filler} {' '.join(words[:5])} {filler}"),
        (5, ", ".join(words)),
    ]
    found = leaks(spark, table, rows, [(10, item), (11, "too short"), (12, None), (13, "")])
    assert found.keys() == {(1, 10), (2, 10), (5, 10)}
    assert found[1, 10].coverage == 1.0 and not found[1, 10].reordered and len(found[1, 10].tiles) == 1
    assert found[2, 10].coverage == 1.0 and found[2, 10].reordered and len(found[2, 10].tiles) == 2


def test_odd_rows(spark, table, odd_rows):
    found = leaks(spark, table, odd_rows, [(1, "the dog lay by the door of the old house"), (1, "x y")])
    assert found.keys() == {(1, 1)}
    assert leaks(spark, table, [], [(1, "a b c d e")]) == {}
    assert leaks(spark, table, odd_rows, []) == {}


def test_items_with_null_and_repeated_ids(spark, table):
    one, two, three = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    items = [(None, one), (7, two), (7, three), (7, three)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.find_leaks(table([(1, one), (2, two), (3, three), (4, "clean")]), bench).collect()
    found = sorted((r.doc_id, str(r.item_id), r.coverage) for r in rows)
    assert found == [(1, "None", 1.0), (2, "7", 1.0), (3, "7", 1.0)]
