import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from townpulse.operators import feed as P
from townpulse.sources import feeds, tables

FLAT = [
    ("g", 1, dt.datetime(2024, 1, 1, 1), None, 5, 'says "hi", twice', None),
    ("g", 1, dt.datetime(2024, 1, 1, 1), 2, 6, "line one\nline two\r\nthree", dt.datetime(2024, 1, 2)),
    ("h", 2, dt.datetime(2024, 1, 1, 2), 3, 7, " padded, привет ", dt.datetime(2024, 1, 3)),
    ("h", 2, dt.datetime(2024, 1, 1, 2), 4, 7, "NA", dt.datetime(2024, 1, 3)),
    ("h", 2, dt.datetime(2024, 1, 1, 2), 5, 7, "null", dt.datetime(2024, 1, 3)),
    ("h", 3, dt.datetime(2024, 1, 1, 2), None, 7, "", None),
    ("h", 3, dt.datetime(2024, 1, 1, 2), 6, 7, "back\\slash \\\" end", dt.datetime(2024, 1, 3)),
]


@pytest.fixture
def flat(spark):
    return spark.createDataFrame(FLAT, tables.FLAT_SCHEMA)


def by_key(rows):
    return sorted(rows, key=lambda r: (r[1], r[3] or 0))


def test_group_list_is_stripped_and_keeps_repeats(spark, tmp_path):
    path = tmp_path / "groups.txt"
    path.write_text("one\n  two \n\n three \none\n   \n", encoding="utf-8")
    groups = feeds.read_groups(spark, str(path))
    assert [r[0] for r in groups.collect()] == ["one", "two", "three", "one"]


def test_csv_round_trip(spark, flat, tmp_path):
    path = str(tmp_path / "csv")
    tables.write_comments(flat, path, first=True)
    back = tables.read_comments(spark, path, missing_words=False).collect()
    expected = [tuple(None if v == "" else v for v in r) for r in FLAT]
    assert [tuple(r) for r in by_key(back)] == [tuple(r) for r in by_key(expected)]


def test_words_for_missing_text_become_null(spark, flat, tmp_path):
    path = str(tmp_path / "csv")
    tables.write_comments(flat, path, first=True)
    texts = {(r.post_id, r.comment_id): r.text for r in tables.read_comments(spark, path).collect()}
    assert texts[2, 4] is texts[2, 5] is texts[3, None] is None
    assert texts[2, 3] == " padded, привет "


def test_first_batch_replaces_later_ones_add(spark, flat, tmp_path):
    path = str(tmp_path / "csv")
    for first in (True, True, False):
        tables.write_comments(flat, path, first=first)
    assert tables.read_comments(spark, path).count() == 2 * len(FLAT)


def test_files_hold_a_bounded_number_of_rows_and_a_header_each(spark, flat, tmp_path):
    path = tmp_path / "csv"
    tables.write_comments(flat.coalesce(1), str(path), first=True, rows_per_file=2)
    files = list(path.glob("*.csv"))
    assert len(files) == 4
    assert all(f.read_text(encoding="utf-8").splitlines()[0].count("group_domain") for f in files)
    assert tables.read_comments(spark, str(path)).count() == len(FLAT)


def test_group_store_appends_by_directory(spark, flat, tmp_path):
    path = tmp_path / "store"
    tables.append_groups(flat, str(path))
    tables.append_groups(flat.filter("group_domain = 'h'"), str(path))
    assert sorted(p.name for p in path.glob("group_domain=*")) == ["group_domain=g", "group_domain=h"]
    back = tables.read_store(spark, str(path))
    assert back.columns == P.FLAT_COLUMNS
    assert back.count() == len(FLAT) + 5
    one = back.filter("group_domain = 'g'")
    assert "PartitionFilters: [isnotnull(group_domain" in one._jdf.queryExecution().executedPlan().toString()


def test_group_names_that_look_like_numbers_stay_text(spark, flat, tmp_path):
    path = str(tmp_path / "store")
    tables.append_groups(flat.withColumn("group_domain", F.lit("0123")), path)
    assert {r[0] for r in tables.read_store(spark, path).select("group_domain").collect()} == {"0123"}


def test_result_tables_and_time_keys(spark, flat, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(flat.withColumn("date_time", tables.date_time_of()), path)
    tables.write_table(flat.withColumn("date_time", tables.date_time_of()), path)
    rows = tables.with_time_keys(tables.read_table(spark, path))
    assert rows.count() == len(FLAT)
    row = rows.filter("comment_id = 2").first()
    assert (row.year, row.week, row.week_start) == (2024, "2024-01-01/2024-01-07", dt.date(2024, 1, 1))
    assert rows.filter("comment_id is null and date_time <> post_date").count() == 0


def test_freshness_lists_files_without_reading_them(spark, flat, tmp_path):
    path = tmp_path / "table"
    tables.write_table(flat, str(path))
    when = dt.datetime(2031, 5, 6, 7, 8, tzinfo=dt.timezone.utc).timestamp()
    part = next(path.glob("part-*"))
    os.utime(part, (when, when))
    assert tables.freshness(spark, str(path)).first().last_updated == "06.05.2031 07:08"


def write_feed(root, groups):
    for name, lines in groups.items():
        folder = root / f"group_domain={name}"
        folder.mkdir(parents=True)
        (folder / f"{time.time_ns()}.json").write_text("\n".join(lines), encoding="utf-8")


def line(number, **more):
    return json.dumps({"seq": number, "id": number, "owner_id": -1, "date": 1_704_067_200, **more})


def test_a_bad_line_takes_out_its_group_only(spark, tmp_path):
    write_feed(
        tmp_path / "feed",
        {
            "good": [line(1, text="hello", comments=[{"id": 9, "text": "да", "date": 1_704_070_000}])],
            "bad": [line(1), '{"seq": 2, "id": ', line(3)],
            "123": [line(1)],
            "empty": [""],
        },
    )
    rows = feeds.land_feed(spark, str(tmp_path / "feed"), str(tmp_path / "landed"))
    posts = feeds.good_posts(rows)
    assert sorted((r.group_domain, r.id) for r in posts.collect()) == [("123", 1), ("good", 1)]
    bad = feeds.bad_lines(rows).collect()
    assert [(r.group_domain, r.bad_line) for r in bad] == [("bad", '{"seq": 2, "id": ')]
    assert sorted(r.text for r in P.flatten(posts).collect()) == ["", "hello", "да"]
    wanted = spark.createDataFrame([("good",), ("good",)], "group_domain string")
    assert feeds.listed_posts(posts, wanted).count() == 1
    assert feeds.read_posts(spark, str(tmp_path / "feed")).count() == 2
