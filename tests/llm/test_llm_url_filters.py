import random

from townpulse.llm import url_filters as U


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = ""
    for c in rest:
        if c in "/?#":
            break
        host += c.lower() if c.isascii() else c
    path = ""
    for c in rest[len(host) :]:
        if c in "?#":
            break
        path += c
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if rest and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"),
    ("example.net", "/en/x/y", "allow"), ("org", "", "block"), ("b.org", "/", "allow"), ("", "/", "block"),
]


def judged(spark, rows, rules, **options):
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS rule", "1 AS n_rows")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = U.judge_urls(pages, table, **options).collect()
    return sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in found)


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, "no scheme/en"), (3, "http://"), (4, "a://b://net/"), (None, "x://NET/q")]
    for i in range(10, 400):
        host = ".".join(rng.choice(["a", "b", "example", "Net", "org", ""]) for _ in range(rng.randint(1, 4)))
        path = "".join(rng.choice(["/en", "/", "x", "/x/y", "é"]) for _ in range(rng.randint(0, 4)))
        rows.append((i, f"http://{host}{path}{rng.choice(['', '?a=/en/', '#/'])}"))
    rows += rows[20:25] + [(500, "http://a.example.net/en/x")] * 30
    rules = [r for r in RULES if r[0]]
    want = sorted(str((i, *plain(u, rules))) for i, u in rows)
    for options in ({}, {"ranges": 1, "salts": 1}, {"ranges": 5, "salts": 3}):
        assert judged(spark, rows, rules, **options) == want


def test_equal_rules_and_empty_tables(spark):
    rows = [(1, "http://x.net/")]
    assert judged(spark, rows, [("net", "/", "allow"), ("net", "/", "block")]) == [str((1, "x.net", "/", "net/", "block"))]
    assert judged(spark, rows, []) == [str((1, "x.net", "/", None, "allow"))]
    assert judged(spark, [], RULES[:1]) == []


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id bigint, url string")
    rules = spark.sql("SELECT 'net' AS host, '/' AS path, 'block' AS verdict")
    plan = U.judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "Cartesian", "NestedLoop"))
