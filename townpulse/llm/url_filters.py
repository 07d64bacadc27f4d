"""URL filters: a sort-merge range join of reversed-host keys with nested rule intervals.

A rule is a host and a path prefix; it fits its host, all subdomains, and paths that start with its
path. Its key is the reversed host, ``#`` and the path (``net.example#/en/``; neither part can hold
``#``), and it covers the interval of all keys that start with it. A URL has one key for each suffix
of its host. Rules and URL keys are sorted together and swept once: intervals of prefixes nest, so
the rules open at a place form a stack, and at stack depth d its top is the last rule that opened at
depth d. Everything is DataFrame functions and windows.

The sweep is cut into key ranges, and each range into salts, so neither a hot host nor one URL that
a third of all rows repeat lands in one task; a rule is sent to the ranges that its interval meets.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. Equal
rows are counted before the sweep and all returned. Of two equal rules, block wins. An empty table
gives no rows; without rules every URL gets the default. Other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townpulse.llm.common import lower_ascii, kept

# Keys looked at to choose the cuts between ranges, and how much of each.
CUT_SAMPLE = 2048
CUT_CHARS = 64

OPEN, URL, CLOSE = 0, 1, 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path columns of a URL column."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, shape, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))
    return lower_ascii(host), path


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("#"), path)


def suffix_keys(host: Column, path: Column, most_labels: int) -> Column:
    """Keys of all suffixes of the host with at most as many labels as the longest rule host."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda n: F.concat(F.concat_ws(".", F.slice(labels, 1, n)), F.lit("#"), path),
    )


def key_cuts(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` sorted keys that cut the keys into ranges of like size.

    They come from a sample of fixed size and only say where rows go, never which rows stay.
    """
    found = (
        keys.select(F.xxhash64("key", "url").alias("h"), F.left("key", F.lit(CUT_CHARS)).alias("k"))
        .orderBy("h", "k")
        .limit(CUT_SAMPLE)
        .collect()
    )
    order = sorted((row.k for row in found), key=lambda k: k.encode())
    picked = {order[len(order) * i // ranges] for i in range(1, ranges)} if order else set()
    return sorted(picked, key=lambda k: k.encode())


def range_of(key: Column, cuts: list[str]) -> Column:
    """Number of the range that holds a binary key."""
    if not cuts:
        return F.lit(0)
    marks = F.array(*[F.encode(F.lit(cut), "UTF-8") for cut in cuts])
    return F.size(F.filter(marks, lambda cut: cut <= key))


def rule_edges(rules: DataFrame, cuts: list[str], salts: int) -> DataFrame:
    """The two ends of each rule's interval, in every range that it meets and in every salt.

    0xFF stands in no UTF-8 text: the rule's key followed by it is above all keys that start with it.
    """
    low = F.encode("rule_key", "UTF-8")
    high = F.concat(low, F.lit(b"\xff"))
    ends = F.array(
        F.struct(low.alias("at"), F.lit(OPEN).alias("kind"), F.col("hit")),
        F.struct(high.alias("at"), F.lit(CLOSE).alias("kind"), F.lit(None).alias("hit")),
    )
    return (
        rules.select(ends.alias("ends"), F.sequence(range_of(low, cuts), range_of(high, cuts)).alias("met"))
        .select("ends", F.explode("met").alias("range"))
        .select("ends", "range", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        .select("range", "salt", F.inline("ends"))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    page: str = "page_id",
    url: str = "url",
    default: str = "allow",
    ranges: int = 48,
    salts: int = 8,
) -> DataFrame:
    """``page``, host, path, rule (or null) and verdict for every row of ``pages``.

    ``rules`` has host, path and verdict. The longest fitting rule wins, counted in characters of
    host and path together, then of the host.
    """
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("rule_host"), "path", "verdict")
        .groupBy("rule_host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            rule_key(F.col("rule_host"), F.col("path")).alias("rule_key"),
            F.size(F.split("rule_host", r"\.")).alias("labels"),
            F.struct(
                (F.length("rule_host") + F.length("path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                F.concat("rule_host", "path").alias("rule"),
                F.col("verdict"),
            ).alias("hit"),
        )
    )
    labels = rules.agg(F.max("labels").alias("n")).first().n or 1
    host, path = url_parts(F.col("url"))
    distinct = kept(
        pages.select(F.col(page).alias("page"), F.col(url).alias("url"))
        .groupBy("page", "url")
        .agg(F.count("*").alias("n_rows"))
        .withColumns({"host": host, "path": path}),
        "urls",
    )
    keys = distinct.where(F.col("host") != "").select(
        "page", "url", F.explode(suffix_keys(F.col("host"), F.col("path"), labels)).alias("key")
    )
    cuts = key_cuts(keys, ranges)
    opened = rule_edges(rules, cuts, salts)
    urls = keys.select(
        range_of(F.encode("key", "UTF-8"), cuts).alias("range"),
        F.pmod(F.xxhash64("page", "url"), F.lit(salts)).cast("int").alias("salt"),
        F.encode("key", "UTF-8").alias("at"),
        F.lit(URL).alias("kind"),
        F.lit(None).cast(rules.schema["hit"].dataType).alias("hit"),
        "page",
        "url",
    )
    part = Window.partitionBy("range", "salt").orderBy("at", "kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    level = Window.partitionBy("range", "salt", "depth").orderBy("at", "kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    best = (
        urls.unionByName(opened, allowMissingColumns=True)
        .withColumn("depth", F.sum(step).over(part))
        .withColumn("top", F.last("hit", ignorenulls=True).over(level))
        .where((F.col("kind") == URL) & (F.col("depth") > 0))
        .groupBy("page", "url")
        .agg(F.max("top").alias("best"))
    )
    same = F.col("l.page").eqNullSafe(F.col("r.page")) & F.col("l.url").eqNullSafe(F.col("r.url"))
    return (
        distinct.alias("l")
        .join(best.alias("r"), same, "left")
        .select(
            F.col("l.page").alias(page),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1).cast("bigint"), "n_rows")).alias("_copy"),
        )
        .drop("_copy")
    )
