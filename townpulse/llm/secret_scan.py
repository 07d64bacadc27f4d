"""Secret scans over a trigram inverted index.

From each rule's expression a Boolean query over trigrams is derived: every match must hold, for each
of some segments, all trigrams of one of the segment's alternatives. The index holds, for every
trigram that some query uses, the documents with it. Postings are intersected per document, and only
documents that satisfy a rule's query are searched with its expression. A rule without mandatory
trigrams is searched for in all documents. Queries are derived on the driver from the expressions
alone; all work on texts is SQL functions.

Defined cases: a null or empty text has no spans. Equal ids may repeat, also null ones: each row is
judged by its own text (the index only adds candidates). An empty table gives no rows. Only the id
and the text column are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import itertools
import re._constants as rc
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townpulse.llm.common import join_sized, kept


@dataclass(frozen=True)
class Rule:
    """What to find; ``group`` of a match must have ``least`` characters at least, or it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules, then what the method adds.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of fewer than 24 cannot pass, so the search looks for long ones alone.
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES

# A segment with more possible strings than this is cut off and gives no trigrams of its own.
MOST_STRINGS = 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _class_members(items) -> set[str] | None:
    """Characters of a small positive class, in lower case; ``None`` if it is large or negated."""
    out = set()
    for kind, value in items:
        if kind is rc.LITERAL:
            out.add(chr(value).lower())
        elif kind is rc.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _exact(node) -> set[str] | None:
    """All strings that a parsed part can match, in lower case, if they are few."""
    kind, value = node
    if kind is rc.LITERAL:
        return {chr(value).lower()}
    if kind is rc.IN:
        return _class_members(value)
    if kind is rc.SUBPATTERN:
        return _exact_all(value[3])
    if kind is rc.BRANCH:
        options = [_exact_all(part) for part in value[1]]
        return None if None in options else set().union(*options)
    if kind is rc.MAX_REPEAT and value[1] <= 4:
        inner = _exact_all(value[2])
        if inner is None:
            return None
        return {
            "".join(t) for n in range(value[0], value[1] + 1) for t in itertools.product(inner, repeat=n)
        }
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _exact(node)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in found}
    return out


def _segment(strings: set[str]) -> list[frozenset[str]]:
    """The alternatives of a segment without those that imply another; none if one has no trigram."""
    sets = {trigrams(s) for s in strings}
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Segments (all needed) of alternatives (one needed) of trigrams (all needed), in lower case.

    An empty list says that nothing is mandatory.
    """
    segments, open_strings = [], {""}
    for node in _parser.parse(pattern):
        found = _exact(node)
        if found is not None and len(found) * len(open_strings) <= MOST_STRINGS:
            open_strings = {a + b for a in open_strings for b in found}
            continue
        segments.append(_segment(open_strings))
        open_strings = found or {""}
        kind, value = node
        if found is None and kind is rc.SUBPATTERN:
            segments += trigram_query_of(value[3])
    segments.append(_segment(open_strings))
    return [s for s in segments if s]


def trigram_query_of(nodes) -> list[list[frozenset[str]]]:
    """Segments of a group that is too varied to list: the runs of its own parts that can be listed."""
    out, run = [], {""}
    for node in nodes:
        found = _exact(node)
        if found is None or len(found) * len(run) > MOST_STRINGS:
            out.append(_segment(run))
            run = found or {""}
        else:
            run = {a + b for a in run for b in found}
    out.append(_segment(run))
    return [s for s in out if s]


def build_index(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key): one for each document and each given trigram in its lower-cased text."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))
    return docs.select(F.col(key), F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: list[Rule], key: str = "doc_id") -> DataFrame:
    """``key`` and the kinds of the rules whose trigram query it satisfies.

    A document's postings are intersected by gathering its trigrams, of which there are at most as
    many as the queries use.
    """
    grams = index.groupBy(key).agg(F.collect_set("gram").alias("grams"))

    def holds(rule: Rule) -> Column:
        test = F.lit(True)
        for segment in trigram_query(rule.pattern):
            one = F.lit(False)
            for alternative in segment:
                need = F.array(*[F.lit(g) for g in sorted(alternative)])
                one |= F.size(F.array_intersect("grams", need)) == len(alternative)
            test &= one
        return test

    kinds = F.array_compact(F.array(*[F.when(holds(r), F.lit(r.kind)) for r in rules]))
    return grams.select(key, kinds.alias("kinds")).where(F.size("kinds") > 0)


def find_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches, without those that fail its length.

    The text is split by the expression; the lengths of gaps and matches add up to the places.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>").alias("spans"),
    )

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + F.length(pair["gap"])
        last = first + F.length(pair["hit"])
        part = F.regexp_extract(pair["hit"], rule.pattern, rule.group) if rule.group else pair["hit"]
        span = F.struct(
            first.alias("start"),
            F.lit(order).alias("ord"),
            F.lit(rule.kind).alias("kind"),
            last.alias("end"),
        )
        kept_spans = F.when(
            F.length(part) >= rule.least, F.concat(state["spans"], F.array(span))
        ).otherwise(state["spans"])
        return F.struct(last.alias("at"), kept_spans.alias("spans"))

    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All columns of ``docs`` and ``spans``: start, ord (place of the rule), kind, end, sorted."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind]]
    grams = sorted({g for q in queries.values() for s in q for alternative in s for g in alternative})
    none = F.array().cast("array<string>")
    if indexed:
        index = kept(build_index(docs, grams, key, text), "trigrams")
        found = candidates(index, indexed, key).withColumnRenamed("kinds", "_kinds")
        docs = join_sized(docs, found, key)
    else:
        docs = docs.withColumn("_kinds", none)
    body, kinds = F.coalesce(F.col(text), F.lit("")), F.coalesce("_kinds", none)
    parts = []
    for order, rule in enumerate(rules):
        spans = find_spans(body, rule, order)
        if queries[rule.kind]:
            empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
            spans = F.when(F.array_contains(kinds, rule.kind), spans).otherwise(empty)
        parts.append(spans)
    return docs.withColumn("spans", F.array_sort(F.concat(*parts))).drop("_kinds")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def mask(text: Column, spans: Column, sign: str = "[secret]") -> Column:
    """``text`` with every span replaced by ``sign``; spans that overlap become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(F.lit(0), span["start"] - state["at"]))
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(sign))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(
        spans,
        start,
        step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
