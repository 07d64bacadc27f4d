"""DuckDB SQL for the operators that SQL can express: ``name -> statement``."""

from __future__ import annotations

from townpulse.llm.secret_scan import BASE_RULES, RULES

ORACLES: dict[str, str] = {}

ORACLES["op9_url_filters"] = """
WITH rest AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
      THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def _ascii_either_case(pattern: str) -> str:
    """The ``(?i)`` expression with ASCII classes, because RE2 folds more letters than that."""
    if not pattern.startswith("(?i)"):
        return pattern
    out, inside, escaped = [], False, False
    for c in pattern.removeprefix("(?i)"):
        inside = (inside or c == "[") and c != "]"
        plain = c.isalpha() and not inside and not escaped
        out.append(f"[{c.lower()}{c.upper()}]" if plain else c)
        escaped = c == "\\"
    return "".join(out)


def _scan_sql() -> str:
    parts = []
    for order, rule in enumerate(RULES):
        pattern = _ascii_either_case(rule.pattern).replace("'", "''")
        length = (
            f"length(regexp_extract(hits[i], '{pattern}', {rule.group}))" if rule.group else "length(hits[i])"
        )
        parts.append(f"""
          SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, s AS first, s + length(hits[i]) AS last
          FROM (SELECT doc_id, hits, i,
                       CAST(list_sum([length(x) FOR x IN gaps[1:i]])
                            + coalesce(list_sum([length(x) FOR x IN hits[1:i-1]]), 0) AS BIGINT) AS s
                FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
                      FROM (SELECT doc_id, regexp_extract_all(body, '{pattern}') AS hits,
                                   string_split_regex(body, '{pattern}') AS gaps
                            FROM bodies)))
          WHERE {length} >= {rule.least}""")
    base = len(BASE_RULES)
    place = "kind || ':' || first || ':' || last"
    return f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({" UNION ALL ".join(parts)}),
lines AS (
  SELECT doc_id,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign,
         count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg({place}, ',' ORDER BY first, ord) FILTER (WHERE ord < {base}) AS base,
         string_agg({place}, ',' ORDER BY first, ord) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lines USING (doc_id)
"""


ORACLES["op6_secret_scan"] = _scan_sql()

ORACLES["op7_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i+49], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)
),
bad AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM windows)
  WHERE least < doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM bad),
left_over AS (
  SELECT doc_id, count(g.i) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w)
  LEFT JOIN gone g USING (doc_id, i)
  GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""

ORACLES["op10_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i+4], ' ') FOR i IN range(1, len(words) - 3)]) END AS s
  FROM w
),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.least AS component_id
FROM sets s JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON s.doc_id = r.a
"""

ORACLES["op13_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""
