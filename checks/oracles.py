"""DuckDB SQL for the queries: ``name -> statement``, columns named alike."""

from __future__ import annotations

from checks import params as P


def _words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pairs(mapping: dict) -> str:
    def quote(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join(f"({quote(k)}, {quote(v)})" for k, v in mapping.items())


SPACE = r"\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}"
EMOJI = (
    r"[\x{1F300}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}"
    r"\x{1F000}-\x{1F0FF}\x{E0020}-\x{E007F}\x{FE0F}\x{200D}\x{20E3}]+"
)


def clean(column: str) -> str:
    return rf"regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_{SPACE}]', '', 'g')"


def no_links(column: str) -> str:
    return rf"regexp_replace({column}, '(https?://|www\.)[^{SPACE}]+', ' ', 'g')"


def split(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '[{SPACE}]+'), lambda w: w <> '')"


TOKENS = f"""
docs AS (SELECT doc_id, source, {split(clean('text'))} AS ws FROM documents),
tokens AS (SELECT doc_id, source, unnest(ws) AS term FROM docs),
kept AS (SELECT * FROM tokens WHERE length(term) >= 2 AND term NOT IN ({_words(P.STOP)}))"""

WEEKS = """
base AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type AS topic_name
         FROM events {where})
SELECT w.week_start, t.topic_name, count(b.topic_name) AS count
FROM (SELECT DISTINCT week_start FROM base) w
CROSS JOIN (SELECT DISTINCT topic_name FROM base WHERE topic_name IS NOT NULL) t
LEFT JOIN base b ON b.week_start = w.week_start AND b.topic_name = t.topic_name
GROUP BY ALL"""

_MONTH_OF = {
    "week": "CAST(date_trunc('month', date_trunc('week', o_orderdate)) AS DATE)",
    "calendar": "CAST(date_trunc('month', o_orderdate) AS DATE)",
}


def shares(by: str = "week", where: str = "") -> str:
    """Common table expressions up to ``shares``."""
    return f"""
base AS (SELECT {_MONTH_OF[by]} AS month_start, o_orderpriority AS topic_name FROM orders {where}),
grid AS (
  SELECT m.month_start, t.topic_name, count(b.topic_name) AS count
  FROM (SELECT DISTINCT month_start FROM base) m
  CROSS JOIN (SELECT DISTINCT topic_name FROM base WHERE topic_name IS NOT NULL) t
  LEFT JOIN base b ON b.month_start = m.month_start AND b.topic_name = t.topic_name
  GROUP BY ALL),
totals AS (SELECT *, CAST(sum(count) OVER (PARTITION BY month_start) AS BIGINT) AS total_comments
           FROM grid),
shares AS (SELECT *, CASE WHEN total_comments = 0 THEN 0.0
                          ELSE round_even(count / total_comments * 100, 1) END AS percent
           FROM totals)"""


_SERIES = """
series AS (SELECT topic_name, list(percent ORDER BY month_start) AS y,
                  max(month_start) AS last FROM shares GROUP BY topic_name)"""


def fitted(season: bool) -> str:
    """The search written out: the coarse grid, then each box around the best, by recursion over months."""
    if season:
        begun = """begun AS (SELECT topic_name, y, last, list_sum(y[1:12]) / 12.0::DOUBLE AS m1,
                 list_sum(y[13:24]) / 12.0::DOUBLE AS m2 FROM series)"""
        start = """13 AS i, m1 + shift * (m2 - m1) AS lev, tilt * ((m2 - m1) / 12.0::DOUBLE) AS slope,
         list_transform(y[1:12], lambda v: swing * (v - m1)) AS s"""
        gammas = "(SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS x)"
        moved = "greatest(least({0}, 0.99), 0.01)"
    else:
        begun = "begun AS (SELECT topic_name, y, last, y[1] AS m1, y[2] AS m2 FROM series)"
        start = "2 AS i, m1 + shift * (m2 - m1) AS lev, tilt * (m2 - m1) AS slope, list_transform(range(12), lambda v: 0.0::DOUBLE) AS s"
        gammas = "(SELECT 0.0::DOUBLE AS x)"
        moved = "b.gamma"
    out = [_SERIES, begun, f"""
tried0 AS (SELECT g.*, a.x AS alpha, b.x AS beta, c.x AS gamma, 0.0::DOUBLE AS shift, 1.0::DOUBLE AS tilt,
                  1.0::DOUBLE AS swing
           FROM begun g, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS x) a,
                (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS x) b, {gammas} c),
corners AS (SELECT x.v AS x, y.v AS y, z.v AS z FROM (SELECT unnest([-1, 0, 1])::DOUBLE AS v) x,
            (SELECT unnest([-1, 0, 1])::DOUBLE AS v) y, (SELECT unnest([-1, 0, 1])::DOUBLE AS v) z)"""]
    names = "topic_name, y, last, m1, m2, alpha, beta, gamma, shift, tilt, swing"
    boxes = [size for n in range(7) for size in ((0.1 / 2**n, 0.0), (0.0, 0.5 / 2**n))]
    for r in range(len(boxes) + 1):
        out.append(f"""
fit{r} AS (
  SELECT {names}, {start}, 0.0::DOUBLE AS sse FROM tried{r}
  UNION ALL
  SELECT {names}, i + 1,
         alpha * (y[i] - s[1]) + (1 - alpha) * (lev + slope),
         beta * (alpha * (y[i] - s[1]) + (1 - alpha) * (lev + slope) - lev) + (1 - beta) * slope,
         list_concat(s[2:12], [{"gamma * (y[i] - (lev + slope)) + (1 - gamma) * s[1]" if season else "0.0::DOUBLE"}]),
         sse + (y[i] - (lev + slope + s[1])) * (y[i] - (lev + slope + s[1]))
  FROM fit{r} WHERE i <= len(y)),
best{r} AS MATERIALIZED (SELECT * FROM fit{r} WHERE i = len(y) + 1 QUALIFY row_number() OVER (
  PARTITION BY topic_name ORDER BY round(sse, 9), alpha, beta, gamma, shift, tilt, swing) = 1)""")
        if r < len(boxes):
            a, b = boxes[r]
            out.append(f"""
tried{r + 1} AS (SELECT topic_name, b.y, last, m1, m2,
  greatest(least(round(alpha + c.x * {a}::DOUBLE, 6), 0.99), 0.01) AS alpha,
  greatest(least(round(beta + c.y * {a}::DOUBLE, 6), 0.99), 0.01) AS beta,
  {moved.format(f"round(gamma + c.z * {a}::DOUBLE, 6)")} AS gamma,
  round(shift + c.x * {b}::DOUBLE, 6) AS shift, round(tilt + c.y * {b}::DOUBLE, 6) AS tilt,
  {f"round(swing + c.z * {b}::DOUBLE, 6)" if season else "b.swing"} AS swing
  FROM best{r} b, corners c)""")
    out.append(f"""
ahead AS (SELECT topic_name, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS month_start,
                 round_even(lev + h * slope + s[h], 1) AS percent
          FROM best{len(boxes)}, (SELECT unnest(range(1, 4)) AS h))""")
    return ",".join(out)


TREND_FIT, SEASON_FIT = fitted(False), fitted(True)

CONVERSATION = """
posts AS (SELECT 'g' || (conv_id % 3) AS group_domain, conv_id AS post_id,
                 TIMESTAMP '2024-01-01' + to_hours(conv_id) AS post_date,
                 CASE role WHEN 'user' THEN 1 ELSE 2 END AS from_id, text
          FROM conversations WHERE turn = 0),
answers AS (SELECT p.group_domain, p.post_id, p.post_date, c.turn AS comment_id,
                   CASE c.role WHEN 'user' THEN 1 ELSE 2 END AS from_id, c.text,
                   p.post_date + to_minutes(c.turn) AS comment_date
            FROM conversations c JOIN posts p ON p.post_id = c.conv_id
            WHERE c.turn > 0 AND coalesce(c.text, '') <> ''),
flat AS (SELECT group_domain, post_id, post_date, CAST(NULL AS BIGINT) AS comment_id, from_id,
                coalesce(text, '') AS text, CAST(NULL AS TIMESTAMP) AS comment_date FROM posts
         UNION ALL SELECT * FROM answers)"""

FLAT_OUT = """SELECT group_domain, post_id, strftime(post_date, '%Y-%m-%d %H:%M:%S') AS post_date,
comment_id, CAST(from_id AS BIGINT) AS from_id, text,
strftime(comment_date, '%Y-%m-%d %H:%M:%S') AS comment_date FROM flat"""

def some_without(name: str) -> str:
    """The column, null for about one value in sixteen."""
    return f"CASE WHEN left(md5(CAST({name} AS VARCHAR)), 1) <> '0' THEN {name} END"


def feed_rows(low: str | None = None, high: str | None = None) -> str:
    """The nested feed's posts, comments and flat rows, with dates within the bounds where given.

    Every seventh comment has no date, and lies outside any bounds.
    """
    posts = f"WHERE post_date BETWEEN TIMESTAMP '{low}' AND TIMESTAMP '{high}'" if low else ""
    answers = f"AND comment_date <= TIMESTAMP '{high}'" if low else ""
    return f"""
dated AS (SELECT source AS group_domain, doc_id AS post_id, n_chars AS from_id, lang, text,
                 TIMESTAMP '2024-01-01' + to_hours(doc_id % 1000) AS post_date FROM documents),
posts AS (SELECT * FROM dated {posts}),
cut AS (SELECT *, string_split(text, chr(10)) AS ls FROM posts),
lines AS (SELECT group_domain, post_id, post_date, unnest(ls) AS line,
                 unnest(range(len(ls))) AS i FROM cut),
answers AS (SELECT group_domain, post_id, post_date, i + 1 AS comment_id,
                   CASE WHEN i % 9 <> 8 THEN post_id + i END AS from_id, line AS text,
                   CASE WHEN i % 7 <> 6 THEN post_date + to_minutes(i) END AS comment_date
            FROM lines
            WHERE line <> '' {answers}),
flat AS (SELECT group_domain, post_id, post_date, CAST(NULL AS BIGINT) AS comment_id, from_id,
                lang AS text, CAST(NULL AS TIMESTAMP) AS comment_date FROM posts
         UNION ALL SELECT * FROM answers)"""


FEED = feed_rows(*P.FEED_RANGE)
WHOLE_FEED = feed_rows()


def term_counts(scale: str = "") -> str:
    return f"""WITH {TOKENS},
counts AS (SELECT source, term, count(*) AS n FROM kept GROUP BY ALL),
mean AS (SELECT sum(n) / count(DISTINCT source) AS a FROM counts),
everywhere AS (SELECT term, sum(n) AS f FROM counts GROUP BY term),
sizes AS (SELECT source, sum(n) AS words FROM counts GROUP BY source),
weighed AS (SELECT c.source, c.term, round(c.n * ln(1 + a / f){scale}, 9) AS weight
            FROM counts c JOIN everywhere e USING (term) JOIN sizes s USING (source), mean),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank
           FROM weighed)"""

_LABELLED = """SELECT d.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
ELSE 'neutral' END AS label FROM documents d JOIN labels USING (doc_id)"""

BAYES = f"""WITH l AS ({_LABELLED}),
seen AS (SELECT label, unnest({split(clean('text'))}) AS w FROM l WHERE text IS NOT NULL),
counts AS (SELECT label, w, count(*) AS n FROM seen GROUP BY ALL),
vocabulary AS (SELECT DISTINCT w FROM counts),
labels AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM l WHERE text IS NOT NULL GROUP BY label),
sizes AS (SELECT label, prior, coalesce((SELECT sum(n) FROM counts c WHERE c.label = labels.label), 0)
          + (SELECT count(*) FROM vocabulary) AS n FROM labels),
docs AS (SELECT doc_id, unnest({split(clean("coalesce(text, '')"))}) AS w FROM documents),
known AS (SELECT doc_id, w, count(*) AS tf FROM docs JOIN vocabulary USING (w) GROUP BY ALL),
summed AS (SELECT k.doc_id, s.label, sum(tf * ln((coalesce(c.n, 0) + 1) / s.n)) AS s
           FROM known k, sizes s LEFT JOIN counts c ON c.label = s.label AND c.w = k.w GROUP BY ALL),
scored AS (SELECT d.doc_id, z.label, round(z.prior + coalesce(m.s, 0), 9) AS score
           FROM documents d, sizes z LEFT JOIN summed m ON m.doc_id = d.doc_id AND m.label = z.label)
SELECT doc_id, label, round(score, 4) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1"""

LATEST = """WITH v AS (SELECT event_id // 3 AS key, CASE WHEN event_id % 11 <> 0 THEN event_id % 5 END AS version,
  event_id, event_type AS topic_name FROM events)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC NULLS LAST, event_id DESC) = 1"""

_E_RANGE = f"ts >= TIMESTAMP '{P.EVENT_RANGE[0]}' AND ts < TIMESTAMP '2024-01-22'"
_C_RANGE = f"ts BETWEEN TIMESTAMP '{P.COMMENT_RANGE[0]}' AND TIMESTAMP '{P.COMMENT_RANGE[1]}'"
_RUNS = f"""runs AS (SELECT event_id, event_type AS topic_name FROM events WHERE ts < TIMESTAMP '2024-01-22'
UNION ALL SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '{P.EVENT_RANGE[0]}')"""


def wrap(mode: str) -> str:
    """Words numbered, joined in lines of five, lines joined with breaks."""
    lines = f"""WITH docs AS (SELECT doc_id, text, {split('text')} AS ws FROM documents),
cut AS (SELECT doc_id, text, len(ws) AS n,
        list_transform(range(0, len(ws), 5), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) AS ls
        FROM docs)"""
    if mode == "clean":
        wrapped = "array_to_string(ls, '<br>')"
    else:
        # full lines with words after them, a break, then the rest if there is one
        wrapped = """array_to_string(ls[1:greatest(len(ls) - 1, 0)], '<br>') || '<br>' ||
            CASE WHEN n % 5 <> 0 THEN ls[len(ls)] || '<br>' ELSE '' END"""
    return f"""{lines} SELECT doc_id, CASE WHEN contains(text, '<br>') THEN text
ELSE {wrapped} END AS label FROM cut"""


def density(dims: int, tables: int, bits: int, m: int, threshold: float, min_size: int) -> str:
    """Rows compared in the cells of several tables, dense rows, what they connect by recursion."""
    cube = "((131 * i + 977 * j + 7) * (131 * i + 977 * j + 7) % 1000003) * (131 * i + 977 * j + 7) % 1000003"
    return f"""WITH RECURSIVE
dims AS (SELECT vec_id, unnest(range({dims})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
planes AS (SELECT i, t, k, CASE WHEN ({cube}) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign
           FROM (SELECT i, t, k, 60 * t + k AS j FROM (SELECT unnest(range({dims})) AS i),
                 (SELECT unnest(range({tables})) AS t), (SELECT unnest(range({bits})) AS k))),
sides AS (SELECT vec_id, t, k, sum(x * sign) > 0 AS above FROM dims JOIN planes USING (i) GROUP BY ALL),
points AS MATERIALIZED (
  SELECT vec_id, t, CAST(sum(CASE WHEN above THEN 1 << k ELSE 0 END) AS BIGINT) AS cell
  FROM sides GROUP BY vec_id, t),
norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dims GROUP BY vec_id),
units AS (SELECT vec_id, list(x / n ORDER BY i) AS u FROM dims JOIN norms USING (vec_id) GROUP BY vec_id),
same AS (SELECT a.t, a.cell, a.vec_id AS a, b.vec_id AS b FROM points a JOIN points b USING (t, cell)),
close AS (SELECT a, b, round(list_inner_product(x.u, y.u), 9) AS c
          FROM (SELECT DISTINCT a, b FROM same) s JOIN units x ON x.vec_id = a JOIN units y ON y.vec_id = b),
near AS MATERIALIZED (SELECT t, cell, a, b, c FROM same JOIN close USING (a, b) WHERE c >= {threshold}),
dense_in AS (SELECT t, cell, a FROM near GROUP BY ALL HAVING count(*) >= {m}),
dense AS (SELECT DISTINCT a FROM dense_in),
touch AS MATERIALIZED (SELECT n.a, n.b, max(c) AS c FROM near n
          JOIN dense_in d ON d.t = n.t AND d.cell = n.cell AND d.a = n.b GROUP BY ALL),
hung AS (SELECT a, b FROM touch WHERE a IN (SELECT a FROM dense)),
links AS MATERIALIZED (SELECT a, b FROM hung UNION SELECT b, a FROM hung),
walk AS (SELECT a AS root, a AS point FROM dense
         UNION SELECT w.root, l.b FROM walk w JOIN links l ON l.a = w.point),
roots AS (SELECT point, min(root) AS root FROM walk GROUP BY point),
border AS (SELECT t.a AS point, r.root,
                  row_number() OVER (PARTITION BY t.a ORDER BY t.c DESC, r.root) AS k
           FROM touch t JOIN roots r ON r.point = t.b WHERE t.a NOT IN (SELECT a FROM dense)),
placed AS (SELECT point, root FROM roots UNION ALL SELECT point, root FROM border WHERE k = 1),
groups AS (SELECT root, count(*) AS size, min(point) AS first_key
           FROM placed GROUP BY root HAVING count(*) >= {min_size}),
numbered AS (SELECT root, row_number() OVER (ORDER BY size DESC, first_key) - 1 AS topic FROM groups)
SELECT vec_id, CAST(coalesce(topic, -1) AS BIGINT) AS topic FROM embeddings
LEFT JOIN placed ON point = vec_id LEFT JOIN numbered USING (root)"""


def kmeans(dims: int, count: int, rounds: int, threshold: float, seed: int) -> str:
    """Every round of assignment and mean written out; rounds after the fixed point change nothing."""
    steps = []
    for r in range(rounds):
        steps.append(f"""
near{r} AS MATERIALIZED (SELECT vec_id, u, k FROM units, centres{r} QUALIFY row_number() OVER (
  PARTITION BY vec_id ORDER BY round(list_inner_product(u, c), 9) DESC, k) = 1),
sums{r} AS (SELECT k, i, sum(x) AS x FROM
            (SELECT k, unnest(u) AS x, unnest(range({dims})) AS i FROM near{r}) GROUP BY k, i),
means{r} AS (SELECT k, list(x ORDER BY i) AS m, sqrt(sum(x * x)) AS n FROM sums{r} GROUP BY k),
centres{r + 1} AS MATERIALIZED (
  SELECT o.k, CASE WHEN n > 0 THEN list_transform(m, lambda x: round(x / n, 9)) ELSE o.c END AS c
  FROM centres{r} o LEFT JOIN means{r} USING (k))""")
    return f"""WITH
norms AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
          FROM embeddings),
units AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / n) AS u,
                       md5('{seed}/' || vec_id) AS h FROM norms WHERE n > 0),
chosen AS (SELECT u, min(h) AS h FROM units GROUP BY u ORDER BY 2 LIMIT {count}),
centres0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k,
                          list_transform(u, lambda x: round(x, 9)) AS c FROM chosen),{",".join(steps)},
scored AS (SELECT vec_id, k, round(list_inner_product(u, c), 9) AS s FROM units, centres{rounds}
           QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) = 1),
kept AS (SELECT vec_id, CASE WHEN s >= {threshold} THEN k END AS k FROM scored),
groups AS (SELECT k, count(*) AS size, min(vec_id) AS first_key FROM kept WHERE k IS NOT NULL GROUP BY k),
numbered AS (SELECT k, row_number() OVER (ORDER BY size DESC, first_key) - 1 AS topic FROM groups)
SELECT vec_id, CAST(coalesce(topic, -1) AS BIGINT) AS topic FROM kept LEFT JOIN numbered USING (k)"""


ORACLES: dict[str, str] = {
    "weekly_topic_counts": "WITH " + WEEKS.format(where=""),
    "stream_weekly_counts": """SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start,
event_type AS topic_name, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY ALL""",
    "date_range_filter": f"SELECT event_id, event_type AS topic_name FROM events WHERE {_E_RANGE}",
    "date_range_open_end": f"""SELECT event_id, event_type AS topic_name FROM events
WHERE ts >= TIMESTAMP '{P.EVENT_RANGE[0]}' AND ts < TIMESTAMP '{P.EVENT_RANGE[1]}'""",
    "week_keys": """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year,
strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' ||
strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start FROM orders""",
    "monthly_topic_share": f"WITH {shares()} SELECT * FROM shares",
    "monthly_share_calendar": f"WITH {shares('calendar')} SELECT * FROM shares",
    "yearly_topic_counts": """SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
o_orderpriority AS topic_name, count(*) AS count FROM orders GROUP BY ALL""",
    "yearly_top3": """WITH c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
o_orderpriority AS topic_name, count(*) AS count FROM orders GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY year ORDER BY count DESC, topic_name) AS rank FROM c
QUALIFY rank <= 3""",
    "yearly_label_share": """WITH c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
CASE o_orderstatus WHEN 'O' THEN 'Позитивный' WHEN 'F' THEN 'Негативный'
WHEN 'P' THEN 'Нейтральный' END AS label, count(*) AS count FROM orders GROUP BY ALL)
SELECT *, round(count / sum(count) OVER (PARTITION BY year), 6) AS share FROM c""",
    "label_recode": f"""SELECT m.name, count(*) AS count
FROM events JOIN (VALUES {_pairs(P.EVENT_NAMES)}) m(kind, name) ON kind = event_type GROUP BY ALL""",
    "topic_filter": """SELECT event_id, event_type AS topic_name, value FROM events
WHERE event_type IN ('click', 'error')""",
    "topic_names": "SELECT DISTINCT event_type AS topic_name FROM events ORDER BY 1",
    "time_bounds": "SELECT min(ts) AS min_date, max(ts) AS max_date FROM events",
    "latest_month": f"SELECT max({_MONTH_OF['week']}) AS month_start FROM orders",
    "flatten_posts_comments": f"WITH {CONVERSATION} {FLAT_OUT}",
    "bad_groups": """WITH counted AS (SELECT source AS group_domain, count(*) AS lines,
  count(*) FILTER (WHERE doc_id % 13 = 5) AS bad FROM documents GROUP BY source)
SELECT 'batch' AS mode, *, bad = 0 AS kept FROM counted UNION ALL SELECT 'stream', *, true FROM counted""",
    "readable_posts": """WITH good AS (SELECT doc_id AS id FROM documents WHERE doc_id % 13 <> 5),
whole AS (SELECT doc_id AS id FROM documents WHERE source NOT IN (
  SELECT source FROM documents WHERE doc_id % 13 = 5))
SELECT 'batch' AS mode, 'line' AS rule, id FROM good UNION ALL SELECT 'batch', 'group', id FROM whole
UNION ALL SELECT 'stream', 'line', id FROM good""",
    "latest_rows": LATEST,
    "latest_rows_stream": LATEST,
    "csv_store": f"WITH {CONVERSATION} {FLAT_OUT}",
    "group_store": f"""WITH {CONVERSATION},
twice AS (SELECT group_domain FROM flat UNION ALL SELECT group_domain FROM flat)
SELECT group_domain, count(*) AS count FROM twice GROUP BY ROLLUP (group_domain)""",
    "flatten_nested_feed": f"WITH {FEED} {FLAT_OUT}",
    "feed_files": f"WITH {WHOLE_FEED} {FLAT_OUT}",
    "stream_ingest": f"WITH {WHOLE_FEED} {FLAT_OUT}",
    "comment_window": f"""SELECT user_id AS group_domain, count(*) AS count FROM events
WHERE {_C_RANGE} GROUP BY ALL""",
    "take_while_window": f"""WITH r AS (SELECT *, max(CASE WHEN ts < TIMESTAMP '{P.COMMENT_RANGE[0]}'
THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value DESC, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM events)
SELECT user_id AS group_domain, event_id FROM r WHERE stopped = 0 AND {_C_RANGE}""",
    "post_cap": f"""SELECT {some_without("user_id")} AS group_domain, event_id FROM events
WHERE {_C_RANGE}
QUALIFY row_number() OVER (PARTITION BY {some_without("user_id")} ORDER BY event_id) <= {P.POST_CAP}""",
    "comment_cap": f"""SELECT 'g' || (conv_id % 3) AS group_domain, conv_id AS post_id, turn
FROM conversations WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)
QUALIFY row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn) <= {P.COMMENT_CAP}""",
    "comment_cap_nested": f"""WITH {WHOLE_FEED},
named AS (SELECT {some_without("group_domain")} AS group_domain, post_id, comment_id FROM answers),
capped AS (SELECT group_domain, post_id, comment_id FROM named
QUALIFY row_number() OVER (PARTITION BY group_domain ORDER BY post_id, comment_id)
  <= {P.NESTED_COMMENT_CAP})
SELECT {some_without("group_domain")} AS group_domain, post_id, CAST(NULL AS BIGINT) AS comment_id
FROM posts
UNION ALL SELECT * FROM capped""",
    "post_batches": f"""WITH g AS (SELECT {some_without("user_id")} AS group_domain, event_id FROM events),
n AS (SELECT group_domain, event_id,
row_number() OVER (PARTITION BY group_domain ORDER BY event_id) AS number FROM g)
SELECT *, CAST(ceil(number / 10) AS BIGINT) AS batch FROM n""",
    "epoch_format": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events",
    "rows_per_group": """SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL
GROUP BY ROLLUP (source)""",
    "append_union": f"WITH {_RUNS} SELECT event_id, count(*) AS copies FROM runs GROUP BY ALL",
    "append_dedup": f"WITH {_RUNS} SELECT DISTINCT event_id, topic_name FROM runs",
    "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
    "strip_links": f"SELECT page_id, {no_links('html')} AS text FROM pages",
    "strip_emojis": f"""WITH signs AS (SELECT [{_words(P.EMOJI)}] AS e),
given AS (SELECT doc_id, substr(text, 1, CAST(length(text) // 2 AS INTEGER)) || e[doc_id % {len(P.EMOJI)} + 1]
          || substr(text, CAST(length(text) // 2 AS INTEGER) + 1) || e[(doc_id + 1) % {len(P.EMOJI)} + 1] || 'end' AS text
          FROM documents, signs)
SELECT doc_id, regexp_replace(text, '{EMOJI}', ' ', 'g') AS text FROM given""",
    "group_list": """WITH g AS (SELECT source AS group_domain, count(*) AS posts FROM documents GROUP BY source)
SELECT group_domain, 2 AS listed, posts FROM g WHERE length(group_domain) % 2 = 0
UNION ALL SELECT 'nobody', count(*), NULL FROM g WHERE length(group_domain) % 2 = 0""",
    "lenient_dates": """WITH w AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS s FROM orders),
t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN s WHEN 1 THEN s[1:10] WHEN 2 THEN s[1:8] || '31 10:00:00'
             WHEN 3 THEN 'on ' || s END AS s FROM w)
SELECT o_orderkey, strftime(try_cast(s AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS stamp FROM t""",
    "strict_dates": """SELECT o_orderkey, strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S') AS stamp
FROM orders""",
    "stored_answers": """SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN text END AS name FROM conversations""",
    "report_yearly_top": """WITH c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
o_orderpriority AS topic_name, count(*) AS count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY year ORDER BY count DESC, topic_name) AS rank FROM c
QUALIFY rank <= 3""",
    "report_yearly_labels": """WITH c AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
CASE o_orderstatus WHEN 'O' THEN 'Позитивный' WHEN 'F' THEN 'Негативный'
WHEN 'P' THEN 'Нейтральный' END AS label, count(*) AS count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY ALL)
SELECT *, round(count / sum(count) OVER (PARTITION BY year), 6) AS share FROM c""",
    "report_topic_words": rf"""WITH {TOKENS},
counts AS (SELECT 'src3' AS asked, term, count(*) AS count FROM kept
           WHERE source = 'src3' AND NOT regexp_full_match(term, '\p{{Nd}}+') GROUP BY ALL)
SELECT *, round(count / max(count) OVER (), 6) AS frequency FROM counts
QUALIFY row_number() OVER (ORDER BY count DESC, term) <= 200""",
    "report_topic_comments": """SELECT 'src3' AS asked, text FROM documents WHERE source = 'src3'
ORDER BY doc_id LIMIT 20""",
    "remove_stopwords": f"""SELECT doc_id, array_to_string(list_filter({split(clean('text'))},
lambda w: w NOT IN ({_words(P.STOP)})), ' ') AS text FROM documents""",
    "prepare_text": f"""SELECT doc_id, array_to_string(list_filter(
{split(clean(f"regexp_replace({no_links('text')}, '{EMOJI}', ' ', 'g')"))},
lambda w: w NOT IN ({_words(P.STOP)})), ' ') AS text_preprocessed FROM documents""",
    "lemmatize": f"""WITH dict(form, lemma) AS (VALUES {_pairs(P.LEMMAS)}),
docs AS (SELECT doc_id, {split(clean('text'))} AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
found AS (SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS lemmas
          FROM placed LEFT JOIN dict ON form = w GROUP BY doc_id)
SELECT doc_id, coalesce(lemmas, '') AS lemmas FROM docs LEFT JOIN found USING (doc_id)""",
    "lexicon_sentiment": f"""WITH lex(word, s) AS (VALUES {_pairs(P.SCORES)}),
docs AS (SELECT doc_id, {split(clean('text'))} AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS w FROM docs),
sums AS (SELECT doc_id, sum(s) AS s FROM placed JOIN lex ON word = w GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(s, 0) AS BIGINT) AS score,
CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS label
FROM docs LEFT JOIN sums USING (doc_id)""",
    "bayes_sentiment": BAYES,
    "bayes_sentiment_joined": BAYES,
    "full_run_labels": f"""WITH {WHOLE_FEED},
prepared AS (SELECT concat_ws('/', group_domain, post_id::VARCHAR, coalesce(comment_id::VARCHAR, '')) AS row_id,
  list_filter({split(clean(f"regexp_replace({no_links('text')}, '{EMOJI}', ' ', 'g')"))},
              lambda w: w NOT IN ({_words(P.STOP)})) AS ws FROM flat),
scored AS (SELECT row_id, array_to_string(ws, ' ') AS text_preprocessed,
  list_sum(list_transform(ws, lambda w: CASE w {" ".join(f"WHEN '{w}' THEN {n}" for w, n in P.RUN_SCORES.items())}
                                        ELSE 0 END)) AS s
  FROM prepared)
SELECT row_id, coalesce(text_preprocessed, '') AS text_preprocessed,
CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS label FROM scored""",
    "label_wrap_exact": wrap("exact"),
    "label_wrap_clean": wrap("clean"),
    "series_name": "SELECT doc_id, replace(text, ', ', ' - ') AS name FROM documents",
    "negative_rows": f"""WITH l AS ({_LABELLED})
SELECT doc_id, {clean('text')} AS cleaned FROM l WHERE label = 'negative' AND text IS NOT NULL""",
    "tfidf": f"""WITH {TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM kept GROUP BY ALL),
total AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), total
      WHERE df >= 10 AND df <= 0.9 * n),
lengths AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id)
SELECT doc_id, term, round(w / l, 6) AS weight FROM w JOIN lengths USING (doc_id)""",
    "topic_word_freq": rf"""WITH {TOKENS},
counts AS (SELECT source, term, count(*) AS count FROM kept
           WHERE NOT regexp_full_match(term, '\p{{Nd}}+') GROUP BY ALL)
SELECT *, round(count / max(count) OVER (PARTITION BY source), 6) AS frequency FROM counts
QUALIFY row_number() OVER (PARTITION BY source ORDER BY count DESC, term) <= 200""",
    "topic_phrase_freq": rf"""WITH {TOKENS},
plain AS (SELECT source, list_filter(ws, lambda w: length(w) >= 2
          AND NOT regexp_full_match(w, '\p{{Nd}}+')) AS ws FROM docs),
placed AS (SELECT source, ws[i] AS a, ws[i + 1] AS b
           FROM (SELECT source, ws, unnest(range(1, len(ws))) AS i FROM plain)),
pairs AS (SELECT source, a, b, count(*) AS n12 FROM placed
          WHERE a NOT IN ({_words(P.STOP)}) AND b NOT IN ({_words(P.STOP)}) GROUP BY ALL),
words AS (SELECT source, term, count(*) AS n FROM kept
          WHERE NOT regexp_full_match(term, '\p{{Nd}}+') GROUP BY ALL),
totals AS (SELECT source, sum(n) AS t FROM words GROUP BY source),
joined AS (SELECT p.*, x.n::DOUBLE AS c1, y.n::DOUBLE AS c2, t::DOUBLE AS t FROM pairs p
           JOIN words x ON x.source = p.source AND x.term = a
           JOIN words y ON y.source = p.source AND y.term = b JOIN totals s ON s.source = p.source),
chance AS (SELECT *, greatest(c2 / t, 1e-10) AS p, greatest(1 - c2 / t, 1e-10) AS q,
                  greatest(n12 / c1, 1e-10) AS p1, greatest(1 - n12 / c1, 1e-10) AS q1,
                  greatest((c2 - n12) / (t - c1), 1e-10) AS p2,
                  greatest(1 - (c2 - n12) / (t - c1), 1e-10) AS q2 FROM joined WHERE t > c1 AND t > c2),
phrases AS (SELECT source, a, b, n12 FROM chance
            WHERE -2 * (ln(p) * n12 + ln(q) * (c1 - n12) + ln(p) * (c2 - n12)
                        + ln(q) * (t - c1 - c2 + n12) - ln(p1) * n12 - ln(q1) * (c1 - n12)
                        - ln(p2) * (c2 - n12) - ln(q2) * (t - c1 - c2 + n12)) > 30),
taken AS (SELECT source, w, sum(n12) AS n FROM (SELECT source, unnest([a, b]) AS w, n12 FROM phrases)
          GROUP BY ALL),
left_over AS (SELECT w.source, w.term, w.n - coalesce(k.n, 0) AS n FROM words w
              LEFT JOIN taken k ON k.source = w.source AND k.w = w.term),
final AS (SELECT source, term, n FROM left_over WHERE n > 0
          UNION ALL SELECT source, a || ' ' || b, n12 FROM phrases)
SELECT source, term, CAST(n AS BIGINT) AS count,
       round(n / max(n) OVER (PARTITION BY source), 6) AS frequency FROM final
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, term) <= 200""",
    "topic_terms": f"""{term_counts()}
SELECT source, rank, term, round(weight, 6) AS weight FROM ranked WHERE rank <= 10""",
    "topic_terms_normalised": f"""{term_counts(' / words')}
SELECT source, rank, term, round(weight, 6) AS weight FROM ranked WHERE rank <= 30""",
    "topic_word_line": f"""{term_counts()}
SELECT source, string_agg(term, ' | ' ORDER BY rank) AS line FROM ranked WHERE rank <= 10 GROUP BY source""",
    "topic_names_auto": f"""{term_counts()}
SELECT source, string_agg(term, ' ' ORDER BY rank) AS topic_name FROM ranked WHERE rank <= 4
GROUP BY source""",
    "named_rows": """WITH r AS (SELECT vec_id, CAST(CASE label WHEN 8 THEN -1 WHEN 9 THEN 46
ELSE label END AS BIGINT) AS topic FROM embeddings)
SELECT vec_id, topic, CASE WHEN topic BETWEEN 0 AND 45
THEN 'topic of ' || count(*) OVER (PARTITION BY topic) END AS topic_name FROM r""",
    "topic_comments": """SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id)
AS position, doc_id, text FROM documents QUALIFY position <= 20""",
    "one_topic_comments": """SELECT doc_id, text FROM documents WHERE source = 'src3'
ORDER BY doc_id LIMIT 20""",
    "assign_centroid": f"""WITH dims AS (SELECT vec_id, label, unnest(range({P.DIMS})) AS i,
unnest(embedding)::DOUBLE AS x FROM embeddings),
cent AS (SELECT label, i, avg(x) AS c FROM dims GROUP BY ALL),
cn AS (SELECT label, sqrt(sum(c * c)) AS n FROM cent GROUP BY label),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM dims GROUP BY vec_id),
s AS (SELECT d.vec_id, c.label, round(sum(x * c) / (any_value(vn.n) * any_value(cn.n)), 9) AS s
      FROM dims d JOIN cent c USING (i) JOIN cn ON cn.label = c.label JOIN vn ON vn.vec_id = d.vec_id
      GROUP BY d.vec_id, c.label)
SELECT vec_id, CAST(CASE WHEN s >= 0.3 THEN label ELSE -1 END AS BIGINT) AS topic,
round(s, 6) AS closeness FROM s
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""",
    "density_topics": density(P.DIMS, P.TABLES, P.BITS, 5, P.CLOSE, 10),
    "kmeans_topics": kmeans(P.DIMS, 10, 20, 0.3, 7),
    "forecast_trend": f"WITH RECURSIVE {shares()}, {TREND_FIT} SELECT * FROM ahead",
    "forecast_seasonal": f"WITH RECURSIVE {shares()}, {SEASON_FIT} SELECT * FROM ahead",
    "series_last_value": f"""WITH {shares()} SELECT topic_name,
arg_max(percent, month_start) AS last_value FROM shares GROUP BY topic_name""",
    "share_with_forecast": f"""WITH RECURSIVE {shares()}, {SEASON_FIT}
SELECT month_start, topic_name, count, total_comments, percent, 'актуальный' AS data_type FROM shares
UNION ALL SELECT month_start, topic_name, NULL, NULL, percent, 'прогноз' FROM ahead""",
    "report_weekly": "WITH "
    + WEEKS.format(where=f"WHERE {_E_RANGE} AND event_type IN ('click', 'view')"),
    "report_monthly": f"""WITH RECURSIVE {shares(where='''WHERE o_orderdate >= TIMESTAMP '1996-01-01'
AND o_orderdate < TIMESTAMP '2001-01-01' ''')}, {SEASON_FIT},
both_kinds AS (
SELECT month_start, topic_name, count, total_comments, percent, 'актуальный' AS data_type FROM shares
UNION ALL SELECT month_start, topic_name, NULL, NULL, percent, 'прогноз' FROM ahead)
SELECT *, replace(topic_name, ', ', ' - ') AS series FROM both_kinds""",
}

for _name in ("lemmatize", "lexicon_sentiment"):
    ORACLES[f"{_name}_joined"] = (
        f"WITH once AS ({ORACLES[_name]}) SELECT * FROM once UNION ALL SELECT * FROM once"
    )
