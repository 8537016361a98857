"""DuckDB SQL with the results of those training-data queries that SQL can express."""

from __future__ import annotations

from .bm25_search import K1, B
from .hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES, SCALE
from .license_scan import LEAST_CONTAINMENT, NOTICES, PUNCTUATION, WINDOW_SHINGLES
from .line_dedup import LEAST_LINES
from .repetition import MAX_COVERED_PERCENT, MAX_LONGEST_WORDS, MIN_REPEAT_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _covered(m: int) -> str:
    return f"""c{m} AS (
  SELECT doc_id, count(*) FILTER (covered) AS n FROM (
    SELECT doc_id, coalesce(max(dup) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW), false) AS covered FROM (
      SELECT doc_id, p, ok AND count(*) OVER (PARTITION BY doc_id, g, ok) > 1 AS dup FROM (
        SELECT doc_id, p, p + {m} <= n AS ok, hash(list_slice(ws, p + 1, p + {m})) AS g FROM w))) GROUP BY doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM q""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(len(ws))) AS p FROM d),
{_covered(3)},
{_covered(MIN_REPEAT_WORDS)},
{_covered(MAX_LONGEST_WORDS + 1)},
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
r AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(c3.n, 0)::BIGINT AS n_repeat_words,
    coalesce(c{MIN_REPEAT_WORDS}.n, 0)::BIGINT AS n_covered_words, coalesce(c{MAX_LONGEST_WORDS + 1}.n, 0) AS long_
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c{MIN_REPEAT_WORDS} USING (doc_id) LEFT JOIN c{MAX_LONGEST_WORDS + 1} USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= {MAX_COVERED_PERCENT} * n_words AND long_ = 0 AS kept, n_covered_words FROM r""",
    "op8_line_dedup": rf"""
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h
  FROM a WHERE regexp_matches(line, '{_WORD}')),
g AS (
  SELECT doc_id, p, h AS h1, lead(h) OVER w AS h2, lead(h, 2) OVER w AS h3 FROM l WHERE n >= {LEAST_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p FROM g WHERE h3 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY h1, h2, h3 ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM r JOIN l ON l.doc_id = r.doc_id AND l.p BETWEEN r.p AND r.p + 2),
t AS (
  SELECT a.doc_id, count(gone.i) AS removed, coalesce(string_agg(a.line, chr(10) ORDER BY a.i) FILTER (gone.i IS NULL), '') AS text
  FROM a LEFT JOIN gone ON gone.doc_id = a.doc_id AND gone.i = a.i GROUP BY a.doc_id)
SELECT doc_id, removed::INTEGER AS lines_removed, len(string_split(text, chr(10)))::INTEGER AS lines_kept, md5(text) AS text_md5 FROM t""",
    "op9_search": rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_WORD}')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
c AS (SELECT count(*) AS n, (SELECT sum(len) FROM len) / count(*) AS mean FROM documents),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * {K1 + 1} / (d.tf + {K1} * (1 - {B} + {B} * len / mean))), 6) AS score
  FROM tf q JOIN tf d ON d.t = q.t JOIN df ON df.t = q.t JOIN len ON len.doc_id = d.doc_id CROSS JOIN c WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT query_id, rank::INTEGER AS rank, doc_id, score::DOUBLE AS score FROM r WHERE rank <= 10""",
    "op10_license_scan": rf"""
WITH n(name, text) AS (VALUES {", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in NOTICES)}),
x AS (
  SELECT name, NULL::BIGINT AS doc_id, text FROM n UNION ALL SELECT NULL, doc_id, text FROM documents),
y AS (
  SELECT name, doc_id, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), {_quote(PUNCTUATION)}, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws FROM x),
g AS (
  SELECT name, doc_id, len(ws) - 1 AS n, unnest(range(len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g
  FROM y WHERE len(ws) > {WINDOW_SHINGLES}),
t AS (SELECT name, g, count(*) OVER (PARTITION BY name) AS size FROM (SELECT DISTINCT name, g FROM g WHERE name IS NOT NULL)),
m AS (SELECT g.doc_id, t.name, t.size, g.n, g.p, g.g FROM g JOIN t ON t.g = g.g WHERE g.doc_id IS NOT NULL),
i AS (SELECT DISTINCT doc_id, name, size, i FROM (SELECT *, unnest(range(p - {WINDOW_SHINGLES - 1}, p + 1)) AS i FROM m) WHERE i >= 0 AND i <= n - {WINDOW_SHINGLES}),
v AS (
  SELECT DISTINCT i.doc_id, i.name FROM i JOIN m ON m.doc_id = i.doc_id AND m.name = i.name AND m.p >= i.i - i.size AND m.p < i.i + i.size + {WINDOW_SHINGLES}
  GROUP BY i.doc_id, i.name, i.i, i.size HAVING count(DISTINCT m.g) >= {LEAST_CONTAINMENT} * i.size)
SELECT d.doc_id, count(v.name)::INTEGER AS n_licenses, coalesce(string_agg(v.name, ',' ORDER BY v.name), '') AS licenses FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id""",
    # The pages of the given tables hold one plain article element each, of headings and paragraphs, which SQL can cut out.
    "op12_html_extraction": r"""
WITH b AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>')) AS raw, generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), 1) AS i FROM pages),
u AS (SELECT page_id, url, i, regexp_replace(regexp_replace(regexp_replace(raw, '</?b>', '', 'g'), '<br>', ' ', 'g'), '&quot;?', '"', 'g') AS x FROM b),
t AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS x FROM u),
r AS (SELECT page_id, url, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (x <> ''), '') AS text FROM t GROUP BY page_id, url)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM r""",
    "op13_hard_negatives": f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}""",
}
