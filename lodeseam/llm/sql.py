"""The queries that SQL can say, for DuckDB on the same tables."""

from __future__ import annotations

from lodeseam.llm.chat_format import BEGIN, END, MIDDLE
from lodeseam.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, template_words

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[0-9a-z\x{80}-\x{10FFFF}]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


_PHRASES = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(template_words(t)))})" for label, t in TEMPLATES)

LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_ALNUM} AS w FROM documents),
places AS (SELECT r, i - 1 AS i, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) AS x, (VALUES {_PHRASES}) AS p(phrase, label, n)
       WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
lines AS (SELECT r, list_distinct(regexp_extract_all(line, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS w FROM (SELECT r, unnest(string_split({_LOWER}, chr(10))) AS line FROM d)),
found AS (SELECT r, label, len(list_intersect(w, own)) / len(own) AS score FROM lines, (VALUES {_TEMPLATES}) AS t(label, own) WHERE len(list_intersect(w, own)) >= {THRESHOLD} * len(own) - 1e-9),
more AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  coalesce(more.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
p AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, i, n, item_id FROM p JOIN k USING (n, k)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

SUBSTRINGS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPACED} AS w FROM documents),
p AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM p) WHERE n > 1),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

_OWN = "\\### Assistant: </turn> ok"


def _escaped(column: str, characters: str) -> str:
    return f"length({column}) + " + " + ".join(f"length({column}) - length(replace({column}, '{c}', ''))" for c in characters)


_FIXED = len(BEGIN) + len(MIDDLE) + len(END)
CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_OWN}'), (-7, 1, 'assistant', '{_OWN}')),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
  sum({_FIXED} + {_escaped('role', '\\#<:')} + {_escaped('text', '\\#<')})::BIGINT AS formatted_chars,
  string_agg(role, ',' ORDER BY turn, role, text) AS roles, arg_min(text, turn) AS first_text FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
  CASE WHEN roles = 'user,assistant' THEN 'prompt' WHEN roles = 'system,user,assistant' AND first_text <> '' THEN 'system_prompt' ELSE 'messages' END AS layout FROM c"""


def url_filters(entries) -> str:
    rows = ", ".join(str(e) for e in entries)
    return rf"""
WITH e AS (SELECT lower(domain) AS domain, since::DATE AS since, max(action) AS action FROM (VALUES {rows}) AS v(domain, action, since) GROUP BY 1, 2),
i AS (SELECT *, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM e),
p AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host, DATE '2024-01-01' + (page_id % 366)::INT AS d FROM pages),
m AS (SELECT page_id, i.*, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS k FROM p JOIN i ON (host = domain OR ends_with(host, '.' || domain)) AND since <= d AND (until IS NULL OR d < until))
SELECT p.page_id, host, domain, action, since::VARCHAR AS since, coalesce(action = 'block', FALSE) AS blocked FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1"""
