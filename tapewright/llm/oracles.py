"""SQL for DuckDB of the queries that SQL can express on whole small tables."""

from __future__ import annotations

import re

from tapewright.llm.exact_dedup import _LOWER, _UPPER
from tapewright.llm.licenses import CONTAINED, SHINGLE, SPDX, TAG, TEMPLATES


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.x = y.x AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n c ON c.doc_id = p.a JOIN n d ON d.doc_id = p.b
  WHERE 100 * shared >= 85 * (c.n + d.n - shared)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1) m USING (doc_id)
"""

OP2 = f"""
WITH t AS (SELECT doc_id, {_lower("coalesce(text, '')")} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

OP4 = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w AS after,
    5 + length(role) + 1 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 9 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, (before, role) NOT IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS bad FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  coalesce(arg_min(concat(role, ' after ', before, ' at ', CAST(n AS VARCHAR)), n) FILTER (bad), max(concat('ends with ', role)) FILTER (after IS NULL AND role NOT IN ('user', 'assistant'))) AS problem
FROM p GROUP BY 1
"""


def _template_rows() -> str:
    rows = []
    for name, texts in TEMPLATES.items():
        for k, text in enumerate(texts):
            words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
            shingles = sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
            rows += [f"('{name}', '{name}-{k}', {len(words)}, {len(shingles)}, '{s}')" for s in shingles]
    return ", ".join(rows)


OP8 = f"""
WITH t(license, template, size, many, x) AS (VALUES {_template_rows()}),
w AS (SELECT row_number() OVER () AS r, doc_id, text, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[^a-z0-9]+'), lambda s: s <> '') AS w FROM documents),
s AS (SELECT r, len(w) AS words, i - 1 AS pos, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {SHINGLE} + 2)) AS i FROM w WHERE len(w) >= {SHINGLE})),
m AS (SELECT r, words, pos, license, template, size, many, x, size // 2 AS step FROM s JOIN t USING (x)),
v AS (SELECT *, unnest(range(greatest(0, pos + {SHINGLE} - size - step), pos + 1)) AS start FROM m),
f AS (SELECT r, license FROM v WHERE start % step = 0 AND start <= greatest(words - size, 0) AND pos >= start AND pos + {SHINGLE} <= start + size + step
  GROUP BY r, license, template, many, start HAVING count(DISTINCT x) >= {CONTAINED} * many
  UNION ALL SELECT r, license FROM (SELECT r, rtrim(unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '{TAG}', 1)), '.-') AS tag FROM w) JOIN (VALUES {", ".join(str(x) for x in SPDX.items())}) AS names(tag, license) USING (tag))
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses FROM w LEFT JOIN (SELECT r, count(DISTINCT license) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM f GROUP BY 1) USING (r)
"""

_WORDS = rf"regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS x FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT list(DISTINCT k) AS ks FROM win),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT r, w, unnest((SELECT ks FROM sizes)) AS k FROM d))),
hit AS (SELECT r, i, k, item FROM dw JOIN win USING (k, x)),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP13 = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT row_number() OVER () AS r, page_id, {_lower("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(rule_host, rule_path, verdict)),
fits AS (SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON ends_with('.' || host, '.' || rule_host) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits USING (r)
"""
