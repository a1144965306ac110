"""DuckDB SQL for those training-text queries that SQL can express over whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op1_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS g
       FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(p) WHERE len(w) >= size),
hits AS (SELECT doc_id, item_id, p, dw.size FROM dw JOIN iw ON dw.size = iw.size AND dw.g = iw.g),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, size FROM hits), unnest(range(p, p + size)) AS t(q) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

ORACLE["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, host, t, l, i, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw
          FROM (SELECT doc_id, host, t, string_split(t, chr(10)) AS ls FROM d), unnest(ls) WITH ORDINALITY AS x(l, i)),
worded AS (SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS k FROM lines WHERE len(lw) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY doc_id),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS x(p) WHERE len(w) >= 5),
rep AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT q) AS n FROM rep, unnest(range(p, p + 5)) AS x(q) GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
over AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT doc_id) AS n FROM worded GROUP BY host, k) JOIN hosts USING (host) WHERE n >= 10 AND n >= docs * 0.01),
lost AS (SELECT doc_id, sum(len(lw)) AS n FROM worded JOIN over USING (host, k) GROUP BY doc_id),
o AS (SELECT d.doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
      CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
      CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
      FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > n_words * 0.5 OR n_words - n_removed_words < 10) AS kept FROM o
"""

ORACLE["op7_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d, min(page_id) OVER (PARTITION BY b) AS least FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to
FROM q
"""

_ROLE = r"replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c')"
_TEXT = r"replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t')"
ORACLE["op8_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS s,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
      CAST(sum(14 + length({_ROLE}) + length({_TEXT})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(s) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""

ORACLE["op2_jaccard"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 4], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS x(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT i.a, i.b FROM i JOIN n AS x ON x.doc_id = i.a JOIN n AS y ON y.doc_id = i.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM pairs UNION SELECT r.a, pairs.b FROM r JOIN pairs ON r.b = pairs.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
