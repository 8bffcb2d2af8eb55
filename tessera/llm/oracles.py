"""DuckDB SQL for the queries that SQL expresses; the others are held against brute force in tests."""

from __future__ import annotations

from .chat import CONTROLS
from .urls import RULES, TRACKING

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[s:s + least(10, len(w)) - 1] AS win FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

FITS = {h + p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in RULES}
BY_LENGTH = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
CANONICAL = f"""CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
 || CASE WHEN len(args) > 0 THEN '?' || array_to_string(list_sort(args), '&') ELSE '' END END"""
OP2 = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
 list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')) AS args FROM u),
c AS (SELECT page_id, host, path, {CANONICAL} AS url FROM p),
listed AS (SELECT DISTINCT url, TRUE AS inside FROM c WHERE page_id % 100 = 0 AND url IS NOT NULL),
j AS (SELECT page_id, host, path, CASE {' '.join(f"WHEN {FITS[h + p]} THEN '{h + p}'" for h, p, _ in BY_LENGTH)} END AS rule,
 CASE {' '.join(f"WHEN {FITS[h + p]} THEN '{v}'" for h, p, v in BY_LENGTH)} END AS said, coalesce(inside, FALSE) AS listed FROM c LEFT JOIN listed USING (url))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j
"""

SOLID = r"[^\x20\x09-\x0D]"
OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SOLID}+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SOLID}') GROUP BY 1),
win AS (SELECT doc_id, s, w[s:s + 2] AS g FROM d, unnest(range(1, len(w) - 1)) x(s)),
again AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM win JOIN again USING (doc_id, g)) GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (10 * n_dup_lines > 6 * n_lines)::INT
 + 16 * (n_words > 0 AND word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f
"""

CONTROL = "|".join("".join("\\" + c if c in "[]" else c for c in s) for s in CONTROLS)
ESCAPED = "(length(replace(t, '\\', '\\\\')) + len(regexp_extract_all(replace(t, '\\', '\\\\'), '{}')))".format(CONTROL)
OP9 = f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {ESCAPED} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 16 + length(role) + 2 * len(regexp_extract_all(role, '[%<>\\[\\]\\\\]')) END AS size FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(3 + sum(size) AS BIGINT) AS formatted_chars FROM e GROUP BY 1
"""

SYMBOLS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 10 * g}, 10))::BIGINT >> {35 - 5 * s}) & 31)::INT + 1, 1)" for g in range(4) for s in range(8))
OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), x AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {SYMBOLS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM x
"""

ORACLES = {"op1_decontaminate": OP1, "op2_url_filter": OP2, "op3_quality_rules": OP3, "op9_chat_format": OP9, "op10_warc": OP10}
