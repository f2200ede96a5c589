"""DuckDB SQL for the queries of :mod:`stowage.llm.queries` that SQL can express.

The others are tested against brute force: op2 (pieces), op3 (a trained
model), op5 (trees of templates), op7 (spans of terms), op8 (image files) and
op10 (a trained model); see tests/llm.
"""

from __future__ import annotations

from .chat import CONTROL, END, START

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g
  FROM w WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (
  SELECT DISTINCT a AS doc_id, a AS c FROM l
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""


def _escaped(text: str) -> str:
    out = rf"replace({text}, '\', '\\')"
    for c in CONTROL:
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


OP4 = rf"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END)} + length({_escaped('text')}) + length(replace({_escaped('role')}, chr(10), chr(92) || chr(10))))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id, alone
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
l AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM l
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_words(_ALNUM)} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_words(_ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (
  SELECT DISTINCT item, g, len(g) AS n FROM (
    SELECT item, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda j: w[j:j+9]) END) AS g FROM i WHERE len(w) > 0
  )
),
sizes AS (SELECT DISTINCT n FROM v),
g AS (
  SELECT k, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes WHERE len(w) >= n
),
h AS (SELECT g.k, g.p, g.n, v.item FROM (SELECT k, p, n, w[p:p+n-1] AS x FROM g) g JOIN v ON v.g = g.x),
pos AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM h) GROUP BY k),
it AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN it USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1, "op4_chat_format": OP4, "op6_warc": OP6, "op9_decontamination": OP9}
