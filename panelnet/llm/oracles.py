"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from panelnet.llm.chat import CONTROLS, END, TEXT, TURN

_SPACE = r"[\x20\x09-\x0D]"


def _escaped(column: str) -> str:
    sql = rf"replace({column}, '\', '\\')"
    for c in CONTROLS:
        sql = rf"replace({sql}, '{c}', '{c[0]}\{c[1:]}')"
    return sql


_MARKS = len(TURN) + len(TEXT) + len(END)
_TOLD = "'</s>[INST] ok [/INST]'"

OP2 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), bare AS (
  SELECT doc_id, pos, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), cum AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM bare WHERE n > 0
), win AS (
  SELECT doc_id, pos AS b, max(pos) OVER w AS e, sum(n) OVER w AS words, string_agg(line, chr(10)) OVER w AS content FROM cum
  WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), full_ AS (SELECT * FROM win WHERE words >= 50),
placed AS (
  SELECT *, first_value(doc_id) OVER o AS d0, first_value(e) OVER o AS e0 FROM full_ WINDOW o AS (PARTITION BY content ORDER BY doc_id, b ROWS UNBOUNDED PRECEDING)
), gone AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS pos FROM placed WHERE doc_id > d0 OR b > e0)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text, count(*) AS n, count(g.pos) AS removed
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
) k ON k.doc_id = d.doc_id
"""

OP7 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS fine FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.fine AND b.fine AND list_cosine_similarity(a.x, b.x) >= 0.98
), reach(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) r ON r.id = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.vec_id
"""

OP9 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {_TOLD}), (-7, 1, 'assistant', {_TOLD})
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped('role')}) + length({_escaped('text')}) + {_MARKS})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
