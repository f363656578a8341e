"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from corvane.llm.secret_scan import BASE, KINDS

_WORDS = "list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(words: str, size: int) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < {size} THEN [array_to_string({words}, ' ')] ELSE list_distinct(list_transform(range(1, len({words}) - {size - 2}), lambda i: array_to_string({words}[i:i + {size - 1}], ' '))) END"


OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text='text')} AS ws FROM documents),
g AS (SELECT doc_id, {_shingles('ws', 4)} AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS sh FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN g gx ON gx.doc_id = x JOIN g gy ON gy.doc_id = y WHERE 100 * c >= 85 * (len(gx.gs) + len(gy.gs) - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT g.doc_id, CAST(len(g.gs) AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM g JOIN r ON r.doc_id = g.doc_id GROUP BY g.doc_id, len(g.gs)
"""


def _kind(number: int) -> str:
    kind, pattern, group, least, _ = KINDS[number]
    quoted = pattern.replace("'", "''")
    return f"""SELECT rid, {number} AS no, '{kind}' AS kind, before + gaps AS b, before + gaps + length(whole) AS e, value FROM (
 SELECT rid, whole, value, coalesce(sum(length(whole)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(gap)) OVER (PARTITION BY rid ORDER BY i) AS gaps FROM (
  SELECT rid, unnest(range(len(m))) AS i, unnest(m) AS whole, unnest(v) AS value, unnest(g[1:len(m)]) AS gap FROM (
   SELECT rid, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v, string_split_regex(t, '{quoted}') AS g FROM d) WHERE len(m) > 0))
WHERE length(value) >= {least}"""


_COUNTS = ", ".join(f"count(*) FILTER (WHERE no = {i}) AS n_{KINDS[i][0]}" for i in range(BASE))
OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS repo, coalesce(text, '') AS t FROM documents),
c AS ({' UNION ALL '.join(_kind(i) for i in range(len(KINDS)))}),
o AS (SELECT value, count(DISTINCT split_part(repo, '/', 1)) AS owners FROM c JOIN d USING (rid) GROUP BY value),
j AS (SELECT c.*, owners > 2 AS copied, len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS varied FROM c JOIN o USING (value)),
a AS (SELECT rid, {_COUNTS}, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, no) FILTER (WHERE no < {BASE}) AS base, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, no) AS spans, count(*) FILTER (WHERE NOT copied AND varied) AS n_live, count(*) FILTER (WHERE copied) AS n_copied FROM j GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{KINDS[i][0]}, 0) AS n_{KINDS[i][0]}' for i in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN a USING (rid)
"""

OP6_LINES = f"""
WITH RECURSIVE q AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS l FROM q),
v AS (SELECT doc_id, line, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, length(l) AS n, {_WORDS.format(text='l')} AS ws FROM u),
g AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, CAST(b AS BIGINT) AS "start", CAST(b + n AS BIGINT) AS "end", CAST(len(ws) AS BIGINT) AS n_words, {_shingles('ws', 5)} AS gs FROM v WHERE len(ws) >= 20),
s AS (SELECT id, unnest(gs) AS sh FROM g),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN g gx ON gx.id = x JOIN g gy ON gy.id = y WHERE 100 * c >= 80 * (len(gx.gs) + len(gy.gs) - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(id, reach) AS (SELECT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.reach = e.x),
k AS (SELECT id, min(reach) AS first FROM r GROUP BY id)
SELECT g.doc_id, 'line' AS kind, g.line, g."start", g."end", g.n_words, f.doc_id AS class_doc_id, f.line AS class_line, g.id <> f.id AS removed FROM k JOIN g USING (id) JOIN g f ON f.id = k.first
"""

#: Passages: words with their places, windows of 50 words, the least document of each, and runs of windows.
_GAP = "[\\x20\\x09-\\x0D]+"
OP6_PASSAGES = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (SELECT DISTINCT doc_id, text FROM documents)),
c AS (SELECT rid, doc_id, unnest(string_split_regex(t, '{_GAP}')) AS word, unnest(list_concat([''], regexp_extract_all(t, '{_GAP}'))) AS gap, unnest(range(len(regexp_extract_all(t, '{_GAP}')) + 1)) AS i FROM t),
p AS (SELECT rid, doc_id, word, i, sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY i) AS e FROM c),
w AS (SELECT rid, word, e - length(word) AS b, e, row_number() OVER (PARTITION BY rid ORDER BY i) AS place FROM p WHERE word <> ''),
l AS (SELECT rid, doc_id, {_WORDS.format(text='t')} AS ws FROM t),
x AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 48)) AS place, unnest(list_transform(range(1, len(ws) - 48), lambda i: array_to_string(ws[i:i + 49], ' '))) AS win FROM l WHERE len(ws) >= 50),
o AS (SELECT win, min(doc_id) AS first FROM x GROUP BY win HAVING min(doc_id) <> max(doc_id)),
j AS (SELECT rid, doc_id, place, first, doc_id <> first AS removed FROM x JOIN o USING (win)),
k AS (SELECT *, coalesce(CAST(place - lag(place) OVER (PARTITION BY rid, removed ORDER BY place) > 50 AS INT), 1) AS begins FROM j),
r AS (SELECT *, sum(begins) OVER (PARTITION BY rid, removed ORDER BY place) AS run FROM k),
m AS (SELECT rid, doc_id, removed, min(place) AS a, max(place) + 49 AS z, min(first) AS first FROM r GROUP BY rid, doc_id, removed, run)
SELECT m.doc_id, 'passage' AS kind, CAST(NULL AS BIGINT) AS line, CAST(f.b AS BIGINT) AS "start", CAST(g.e AS BIGINT) AS "end", z - a + 1 AS n_words, first AS class_doc_id, CAST(NULL AS BIGINT) AS class_line, removed FROM m JOIN w f ON f.rid = m.rid AND f.place = m.a JOIN w g ON g.rid = m.rid AND g.place = m.z
"""
OP6 = f"SELECT * FROM ({OP6_LINES}) UNION ALL SELECT * FROM ({OP6_PASSAGES})"

OP8 = f"""
WITH a AS (SELECT DISTINCT doc_id, {_WORDS.format(text='text')} AS ws FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS.format(text='text')} AS ws FROM benchmark),
d AS (SELECT doc_id, unnest({_shingles('ws', 5)}) AS sh FROM a),
i AS (SELECT item_id, {_shingles('ws', 5)} AS gs FROM b),
s AS (SELECT item_id, len(gs) AS q, unnest(gs) AS sh FROM i)
SELECT doc_id, item_id, count(*) AS n_shared, q AS n_shingles FROM d JOIN s USING (sh) GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 80 * q
"""
