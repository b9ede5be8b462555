"""SQL for DuckDB of the operators whose result SQL can express, over the whole tables."""

from __future__ import annotations

LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (h) WHERE doc_id > least),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM k ANTI JOIN g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 49)) AS i, x FROM d WHERE len(x) >= 100),
h AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least, max(doc_id) AS most FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM h JOIN f USING (h) WHERE doc_id > least),
e AS (SELECT *, sum(CASE WHEN b IS NULL OR i > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM e GROUP BY doc_id, run),
p AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM r UNION ALL SELECT doc_id, 0, min(a) FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(z, len(x) // 2) - a)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce({LOW}, ''), '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

WORDS = rf"regexp_extract_all(coalesce({LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
h AS (SELECT d.doc_id, size, i AS place, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size) d),
m AS (SELECT doc_id, place, h.size, item FROM h JOIN i ON h.s = i.s AND h.size = i.size),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(place, place + size)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda d, y: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, x)), 4294967295::BIGINT) AS crc FROM conversations),
g AS (SELECT conv, turn, xor(crc, 4294967295) % 20 AS draw, role, text FROM o),
h AS (SELECT conv, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE draw WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM g WHERE draw <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos, rtrim(text, E' \t\n\x0b\x0c\r') AS cut FROM h),
f AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY pos) AS before FROM p),
t AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
w AS (SELECT conv, n + 1 AS pos, [{'c': 0::BIGINT, 's': ''}, {'c': 4, 's': 'II'}, {'c': 2, 's': 'I'}, {'c': 0, 's': ''}] AS u FROM t
UNION ALL
SELECT conv, pos, [list_min([b[1], {'c': 2 + v3.c, 's': 'I' || v3.s}]), list_min([b[2], {'c': 2 + v3.c, 's': 'I' || v3.s}]), v3, list_min([b[4], {'c': 2 + b[3].c, 's': 'I' || b[3].s}])]
FROM (SELECT *, list_min([b[3], {'c': 2 + b[4].c, 's': 'I' || b[4].s}]) AS v3 FROM (SELECT f.conv, f.pos, list_transform([1, 2, 3, 4], lambda q: list_min(list_filter([{'c': 3 + u[q].c, 's': 'D' || u[q].s},
CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE {'c': 2 + late + u[[3, 3, 4, 3][q]].c, 's': 'R' || u[[3, 3, 4, 3][q]].s} END,
CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN i = 's' AND q = 1 THEN {'c': late + u[2].c, 's': 'K' || u[2].s} WHEN i = 'u' AND q <> 3 THEN {'c': late + u[3].c, 's': 'K' || u[3].s} WHEN i = 'a' AND q = 3 THEN {'c': late + u[4].c, 's': 'K' || u[4].s} END], lambda x: x IS NOT NULL))) AS b
FROM w JOIN (SELECT *, CAST(fault = 'truncated' AS INT) AS late FROM f) f ON f.conv = w.conv AND f.pos = w.pos - 1))),
a AS (SELECT conv, u[1].c AS cost, u[1].s AS audit FROM w WHERE pos = 1),
l AS (SELECT conv, unnest(string_split(audit, '')) AS x, unnest(range(1, length(audit) + 1)) AS k FROM a WHERE audit <> ''),
m AS (SELECT conv, x, k, sum(CAST(x <> 'I' AS INT)) OVER (PARTITION BY conv ORDER BY k) AS pos FROM l),
y AS (SELECT m.conv, k, x, role, text, row_number() OVER (PARTITION BY m.conv ORDER BY k) AS j, first_value(CASE WHEN x = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv ORDER BY k) AS led FROM m LEFT JOIN f ON f.conv = m.conv AND f.pos = m.pos WHERE x <> 'D'),
z AS (SELECT conv, string_agg(CASE WHEN x = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM y GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM o) LEFT JOIN t USING (conv) LEFT JOIN a USING (conv) LEFT JOIN z USING (conv)"""


def _clustering(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    near = lambda c: f"SELECT v.row, v.x, min({{'d': list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x), 'k': c.k}}) AS m FROM v, {c} c GROUP BY ALL"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS ({near(f'c{i}')})")
        steps.append(f"s{i} AS (SELECT m.k AS k, axis, sum(CAST(e AS BIGINT)) AS s, count(*) AS n FROM (SELECT m, unnest(x) AS e, unnest(range({dim})) AS axis FROM a{i}) GROUP BY ALL)")
        steps.append(f"c{i + 1} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY axis) AS x FROM s{i} GROUP BY k UNION ALL SELECT k, x FROM c{i} ANTI JOIN s{i} USING (k))")
    return f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS (SELECT row_number() OVER (ORDER BY drawn) - 1 AS k, x FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS drawn, x FROM v ORDER BY drawn LIMIT {k})),
{", ".join(steps)},
z AS ({near(f"c{rounds}")}),
i AS (SELECT m.k AS k, sum(m.d) AS d FROM z GROUP BY ALL)
SELECT vec_id, CAST(m.k AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(i.d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM z JOIN v USING (row) JOIN i ON i.k = m.k JOIN c{rounds} c ON c.k = m.k"""


CENTROID_CLUSTERING = _clustering()
