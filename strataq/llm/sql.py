"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op7_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(w, '[^\s]')),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM n WHERE k > 1),
x AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END::BIGINT AS n_lines, coalesce(x.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN x.n IS NULL THEN text ELSE array_to_string([l[k] FOR k IN range(1, len(l) + 1) IF NOT list_contains(x.gone, k)], chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

ORACLE_SQL["op8_decontamination"] = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
p AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
b AS (SELECT id, w, least(10, len(w)) AS n FROM p WHERE kind = 'b' AND len(w) > 0),
bw AS (SELECT DISTINCT id AS item, n, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
z AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT id, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM p, z WHERE kind = 'd' AND len(w) >= n)),
h AS (SELECT id, dw.n, i, item FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
c AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM h) GROUP BY id),
s AS (SELECT id, list_sort(list(DISTINCT item::VARCHAR)) AS items FROM h GROUP BY id)
SELECT p.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM p LEFT JOIN c ON p.id = c.id LEFT JOIN s ON p.id = s.id WHERE kind = 'd'
"""

ORACLE_SQL["op9_minhash_near_dedup"] = r"""
WITH RECURSIVE p AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS i FROM p WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS least FROM e UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node WHERE r.least < e.b),
m AS (SELECT node, min(least) AS least FROM r GROUP BY node)
SELECT p.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, p.doc_id) AS component_id, coalesce(m.least, p.doc_id) = p.doc_id AS kept
FROM p LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = p.doc_id
"""

ORACLE_SQL["op6_token_counts"] = r"""
WITH d AS (SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n1, coalesce(len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 0) AS n2 FROM documents)
SELECT source, lang, 'words-2' AS tokenizer, count(*)::BIGINT AS n_docs, sum(n2)::BIGINT AS n_tokens FROM d WHERE lang = 'en' GROUP BY 1, 2
UNION ALL
SELECT source, lang, 'words-1', count(*)::BIGINT, sum(n1)::BIGINT FROM d WHERE (lang IS NULL OR lang <> 'en') AND n2 >= 20 GROUP BY 1, 2
"""

ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || x[1:8])::BIGINT % (n + 1) AS a, ('0x' || x[9:16])::BIGINT % (n + 1) AS b, ('0x' || x[17:24])::BIGINT % 100 AS c, ('0x' || x[25:32])::BIGINT % 100 AS s FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, low) AS pre, substring(t, low + 1, high - low) AS mid, substring(t, high + 1, n - high) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""

ORACLE_SQL["op13_source_audit"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
gp AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) AS p
  FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
lp AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (c.n + 1)) // (l.n + v.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) c JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM c GROUP BY lang) l ON l.lang = c.lang JOIN v ON v.lang = c.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT gp.lang, gp.source, 'term', gp.term, (((p - q) * (p - q)) // q)::BIGINT FROM gp JOIN lp ON gp.lang = lp.lang AND gp.term = lp.term WHERE gp.n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o QUALIFY part = 'pair' OR rank <= 200
"""
