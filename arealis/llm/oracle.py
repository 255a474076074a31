"""SQL for the rows of those queries that SQL can express, in DuckDB's dialect."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_REACH = "reach AS (SELECT {id}, {id} AS c FROM node UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.{id}), root AS (SELECT {id}, min(c) AS component_id FROM reach GROUP BY 1)"

OP1 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages), h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((instr('0123456789abcdef', substr(h, CAST(1 + (5 * i) // 4 AS BIGINT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, CAST(2 + (5 * i) // 4 AS BIGINT), 1)) - 1) >> (3 - (5 * i) % 4)) & 31 AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

OP2 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents), p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS first FROM p GROUP BY 1), c AS (SELECT DISTINCT doc_id, i + j AS pos FROM p JOIN m USING (k), range(13) AS t(j) WHERE first < doc_id), r AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)"""

OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2), e AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
link AS (SELECT a, b FROM e UNION SELECT b, a FROM e), node AS (SELECT doc_id FROM documents), {_REACH.format(id="doc_id")}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM root LEFT JOIN z USING (doc_id)"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP6 = f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents), t AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
q AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM t WHERE len(ws) > 0)), z AS (SELECT DISTINCT size FROM q),
p AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, z)), f AS (SELECT doc_id, p.size, i, item FROM p JOIN q ON p.k = q.k AND p.size = q.size),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM f, range(10) AS r(j) WHERE j < size GROUP BY 1), l AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM f GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)"""

OP7 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95), link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), node AS (SELECT vec_id FROM v),
{_REACH.format(id="vec_id")}, n AS (SELECT a, count(*) AS n FROM link GROUP BY 1) SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM root LEFT JOIN n ON a = vec_id"""

_ITEM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ITEM}) AS ws FROM documents), t AS (SELECT r, unnest(ws) AS term FROM d), i AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, {_ITEM})) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY 1, 2), s AS (SELECT count(*) AS docs, coalesce(sum(len(ws)), 0)::BIGINT AS terms FROM d WHERE len(ws) > 0), f AS (SELECT r, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY 1, 2),
v AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs), m AS (SELECT r, doc_id, 25 + (75 * len(ws)::HUGEINT * docs) // terms AS m FROM d, s WHERE len(ws) > 0),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN v USING (term) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10"""

_LETTERS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, {_LETTERS}) AS ws FROM documents), t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10), c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3), v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d), s AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS BIGINT) AS q FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
e AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
UNION ALL SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o QUALIFY part = 'pair' OR rank <= 10"""
