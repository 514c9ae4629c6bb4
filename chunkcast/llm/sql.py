"""DuckDB twins of the queries that SQL can express.

Verdicts, scores and token ids come from models and tokenizers, so op1, op2, op4, op8, op9, op10 and the
pipeline have none; they are tested against slow versions, held-out labels and the library itself.
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT rid, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) END)) AS sh FROM d
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, edges.y FROM reach JOIN edges ON edges.x = reach.b),
least AS (SELECT a, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id
FROM d JOIN least ON least.a = d.rid LEFT JOIN n ON n.rid = d.rid
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h)) AS owner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM d
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT rid, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), edges AS (
  SELECT a.rid AS x, b.rid AS y FROM u a JOIN u b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (SELECT rid, rid FROM v UNION SELECT reach.a, edges.y FROM reach JOIN edges ON edges.x = reach.b),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY a),
n AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least ON least.a = v.rid LEFT JOIN n ON n.x = v.rid
"""

_ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT rid, size, k, array_to_string(w[k:k + size - 1], ' ') AS t
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)
), h AS (SELECT rid, k, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.t = iw.t),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS p FROM h) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

#: A window is named by its 35 words; it counts for its words if it starts in two places.
OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT rid, k, array_to_string(w[k:k + 34], ' ') AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)
), r AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY t) AS c FROM v) WHERE c > 1),
gone AS (SELECT rid, list(DISTINCT p) AS g FROM (SELECT rid, unnest(range(k, k + 35)) AS p FROM r) GROUP BY rid),
words AS (SELECT rid, p, w[p] AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT words.rid, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN (SELECT rid, unnest(g) AS p FROM gone) o ON o.rid = words.rid AND o.p = words.p
  WHERE o.p IS NULL GROUP BY words.rid
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

ORACLES = {"op3_jaccard_join": OP3, "op5_warc": OP5, "op6_embedding_dedup": OP6, "op7_decontamination": OP7, "op13_substring_dedup": OP13}
