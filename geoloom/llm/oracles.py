"""SQL that gives the same rows as a query, where SQL can say it.

The other queries rest on models or parsers that SQL has no words for; tests
compare those with brute force or with held-out labels.
"""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS k FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 80 * (x.n + y.n - o.o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

#: The exponent is bisected to the last bit by a recursive query, and each source's last pass is cut by a running sum.
OP7 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce(source, '') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS n_tokens FROM documents),
src AS (SELECT key, sum(n_tokens)::DOUBLE AS tokens FROM t GROUP BY key HAVING sum(n_tokens) > 0),
p AS (SELECT key, tokens, tokens / (SELECT sum(tokens) FROM src) AS p FROM src),
ent(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT log2(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * log2(p)) / sum(pow(p, (lo + hi) / 2)) FROM p)
        >= 0.999 * log2((SELECT count(*) FROM p)) - 1e-12 AS good FROM ent WHERE i < 60)),
full_ok AS (SELECT (SELECT log2(sum(p)) - sum(p * log2(p)) / sum(p) FROM p) >= 0.999 * log2((SELECT count(*) FROM p)) - 1e-12 AS ok),
a1 AS (SELECT CASE WHEN (SELECT ok FROM full_ok) OR (SELECT count(*) FROM p) < 2 THEN 1.0 ELSE max(lo) END AS alpha FROM ent WHERE i = 60),
rep(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT max(pow(p, -(lo + hi) / 2)) / sum(pow(p, 1 - (lo + hi) / 2)) FROM p) <= 4 * (1 + 1e-12) AS good FROM rep WHERE i < 60)),
rep_ok AS (SELECT (SELECT max(1 / p) / count(*) FROM p) <= 4 * (1 + 1e-12) AS ok),
a AS (SELECT greatest((SELECT alpha FROM a1), 1 - CASE WHEN (SELECT ok FROM rep_ok) THEN 1.0 ELSE max(lo) END) AS alpha FROM rep WHERE i = 60),
w AS (SELECT key, tokens::BIGINT AS tokens, floor(round((SELECT sum(tokens) FROM p) * pow(p, alpha) / (SELECT sum(pow(p, alpha)) FROM p, a), 6))::BIGINT AS granted FROM p, a),
d AS (SELECT t.*, w.granted // w.tokens AS passes, w.granted % w.tokens AS rest FROM t JOIN w USING (key)),
placed AS (SELECT *, ('0x' || substr(md5('17:' || passes || ':' || coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS last_place FROM d),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY key ORDER BY last_place RANGE UNBOUNDED PRECEDING) AS upto FROM placed),
taken AS (SELECT doc_id, source, n_tokens, passes + CASE WHEN n_tokens > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM run),
rows_ AS (SELECT doc_id, source, n_tokens, unnest(range(0, times)) AS epoch FROM taken)
SELECT doc_id, source, epoch, ('0x' || substr(md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS place, n_tokens FROM rows_
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_jaccard": OP5, "op7_source_mixing": OP7, "op8_substring_dedup": OP8}
