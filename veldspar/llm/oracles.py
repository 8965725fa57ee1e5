"""SQL of operators that SQL can express, for tables small enough to compare all windows or pairs."""

#: Names of 2, 4, .. 256 bytes from each position on, doubled; 256, 128 and 16 make a window of 400.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
     h2 AS (SELECT doc_id, b, [hash(b[i], b[i + 1]) for i in range(1, len(b))] AS x FROM d),
     h4 AS (SELECT doc_id, b, [hash(x[i], x[i + 2]) for i in range(1, len(x) - 1)] AS x FROM h2),
     h8 AS (SELECT doc_id, b, [hash(x[i], x[i + 4]) for i in range(1, len(x) - 3)] AS x FROM h4),
     h16 AS (SELECT doc_id, b, [hash(x[i], x[i + 8]) for i in range(1, len(x) - 7)] AS x FROM h8),
     h32 AS (SELECT doc_id, b, x AS x16, [hash(x[i], x[i + 16]) for i in range(1, len(x) - 15)] AS x FROM h16),
     h64 AS (SELECT doc_id, b, x16, [hash(x[i], x[i + 32]) for i in range(1, len(x) - 31)] AS x FROM h32),
     h128 AS (SELECT doc_id, b, x16, [hash(x[i], x[i + 64]) for i in range(1, len(x) - 63)] AS x FROM h64),
     h256 AS (SELECT doc_id, b, x16, x AS x128, [hash(x[i], x[i + 128]) for i in range(1, len(x) - 127)] AS x FROM h128),
     w AS (SELECT row_number() OVER () AS r, doc_id, b, [hash(x[i], x128[i + 256], x16[i + 384]) for i in range(1, len(b) - 398)] AS g FROM h256),
     starts AS (SELECT r, unnest(g) AS g, unnest(range(len(g))) AS s FROM w WHERE len(g) > 0),
     hit AS (SELECT r, s FROM starts WHERE g IN (SELECT g FROM starts GROUP BY g HAVING count(*) > 1)),
     runs AS (SELECT r, s, s - coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1000) AS step FROM hit),
     spans AS (SELECT r, min(s) AS first, max(s) + 400 AS beyond FROM (SELECT r, s, sum((step > 400)::INT) OVER (PARTITION BY r ORDER BY s) AS k FROM runs) GROUP BY r, k),
     gone AS (SELECT r, sum(beyond - first) AS n_removed, count(*) AS n_spans, list({'a': first, 'z': beyond} ORDER BY first) AS l FROM spans GROUP BY r),
     kept AS (SELECT w.r, doc_id, len(b) AS n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
              CASE WHEN l IS NULL THEN array_to_string(b, '') ELSE array_to_string(flatten([b[(CASE WHEN i = 0 THEN 0 ELSE l[i].z END) + 1:CASE WHEN i = len(l) THEN len(b) ELSE l[i + 1].a END] for i in range(len(l) + 1)]), '') END AS t
              FROM w LEFT JOIN gone ON w.r = gone.r)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256 FROM kept
"""

OP3_SQL = r"""
WITH RECURSIVE
     v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
     u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
     links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND x.norm > 0 AND y.norm > 0 AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
     reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id)
"""

OP4_SQL = r"""
WITH RECURSIVE
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest([hash(w[i + 1:i + 5]) for i in range(greatest(1, len(w) - 4))]) AS g FROM d WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     pairs AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
     links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     starts AS (SELECT doc_id, unnest([hash(w[i + 1:i + 20]) for i in range(len(w) - 19)]) AS g, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
     windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM starts),
     gone AS (SELECT DISTINCT doc_id, s + i AS p FROM windows, (SELECT unnest(range(20)) AS i) WHERE n > 1),
     spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (NOT follows) AS n_spans
               FROM (SELECT doc_id, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) = 1, false) AS follows FROM gone) GROUP BY doc_id),
     words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
