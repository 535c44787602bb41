"""DuckDB SQL that gives the same rows as the registered corpus queries."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS sh FROM d
), classes AS (
  SELECT min(doc_id) AS cid, list_sort(sh) AS sh, len(sh) AS n FROM s GROUP BY list_sort(sh), len(sh)
), x AS (
  SELECT cid, n, md5_number_lower(unnest(sh)) AS h FROM classes WHERE n > 0
), f AS (
  SELECT h FROM x GROUP BY h HAVING count(*) > 1
), common AS (
  SELECT a.cid AS a, b.cid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM x a JOIN f USING (h) JOIN x b ON a.h = b.h AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.cid, b.cid
), links AS (
  SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)
), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS root, b AS node FROM e UNION SELECT r.root, e.b FROM reach r JOIN e ON e.a = r.node
), comp AS (
  SELECT node, least(min(root), node) AS c FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
  CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE coalesce(comp.c, classes.cid) END AS component_id,
  s.doc_id = CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE coalesce(comp.c, classes.cid) END AS kept
FROM s JOIN classes ON list_sort(s.sh) = classes.sh LEFT JOIN comp ON comp.node = classes.cid
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORDS}'), []) AS w FROM documents
), b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), p AS (
  SELECT item, m, array_to_string(w[i:i+m-1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), t AS (
  SELECT r, m, i, array_to_string(w[i:i+m-1], ' ') AS s
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), hits AS (
  SELECT DISTINCT t.r, t.i, t.m, p.item FROM t JOIN p USING (m, s)
), n AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS x FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN items USING (r)
"""

OP7 = r"""
WITH s AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM s
), li AS (
  SELECT doc_id, line_no, trim(line) AS h, len(regexp_extract_all(line, '\S+')) AS w,
    row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, sum(len(regexp_extract_all(line, '\S+'))) OVER (PARTITION BY doc_id ORDER BY line_no) AS c
  FROM l WHERE regexp_matches(line, '\S')
), spans AS (
  SELECT a.doc_id, a.i, b.i AS j FROM li a ASOF JOIN li b ON a.doc_id = b.doc_id AND a.c - a.w + 50 <= b.c
), passages AS (
  SELECT p.doc_id, p.i, string_agg(x.h, chr(10) ORDER BY x.i) AS passage
  FROM spans p JOIN li x ON x.doc_id = p.doc_id AND x.i BETWEEN p.i AND p.j GROUP BY p.doc_id, p.i
), firsts AS (
  SELECT passage, min((doc_id, i)) AS f FROM passages GROUP BY passage HAVING count(*) > 1
), pairs AS (
  SELECT doc_id, struct_extract(f, 1) AS other, i - struct_extract(f, 2) AS shift, i FROM passages JOIN firsts USING (passage) WHERE (doc_id, i) > f
), equal AS (
  SELECT g.*, a.i, a.line_no FROM (SELECT DISTINCT doc_id, other, shift FROM pairs) g JOIN li a ON a.doc_id = g.doc_id JOIN li b ON b.doc_id = g.other AND b.i = a.i - g.shift AND b.h = a.h
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS run FROM equal
), runs AS (
  SELECT doc_id, other, shift, min(i) AS low, max(i) AS high, min(line_no) AS a, max(line_no) AS b FROM islands GROUP BY doc_id, other, shift, run
), cuts AS (
  SELECT DISTINCT r.doc_id, r.a, r.b FROM runs r JOIN pairs p ON p.doc_id = r.doc_id AND p.other = r.other AND p.shift = r.shift AND p.i BETWEEN r.low AND r.high
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n FROM l
  WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.doc_id = l.doc_id AND l.line_no BETWEEN c.a AND c.b) GROUP BY doc_id
), whole AS (
  SELECT s.doc_id, len(lines) AS total, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS n FROM s LEFT JOIN kept USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(total - n AS BIGINT) AS n_dropped, length(text) AS n_chars, sha256(text) AS text_sha256 FROM whole
"""

SECRET_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM d
"""

LICENSE_BASE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORDS}'), []) AS w FROM documents
), p AS (
  SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i:i+1] = ['mit', 'license']) AS mit, list_filter(range(1, len(w) + 1), lambda i: w[i:i+1] = ['apache', 'license']) AS apache,
    list_filter(range(1, len(w) + 1), lambda i: w[i:i+2] = ['general', 'public', 'license']) AS gpl FROM d
), a AS (
  SELECT *, list_sort(list_concat(mit, apache, gpl)) AS places FROM p
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, places[1] - 1 AS first_word, places[-1] - 1 AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM a
"""

OP13 = rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM t
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS phrase FROM w, range(1, 5) AS ks(k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30
), x AS (
  SELECT lang, k, f, string_split(phrase, ' ') AS q FROM f WHERE k > 2
), inside AS (
  SELECT lang, array_to_string(q[i:i+m-1], ' ') AS phrase, max(f) AS within FROM x, range(2, 4) AS ms(m), range(1, 4) AS js(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), c AS (
  SELECT f.lang, f.phrase, f.k, f.f AS a, string_split(f.phrase, ' ') AS q FROM f LEFT JOIN inside USING (lang, phrase)
  WHERE f.k > 1 AND (within IS NULL OR 100 * within < 80 * f.f)
), cuts AS (
  SELECT lang, phrase, a, i, array_to_string(q[1:i], ' ') AS first, array_to_string(q[i+1:k], ' ') AS rest FROM c, range(1, 4) AS js(i) WHERE i < k
), scored AS (
  SELECT cuts.*, p.f AS l, s.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (p.f + s.f) AS BIGINT) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = first JOIN f s ON s.lang = cuts.lang AND s.phrase = rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op13_collocations": OP13, "secret_base_counts": SECRET_BASE, "license_base_places": LICENSE_BASE, "op3_decontaminate": OP3, "op4_near_dedup": OP4, "op7_line_dedup": OP7}
