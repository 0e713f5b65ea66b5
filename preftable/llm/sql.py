"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)
)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

OP10 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(text, '[^!-@\[-`{{-~]', '', 'g')) AS n_other,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w FROM t
), g AS (
  SELECT doc_id, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM f)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), p AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM r) GROUP BY doc_id
), b AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, n_upper, n_lower, n_other,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS n_stutter
  FROM f LEFT JOIN p USING (doc_id)
), c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_upper > 40 * (n_upper + n_lower) OR 100 * n_other > 40 * word_chars
    OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutter > 20 * n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM c
"""

OP7 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

OP8 = """
WITH RECURSIVE c AS (SELECT source, pow(count(*), 0.5) AS p FROM documents GROUP BY source),
s AS (SELECT sum(p) AS t, greatest(1000, ceil(20 * sum(p) / min(p))) AS whole FROM c),
u AS (SELECT source, floor(whole * p / t)::BIGINT AS u FROM c, s),
a AS (SELECT list(u ORDER BY source) AS us, list(source ORDER BY source) AS ss, sum(u)::BIGINT AS w FROM u),
e AS (
  SELECT 0::BIGINT AS t, list_transform(us, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS i, NULL::BIGINT AS j, us, ss, w FROM a
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, k: x + CASE WHEN k = best.i THEN 1 ELSE 0 END), best.i, done[best.i], us, ss, w
  FROM (
    SELECT *, list_min(list_filter(list_transform(done, lambda x, k: CASE WHEN x < us[k] AND x * w // us[k] <= t
      THEN {'d': ((x + 1) * w + us[k] - 1) // us[k], 'i': k} END), lambda y: y IS NOT NULL)) AS best FROM e WHERE t < w
  )
), z AS (SELECT ss[i] AS source, us[i] AS u, w, j, t - 1 AS slot FROM e WHERE i IS NOT NULL),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rn FROM documents)
SELECT doc_id, d.source, rn // 8 AS block, (rn // 8) // z.u * w + z.j * w // z.u AS release,
  (rn // 8) // z.u * w + ((z.j + 1) * w + z.u - 1) // z.u AS deadline, (rn // 8) // z.u * w + z.slot AS slot, rn % 8 AS place
FROM d JOIN z ON d.source = z.source AND (rn // 8) % z.u = z.j
"""

OP3 = rf"""
WITH l AS (
  SELECT doc_id, k - 1 AS line_no, list_distinct(regexp_extract_all(lines[k], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), s AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS o, doc_id, line_no, len(w) AS n, w FROM l WHERE len(w) >= 1),
t AS (SELECT o, n, unnest(w) AS x FROM s),
p AS (
  SELECT a.o AS a, b.o AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b
    ON a.x = b.x AND a.o < b.o AND 80 * greatest(a.n, b.n) <= 100 * least(a.n, b.n) GROUP BY ALL
), m AS (SELECT b, max(k = na AND k = nb) AS exact FROM p WHERE 100 * k >= 80 * (na + nb - k) GROUP BY b)
SELECT doc_id, line_no, exact FROM m JOIN s ON m.b = s.o
"""

OP11 = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
  FROM documents
), d AS (
  SELECT w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS hx FROM runs WHERE length(w) >= 5 GROUP BY doc_id, w
), h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM d, tab
), v AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), g AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM g a JOIN g b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.cut = v.word
  UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.cut = v.word
), q AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN q USING (word)),
r AS (SELECT word, word AS root, form AS ahead FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.ahead = f.word)
SELECT word, f.form, root, f.n, n_near, form_n FROM r JOIN f USING (word) WHERE ahead IS NULL
"""

OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM t),
c AS (
  SELECT doc_id, text, w, len(w)::BIGINT AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a+1:b], '') AS m, array_to_string(w[b+1:n], '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || z) AS restored_sha256
FROM s
"""

ORACLES: dict[str, str] = {
    "op3_lines": OP3,
    "op5_cover_tree": OP5,
    "op7_near_duplicates": OP7,
    "op8_mixing": OP8,
    "op10_quality": OP10,
    "op11_spelling": OP11,
    "op13_infill": OP13,
}
