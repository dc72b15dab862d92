"""SQL that the training-data queries must agree with."""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
),
lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d
),
lw AS (
  SELECT doc_id, l, i, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws,
    row_number() OVER (PARTITION BY doc_id, l ORDER BY i) AS nth FROM lines
),
judged AS (
  SELECT doc_id, len(ws) AS n, nth,
    10 * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 3 * len(ws) AS symbols,
    len(list_filter(ws, lambda x: x IN ('|', '»', '«', '›', '·', '•', '/', '>', '<'))) AS bars,
    length(regexp_replace(l, '[^\p{Lu}]', '', 'g')) AS capitals,
    length(regexp_replace(l, '[^\p{L}]', '', 'g')) AS letters,
    regexp_matches(l, '[.!?…:;。！？]["''”’»)\]]*[\x20\x09-\x0D]*$') AS line_end,
    regexp_matches(l, '[.!?…:;。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)') AS word_end,
    regexp_matches(lower(l), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|click here|sign up|log in|subscribe to|share this|javascript|copyright|©|licensed under|released under') AS phrase
  FROM lw WHERE len(ws) > 0
),
per AS (
  SELECT doc_id, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS dup,
    sum(CASE WHEN bad THEN n ELSE 0 END) AS lost, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS removed
  FROM (SELECT *, symbols OR (bars >= 2 AND 5 * bars >= n) OR (letters >= 10 AND 10 * capitals >= 8 * letters)
      OR (NOT line_end AND (n < 10 OR NOT word_end)) OR phrase AS bad FROM judged)
  GROUP BY doc_id
),
grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
),
base AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(r, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(removed, 0) AS removed
  FROM w LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 30 * n_words AS kept,
  CAST(removed AS BIGINT) AS n_lines_removed, CAST(lost AS BIGINT) AS n_words_removed
FROM base
"""

OP2_SQL = r"""
WITH low AS (
  SELECT item_id, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
),
iw AS (SELECT DISTINCT item_id, text, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM low WHERE t IS NOT NULL),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL
),
ir AS (
  SELECT DISTINCT item_id, text, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS run
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM iw WHERE len(ws) > 0)
),
dr AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS run
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM dw WHERE len(ws) > 0)
),
n AS (SELECT item_id, text, count(*) AS n_runs FROM ir GROUP BY ALL),
shared AS (SELECT doc_id, item_id, text, count(*) AS n_shared FROM ir JOIN dr USING (run) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_runs AS BIGINT) AS n_runs
FROM shared JOIN n USING (item_id, text) WHERE n_shared >= 0.8 * n_runs
"""

OP7_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END) AS run
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM dw WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM edges
  UNION
  SELECT r.doc_id, edges.b FROM reach r JOIN edges ON r.other = edges.a
),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, dw.doc_id) AS component_id,
  dw.doc_id = coalesce(component_id, dw.doc_id) AS kept
FROM dw LEFT JOIN n ON n.doc_id = dw.doc_id LEFT JOIN comp ON comp.doc_id = dw.doc_id
"""

OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL
),
same AS (
  SELECT *, len(ws) AS n, min(doc_id) OVER (PARTITION BY ws) AS lo, max(doc_id) OVER (PARTITION BY ws) AS hi FROM dw
),
win AS (
  SELECT doc_id, s, hash(ws[s + 1:s + 50]) AS h
  FROM (SELECT doc_id, ws, unnest(range(0, n - 49)) AS s FROM same WHERE doc_id = lo AND n >= 50)
),
rep AS (
  SELECT doc_id, s, doc_id <> least_id AS removed
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least_id, max(doc_id) OVER (PARTITION BY h) AS most_id FROM win)
  WHERE least_id <> most_id
),
marked AS (
  SELECT *, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id, removed ORDER BY s) + 50 THEN 1 ELSE 0 END AS new FROM rep
),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, removed ORDER BY s) AS island FROM marked)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 AS BIGINT) AS end_word, removed
FROM islands GROUP BY doc_id, removed, island
UNION ALL
SELECT doc_id, CAST(0 AS BIGINT), CAST(n AS BIGINT), doc_id <> lo FROM same WHERE lo <> hi AND n >= 50
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
worded AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT piece, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM worded),
suffixes AS (
  SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)
),
runs AS (
  SELECT lang, 1 AS m, [w1] AS p FROM suffixes UNION ALL
  SELECT lang, 2, [w1, w2] FROM suffixes WHERE w2 IS NOT NULL UNION ALL
  SELECT lang, 3, [w1, w2, w3] FROM suffixes WHERE w3 IS NOT NULL
),
f AS (SELECT lang, m, p, count(*) AS c FROM runs GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cuts AS (
  SELECT f.lang, f.p, f.m, f.c AS a, k, x.c AS l, y.c AS r,
    (1000000::HUGEINT * f.c * f.c // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM f JOIN (SELECT unnest([1, 2]) AS k) ON k < f.m
  JOIN f x ON x.lang = f.lang AND x.p = f.p[1 : k] JOIN f y ON y.lang = f.lang AND y.p = f.p[k + 1 : f.m]
),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, p, max(c) AS c FROM (
    SELECT lang, p[1 : 2] AS p, c FROM f WHERE m = 3 UNION ALL SELECT lang, p[2 : 3], c FROM f WHERE m = 3
  ) GROUP BY ALL
),
kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score FROM scored s
  LEFT JOIN inside i ON i.lang = s.lang AND i.p = s.p WHERE i.c IS NULL OR 100 * i.c < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (SELECT a, b, s FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS rank,
  n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY rank <= 10
"""
