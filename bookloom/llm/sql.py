"""DuckDB equivalents of the queries, where SQL can express them."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS1 = rf"regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH item AS (SELECT item_id, {_WORDS1} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, coalesce({_WORDS1}, []) AS w FROM documents),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, i, n, item_id FROM gram JOIN win USING (n, s)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = r"""
WITH line AS (
  SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
),
win AS (
  SELECT doc_id, pos, s, lead(s) OVER w AS s2, lead(s, 2) OVER w AS s3 FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
full_win AS (SELECT *, row_number() OVER (PARTITION BY s, s2, s3 ORDER BY doc_id, pos) AS nth, count(*) OVER (PARTITION BY s, s2, s3) AS n FROM win WHERE s3 IS NOT NULL AND trim(s || s2 || s3) <> ''),
covered AS (SELECT doc_id, pos + unnest([0, 1, 2]) AS pos, nth = 1 AS first FROM full_win WHERE n > 1),
gone AS (SELECT doc_id, pos FROM covered GROUP BY 1, 2 HAVING NOT bool_or(first)),
kept AS (SELECT line.doc_id, string_agg(s, chr(10) ORDER BY pos) AS t FROM line ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_lines FROM line GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS text_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM doc WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
both_in AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM gram x JOIN gram y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_in JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) r USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7 = rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT AS hash FROM documents
),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY any_value(source) NULLS LAST) AS rank FROM d GROUP BY skey),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0 AS rest,
    sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w
),
l AS (SELECT rest, open FROM f WHERE NOT rest * weight / open > source_size * 2.0 ORDER BY source_size / weight, rank LIMIT 1),
t AS (SELECT f.skey, source_size, coalesce(least(l.rest * weight / l.open, source_size * 2.0), source_size * 2.0)::DOUBLE AS target FROM f LEFT JOIN l ON true),
cell AS (SELECT skey, size, count(*) AS n, row_number() OVER (PARTITION BY skey ORDER BY size DESC) AS rank FROM d GROUP BY skey, size),
listed AS (SELECT skey, target, list({'n': n, 's': size}) AS cells FROM cell JOIN t USING (skey) GROUP BY skey, target),
-- the dual's root by halving
half AS (
  SELECT skey, target, cells, -40.0::DOUBLE AS lo, ln(2.0::DOUBLE) AS hi, 0 AS step FROM listed
  UNION ALL
  SELECT skey, target, cells, CASE WHEN over THEN lo ELSE mid END, CASE WHEN over THEN mid ELSE hi END, step + 1
  FROM (SELECT *, list_sum(list_transform(cells, lambda c: c.n * c.s * least(2.0::DOUBLE, exp(least(700.0, mid * c.s))))) > target AS over FROM (SELECT *, (lo + hi) / 2 AS mid FROM half WHERE step < 200))
),
rate AS (
  SELECT c.skey, c.size, c.n, c.rank, floor((CASE WHEN h.target >= t.source_size * 2.0 * (1 - 1e-12) THEN 2.0 ELSE least(2.0::DOUBLE, exp(least(700.0, h.hi * c.size))) END) * 10000000 + 0.5)::BIGINT AS parts
  FROM cell c JOIN half h USING (skey) JOIN t USING (skey) WHERE h.step = 200
),
-- whole copies, down the sizes
deal AS (
  SELECT skey, 0::BIGINT AS rank, 0::BIGINT AS size, 0::BIGINT AS n, 0::BIGINT AS k, 0.0::DOUBLE AS carried FROM t
  UNION ALL
  SELECT skey, rank, size, n, k, CASE WHEN size = 0 THEN have ELSE have - k::DOUBLE * size::DOUBLE END
  FROM (
    SELECT *, CASE WHEN size = 0 THEN floor(n::DOUBLE * parts::DOUBLE / 10000000 + 0.5)::BIGINT ELSE least(greatest(floor(have / size::DOUBLE + 0.5)::BIGINT, 0), 2 * n) END AS k
    FROM (SELECT r.skey, r.rank, r.size, r.n, r.parts, deal.carried + r.n::DOUBLE * r.parts::DOUBLE * r.size::DOUBLE / 10000000 AS have FROM deal JOIN rate r ON r.skey = deal.skey AND r.rank = deal.rank + 1)
  )
),
nth AS (SELECT *, row_number() OVER (PARTITION BY skey, size ORDER BY hash, doc_id) AS i FROM d)
SELECT doc_id, nth.size, source_size, target, nth.size * (k * i // n - k * (i - 1) // n) AS taken
FROM nth JOIN deal ON deal.skey = nth.skey AND deal.size = nth.size AND deal.rank > 0 JOIN t ON t.skey = nth.skey
"""

_ESCAPED = r"""length(replace({0}, '\', '\\')) + len(regexp_extract_all({0}, '<\||</?s>|<</?SYS>>|\[/?INST\]'))"""
OP10 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 24)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op1_decontaminate": OP1, "op4_line_dedup": OP4, "op6_minhash_neardup": OP6, "op7_exact_dedup": OP7, "op9_mix_sources": OP9, "op10_chat_format": OP10}
