"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from .. import config as K
from . import fixtures as X

ORACLE: dict[str, str] = {}

N2 = "chr(10) || chr(10)"
#: The text of ``src`` after an expression, as digest and length.
_OUT = "md5({0}) AS {1}_md5, length({0}) AS {1}_chars"


def _out(e: str, name: str = "text") -> str:
    return _OUT.format(e, name)


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _normal(name: str, expression: str, out: str) -> None:
    ORACLE[name] = f"WITH {X.documents_sql(expression)} SELECT doc_id, {_out(out)} FROM src"


_CANON = "replace(replace(replace(text, chr(13) || chr(13) || chr(10), chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_CONTROL = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_BLANK = r"regexp_replace({}, '(?m)^[ \t]+$', '', 'g')"
_DASH = "regexp_replace({}, '--+', '—', 'g')"
_normal("newline_canon", X.ROUGH, _CANON)
_normal("control_strip", X.ROUGH, _CONTROL.format("text"))
_normal("blank_line_norm", X.ROUGH_LINES, _BLANK.format("text"))
_normal("dash_fold", X.ROUGH, _DASH.format("text"))
_normal("canonical_text", X.ROUGH, _DASH.format(_BLANK.format(_CONTROL.format(_CANON))))

_START, _END = _q("(?im)" + K.START_MARK), _q("(?im)" + K.END_MARK)
ORACLE["boilerplate_strip"] = f"""
WITH {X.documents_sql(X.MARKED)},
a AS (SELECT *, regexp_extract(text, '{_START}', 0) AS m FROM src),
b AS (SELECT doc_id, CASE WHEN m <> '' AND strpos(text, m) - 1 < length(text) // 2 THEN substr(text, strpos(text, m) + length(m)) ELSE text END AS t FROM a),
c AS (SELECT doc_id, t, regexp_extract_all(t, '{_END}', 0)[-1] AS m, length(string_split_regex(t, '{_END}')[-1]) AS after FROM b),
d AS (SELECT doc_id, CASE WHEN m IS NOT NULL AND length(t) - after - length(m) > length(t) // 2 THEN substr(t, 1, length(t) - after - length(m)) ELSE t END AS t FROM c)
SELECT doc_id, {_out("t")} FROM d"""

_PIC = _q(K.ILLUSTRATION)
ORACLE["illustration_strip"] = rf"""
WITH {X.documents_sql(X.ILLUSTRATED)},
p AS (SELECT doc_id, unnest(string_split_regex(text, '{_PIC}')) AS piece, generate_subscripts(string_split_regex(text, '{_PIC}'), 1) AS k, regexp_extract_all(text, '{_PIC}', 0) AS m FROM src),
r AS (SELECT doc_id, k, piece || coalesce(array_to_string(list_transform(list_filter(string_split(m[k], chr(10)), lambda x: regexp_matches(x, '(?i)^\s*chapter\b')), lambda x: regexp_replace(x, '^[ \t\]]+|[ \t\]]+$', '', 'g')), {N2}), '') AS piece FROM p),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY k) AS t FROM r GROUP BY doc_id)
SELECT doc_id, {_out("t")} FROM t"""

_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _html(src: str, key: str) -> str:
    """Common table expressions from ``src`` (key, body) to ``html`` (key, html)."""
    return rf"""
tok AS (
  SELECT {key}, unnest(string_split_regex(b, '\n{{2,}}')) AS t, generate_subscripts(string_split_regex(b, '\n{{2,}}'), 1) AS k, regexp_extract_all(b, '\n{{2,}}') AS gaps
  FROM (SELECT {key}, {_strip(r"regexp_replace(body, '\n{4,}', chr(10) || chr(10) || chr(10), 'g')")} AS b FROM {src})
),
part AS (
  SELECT {key}, 2 * k AS k, '<p>' || replace({_ESC.format(_strip("t"))}, chr(10), '<br/>') || '</p>' AS h FROM tok WHERE {_strip("t")} <> ''
  UNION ALL SELECT {key}, 2 * k + 1, '<p>' || chr(160) || '</p>' FROM tok WHERE length(gaps[k]) >= 3
),
html AS (SELECT {key}, coalesce(string_agg(h, chr(10) ORDER BY k), '') AS html FROM (SELECT DISTINCT {key} FROM {src}) LEFT JOIN part USING ({key}) GROUP BY ALL)"""


ORACLE["html_render"] = f"WITH {X.documents_sql(X.SPACED)}, s AS (SELECT doc_id, text AS body FROM src), {_html('s', 'doc_id')} SELECT doc_id, {_out('html')} FROM html"
ORACLE["nonws_count"] = r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n FROM documents"


def _wrap(src: str, key: str) -> str:
    return f"""
len_ AS (SELECT {key}, length(x) AS n, row_number() OVER (PARTITION BY {key} ORDER BY length(x)) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS m FROM (SELECT {key}, unnest(string_split(text, chr(10))) AS x FROM {src}) WHERE length({_strip("x")}) > 30),
wrap AS (SELECT {key}, wrap FROM (SELECT DISTINCT {key} FROM {src}) LEFT JOIN (SELECT {key}, n AS wrap FROM len_ WHERE i = m * 9 // 10 AND n >= 40) USING ({key}))"""


ORACLE["wrap_width"] = f"WITH {X.books_sql(X.INDENTED)}, {_wrap('books', 'book_id')} SELECT book_id, wrap FROM wrap"

_ENDS = "[" + K.SENTENCE_ENDS + "]$"
_CONT = ", ".join(f"'{w}'" for w in K.CONTINUING_WORDS)


def _break(before: str, line: str) -> str:
    return rf"""CASE WHEN coalesce(length({before}) >= wrap - 3, false) THEN 0 WHEN regexp_matches({before}, '{_ENDS}') THEN 1 WHEN regexp_matches({line}, '^[\p{{Ll}}\p{{Nd}}]') THEN 0
  WHEN regexp_replace(lower(regexp_extract({before}, '\S+$')), '[.,;:''"]+$', '') IN ({_CONT}) THEN 0 WHEN coalesce(length({before}) >= wrap - 12, false) THEN 0 ELSE 1 END"""


def _blocks(source: str) -> str:
    """From ``raw`` (book_id, text) to ``f`` (features), ``para`` and ``cleaned``."""
    return rf"""
{source.replace("books AS", "raw AS", 1)}, {_wrap("raw", "book_id")},
b0 AS (SELECT book_id, unnest(string_split(text, {N2})) AS b, generate_subscripts(string_split(text, {N2}), 1) AS k FROM raw),
l0 AS (SELECT book_id, k, unnest(string_split(b, chr(10))) AS x, generate_subscripts(string_split(b, chr(10)), 1) AS pos FROM b0),
l1 AS (SELECT book_id, dense_rank() OVER (PARTITION BY book_id ORDER BY k) - 1 AS block_no, row_number() OVER (PARTITION BY book_id, k ORDER BY pos) AS i, count(*) OVER (PARTITION BY book_id, k) AS n, x, {_strip("x")} AS s FROM l0 WHERE {_strip("x")} <> ''),
med AS (SELECT book_id, block_no, length(s) AS median FROM l1 QUALIFY row_number() OVER (PARTITION BY book_id, block_no ORDER BY length(s)) - 1 = n // 2),
f0 AS (
  SELECT book_id, block_no, max(n) AS n_lines, count(*) FILTER (x LIKE '  %' OR x LIKE chr(9) || '%') AS indented, max(n) = 2 AND min(length(s)) FILTER (i = 1) <= 12 AS two_line_heading,
    count(DISTINCT length(x) - length(regexp_replace(x, '^\s+', ''))) AS indents, max(length(s)) FILTER (i < n) AS longest, min(length(s)) FILTER (i < n) AS shortest, count(*) FILTER (i < n AND s LIKE '%-') >= 3 AS hyphenated
  FROM l1 GROUP BY ALL
),
pm AS (SELECT book_id, n_lines > 25 AS page_mode, m AS n_blocks FROM (SELECT book_id, n_lines, row_number() OVER (PARTITION BY book_id ORDER BY n_lines) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS m FROM f0) WHERE i = m // 2),
f1 AS (SELECT *, coalesce(indents = 1 AND n_lines >= 3 AND longest - shortest <= 8 AND shortest >= wrap - 20, false) AS uniform FROM f0 JOIN med USING (book_id, block_no) JOIN wrap USING (book_id) JOIN pm USING (book_id)),
f AS (
  SELECT *, CASE WHEN n_lines = 1 THEN 'single' WHEN n_lines <= 200 AND median <= 85 AND NOT two_line_heading AND indented * 3 >= n_lines * 2 AND NOT uniform THEN 'verse'
    WHEN page_mode OR n_lines > 60 OR (n_lines > 25 AND hyphenated) THEN 'wrapped' ELSE 'prose' END AS kind FROM f1
),
g AS (SELECT l1.*, kind, wrap, lag(s) OVER (PARTITION BY book_id, block_no ORDER BY i) AS prev FROM l1 JOIN f USING (book_id, block_no)),
h AS (SELECT *, sum(CASE WHEN kind = 'wrapped' AND prev IS NOT NULL THEN {_break("prev", "s")} ELSE 0 END) OVER (PARTITION BY book_id, block_no ORDER BY i) AS para_no FROM g),
para AS (SELECT book_id, block_no, para_no, kind, CASE kind WHEN 'single' THEN min(regexp_replace(x, '\s+$', '')) WHEN 'verse' THEN string_agg(s, chr(10) ORDER BY i) ELSE string_agg(s, ' ' ORDER BY i) END AS t FROM h GROUP BY book_id, block_no, para_no, kind),
cleaned AS (SELECT book_id, string_agg(b, chr(10) || {N2} ORDER BY block_no) AS cleaned FROM (SELECT book_id, block_no, string_agg(t, {N2} ORDER BY para_no) AS b FROM para GROUP BY ALL) GROUP BY book_id)"""


_BLOCKS = _blocks(X.books_sql(X.INDENTED))
ORACLE["page_mode"] = f"WITH {_BLOCKS} SELECT book_id, n_blocks, page_mode FROM pm"
ORACLE["block_features"] = f"WITH {_BLOCKS} SELECT book_id, block_no, n_lines, indented, median, wrap, two_line_heading, uniform, hyphenated, page_mode, kind FROM f"
ORACLE["paragraphs"] = f"WITH {_BLOCKS} SELECT book_id, block_no, para_no::BIGINT AS para_no, kind, {_out('t')} FROM para"
ORACLE["verse_blocks"] = f"WITH {_BLOCKS} SELECT book_id, block_no, para_no::BIGINT AS para_no, {_out('t')} FROM para WHERE kind = 'verse'"
ORACLE["clean_text"] = f"WITH {_BLOCKS} SELECT book_id, {_out('cleaned', 'text')} FROM cleaned"
_KEY = r"regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
ORACLE["paragraph_units"] = f"WITH {_BLOCKS}, u AS (SELECT book_id, {_KEY.format('u')} AS u FROM (SELECT book_id, unnest(string_split_regex(cleaned, '\\n+')) AS u FROM cleaned)) SELECT book_id, md5(u) AS key, count(*) AS n FROM u WHERE u <> '' GROUP BY ALL"

_PLAIN = X.documents_sql("coalesce(text, '')")
ORACLE["prose_join"] = f"WITH {_PLAIN} SELECT doc_id, {_out('t')} FROM (SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), ' '), '') AS t FROM src)"
_CUT = X.documents_sql("replace(replace(coalesce(text, ''), '. ', concat('.', {nl})), ', ', concat(',', {nl}))")
ORACLE["wrapped_split"] = f"""
WITH {_CUT}, {_wrap("src", "doc_id")},
l AS (SELECT doc_id, i, {_strip("x")} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src) WHERE {_strip("x")} <> ''),
g AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l JOIN wrap USING (doc_id)),
h AS (SELECT *, sum(CASE WHEN prev IS NULL THEN 0 ELSE {_break("prev", "s")} END) OVER (PARTITION BY doc_id ORDER BY i) AS para_no FROM g),
p AS (SELECT doc_id, para_no::BIGINT AS para_no, string_agg(s, ' ' ORDER BY i) AS t FROM h GROUP BY ALL)
SELECT doc_id, para_no, {_out("t")} FROM p UNION ALL SELECT doc_id, 0, {_out("''")} FROM src WHERE doc_id NOT IN (SELECT doc_id FROM p)"""


def _explicit(s: str, k: int) -> str:
    pattern, any_case = K.EXPLICIT[k]
    return f"regexp_matches({s}, '{'(?i)' * any_case}{_q(pattern)}')"


def _heading(s: str) -> str:
    small = "|".join(_q(w) for w in K.TITLE_WORDS)
    word = rf"([\p{{Lu}}\p{{Nd}}]\S*|(?i:{small}))"
    m = lambda p: f"regexp_matches({s}, '{p}')"
    upper = f"({m(r'\p{Lu}')} AND NOT {m(r'\p{Ll}')})"
    return rf"""CASE WHEN {s} = '' OR length({s}) > 100 THEN false WHEN {" OR ".join(_explicit(s, k) for k in range(len(K.EXPLICIT)))} THEN true
    WHEN {m("[A-Za-z]")} AND NOT {m("[A-Za-z]{3}")} THEN false WHEN {m('^["“‘’' + "''" + r"\[(]")} THEN false WHEN {m("[?!;:]$")} THEN false WHEN {m(r"\s{3}")} THEN false
    WHEN {m(r"(^|\s)\p{Nd}+$")} THEN false WHEN {m(r"(?i)^(re-)?(enter|exit|exeunt)\b")} THEN false WHEN {m(r"^[^\s\p{Ll}]{2,}\.(\s|$)")} AND {m(r"^\S*\p{Lu}")} THEN false
    WHEN {upper} AND {m(r"\.$")} AND {m(r"^\S+(\s+\S+){0,2}$")} THEN false WHEN {upper} AND length({s}) >= 3 AND {m("[A-Z]")} THEN strpos({s}, ',') = 0 WHEN {m(r":\s")} THEN false
    WHEN {m(r"^\S+(\s+\S+){1,7}$")} AND strpos({s}, ',') = 0 AND NOT {m(r"\.$")} AND {m(r"^(\p{Lu}|\p{Nd}+(\s|$))")} AND {m(rf"^{word}(\s+{word})*$")} THEN true ELSE false END"""


def _index(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {_explicit(s, k)} THEN {k}" for k in range(len(K.EXPLICIT))) + " END"


_VALUES = ", ".join(f"({i}, '{_q(x)}')" for i, x in enumerate(X.LINES))
ORACLE["heading_rules"] = f"SELECT i::BIGINT AS i, line, ({_index('s')})::BIGINT AS explicit_index, {_heading('s')} AS heading FROM (SELECT i, line, {_strip('line')} AS s FROM (VALUES {_VALUES}) v(i, line))"


def _candidates(books: str) -> str:
    """From ``books`` (book_id, text) to ``ln`` (all lines) and ``c0`` (candidates)."""
    return rf"""{books},
ln AS (SELECT book_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT - 1 AS pos FROM books),
ln2 AS (SELECT *, {_strip("line")} AS s, coalesce({_strip("lag(line) OVER w")} = '', true) AS pb, coalesce({_strip("lead(line) OVER w")} = '', true) AS nb FROM ln WINDOW w AS (PARTITION BY book_id ORDER BY pos)),
c0 AS (
  SELECT book_id, pos, s AS title, ({_index("s")}) IS NOT NULL AS explicit, length(line) - length(regexp_replace(line, '^\s+', '')) >= 6 AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '\p{{Ll}}') AS decor,
    replace(lower(regexp_replace(s, '\s+', ' ', 'g')), 'ß', 'ss') AS key
  FROM ln2 WHERE pb AND nb AND s <> '' AND length(s) <= 100 AND {_heading("s")}
)"""


def _repeated(c: str, to: str) -> str:
    return f"{to} AS (SELECT * FROM {c} QUALIFY explicit OR count(*) OVER (PARTITION BY book_id, key) < 3)"


def _nondominant(c: str, to: str) -> str:
    n, v = "count(*) FILTER (explicit) OVER (PARTITION BY book_id)", "count(*) FILTER (explicit OR NOT decor) OVER (PARTITION BY book_id)"
    return f"{to} AS (SELECT * FROM {c} QUALIFY explicit OR NOT ({n} >= 10 AND {n} >= {v} * 0.55))"


def _contents(c: str, to: str) -> str:
    return f"""{to}_n AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY book_id ORDER BY pos), 9000000000) AS nxt FROM {c}),
{to}_e AS (SELECT x.*, NOT EXISTS (SELECT 1 FROM ln2 WHERE ln2.book_id = x.book_id AND ln2.pos > x.pos AND ln2.pos < x.nxt AND ln2.s <> '') AS empty FROM {to}_n x),
{to}_i AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) - row_number() OVER (PARTITION BY book_id, empty ORDER BY pos) AS island FROM {to}_e),
{to} AS (SELECT book_id, pos, title, explicit, decor, key FROM {to}_i QUALIFY NOT empty OR (explicit AND count(*) OVER (PARTITION BY book_id, empty, island) < 3))"""


def _chapters(books: str) -> str:
    """To ``chapters`` (book_id, chap_no, title, body)."""
    return f"""{_candidates(books)}, {_repeated("c0", "c1")}, {_nondominant("c1", "c2")}, {_contents("c2", "c3")},
al AS (SELECT ln.book_id, ln.pos, line, c3.title, sum(CASE WHEN c3.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY ln.book_id ORDER BY ln.pos) AS k FROM ln LEFT JOIN c3 ON c3.book_id = ln.book_id AND c3.pos = ln.pos),
bd AS (SELECT book_id, k, max(title) AS title, {_strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (title IS NULL), '')")} AS body, max(max(k)) OVER (PARTITION BY book_id) AS n FROM al GROUP BY book_id, k),
chapters AS (
  SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY k) AS chap_no, coalesce(title, CASE WHEN n = 0 THEN 'Content' ELSE 'Introduction' END) AS title, body FROM bd WHERE k > 0 OR n = 0 OR body <> ''
)"""


_S = X.books_sql(X.STRUCTURED)
_LIST = "SELECT book_id, pos, title, explicit, decor FROM "
ORACLE["heading_predicate"] = f"WITH {_candidates(_S)} {_LIST} c0"
ORACLE["suppress_repeated"] = f"WITH {_candidates(_S)}, {_repeated('c0', 'c1')} {_LIST} c1"
ORACLE["suppress_nondominant"] = f"WITH {_candidates(_S)}, {_nondominant('c0', 'c1')} {_LIST} c1"
ORACLE["toc_run"] = f"WITH {_candidates(_S)}, {_contents('c0', 'c1')} {_LIST} c1"
_CH = f"WITH {_chapters(_S)}"
ORACLE["chapter_split"] = rf"{_CH} SELECT book_id, chap_no, title, len(regexp_extract_all(body, '\S+')) AS n_words, {_out('body', 'body')} FROM chapters"
_DOCBOOKS = "books AS (SELECT doc_id AS book_id, coalesce(text, '') AS text FROM documents)"
ORACLE["chapter_fallback"] = f"WITH {_chapters(_DOCBOOKS)} SELECT book_id AS doc_id, chap_no, title, {_out('body', 'body')} FROM chapters"
ORACLE["review_merge"] = f"""
WITH g AS (SELECT conv_id, turn, coalesce(role, '') AS title, coalesce(text, '') AS body, coalesce(role, '') = 'user' AS kept, greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn), 1) AS grp FROM conversations),
p AS (SELECT conv_id, turn, grp, kept, title, nullif(CASE WHEN kept THEN body ELSE concat_ws({N2}, nullif(title, ''), nullif(body, '')) END, '') AS piece FROM g),
m AS (SELECT conv_id, grp::BIGINT AS chap_no, coalesce(max(title) FILTER (kept), 'Content') AS title, coalesce(string_agg(piece, {N2} ORDER BY turn), '') AS body FROM p GROUP BY ALL)
SELECT conv_id, chap_no, title, {_out("body", "body")} FROM m"""
ORACLE["dominant_pattern"] = f"""{_CH},
n AS (SELECT book_id, i, count(*) AS n FROM (SELECT book_id, {_index(_strip("title"))} AS i FROM chapters) GROUP BY ALL)
SELECT book_id, (arg_min(i, -n * 100 + i) FILTER (i IS NOT NULL AND n >= 3))::BIGINT AS dominant FROM n GROUP BY book_id"""
_A, _B = (_q(x) for x in K.WARNING_LINES.split("{}"))
ORACLE["structure_warning"] = f"""
WITH {_chapters(f"books AS (SELECT doc_id AS book_id, {X.sql(X.LONG, 'duck')} AS text FROM documents)")},
k AS (SELECT book_id, count(*) AS chaps FROM chapters GROUP BY book_id),
lens AS (SELECT book_id, length(x) AS n, row_number() OVER (PARTITION BY book_id ORDER BY length(x)) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS m FROM (SELECT book_id, unnest(string_split(text, chr(10))) AS x FROM books) WHERE {_strip("x")} <> '')
SELECT book_id AS doc_id, CASE WHEN chaps <= 1 AND length(text) >= 50000 AND n IS NOT NULL THEN '{K.WARNING_HEAD}' || CASE WHEN n > 150 THEN '{_A}' || n || '{_B}' ELSE '{K.WARNING_PATTERN}' END || '{K.WARNING_TAIL}' END AS warning
FROM books JOIN k USING (book_id) LEFT JOIN (SELECT * FROM lens WHERE i = m * 9 // 10) USING (book_id)"""
ORACLE["author_guess"] = rf"""
WITH {X.documents_sql(X.AUTHORED)},
l AS (SELECT doc_id, {_strip("x")} AS s, k FROM (SELECT doc_id, unnest(string_split(substr(text, 1, 4000), chr(10))) AS x, generate_subscripts(string_split(substr(text, 1, 4000), chr(10)), 1) AS k FROM src) WHERE k <= 80 AND {_strip("x")} <> ''),
h AS (SELECT *, row_number() OVER w AS i, lead(s) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
a AS (SELECT *, {_strip(r"regexp_extract(s, '(?i)^by\s+(.{3,60})$', 1)")} AS same FROM h),
c AS (SELECT doc_id, i, CASE WHEN same <> '' AND len(regexp_extract_all(same, '\S+')) <= 6 THEN same WHEN lower(s) = 'by' AND length(nxt) >= 3 AND len(regexp_extract_all(nxt, '\S+')) BETWEEN 1 AND 6 THEN nxt END AS name FROM a WHERE i <= 25),
b AS (SELECT doc_id, arg_min(name, i) FILTER (name IS NOT NULL) AS by_line FROM c GROUP BY doc_id),
t AS (SELECT doc_id, {_strip(r"regexp_extract(s, '^([A-Z][a-z]+(?:\s+[A-Z]\.|\s+[A-Z][a-z]+){1,3})\.\s+\S', 1)")} AS n FROM h WHERE i = 1),
o AS (SELECT doc_id, by_line, CASE WHEN len(regexp_extract_all(n, '\S+')) BETWEEN 2 AND 5 THEN n END AS title_line FROM src LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT doc_id, by_line, title_line, coalesce(by_line, title_line, 'Unknown Author') AS author FROM o"""
ORACLE["title_guess"] = r"""
WITH s AS (SELECT page_id, url, CASE WHEN strpos(substr(n, 2), '.') > 0 THEN regexp_replace(n, '\.[^.]*$', '') ELSE n END AS stem FROM (SELECT page_id, url, string_split(url, '/')[-1] AS n FROM pages)),
t AS (SELECT *, trim(regexp_replace(stem, '[_\-]+', ' ', 'g')) AS t, nullif(replace(trim(regexp_replace(url, '[^\p{L}\p{N}_\s\-]', '', 'g')), ' ', '_'), '') AS safe FROM s)
SELECT page_id, stem, coalesce(array_to_string(list_transform(regexp_extract_all(t, '(\p{L}+|\P{L}+)'), lambda x: upper(x[1]) || lower(x[2:])), ''), '') AS title, coalesce(safe, 'book') AS safe FROM t"""
# first-free numbering, stated by the candidates that are left
ORACLE["unique_name"] = r"""
WITH b AS (SELECT doc_id, replace(trim(regexp_replace('Book: ' || coalesce(source, ''), '[^\p{L}\p{N}_\s\-]', '', 'g')), ' ', '_') AS base FROM documents),
n AS (SELECT doc_id, base || CASE WHEN doc_id % 7 = 3 THEN '_2' WHEN doc_id % 11 = 5 THEN '_4' WHEN doc_id % 13 = 1 THEN '_2_3' ELSE '' END AS name FROM b),
taken AS (SELECT DISTINCT base || CASE WHEN doc_id % 100 = 0 THEN '_3' ELSE '' END AS name FROM b WHERE doc_id % 50 = 0),
used AS (SELECT name FROM n UNION SELECT name FROM taken),
k AS (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) - (name NOT IN (SELECT name FROM taken))::INT AS i FROM n),
free AS (
  SELECT name, name || '_' || j AS candidate, row_number() OVER (PARTITION BY name ORDER BY j) AS i
  FROM (SELECT name, unnest(generate_series(2, max(i) + (SELECT count(*) FROM used) + 2)) AS j FROM k GROUP BY name) WHERE name || '_' || j NOT IN (SELECT name FROM used)
)
SELECT doc_id, k.name, CASE WHEN k.i = 0 THEN k.name ELSE candidate END AS unique_name FROM k LEFT JOIN free ON free.name = k.name AND free.i = k.i"""
_FILE = "'chap_' || CASE WHEN chap_no < 1000 THEN lpad(chap_no::VARCHAR, 3, '0') ELSE chap_no::VARCHAR END || '.xhtml'"
_TITLE = _ESC.format("title")
_HEAD = "'" + "' || chr(10) || '".join(_q(K.XHTML_HEAD).replace("{lang}", "en").replace("{title}", f"' || {_TITLE} || '").split("\n")) + "'"
_FOOT = "'" + "' || chr(10) || '".join(K.XHTML_FOOT.split("\n")) + "'"
ORACLE["xhtml_chapters"] = f"{_CH}, s AS (SELECT book_id || '#' || chap_no AS id, * FROM chapters), {_html('s', 'id')}, p AS (SELECT book_id, {_FILE} AS file, {_HEAD} || html || {_FOOT} AS p FROM s JOIN html USING (id)) SELECT book_id, file, {_out('p', 'page')} FROM p"
ORACLE["toc_links"] = f"{_CH} SELECT book_id, string_agg({_FILE} || chr(9) || title, chr(10) ORDER BY chap_no) AS toc FROM chapters GROUP BY book_id"
_LONG = X.documents_sql("repeat(coalesce(text, ''), case when doc_id % 5 = 0 then 20 else 1 end)")
ORACLE["status_report"] = rf"""WITH {_LONG}
SELECT CASE WHEN strlen(text) < 5120 THEN 'skipped' WHEN doc_id % 9 = 0 THEN 'failed' WHEN length(text) >= 50000 AND regexp_matches(text, '\S') THEN 'warned' ELSE 'done' END AS status, count(*) AS n FROM src GROUP BY 1"""
ORACLE["converted"] = """
WITH s AS (SELECT doc_id, coalesce(source, 'none') AS source FROM documents),
t AS (SELECT doc_id, '/in/' || source AS folder, 'My_' || array_to_string(list_transform(regexp_extract_all(source, '([a-z]+|[^a-z]+)'), lambda x: upper(x[1]) || x[2:]), '') AS name FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) AS k FROM t)
SELECT doc_id, folder, name || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS name, true AS built FROM k"""
ORACLE["norm_para"] = f"WITH {_PLAIN} SELECT doc_id, {_out(_KEY.format('text'))} FROM src"
ORACLE["title_tokens"] = rf"WITH {_PLAIN}, t AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+') AS w FROM src) SELECT doc_id, len(w) AS n_tokens, {_out("coalesce(array_to_string(w, ' '), '')")} FROM t"


def _scores(rows: str, by: str) -> str:
    return f"""
SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE AS f1
FROM (SELECT *, coalesce(hits / nullif(predicted, 0), 0)::DOUBLE AS p, coalesce(hits / nullif(truth, 0), 0)::DOUBLE AS r FROM (SELECT {by}, sum(hits)::BIGINT AS hits, sum(predicted)::BIGINT AS predicted, sum(truth)::BIGINT AS truth FROM {rows} GROUP BY ROLLUP ({by})))"""


ORACLE["prf_labels"] = f"WITH j AS (SELECT source, (quality = 1 AND toxic = 1)::INT AS hits, (toxic = 1)::INT AS predicted, (quality = 1)::INT AS truth FROM labels JOIN documents USING (doc_id)) {_scores('j', 'source')}"
_SIDES = f"{_PLAIN}, l AS (SELECT doc_id % 2 AS side, source, unnest(string_split(text, chr(10))) AS line FROM src), c AS (SELECT source, line, count(*) FILTER (side = 0) AS a, count(*) FILTER (side <> 0) AS b FROM l GROUP BY ALL)"
ORACLE["multiset_overlap"] = f"WITH {_SIDES}, j AS (SELECT source, least(a, b) AS hits, a AS predicted, b AS truth FROM c) {_scores('j', 'source')}"
ORACLE["multiset_diff"] = f"WITH {_SIDES} SELECT source, 'missed' AS side, sum(b - a)::BIGINT AS n, count(*) AS n_distinct FROM c WHERE b > a GROUP BY 1 UNION ALL SELECT source, 'false', sum(a - b)::BIGINT, count(*) FROM c WHERE a > b GROUP BY 1"
_TOP = f"{_CH}, n AS (SELECT book_id, title, count(*) AS n, min(chap_no) AS first FROM chapters GROUP BY ALL HAVING count(*) > 1)"
ORACLE["common_titles"] = f"{_TOP} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, first) AS k, title, n FROM n QUALIFY k <= 5"
ORACLE["first_lines"] = f"WITH {_candidates(_S)} SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS n, pos, line FROM ln2 WHERE s <> '' QUALIFY n <= 15"
ORACLE["heading_probe"] = rf"WITH {_candidates(_S)} SELECT book_id, pos, s, pb AS prev_blank, nb AS next_blank FROM ln2 WHERE length(s) BETWEEN 1 AND 60 AND regexp_matches(s, '(?i)^(chapter|part|book)\b|^[\dIVXLC]+\s*$|^\d+\s') QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY pos) <= 12"
ORACLE["encoding_sniff"] = rf"SELECT doc_id, {_out('t')} FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN regexp_replace(coalesce(text, ''), '[^\x00-\xFF]', '?', 'g') ELSE coalesce(text, '') END AS t FROM documents)"
ORACLE["tiny_filter"] = "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes FROM documents WHERE strlen(coalesce(text, '')) >= 5120"
ORACLE["expand_paths"] = "SELECT DISTINCT '/books/' || (page_id // 2) || CASE page_id % 3 WHEN 0 THEN '.txt' ELSE '.TXT' END AS path FROM pages WHERE page_id % 3 <> 2"
ORACLE["cover_join"] = """
WITH i AS (SELECT '/b/' || CASE WHEN page_id % 2 = 0 THEN 'Book' ELSE 'BOOK' END || page_id || '.png' AS image, page_id AS id, 3 AS rank, page_id % 2 <> 0 AS other FROM pages WHERE page_id % 4 <> 3
  UNION ALL SELECT '/b/Book' || page_id * 3 || '.JPG', page_id * 3, 1, false FROM pages WHERE page_id % 5 <> 0)
SELECT '/b/Book' || page_id || '.txt' AS path, arg_min(image, (other, rank, image)) AS cover_path FROM pages LEFT JOIN i ON id = page_id GROUP BY ALL"""
ORACLE["drop_paths"] = "SELECT page_id, '/a b/' || page_id || '.txt|c' || page_id || '.txt|the rest ' || url AS paths FROM pages"

_NONWS = r"length(regexp_replace({}, '\s', '', 'g'))"
_CORPUS = rf"""WITH {_blocks(_S)}, {_chapters("books AS (SELECT book_id, cleaned AS text FROM cleaned)")},
k AS (SELECT book_id, count(*) AS n_chapters, sum({_NONWS.format("body")}) AS kept, bool_or(regexp_matches(title, '[A-Za-z]') AND NOT regexp_matches(title, '[A-Za-z]{{3}}') AND ({_index("title")}) IS NULL) AS odd FROM chapters GROUP BY book_id),
r AS (
  SELECT book_id, n_chapters, odd, text, cleaned, round(coalesce(kept / nullif({_NONWS.format("cleaned")}, 0), 1)::DOUBLE, 4) AS coverage, 100 * round(coalesce(kept / nullif({_NONWS.format("text")}, 0), 1)::DOUBLE, 4) AS pct,
    coalesce({_NONWS.format("cleaned")} / nullif({_NONWS.format("text")}, 0), 1) AS whole
  FROM k JOIN raw USING (book_id) JOIN cleaned USING (book_id)
)"""
ORACLE["corpus_report"] = f"{_CORPUS} SELECT book_id, n_chapters, coverage, CASE WHEN pct >= 98 THEN 'ok' WHEN pct >= 90 THEN 'warning' ELSE 'loss' END AS grade FROM r"
ORACLE["corpus_topk"] = f"{_CORPUS} SELECT book_id, n_chapters, row_number() OVER (ORDER BY n_chapters DESC, book_id) AS n FROM r QUALIFY n <= 15"
ORACLE["corpus_lowest"] = rf"""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[xq]')) AS kept FROM documents),
c AS (SELECT doc_id, round(coalesce({_NONWS.format("coalesce(array_to_string(kept, ''), '')")} / nullif({_NONWS.format("text")}, 0), 1)::DOUBLE, 4) AS coverage FROM l)
SELECT doc_id, coverage, row_number() OVER (ORDER BY coverage, doc_id) AS n FROM c WHERE coverage < 0.95 QUALIFY n <= 10"""
_MORE = "CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || chr(10) || chr(10) || 'Chapter 2' || chr(10) || chr(10) || 'more' ELSE coalesce(text, '') END"
_SINGLES = f"""WITH {_chapters(f"books AS (SELECT doc_id AS book_id, {_MORE} AS text FROM documents)")},
k AS (SELECT book_id, count(*) AS n_chapters, sum({_NONWS.format("body")}) AS kept FROM chapters GROUP BY book_id),
r AS (SELECT book_id AS doc_id, n_chapters, round(coalesce(kept / nullif({_NONWS.format("text")}, 0), 1)::DOUBLE, 4) AS coverage FROM k JOIN books USING (book_id))"""
ORACLE["corpus_single"] = f"{_SINGLES} SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM r WHERE n_chapters = 1 QUALIFY n <= 10"
ORACLE["corpus_flags"] = f"""{_SINGLES}
SELECT 'single' AS flag, count(*) AS n FROM r WHERE doc_id % 9 <> 0 AND n_chapters = 1 UNION ALL SELECT 'low_coverage', count(*) FROM r WHERE doc_id % 9 <> 0 AND coverage < 0.95 UNION ALL SELECT 'failed', count(*) FROM r WHERE doc_id % 9 = 0"""
ORACLE["corpus_slowest"] = "SELECT event_id, value AS sec, row_number() OVER (ORDER BY value DESC, event_id) AS n FROM events WHERE value IS NOT NULL QUALIFY n <= 5"
ORACLE["stress_titles"] = f"{_CH} SELECT book_id, count(*) AS n_chapters, string_agg(title, chr(10) ORDER BY chap_no) FILTER (chap_no <= 25) AS titles FROM chapters WHERE book_id = (SELECT min(book_id) FROM books) GROUP BY book_id"
ORACLE["title_hits"] = rf"""{_CH},
p AS (SELECT DISTINCT book_id, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS p FROM chapters WHERE title NOT IN ('Introduction', 'Content')),
t AS (SELECT {X.sql(X.BOOK, "duck")} AS book_id, doc_id, ['chapter', (doc_id // 5 % 40 + 1)::VARCHAR] AS t FROM documents WHERE doc_id % 5 = 0),
h AS (SELECT book_id, count(*) AS n_truth, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.book_id = t.book_id AND len(p.p) > 0 AND t.t[1:len(p.p)] = p.p)) AS n_hit FROM t GROUP BY book_id)
SELECT book_id, coalesce(n_hit, 0) AS n_hit, coalesce(n_truth, 0) AS n_truth FROM books LEFT JOIN h USING (book_id)"""
ORACLE["epub_items"] = rf"""{_CORPUS},
i AS (
  SELECT book_id, chap_no, 0 AS k, 'h1' AS tag, title AS t FROM chapters
  UNION ALL SELECT book_id, chap_no, k, 'p', x FROM (SELECT book_id, chap_no, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM (SELECT *, string_split_regex(body, '\n\n+') AS p FROM chapters))
),
s AS (SELECT book_id, chap_no, k, tag, regexp_replace(t, '\s+', '', 'g') AS text FROM i)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chap_no, k) AS n, tag, {_out("text")} FROM s WHERE text <> ''"""
ORACLE["expand_in_order"] = """
WITH p AS (SELECT '/books/' || (page_id // 2) || CASE page_id % 3 WHEN 0 THEN '.txt' ELSE '.TXT' END AS path, min(page_id * 7 % 5) AS arg FROM pages WHERE page_id % 3 <> 2 GROUP BY 1)
SELECT path, arg, row_number() OVER (ORDER BY arg, path) AS n FROM p"""
_AT = ", ".join(f"v[least(len(v) - 1, floor(len(v) * {share})::BIGINT) + 1] AS {name}" for share, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95")))
ORACLE["corpus_quantiles"] = f"{_CORPUS} SELECT v[1] AS lo, {_AT}, v[-1] AS hi FROM (SELECT list_sort(list(n_chapters)) AS v FROM r)"
ORACLE["quality_checks"] = f"""{_CORPUS},
q AS (
  SELECT book_id, n_chapters, CASE WHEN whole >= 0.97 THEN 'pass' ELSE 'fail' END AS preserved, CASE WHEN strpos(cleaned, '--') = 0 THEN 'pass' ELSE 'fail' END AS dashes,
    CASE WHEN strpos(cleaned, {N2} || {N2}) = 0 THEN 'pass' ELSE 'warn' END AS newlines, CASE WHEN n_chapters >= 1 THEN 'pass' ELSE 'fail' END AS has_chapters, CASE WHEN odd THEN 'warn' ELSE 'pass' END AS titles,
    CASE WHEN coverage >= 0.95 THEN 'pass' ELSE 'warn' END AS coverage, CASE WHEN n_chapters BETWEEN 5 AND CASE WHEN book_id LIKE '%0' THEN 6 ELSE 500 END THEN 'pass' ELSE 'warn' END AS expected, 'pass' AS epub FROM r
)
SELECT *, CASE WHEN list_contains([preserved, dashes, newlines, has_chapters, titles, coverage, expected], 'fail') THEN 'fail' WHEN list_contains([preserved, dashes, newlines, has_chapters, titles, coverage, expected], 'warn') THEN 'warn' ELSE 'pass' END AS worst FROM q"""
