r"""SQL of the queries whose results need more than a few lines of it: sections, export, doubled words, chunks, incidents, transcripts, pages.

Everything here is DuckDB's dialect and is written from what the operators are
meant to do, not from their plans: sections by windows over lines, folds over
time by recursion.
"""

from __future__ import annotations

from marlstone import patterns as p
from marlstone.functions import text as t
from marlstone.operators import guards, quality, routing, transcripts
from marlstone.plans import reading
from marlstone.plans.noisy import noisy_sql
from marlstone.queries import _INCIDENTS_SQL, _ITEM, _SLUG, _STRONG, _STRUCTURAL, _WEAK, lines_sql, lit

STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIPPED.format(x)


def count(pattern: str, text: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({text}, {lit(pattern)})) AS BIGINT)"


TOKENS = "CAST(greatest(1, length({0}) // 4) AS BIGINT)"


# --- doubled words ----------------------------------------------------------------------------
def doubled(w: str) -> str:
    return f"(length({w}) >= 4 AND length({w}) % 2 = 0 AND len(list_filter(range(0, length({w}) // 2), lambda i: substr({w}, 2 * i + 1, 1) <> substr({w}, 2 * i + 2, 1))) = 0)"


def half(w: str) -> str:
    return f"CASE WHEN {doubled(w)} THEN array_to_string(list_transform(range(0, length({w}) // 2), lambda i: substr({w}, 2 * i + 1, 1)), '') ELSE {w} END"


#: From words(doc_id, word): shadows(doc_id, word, single).
SHADOWS = rf"""
h1 AS (SELECT doc_id, word, {half("word")} AS w1 FROM words WHERE {doubled("word")}), h2 AS (SELECT *, {half("w1")} AS w2 FROM h1), h3 AS (SELECT doc_id, word, {half("w2")} AS single FROM h2),
shadows AS (SELECT * FROM h3 WHERE regexp_matches(regexp_replace(lower(single), '[acgtu]', '', 'g'), '\p{{L}}') AND NOT regexp_full_match(single, '[0-9A-Fa-f]+')
  AND regexp_matches(lower(single), '[aeiouy]') AND regexp_matches(regexp_replace(lower(single), '[aeiouy]', '', 'g'), '\p{{L}}'))"""

SHADOW_WORDS = rf"""WITH noisy AS ({noisy_sql("print")}), words AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word FROM noisy),{SHADOWS}
SELECT doc_id, word, single, CAST(len(list_filter(range(0, length(word) // 2), lambda i: regexp_matches(substr(word, 2 * i + 1, 1), '[A-Za-z]'))) AS INTEGER) AS pairs FROM shadows"""

_COUNTERS = {"headings": quality.HEADING, "toc_residue": quality.TOC_RESIDUE, "lone_bullets": quality.LONE_BULLET, "raw_bullet_lines": quality.RAW_BULLET, "hard_wrap_hints": quality.HARD_WRAP, "prepress_residue": quality.PREPRESS}


def scored(*blocks: str) -> str:
    """Tables up to scored(doc_id, chars, est_tokens, counters, fences, doubled_words, score)."""
    costs = " - ".join(f"(CASE WHEN {c} > 0 THEN least({most}, 1 + {c} // {per}) ELSE 0 END)" for c, per, most, _ in quality.COSTS)
    return rf"""WITH noisy AS ({noisy_sql(*blocks)}),
words AS (SELECT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS word FROM noisy) WHERE length(word) >= 6 AND regexp_full_match(word, '[A-Za-z]+')),{SHADOWS},
dw AS (SELECT doc_id, count(*) AS n FROM shadows GROUP BY doc_id),
counted AS (SELECT noisy.doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) // 4 AS BIGINT) AS quarter, {", ".join(f"{count(r)} AS {k}" for k, r in _COUNTERS.items())}, {count(quality.FENCE)} AS fences, coalesce(n, 0) AS doubled_words FROM noisy LEFT JOIN dw ON noisy.doc_id = dw.doc_id),
scored AS (SELECT *, greatest(1, quarter) AS est_tokens, CAST(greatest(0, 100 - (CASE WHEN chars > {quality.BIG_DOCUMENT} AND headings = 0 THEN 25 ELSE 0 END) - (CASE WHEN fences % 2 = 1 THEN 15 ELSE 0 END) - {costs}) AS INTEGER) AS score FROM counted)"""


QUALITY_BY_LANG = scored("numbers", "toc", "chapters", "characters", "bullets", "print", "wrapped", "fence") + """
SELECT lang, count(*) AS n_docs, CAST(sum(score) AS BIGINT) AS score_sum, CAST(min(score) AS BIGINT) AS score_min, CAST(max(score) AS BIGINT) AS score_max, CAST(sum(est_tokens) AS BIGINT) AS tokens
FROM scored JOIN documents USING (doc_id) GROUP BY lang"""

_ISSUES = ", ".join(["CASE WHEN chars > 20000 AND headings = 0 THEN 'no headings' END", "CASE WHEN fences % 2 = 1 THEN 'unbalanced code fences' END", *(f"CASE WHEN {c} > 0 THEN CAST({c} AS VARCHAR) || ' {label}' END" for c, _, _, label in quality.COSTS)])
QUALITY_REPORTS = scored() + f""", r AS (SELECT *, array_to_string([x FOR x IN [{_ISSUES}] IF x IS NOT NULL], '; ') AS issues FROM scored)
SELECT doc_id, score, false AS binary_noise, CAST(doubled_words AS INTEGER) AS doubled_words, issues,
  'Quality ' || score || '/100 - ~' || format('{{:,}}', est_tokens) || ' tokens, ' || headings || ' heading(s), ' || fences // 2 || ' code block(s)' || CASE WHEN issues <> '' THEN ', issues: ' || issues ELSE '' END AS summary FROM r"""


# --- sections -----------------------------------------------------------------------------------
def chapters(lines: str, budget: int) -> str:
    """Tables up to parts(doc_id, section_no, title, markdown, est_tokens), from ``lines`` as far as marked(doc_id, pos, line, is_fence, in_code)."""
    no_text = r"regexp_full_match(x, '\s*(<!--.*?-->)?\s*')"
    return rf"""{lines},
h AS (SELECT *, NOT in_code AND regexp_matches(line, {lit(p.H1.pattern)}) AS top FROM marked),
k AS (SELECT *, top AND regexp_matches({strip("line")}, {lit("(?i)" + p.BOOK_HEADING.pattern)}) AS book FROM h),
m AS (SELECT *, count(CASE WHEN book THEN 1 END) OVER (PARTITION BY doc_id) AS books FROM k),
c AS (SELECT *, CASE WHEN books >= {p.BOOK_HEADINGS} THEN book ELSE top END AS cut FROM m),
s AS (SELECT *, count(CASE WHEN cut THEN 1 END) OVER (PARTITION BY doc_id) AS cuts, count(CASE WHEN cut THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter FROM c),
whole AS (SELECT doc_id, 0 AS chapter, '' AS title, string_agg(line, chr(10) ORDER BY pos) AS md FROM s WHERE cuts < 2 GROUP BY doc_id),
raw AS (SELECT doc_id, chapter, coalesce(max(CASE WHEN cut THEN regexp_extract(line, {lit(p.H1.pattern)}, 1) END), '{p.LEAD_TITLE}') AS title, {strip("string_agg(line, chr(10) ORDER BY pos)")} || chr(10) AS md FROM s WHERE cuts >= 2 GROUP BY doc_id, chapter),
solid0 AS (SELECT *, starts_with(md, '#') AND len([x FOR x IN string_split(md, chr(10))[2:] IF NOT {no_text}]) = 0 AS bare FROM raw WHERE chapter > 0 OR md <> chr(10)),
g AS (SELECT *, count(CASE WHEN NOT bare THEN 1 END) OVER (PARTITION BY doc_id ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp, count(CASE WHEN NOT bare THEN 1 END) OVER (PARTITION BY doc_id) AS solid FROM solid0),
folded AS (SELECT doc_id, max(chapter) AS chapter, arg_max(title, chapter) AS title, string_agg(CASE WHEN bare THEN regexp_replace(md, '\s+$', '') ELSE md END, chr(10) || chr(10) ORDER BY chapter) AS md FROM g WHERE grp < solid GROUP BY doc_id, grp
  UNION ALL SELECT doc_id, chapter, title, md FROM g WHERE grp = solid),
long_lines AS (SELECT doc_id, chapter, title, CAST(unnest(range(len(string_split(md, chr(10))))) AS INTEGER) AS i, unnest(string_split(md, chr(10))) AS line FROM folded WHERE length(md) // 4 > {budget}),
long_marked AS (SELECT *, sum(CAST(regexp_matches(line, '^\s*```') AS INTEGER)) OVER (PARTITION BY doc_id, chapter ORDER BY i) % 2 = 0 AND regexp_matches(line, {lit(p.H2.pattern)}) AS sub FROM long_lines),
long_cut AS (SELECT *, count(CASE WHEN sub THEN 1 END) OVER (PARTITION BY doc_id, chapter) AS subs, count(CASE WHEN sub THEN 1 END) OVER (PARTITION BY doc_id, chapter ORDER BY i) AS n FROM long_marked),
pieces AS (SELECT doc_id, chapter, n, CASE WHEN n = 0 THEN any_value(title) ELSE any_value(title) || ' — ' || max(CASE WHEN sub THEN regexp_extract(line, {lit(p.H2.pattern)}, 1) END) END AS title, {strip("string_agg(line, chr(10) ORDER BY i)")} || chr(10) AS md FROM long_cut WHERE subs > 1 GROUP BY doc_id, chapter, n),
every AS (SELECT doc_id, chapter, 0 AS n, title, md FROM whole UNION ALL SELECT doc_id, chapter, 0, title, md FROM folded WHERE (doc_id, chapter) NOT IN (SELECT (doc_id, chapter) FROM pieces)
  UNION ALL SELECT doc_id, chapter, n, title, md FROM pieces WHERE n > 0 OR md <> chr(10)),
parts AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chapter, n) - 1 AS INTEGER) AS section_no, title, md AS markdown, {TOKENS.format("md")} AS est_tokens FROM every)"""


CHAPTER_SPLIT = chapters(lines_sql("chapters", "images", "fence"), 200) + " SELECT * FROM parts"
#: Lines with image links outside code as notes of what they show.
_NOTED = r"""regexp_replace(regexp_replace(regexp_replace(x, '!\[\s*\]\([^)]+\)', '[Figure]', 'g'), '!\[\s*((?i:figure)[^\]]*?)\s*\]\([^)]+\)', '[\1]', 'g'), '!\[\s*([^\]]*?)\s*\]\([^)]+\)', '[Figure: \1]', 'g')"""


def noted(lines: str) -> str:
    parts = r"regexp_extract_all(line, '`+[^`]*`+|[^`]+|`+')"
    return lines.replace("marked AS (SELECT *,", "marked1 AS (SELECT *,") + f""",
marked AS (SELECT doc_id, pos, is_fence, in_code, CASE WHEN in_code THEN line ELSE array_to_string([CASE WHEN x[1] = '`' THEN x ELSE {_NOTED} END FOR x IN {parts}], '') END AS line FROM marked1)"""


NOTEBOOK_SOURCES = chapters(noted(lines_sql("chapters", "images", "fence")), p.NOTEBOOK_TOKENS) + " SELECT * FROM parts"

#: From parts: named(doc_id, section_no, title, markdown, est_tokens, n, total, file).
NAMED = f""",
n1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS n, count(*) OVER (PARTITION BY doc_id) AS total, first_value(title) OVER (PARTITION BY doc_id ORDER BY section_no) AS opening FROM parts),
n2 AS (SELECT *, n - CASE WHEN opening = '{p.LEAD_TITLE}' OR starts_with(opening, '{p.LEAD_TITLE} (part ') THEN 1 ELSE 0 END AS number, CASE WHEN title = '' THEN 'section' ELSE title END AS shown FROM n1),
n3 AS (SELECT *, lpad(CAST(number AS VARCHAR), CAST(greatest(2, length(CAST(number AS VARCHAR))) AS INTEGER), '0') || '-' || CASE WHEN {_SLUG.format("shown", 60)} = '' THEN 'section' ELSE {_SLUG.format("shown", 60)} END AS name FROM n2),
named AS (SELECT * EXCLUDE (opening, number, shown, name), name || repeat('-b', CAST(row_number() OVER (PARTITION BY doc_id, name ORDER BY section_no) - 1 AS INTEGER)) || '.md' AS file FROM n3)"""
_IMAGES = count(p.IMAGE_LINK.pattern, "{0}")
_FIRST_LINE = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))[1]"
_H1 = lit(p.H1.pattern)


def titled(fallback: str) -> str:
    return f"CASE WHEN regexp_matches({_FIRST_LINE}, {_H1}) THEN regexp_extract({_FIRST_LINE}, {_H1}, 1) ELSE {fallback} END"


BOOK_MANIFESTS = chapters(lines_sql("chapters", "images"), 200) + NAMED + f""",
f AS (SELECT doc_id, list({{'file': file, 'title': title, 'est_tokens': est_tokens, 'image_count': {_IMAGES.format("markdown")}}} ORDER BY n) AS files FROM named GROUP BY doc_id)
SELECT noisy.doc_id, CAST(to_json({{'title': {titled("source")}, 'author': '', 'summary': '', 'source': source, 'engine': 'html', 'converted': '2020-01-01', 'total_est_tokens': {TOKENS.format("noisy.text")}, 'total_images': {_IMAGES.format("noisy.text")}, 'files': files}}) AS VARCHAR) AS manifest
FROM noisy JOIN f USING (doc_id) JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)"""


def quoted(x: str) -> str:
    return f"""CASE WHEN regexp_matches({x}, '[:#\\[\\]{{}}"''|>&%@`,]') THEN '"' || replace(replace({x}, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE {x} END"""


BOOK_FILES = chapters(lines_sql("chapters", "images"), p.DEFAULT_TOKENS) + NAMED + f""",
b AS (SELECT named.*, noisy.text, source, {titled("source")} AS book FROM named JOIN noisy USING (doc_id) JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)),
q AS (SELECT *, CASE WHEN total = 1 THEN book WHEN title = '' THEN book ELSE title END AS head, CASE WHEN total = 1 THEN text ELSE markdown END AS body FROM b)
SELECT doc_id, CASE WHEN total = 1 THEN source || '.md' ELSE file END AS file,
  '---' || chr(10) || 'title: ' || {quoted("head")} || chr(10) || CASE WHEN total > 1 THEN 'book: ' || {quoted("book")} || chr(10) ELSE '' END || 'author: "A: B"' || chr(10) || CASE WHEN total > 1 THEN 'part: ' || n || ' of ' || total || chr(10) ELSE '' END
  || 'source: ' || source || '.pdf' || chr(10) || 'converted: 2020-01-01' || chr(10) || 'converter: reader' || chr(10) || 'est_tokens: ' || {TOKENS.format("body")} || chr(10) || CASE WHEN {_IMAGES.format("body")} > 0 THEN 'image_count: ' || {_IMAGES.format("body")} || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || body AS content FROM q"""

BOOK_INDEXES = chapters(lines_sql("chapters"), 200) + NAMED + f""",
r AS (SELECT doc_id, max(total) AS total, string_agg('- [' || CASE WHEN title = '' THEN '{p.LEAD_TITLE}' ELSE title END || '](' || file || ')', chr(10) ORDER BY n) AS rows FROM named WHERE total > 1 GROUP BY doc_id)
SELECT doc_id, '# ' || {titled("'book'")} || chr(10) || chr(10) || 'Converted from **book.pdf** — ' || total || ' parts.' || chr(10) || chr(10) || rows || chr(10) AS content FROM r JOIN noisy USING (doc_id)"""

_BOOK = titled("'The Book: of things'")
NOTEBOOK_FILES = chapters(noted(lines_sql("chapters", "images")), p.NOTEBOOK_TOKENS) + NAMED + f""",
b AS (SELECT named.*, {_BOOK} AS book FROM named JOIN noisy USING (doc_id)),
l AS (SELECT doc_id, string_agg(n || '. ' || CASE WHEN title = '' THEN '{p.LEAD_TITLE}' ELSE title END, chr(10) ORDER BY n) AS listed FROM named GROUP BY doc_id),
main_titles AS (SELECT *, regexp_replace(regexp_replace(book, '(\\s*[:–—]\\s+|\\s+-\\s+).*$', ''), '[''’]', '', 'g') AS main FROM b JOIN l USING (doc_id)),
q AS (SELECT *, regexp_replace({_SLUG.format("main", 200)}, '^(?:the|an?)-(.)', '\\1') AS slug FROM main_titles)
SELECT doc_id, slug || '-' || file AS file,
  '*' || book || '* by A' || CASE WHEN total = 1 THEN '' ELSE ' — part ' || n || ' of ' || total || CASE WHEN title <> '' THEN ': ' || title ELSE '' END END || CASE WHEN n = 1 THEN chr(10) || chr(10) || 'Summary: s' ELSE '' END
  || CASE WHEN n = 1 AND total > 1 THEN chr(10) || chr(10) || 'This document is split into ' || total || ' sources:' || chr(10) || chr(10) || listed ELSE '' END || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown AS content FROM q"""


# --- chunks for models -----------------------------------------------------------------------------
def chunked(*blocks: str) -> str:
    """Tables up to chunks(doc_id, chunk_no, chunk): the recursion goes from chunk to chunk."""
    return f"""WITH RECURSIVE noisy AS ({noisy_sql(*blocks)}),
l AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS i, unnest(string_split(text, chr(10))) AS line FROM noisy),
w AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(CAST(regexp_matches(line, '^\\s*```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 0 AND NOT regexp_matches(line, '\\S') AS stop FROM l),
a AS (SELECT doc_id, max(i) AS n, list(line ORDER BY i) AS lines, list(upto ORDER BY i) AS upto, coalesce(list(i ORDER BY i) FILTER (stop), []) AS stops FROM w GROUP BY doc_id),
c AS (SELECT doc_id, -1 AS chunk_no, 0 AS start, 0 AS fin FROM a
  UNION ALL SELECT c.doc_id, chunk_no + 1, fin, coalesce(list_filter(stops, lambda k: k > fin AND upto[k] >= coalesce(upto[nullif(fin, 0)], 0) + {guards.CHUNK_CHARS})[1], n) FROM c JOIN a ON c.doc_id = a.doc_id WHERE fin < n),
chunks AS (SELECT c.doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, array_to_string(lines[start + 1:fin], chr(10)) AS chunk FROM c JOIN a ON c.doc_id = a.doc_id WHERE chunk_no >= 0)"""


MODEL_CHUNKS = chunked("boilerplate", "fence") + " SELECT * FROM chunks"
POLISH_GUARD = chunked("boilerplate") + f""",
r AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN '```markdown' || chr(10) || chunk || chr(10) || '```' WHEN 1 THEN translate(chunk, 'aeiou', 'AEIOU') ELSE 'no' END AS reply FROM chunks),
o AS (SELECT doc_id, chunk_no, chunk, CASE WHEN length(reply) / greatest(length(chunk), 1) BETWEEN {guards.MIN_RATIO} AND {guards.MAX_RATIO} THEN CASE WHEN doc_id % 3 = 0 THEN chunk ELSE reply END ELSE chunk END AS out FROM r)
SELECT doc_id, string_agg(out, chr(10) ORDER BY chunk_no) AS text, count(CASE WHEN out <> chunk THEN 1 END) AS changed FROM o GROUP BY doc_id"""


# --- codes and incidents -----------------------------------------------------------------------------
CATALOG = "(VALUES " + ", ".join(f"({', '.join(map(lit, row))})" for row in routing.CATALOG) + ") catalog(code, severity, title, next_step)"
CODE_GUIDE = f"""SELECT CASE substr(code, 4, 1) {" ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in reading.AREAS.items())} END AS area,
'| Code | What happened | What to do |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || code || ' | ' || title || CASE WHEN severity = 'warning' THEN ' *(warning)*' ELSE '' END || ' | ' || next_step || ' |', chr(10) ORDER BY code) AS markdown FROM {CATALOG} GROUP BY 1"""
INCIDENT_EXPLAIN = _INCIDENTS_SQL + f" SELECT seq, i.code, severity, title, next_step FROM i LEFT JOIN {CATALOG} ON i.code = catalog.code"
INCIDENT_TEXTS = _INCIDENTS_SQL + f""" SELECT seq, 'Error ' || i.code || ' · Ref ' || hex(seq) || chr(10) || 'What happened: ' || title || chr(10) || 'Next step: ' || next_step || chr(10) || 'Where: ' || place || chr(10) || 'k: ' || k || chr(10) || 'Technical details: ' || message AS details,
title || ' ' || next_step || ' (' || i.code || ', ref ' || hex(seq) || ')' AS line FROM i JOIN {CATALOG} ON i.code = catalog.code"""
INCIDENT_DEDUPE = _INCIDENTS_SQL.replace("WITH e AS", "WITH RECURSIVE e AS") + """,
r AS (SELECT code, place, message, min((t, seq)) AS moment FROM i GROUP BY ALL
  UNION ALL SELECT code, place, message, nxt FROM (SELECT r.code, r.place, r.message, (SELECT min((i.t, i.seq)) FROM i WHERE i.code = r.code AND i.place = r.place AND i.message = r.message AND i.t >= r.moment[1] + INTERVAL 3600 SECOND) AS nxt FROM r) WHERE nxt IS NOT NULL)
SELECT moment[2] AS seq, moment[1] AS t, code, place AS "where" FROM r"""

_EXT = "element_at(['.pdf', '.mp3', '.PNG', '.docx', ''], CAST(event_id % 5 + 1 AS BIGINT))"
ROUTE_FILES = f"""WITH f AS (SELECT 'f' || event_id || ['.pdf', '.mp3', '.PNG', '.docx', ''][event_id % 5 + 1] AS path, lower(['pdf', 'mp3', 'PNG', 'docx', ''][event_id % 5 + 1]) AS ext, event_id, user_id AS u, value / 100 AS ratio FROM events)
SELECT path, CASE WHEN event_id % 11 = 0 THEN 'missing' WHEN event_id % 13 = 0 THEN 'directory' WHEN ext = 'png' AND u % 2 = 0 THEN 'ocr' WHEN ext = 'pdf' AND u % 7 = 0 THEN 'mineru' WHEN ext = 'pdf' AND u % 3 = 0 AND ratio >= {routing.SCAN_SHARE} THEN 'ocr+text'
  WHEN ext = 'pdf' AND u % 2 = 0 AND u >= {routing.LAYOUT_CHARS} THEN 'pdflayout' WHEN ext = 'pdf' AND u % 5 = 0 AND u >= {routing.LAYOUT_CHARS} THEN 'pdftext' WHEN ext = 'mp3' AND u % 3 = 0 THEN 'whisper' ELSE 'markitdown' END AS route FROM f"""
RESULT_DIAGNOSIS = _INCIDENTS_SQL + """, x AS (SELECT seq, ['.pdf', '.mp3', '.png', '.docx'][k % 4 + 1] AS ext, k, CASE WHEN k % 5 <> 0 THEN message END AS error, CASE WHEN k % 5 <> 0 THEN code END AS own, k % 2 = 0 AS ocr, k % 7 = 0 AS audio FROM i),
y AS (SELECT *, CASE WHEN k % 3 = 1 THEN 'MS-111' END AS special FROM x)
SELECT seq, 'f' || seq || ext AS path, error, ocr, audio,
  CASE WHEN error IS NULL THEN NULL WHEN special IS NOT NULL AND own NOT IN ('MS-101', 'MS-102') THEN special WHEN own IN ('MS-105', 'MS-106', 'MS-199') AND ext = '.mp3' AND NOT audio THEN 'MS-115'
    WHEN own = 'MS-106' AND NOT ocr AND ext IN ('.pdf', '.png') THEN 'MS-110' ELSE own END AS error_code,
  CASE WHEN error IS NOT NULL OR k % 3 = 2 THEN '' WHEN k % 3 = 0 THEN 'MS-125,MS-121' ELSE 'MS-123' END AS warnings FROM y"""


# --- transcripts ------------------------------------------------------------------------------------
TRANSCRIPTS = f"""WITH RECURSIVE s AS (SELECT conv_id AS media_id, turn AS seq, CAST(turn AS DOUBLE) * 10 AS b, CAST(turn AS DOUBLE) * 10 + least(9, length(text) // 10) AS e, {strip("text")} AS text FROM conversations),
g AS (SELECT *, sum(CASE WHEN coalesce(b - pe <= {transcripts.GAP_S}, false) THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY seq) AS piece, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS i FROM (SELECT *, lag(e) OVER (PARTITION BY media_id ORDER BY seq) AS pe FROM s WHERE text <> '')),
u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY media_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY media_id, piece) AS last FROM g),
r AS (SELECT media_id, 1::BIGINT AS start FROM u GROUP BY media_id
  UNION ALL SELECT r.media_id, nxt FROM (SELECT r.media_id, (SELECT min(v.i) + 1 FROM u v WHERE v.media_id = r.media_id AND v.i >= r.start AND (v.i = a.last OR v.upto - a.upto + length(a.text) + 1 > {transcripts.PARAGRAPH_CHARS})) AS nxt FROM r JOIN u a ON a.media_id = r.media_id AND a.i = r.start) r WHERE EXISTS (SELECT 1 FROM u w WHERE w.media_id = r.media_id AND w.i = nxt)),
q AS (SELECT u.*, (SELECT max(start) FROM r WHERE r.media_id = u.media_id AND start <= u.i) AS start FROM u),
para AS (SELECT media_id, start, CAST(floor(min(b)) AS BIGINT) AS sec, string_agg(text, ' ' ORDER BY i) AS text FROM q GROUP BY media_id, start)
SELECT media_id, string_agg('**[' || CASE WHEN sec >= 3600 THEN lpad(CAST(sec // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(sec % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') || ']** ' || text, chr(10) || chr(10) ORDER BY start) AS markdown FROM para GROUP BY media_id"""


# --- pages -------------------------------------------------------------------------------------------
#: The segments of drawn turns: forty characters a line, cut where two blanks or more follow each other.
_DRAWN = r"""WITH p AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, replace(text, chr(10), ' ') AS text FROM conversations),
l AS (SELECT doc_id, page, CAST(unnest(range((length(text) + 39) // 40)) AS INTEGER) AS k, text FROM p),
d AS (SELECT doc_id, page, 1000 + k AS line, 700 - 14 * k AS y, substr(text, 40 * k + 1, 40) AS drawn FROM l WHERE 705 - 14 * k >= -1
  UNION ALL SELECT doc_id, page, 0, 980, 'Collected Conversations' FROM p UNION ALL SELECT doc_id, page, 1000000, 20, CAST(page + 1 AS VARCHAR) FROM p),
x AS (SELECT doc_id, page, line, y, string_split_regex(drawn, ' {2,}') AS parts, drawn FROM d),
z AS (SELECT doc_id, page, line, y, drawn, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS part FROM x),
segs AS (SELECT doc_id, page, line, y, k, trim(part) AS text FROM z WHERE trim(part) <> '')"""
PAGE_SEGMENTS = _DRAWN + """ SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line, k) - 1 AS INTEGER) AS seg, text, CAST(y AS DOUBLE) AS y0, CAST(y + 10 AS DOUBLE) AS y1 FROM segs"""
PAGE_FURNITURE = _DRAWN + """, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line, k) - 1 AS INTEGER) AS seg FROM segs), c AS (SELECT doc_id, count(DISTINCT page) AS pages, max(page) + 1 AS total FROM p GROUP BY doc_id)
SELECT n.doc_id, page, seg FROM n JOIN c ON n.doc_id = c.doc_id WHERE (line = 0 AND pages >= 3) OR (line = 1000000 AND pages >= greatest(2, 0.2 * total))"""

# --- figures -----------------------------------------------------------------------------------------
_CASES = "WITH f0 AS (SELECT doc_id, n, (n + 1) // 2 AS page, n % 2 + 1 AS k, md5(CAST((doc_id + n * 2) % 6 AS VARCHAR)) AS sha1 FROM (SELECT doc_id, unnest(range(1, 6)) AS n FROM documents)), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sha1 ORDER BY page, k) AS rn FROM f0) WHERE rn = 1)"
FIGURE_LINKS = _CASES + """,
l AS (SELECT doc_id, page, k, '![' || CASE WHEN n = 2 THEN 'a (b)' ELSE 'Figure ' || page || '.' || k END || '](images/fig%20' || n || '.png)' AS link FROM f),
g AS (SELECT doc_id, max(CASE WHEN page = 1 AND k = 1 THEN link END) AS first, string_agg(CASE WHEN page = 2 THEN chr(10) || chr(10) || link END, '' ORDER BY k) AS second,
  string_agg(CASE WHEN page = 3 OR page = 1 AND k <> 1 THEN chr(10) || '- ' || link END, '' ORDER BY page, k) AS loose FROM l GROUP BY doc_id)
SELECT d.doc_id, text || CASE WHEN first IS NOT NULL THEN chr(10) || first || chr(10) ELSE '' END || chr(10) || 'between' || chr(10) || '<!-- page 2 -->' || coalesce(second, '') || chr(10) || 'after' || chr(10) || 'end'
  || CASE WHEN loose IS NOT NULL THEN chr(10) || chr(10) || '## Extracted figures' || chr(10) || loose ELSE '' END AS text FROM documents d JOIN g ON d.doc_id = g.doc_id"""


# --- titles, languages, replies ------------------------------------------------------------------------
_FIRST = "string_split(text, chr(10))[1]"
_SQUASH = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_SMALL = ", ".join(map(lit, t.SMALL_WORDS))
_EDITION = lit("(?i)" + t.EDITION)
TITLE_HELPERS = rf"""WITH a AS (SELECT doc_id, text, {_FIRST} AS f, lower(regexp_extract(text, '^(\S*)', 1)) AS w FROM documents),
b AS (SELECT *, {_SQUASH.format("f")} AS s, regexp_replace(f, '(?s)(\s*[:–—]\s+|\s+-\s+).*$', '') AS head FROM a),
c AS (SELECT *, CASE WHEN head = '' THEN f ELSE head END AS main FROM b), d AS (SELECT *, {strip(f"regexp_replace(main, {_EDITION}, '', 'g')")} AS bare FROM c),
e AS (SELECT *, regexp_replace({_SLUG.format("replace(replace(CASE WHEN bare = '' THEN main ELSE bare END, '''', ''), '’', '')", 200)}, '^(?:the|an?)-(.)', '\1') AS slug0 FROM d),
g AS (SELECT *, CASE WHEN slug0 = '' THEN 'section' ELSE slug0 END AS slug, [['i', '1'], ['v', '5'], ['x', '10'], ['l', '50'], ['c', '100'], ['d', '500'], ['m', '1000']] AS romans FROM e)
SELECT doc_id, CASE WHEN length(slug) <= 40 THEN slug WHEN contains(substr(slug, 1, 41), '-') THEN regexp_replace(substr(slug, 1, 41), '-[^-]*$', '') ELSE substr(slug, 1, 40) END AS prefix,
  array_to_string(list_transform(string_split(s, ' '), lambda x, i: CASE WHEN regexp_matches(x, '^\p{{Ll}}') AND (i = 1 OR NOT list_contains([{_SMALL}], lower(x))) THEN CASE WHEN x[1] = 'ß' THEN 'SS' ELSE upper(x[1]) END || x[2:] ELSE x END), ' ') AS title,
  CASE WHEN length(s) BETWEEN 3 AND 200 AND NOT regexp_matches(s, {lit(t.FILE_TITLE)}) AND regexp_matches(s, '[A-Za-z]{{3}}') AND NOT regexp_matches(s, '(?i)^(?:untitled|microsoft word|document)') THEN s ELSE '' END AS meta,
  regexp_replace(regexp_replace(regexp_replace(f, '(\w)�(s|t|d|m|ll|re|ve)\b', '\1’\2', 'g'), '(\w)�(\w)', '\1—\2', 'g'), '�', '', 'g') AS repaired, {_SQUASH.format("regexp_replace(lower(f), '[0-9]+', '#', 'g')")} AS key,
  CASE WHEN w <> '' AND regexp_full_match(w, {lit(p.ROMAN)}) THEN CAST(list_sum(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN i < length(w) AND CAST([r[2] FOR r IN romans IF r[1] = w[i + 1]][1] AS INTEGER) > CAST([r[2] FOR r IN romans IF r[1] = w[i]][1] AS INTEGER) THEN -1 ELSE 1 END * CAST([r[2] FOR r IN romans IF r[1] = w[i]][1] AS INTEGER))) AS INTEGER) END AS roman,
  coalesce(len(regexp_extract_all(f, '\d')) / nullif(len(regexp_extract_all(f, '\S')), 0), 0.0::DOUBLE) AS digits,
  CASE WHEN length({_SQUASH.format("replace(text, '|', chr(92) || '|')")}) <= 90 THEN {_SQUASH.format("replace(text, '|', chr(92) || '|')")} ELSE substr({_SQUASH.format("replace(text, '|', chr(92) || '|')")}, 1, 89) || '…' END AS cell,
  CASE WHEN length({strip("text")}) <= 160 THEN {strip("text")} ELSE substr({strip("text")}, 1, 159) || '…' END AS sample FROM g"""

def code_scores(text: str = "text") -> dict[str, str]:
    """Counts of each language's signs; what only a look ahead could leave out is taken off again."""
    out = {k: count(f"(?m){r.pattern}", text) for k, r in p.LANGUAGES.items()}
    ahead = r"(?!java\.|javax\.|kotlin|android\.|org\.|com\.)"
    out["python"] = f"({count('(?m)' + p.LANGUAGES['python'].pattern.replace(ahead, ''), text)} - {count(ahead.replace('(?!', '(?m)^' + chr(92) + 's*import' + chr(92) + 's+(?:'), text)})"
    return out


LANGUAGE_GUESS = f"""WITH noisy AS ({noisy_sql("code")}), a AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in code_scores().items())}, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> '') AS solid FROM noisy),
b AS (SELECT *, coalesce(len([x FOR x IN solid IF regexp_matches(x, '[;{{}}]$')]) / nullif(len(solid), 0), 0.0::DOUBLE) AS c_share, list_sort([{", ".join(f"[-{k}, {i}]" for i, k in enumerate(p.LANGUAGES))}]) AS ranked FROM a)
SELECT doc_id, {", ".join(p.LANGUAGES)}, c_share, CASE WHEN -ranked[1][1] >= greatest(1, -2 * ranked[2][1]) OR -ranked[1][1] >= 2 AND c_share >= {p.C_SHARE} THEN [{", ".join(map(lit, p.LANGUAGES))}][ranked[1][2] + 1] ELSE '' END AS language FROM b"""

_BARE = "regexp_replace({0}, '^[\"''“”]+|[\"''“”]+$', '', 'g')"
_NAMED_BARE = "regexp_replace(" + _BARE.format("s0") + r", '(?i)^(?:summary|tl;dr)\s*:\s*', '')"
SUMMARY_GUARD = rf"""WITH r AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '<think>x</think>Summary: ' || text WHEN 1 THEN '{{"summary": "' || replace(replace(replace(text, '"', ' '), chr(10), ' '), chr(92), ' ') || '", "insufficient_content": false}}' WHEN 2 THEN 'I cannot help with this document, please provide the text of it.' ELSE text END AS reply FROM documents),
u AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN json_extract_string(reply, '$.summary') ELSE reply END AS unwrapped FROM r),
s0 AS (SELECT *, {_SQUASH.format("regexp_replace(unwrapped, '(?is)<think>.*?</think>', '', 'g')")} AS s0 FROM u),
s1 AS (SELECT *, {_BARE.format(_NAMED_BARE)} AS s FROM s0),
s2 AS (SELECT *, regexp_extract(substr(s, 1, {guards.MAX_SUMMARY}), '(?s)^(.*[.!?]) ', 1) AS head FROM s1)
SELECT doc_id, CASE WHEN contains(s, '```') OR length(s) < {guards.MIN_SUMMARY} OR regexp_matches(s, {lit(guards.REFUSAL)}) THEN NULL WHEN length(s) <= {guards.MAX_SUMMARY} THEN s WHEN length(head) > {guards.MIN_SUMMARY} THEN head END AS summary,
  nullif(substr({_SQUASH.format("reply")}, 1, {guards.MAX_CAPTION}), '') AS caption FROM s2"""

# --- passes that carry state ----------------------------------------------------------------------------
def fitted(budget: int) -> str:
    """After chapters(): fit(doc_id, section_no, k, title, md), long sections cut hard at the last place that fits."""
    most = budget * p.CHARS_PER_TOKEN
    return rf""",
hl AS (SELECT doc_id, section_no, CAST(unnest(range(len(string_split(markdown, chr(10))))) AS INTEGER) AS i, unnest(string_split(markdown, chr(10))) AS line FROM parts WHERE est_tokens > {budget}),
hm AS (SELECT *, regexp_matches(line, '^\s*```') AS mark, regexp_matches(line, '\S') AS solid FROM hl),
hn AS (SELECT *, sum(CAST(mark AS INTEGER)) OVER (PARTITION BY doc_id, section_no) % 2 = 0 AND coalesce(sum(CAST(mark AS INTEGER)) OVER (PARTITION BY doc_id, section_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM hm),
ho AS (SELECT *, CASE WHEN solid THEN NOT inside AND NOT mark AND regexp_matches(line, {lit(p.HEADING.pattern)}) END AS head FROM hn),
hp AS (SELECT *, i > 0 AND NOT inside AND NOT coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id, section_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS soft, lag(NOT solid) OVER (PARTITION BY doc_id, section_no ORDER BY i) AS after_blank FROM ho),
hq AS (SELECT doc_id, section_no, CAST(count(*) AS INTEGER) AS n, list(line ORDER BY i) AS ls, list_concat([0], list(upto ORDER BY i)) AS ends, list(inside ORDER BY i) AS insides, coalesce(list(i ORDER BY i) FILTER (soft), []) AS softs, coalesce(list(i ORDER BY i) FILTER (soft AND after_blank), []) AS blanks
  FROM (SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id, section_no ORDER BY i) AS INTEGER) AS upto FROM hp) GROUP BY doc_id, section_no),
hr AS (SELECT doc_id, section_no, 0 AS start, 0 AS fin FROM hq
  UNION ALL SELECT doc_id, section_no, fin, CASE WHEN lim >= n THEN n ELSE coalesce(list_max([b FOR b IN blanks IF b > fin AND b <= lim]), list_max([b FOR b IN softs IF b > fin AND b <= lim]), list_min([e FOR e IN range(greatest(lim, fin) + 1, n + 1) IF e = n OR NOT insides[e + 1]])) END
  FROM (SELECT hr.doc_id, hr.section_no, hr.fin, hq.*, list_max([c FOR c IN range(0, n + 1) IF ends[c + 1] <= ends[hr.fin + 1] + {most}]) AS lim FROM hr JOIN hq ON hr.doc_id = hq.doc_id AND hr.section_no = hq.section_no WHERE hr.fin < n)),
hs AS (SELECT hr.doc_id, hr.section_no, start, {strip("array_to_string(ls[start + 1:fin], chr(10))")} AS chunk FROM hr JOIN hq ON hr.doc_id = hq.doc_id AND hr.section_no = hq.section_no WHERE fin > start),
ht AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY start) AS k, count(*) OVER (PARTITION BY doc_id, section_no) AS chunks FROM hs WHERE chunk <> ''),
fit AS (SELECT p.doc_id, p.section_no, coalesce(k, 0) AS k, CASE WHEN chunks > 1 THEN CASE WHEN title = '' THEN 'Document' ELSE title END || ' (part ' || k || ')' ELSE title END AS title, CASE WHEN chunks > 1 THEN chunk || chr(10) ELSE markdown END AS md FROM parts p LEFT JOIN ht ON p.doc_id = ht.doc_id AND p.section_no = ht.section_no)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH noisy", "WITH RECURSIVE noisy", 1)


HARD_SPLIT = recursive(chapters(lines_sql("chapters", "images", "fence"), 100)) + fitted(100) + f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) - 1 AS INTEGER) AS section_no, title, md AS markdown, {TOKENS.format("md")} AS est_tokens FROM fit"""

SECTION_FETCH = recursive(chapters(lines_sql("chapters"), p.DEFAULT_TOKENS)) + fitted(p.DEFAULT_TOKENS) + """,
sf AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) - 1 AS INTEGER) AS section_no, md FROM fit)
SELECT d.doc_id, w.n AS section_no, md AS markdown, CASE WHEN md IS NULL THEN 'MS-132' END AS error_code FROM documents d CROSS JOIN (SELECT unnest([1, 3])::INTEGER AS n) w LEFT JOIN sf ON d.doc_id = sf.doc_id AND w.n = section_no"""

_LOCAL = p.TARGETS["Local LLM"]
DOCUMENT_OUTLINES = scored("chapters").replace("WITH noisy", "WITH RECURSIVE noisy", 1) + "," + chapters(lines_sql("chapters"), _LOCAL).split("lines AS (", 1)[1].join(["lines AS (", ""]) + fitted(_LOCAL) + f""",
of1 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) - 1 AS i, CASE WHEN title = '' THEN '(document)' ELSE title END AS title, {TOKENS.format("md")} AS est FROM fit),
of2 AS (SELECT doc_id, list({{'index': i, 'title': title, 'est_tokens': est}} ORDER BY i) AS listed FROM of1 GROUP BY doc_id)
SELECT noisy.doc_id, {titled("'document'")} AS title, {TOKENS.format("noisy.text")} AS est_tokens, score, CAST(to_json(listed) AS VARCHAR) AS sections FROM noisy JOIN scored ON noisy.doc_id = scored.doc_id JOIN of2 ON noisy.doc_id = of2.doc_id"""

_ROOM = p.CHARS_PER_TOKEN * (500 + 1)
PACKED_PARTS = recursive(chapters(lines_sql("chapters", "images", "fence"), 500)) + fitted(500) + rf""",
ka AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) AS i, starts_with(md, '#') AND len([x FOR x IN string_split(md, chr(10))[2:] IF NOT regexp_full_match(x, '\s*(<!--.*?-->)?\s*')]) = 0 AS bare FROM fit),
kb AS (SELECT *, CAST(sum(length(md) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS upto FROM ka),
kc AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, list_concat([0], list(upto ORDER BY i)) AS s, list(bare ORDER BY i) AS bares, list(title ORDER BY i) AS titles, list(md ORDER BY i) AS mds FROM kb GROUP BY doc_id),
kd AS (SELECT doc_id, 0 AS start, 0 AS fin FROM kc
  UNION ALL SELECT doc_id, fin, CASE WHEN e = n THEN n ELSE coalesce(list_min([x FOR x IN range(greatest(fin + 1, least_start), e + 1) IF len([j FOR j IN range(x, e) IF NOT bares[j + 1]]) = 0]), e) END
  FROM (SELECT *, list_min([c FOR c IN range(0, n + 1) IF s[c + 1] >= s[least(e + 1, n) + 1] - {_ROOM}]) AS least_start FROM (SELECT kd.doc_id, kd.fin, kc.n, kc.s, kc.bares, greatest(list_max([c FOR c IN range(0, kc.n + 1) IF kc.s[c + 1] <= kc.s[kd.fin + 1] + {_ROOM}]), kd.fin + 1) AS e FROM kd JOIN kc ON kd.doc_id = kc.doc_id WHERE kd.fin < kc.n))),
ke AS (SELECT kd.doc_id, start, CASE WHEN fin = start + 1 THEN titles[fin] ELSE array_to_string([x FOR x IN [titles[start + 1], titles[fin]] IF x <> ''], ' – ') END AS title, array_to_string(mds[start + 1:fin], chr(10)) AS md FROM kd JOIN kc ON kd.doc_id = kc.doc_id WHERE fin > start)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS section_no, title, md AS markdown, {TOKENS.format("md")} AS est_tokens FROM ke"""

HEADING_PROMOTION = lines_sql("chapters") + rf""",
ch AS (SELECT doc_id, pos, trim(regexp_replace(regexp_extract(line, {lit(p.CHAPTER.pattern)}, 3), '\s+', ' ', 'g')) AS title, regexp_extract(line, {lit(p.CHAPTER.pattern)}, 1) || ' ' || regexp_extract(line, {lit(p.CHAPTER.pattern)}, 2) AS kind FROM lines WHERE regexp_matches(line, {lit(p.CHAPTER.pattern)})),
ti AS (SELECT doc_id, title, arg_min(kind, pos) || ': ' || title AS heading FROM ch WHERE length(title) >= {p.TITLE_LENGTH} GROUP BY doc_id, title),
en AS (SELECT doc_id, count(*) AS n, list(title) AS titles FROM ti GROUP BY doc_id HAVING count(*) >= {p.CHAPTER_TITLES}),
hd AS (SELECT l.doc_id FROM lines l JOIN en ON l.doc_id = en.doc_id WHERE regexp_matches(line, '^\s*#') AND len([x FOR x IN titles IF contains(line, x)]) > 0 GROUP BY 1),
sq AS (SELECT m.*, CASE WHEN is_fence THEN '' ELSE trim(regexp_replace(line, '\s+', ' ', 'g')) END AS w FROM marked m),
jo AS (SELECT *, w AS j1, CASE WHEN w <> '' AND w2 <> '' THEN w || ' ' || w2 END AS j2, CASE WHEN w <> '' AND w2 <> '' AND w3 <> '' THEN w || ' ' || w2 || ' ' || w3 END AS j3 FROM (SELECT *, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS w2, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS w3 FROM sq)),
sp AS (SELECT j.doc_id, pos, CASE WHEN in_code THEN 0 WHEN list_contains(titles, j1) THEN 1 WHEN list_contains(titles, j2) THEN 2 WHEN list_contains(titles, j3) THEN 3 ELSE 0 END AS size, CASE WHEN list_contains(titles, j1) THEN j1 WHEN list_contains(titles, j2) THEN j2 ELSE j3 END AS title FROM jo j JOIN en ON j.doc_id = en.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY pos) = 1 AND doc_id NOT IN (SELECT doc_id FROM hd) AS first FROM sp WHERE size > 0),
cv AS (SELECT m.doc_id, m.pos, m.line, f.size, f.first, f.title, (SELECT count(*) FROM fr g WHERE g.doc_id = m.doc_id AND m.pos > g.pos AND m.pos < g.pos + g.size) > 0 AS covered FROM marked m LEFT JOIN fr f ON f.doc_id = m.doc_id AND f.pos = m.pos),
ou AS (SELECT cv.doc_id, pos, CASE WHEN covered THEN NULL WHEN size IS NULL THEN line WHEN first THEN '# ' || heading END AS line, CASE WHEN covered OR size IS NULL THEN 0 WHEN first THEN 1 ELSE size END AS n FROM cv LEFT JOIN ti ON ti.doc_id = cv.doc_id AND ti.title = cv.title)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, CAST(sum(n) AS BIGINT) AS n FROM ou GROUP BY doc_id"""

BULLET_REPAIR = recursive(lines_sql("bullets", "fence")) + rf""",
bs AS (SELECT *, {strip("line")} AS s FROM marked),
bf AS (SELECT *, s <> '' AS solid, NOT in_code AND regexp_matches(line, {lit(p.LONE_BULLET.pattern)}) AS lone, regexp_matches(line, {lit(p.LONE_BULLET.pattern)}) AS sign, {_ITEM} AS item, NOT in_code AND regexp_matches(line, {lit(p.BULLET.pattern)}) AS simple FROM bs),
bl AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, list(CASE WHEN simple THEN regexp_replace(line, {lit(p.BULLET.pattern)}, '\1- \2') ELSE line END ORDER BY pos) AS ls, list(s ORDER BY pos) AS ss, list(solid ORDER BY pos) AS solids, list(lone ORDER BY pos) AS lones, list(sign ORDER BY pos) AS signs, list(item ORDER BY pos) AS items, list(simple ORDER BY pos) AS simples FROM bf GROUP BY doc_id),
br AS (SELECT doc_id, 1 AS at_line, []::VARCHAR[] AS done, 0 AS fixed FROM bl
  UNION ALL SELECT doc_id, CASE WHEN met THEN picked[wanted] + 1 ELSE at_line + 1 END, list_concat(done, CASE WHEN met THEN flatten([['- ' || ss[x], ''] FOR x IN picked[1:wanted]]) ELSE [ls[at_line]] END), fixed + CASE WHEN met THEN wanted WHEN simples[at_line] THEN 1 ELSE 0 END
  FROM (SELECT *, lones[at_line] AND len(picked) >= wanted AS met FROM (SELECT *, [x FOR x IN range(k, stop) IF items[x]] AS picked FROM (SELECT *, len([x FOR x IN range(at_line, k) IF solids[x]]) AS wanted, coalesce(list_min([x FOR x IN range(k, n + 1) IF solids[x] AND NOT items[x]]), n + 1) AS stop
    FROM (SELECT br.*, bl.* EXCLUDE (doc_id), coalesce(list_min([x FOR x IN range(at_line, n + 1) IF solids[x] AND NOT signs[x]]), n + 1) AS k FROM br JOIN bl ON br.doc_id = bl.doc_id WHERE at_line <= n)))))
SELECT br.doc_id, array_to_string(done, chr(10)) AS text, CAST(fixed AS BIGINT) AS n FROM br JOIN bl ON br.doc_id = bl.doc_id WHERE at_line > n"""

_UNSAFE = lit(p.JOIN_UNSAFE.pattern)
_ENDS = "[" + ", ".join(map(lit, p.SENTENCE_END)) + "]"


WRAP_JOIN = recursive(lines_sql("wrapped", "fence")) + rf""",
wf AS (SELECT *, {strip("line")} AS s FROM marked), wg AS (SELECT *, {_STRUCTURAL} AS own FROM wf),
wl AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n, list(line ORDER BY pos) AS ls, list(own ORDER BY pos) AS owns, list(in_code ORDER BY pos) AS codes FROM wg GROUP BY doc_id),
wr AS (SELECT doc_id, 2 AS at_line, []::VARCHAR[] AS done, ls[1] AS before, owns[1] AS before_own, 0 AS fixed FROM wl
  UNION ALL SELECT doc_id, at_line + 1, CASE WHEN way = 0 THEN list_append(done, before) ELSE done END, CASE way WHEN 0 THEN line WHEN 1 THEN a || b WHEN 2 THEN a[:-2] || b ELSE a || ' ' || b END, CASE WHEN way = 0 THEN own ELSE before_own END, fixed + CASE WHEN way = 0 THEN 0 ELSE 1 END
  FROM (SELECT *, CASE WHEN code OR b = '' OR NOT regexp_matches(a, '\S') OR length(before) > {p.JOIN_LENGTH} OR regexp_matches(line, '^\s') OR own OR before_own OR regexp_matches({strip("line")}, {_UNSAFE}) OR regexp_matches({strip("before")}, {_UNSAFE}) THEN 0
      WHEN regexp_matches(a, {lit(p.HYPHEN.pattern)}) AND regexp_matches(line, '^\p{{Ll}}') THEN CASE WHEN regexp_matches(a, '-[A-Za-z][A-Za-z'']*-$') THEN 1 ELSE 2 END
      WHEN length({strip("before")}) >= {p.WRAP_LENGTH} AND NOT list_contains({_ENDS}, right(a, 1)) THEN 3 ELSE 0 END AS way
    FROM (SELECT wr.*, ls[at_line] AS line, owns[at_line] AS own, codes[at_line] AS code, regexp_replace(before, '\s+$', '') AS a, regexp_replace(ls[at_line], '^\s+', '') AS b FROM wr JOIN wl ON wr.doc_id = wl.doc_id WHERE at_line <= n)))
SELECT wr.doc_id, array_to_string(list_append(done, before), chr(10)) AS text, CAST(fixed AS BIGINT) AS n FROM wr JOIN wl ON wr.doc_id = wl.doc_id WHERE at_line > n"""

def scored_code(text: str) -> str:
    """Columns of language scores, by name, of a text column."""
    return ", ".join(f"{v} AS {k}" for k, v in code_scores(text).items())


def code_share(text: str) -> str:
    solid = rf"list_filter(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '')"
    return f"coalesce(len([x FOR x IN {solid} IF regexp_matches(x, '[;{{}}]$')]) / nullif(len({solid}), 0), 0.0::DOUBLE)"


_RANKED = f"list_sort([{', '.join(f'[-{k}, {i}]' for i, k in enumerate(p.LANGUAGES))}])"
_LEADER = f"CASE WHEN -ranked[1][1] >= greatest(1, -2 * ranked[2][1]) OR -ranked[1][1] >= 2 AND c_share >= {p.C_SHARE} THEN [{', '.join(map(lit, p.LANGUAGES))}][ranked[1][2] + 1] ELSE '' END"
_CODED = rf"""
cs AS (SELECT *, {strip("line")} AS s FROM marked),
cf AS (SELECT *, {_STRONG} AS strong, {_STRONG} OR {_WEAK} AS codeish, s = '' AS blank FROM cs)"""

CODE_FENCING = lines_sql("code") + f""",{_CODED},
cp AS (SELECT *, last_value(CASE WHEN codeish THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv, lag(blank) OVER (PARTITION BY doc_id ORDER BY pos) AS after_blank FROM cf),
cc AS (SELECT *, sum(CASE WHEN codeish AND NOT coalesce(prv = pos - 1 OR prv = pos - 2 AND after_blank, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chain FROM cp),
cr AS (SELECT doc_id, min(CASE WHEN strong AND NOT in_code THEN pos END) AS a, max(CASE WHEN codeish THEN pos END) AS b FROM cc GROUP BY doc_id, chain HAVING min(CASE WHEN strong AND NOT in_code THEN pos END) IS NOT NULL),
ct AS (SELECT cr.doc_id, a, b, string_agg(line, chr(10) ORDER BY pos) AS code, count(CASE WHEN NOT blank THEN 1 END) AS n FROM cr JOIN cf ON cr.doc_id = cf.doc_id AND pos BETWEEN a AND b GROUP BY ALL HAVING count(CASE WHEN NOT blank THEN 1 END) >= {p.CODE_RUN}),
cq AS (SELECT *, {_RANKED} AS ranked FROM (SELECT *, {scored_code("code")}, {code_share("code")} AS c_share FROM ct)),
co AS (SELECT doc_id, pos, 1 AS sub, line FROM cf UNION ALL SELECT doc_id, a, 0, '```' || {_LEADER} FROM cq UNION ALL SELECT doc_id, b, 2, '```' FROM cq)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos, sub) AS text, CAST(count(CASE WHEN sub = 0 THEN 1 END) AS BIGINT) AS n FROM co GROUP BY doc_id"""

FENCE_REPAIR = lines_sql("code", "fence") + f""",{_CODED},
fm AS (SELECT *, sum(CAST(is_fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS m, sum(CAST(is_fence AS INTEGER)) OVER (PARTITION BY doc_id) AS marks FROM cf),
fg AS (SELECT doc_id, m, count(CASE WHEN NOT blank AND NOT is_fence THEN 1 END) AS gap, bool_and(codeish OR blank OR is_fence) AS coded FROM fm GROUP BY doc_id, m),
fd AS (SELECT fm.* EXCLUDE (m), coalesce(is_fence AND (fm.m % 2 = 0 AND g.gap BETWEEN 1 AND {p.FENCE_GAP} AND g.coded AND fm.m < marks OR fm.m % 2 = 1 AND h.gap BETWEEN 1 AND {p.FENCE_GAP} AND h.coded AND fm.m > 1), false) AS gone
  FROM fm LEFT JOIN fg g ON fm.doc_id = g.doc_id AND fm.m = g.m LEFT JOIN fg h ON fm.doc_id = h.doc_id AND fm.m - 1 = h.m),
fk AS (SELECT *, sum(CAST(is_fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS m FROM fd WHERE NOT gone),
fb AS (SELECT doc_id, m, count(CASE WHEN NOT is_fence AND NOT blank THEN 1 END) AS solid, count(CASE WHEN NOT is_fence AND blank THEN 1 END) AS blanks, coalesce(string_agg(CASE WHEN NOT is_fence AND NOT blank THEN line END, chr(10) ORDER BY pos), '') AS code FROM fk WHERE m % 2 = 1 AND marks >= 2 GROUP BY doc_id, m),
fq AS (SELECT *, {_RANKED} AS ranked, solid >= 3 AND blanks >= solid - 1 AS tight FROM (SELECT *, {scored_code("code")}, {code_share("code")} AS c_share FROM fb)),
fl AS (SELECT k.* EXCLUDE (m), k.m AS m, q.code, q.tight, q.blanks, {_LEADER} AS guess, python, greatest({", ".join(k for k in p.LANGUAGES if k != "python")}) AS others, c_share, trim(substr(s, 4)) AS label FROM fk k LEFT JOIN fq q ON k.doc_id = q.doc_id AND k.m = q.m),
fo AS (SELECT *, CASE WHEN is_fence AND code IS NOT NULL AND m % 2 = 1 THEN regexp_extract(line, '^(\\s*)', 1) || '```' || CASE WHEN label NOT IN ('', 'python') THEN label WHEN guess <> '' THEN guess WHEN code <> '' AND (others > python OR python = 0 AND c_share >= {p.C_SHARE}) THEN '' ELSE label END ELSE line END AS out FROM fl WHERE NOT coalesce(tight AND blank AND NOT is_fence, false)),
fn AS (SELECT doc_id, count(*) // 2 AS merged FROM fd WHERE gone GROUP BY doc_id), ft AS (SELECT doc_id, sum(blanks) AS tightened FROM fq WHERE tight GROUP BY doc_id),
fx AS (SELECT doc_id, string_agg(out, chr(10) ORDER BY pos) AS text FROM fo GROUP BY doc_id)
SELECT fx.doc_id, text, CAST(coalesce(merged, 0) + coalesce(tightened, 0) AS BIGINT) AS n FROM fx LEFT JOIN fn ON fx.doc_id = fn.doc_id LEFT JOIN ft ON fx.doc_id = ft.doc_id"""

def adjacent_pairs(text: str, n: int) -> str:
    """Whether n doubled letters follow each other somewhere in a text."""
    pair = "|".join(c + c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    return f"regexp_matches({text}, '(?:{pair}){{{n}}}')"


SHADOW_REPAIR = lines_sql("print") + rf""",
sn AS (SELECT doc_id FROM noisy WHERE {adjacent_pairs("text", 3)}),
st AS (SELECT m.doc_id, pos, regexp_extract(line, '^(\s*)', 1) AS indent, string_split_regex({strip("line")}, '\s+') AS toks FROM marked m JOIN sn ON m.doc_id = sn.doc_id WHERE NOT in_code AND regexp_matches(line, '\S') AND {adjacent_pairs("line", 2)}),
su AS (SELECT doc_id, pos, indent, len(toks) AS n_toks, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok FROM st),
sv AS (SELECT *, {doubled("tok")} AS dbl, {doubled("tok")} OR length(tok) = 2 AND tok[1] = tok[2] AS paired, {half("tok")} AS h1 FROM su),
sw AS (SELECT *, {half("h1")} AS h2 FROM sv), sx AS (SELECT *, {half("h2")} AS h FROM sw),
sy AS (SELECT *, sum(CASE WHEN paired THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, pos ORDER BY i) AS run, regexp_matches(regexp_replace(lower(h), '[acgtu]', '', 'g'), '\p{{L}}') AND NOT regexp_full_match(h, '[0-9A-Fa-f]+') AND regexp_matches(lower(h), '[aeiouy]') AND regexp_matches(regexp_replace(lower(h), '[aeiouy]', '', 'g'), '\p{{L}}') AS wordlike,
  len(list_filter(range(0, length(tok) // 2), lambda k: regexp_matches(substr(tok, 2 * k + 1, 1), '[A-Za-z]') AND substr(tok, 2 * k + 1, 1) = substr(tok, 2 * k + 2, 1))) AS pairs FROM sx),
sz AS (SELECT doc_id, pos, run, min(CASE WHEN dbl AND regexp_matches(tok, '[A-Za-z]') THEN i END) AS first FROM sy WHERE paired GROUP BY ALL),
ta AS (SELECT y.doc_id, y.pos, y.run, first, max(CASE WHEN i = first AND wordlike AND pairs >= CASE WHEN n_toks = 1 THEN 3 ELSE 4 END THEN 1 ELSE 0 END) = 1 OR count(CASE WHEN dbl AND wordlike THEN 1 END) >= 2 AS mend FROM sy y JOIN sz z ON y.doc_id = z.doc_id AND y.pos = z.pos AND y.run = z.run WHERE paired AND i >= first GROUP BY ALL),
tb AS (SELECT y.doc_id, y.pos, indent || string_agg(CASE WHEN coalesce(mend, false) AND paired AND i >= first THEN CASE WHEN length(tok) = 2 THEN tok[1] ELSE h END ELSE tok END, ' ' ORDER BY i) AS line, count(CASE WHEN mend AND paired AND i >= first THEN 1 END) AS n FROM sy y LEFT JOIN ta ON y.doc_id = ta.doc_id AND y.pos = ta.pos AND y.run = ta.run GROUP BY y.doc_id, y.pos, indent)
SELECT m.doc_id, string_agg(CASE WHEN coalesce(n, 0) > 0 THEN tb.line ELSE m.line END, chr(10) ORDER BY m.pos) AS text, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM marked m LEFT JOIN tb ON m.doc_id = tb.doc_id AND m.pos = tb.pos GROUP BY m.doc_id"""

SQL = {
    "shadow_repair": SHADOW_REPAIR,
    "code_fencing": CODE_FENCING, "fence_repair": FENCE_REPAIR,
    "document_outlines": DOCUMENT_OUTLINES, "hard_split": HARD_SPLIT, "packed_parts": PACKED_PARTS, "heading_promotion": HEADING_PROMOTION, "bullet_repair": BULLET_REPAIR, "wrap_join": WRAP_JOIN,
    "figure_links": FIGURE_LINKS, "title_helpers": TITLE_HELPERS, "language_guess": LANGUAGE_GUESS, "summary_guard": SUMMARY_GUARD,
    "shadow_words": SHADOW_WORDS, "quality_score_by_lang": QUALITY_BY_LANG, "quality_reports": QUALITY_REPORTS, "chapter_split": CHAPTER_SPLIT, "section_fetch": SECTION_FETCH, "notebook_sources": NOTEBOOK_SOURCES,
    "book_manifests": BOOK_MANIFESTS, "book_files": BOOK_FILES, "book_indexes": BOOK_INDEXES, "notebook_files": NOTEBOOK_FILES, "model_chunks": MODEL_CHUNKS, "polish_guard": POLISH_GUARD, "code_guide": CODE_GUIDE,
    "incident_explain": INCIDENT_EXPLAIN, "incident_texts": INCIDENT_TEXTS, "incident_dedupe": INCIDENT_DEDUPE, "route_files": ROUTE_FILES, "result_diagnosis": RESULT_DIAGNOSIS, "transcript_paragraphs": TRANSCRIPTS,
    "page_segments": PAGE_SEGMENTS, "page_furniture": PAGE_FURNITURE,
}
