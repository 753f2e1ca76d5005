"""The same results in plain SQL, for the check against an independent engine."""

from __future__ import annotations

from quire.functions.text import WHITESPACE

WS = WHITESPACE
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"trim({x}, '{WS}')"


def lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{BREAK}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts})-1] ELSE {parts} END)"


def drop_blocks(x: str) -> str:
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


def tagless(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


def unescape(x: str) -> str:
    """The references of the pages; a text cut off after one may lack its semicolon."""
    for a, b in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def one_line(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


ARTICLE = r"(?s)<article[^>]*>(.*?)</article>"
NAV_LINK = r'(?s)<a href="/([^"]*)">(.*?)</a>'

SHORT = f"length({strip('line')}) BETWEEN 1 AND 24"

CHAPTERS = f"""
l AS (SELECT id, title0, content, unnest({lines('content')}) AS line, generate_subscripts({lines('content')}, 1) AS i FROM books),
h AS (SELECT *, {SHORT} AS head, sum(CAST({SHORT} AS INT)) OVER (PARTITION BY id ORDER BY i) AS c FROM l),
g AS (SELECT id, greatest(c, 1) AS c, string_agg(line, chr(10) ORDER BY i) AS text,
  arg_min({strip('line')}, i) FILTER (WHERE head) AS title FROM h GROUP BY 1, 2),
cut AS (SELECT id, CAST(c - 1 AS INT) AS chapter_idx, title, text FROM g WHERE title IS NOT NULL),
ensured AS (SELECT id, chapter_idx, title, text, true AS from_headings FROM cut UNION ALL
  SELECT id, 0, coalesce(nullif(title0, ''), CAST(id AS VARCHAR)), content, false FROM books WHERE id NOT IN (SELECT id FROM cut))
"""

DOC_BOOKS = "books AS (SELECT doc_id AS id, lang AS title0, text AS content FROM documents)"

MAIN_TEXT = f"""
m AS (SELECT page_id, url, regexp_extract(html, '{ARTICLE}', 1) AS body, regexp_matches(html, '{ARTICLE}') AS found,
  {tagless("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS t FROM pages),
p AS (SELECT page_id, url, found, t, translate({unescape(tagless(f"regexp_replace({drop_blocks('body')}, '(?i)</p\\s*>|<br\\s*/?>', chr(10), 'g')"))}, chr(12288) || chr(13), ' ') AS x FROM m),
main AS (SELECT page_id, url, CASE WHEN found THEN {strip(f"regexp_replace({strip(unescape('t'))}, '\\s*（\\s*\\d+\\s*/\\s*\\d+\\s*）\\s*$', '')")} ELSE '' END AS title,
  array_to_string(list_filter(list_transform({lines('x')}, lambda y: {strip('y')}), lambda y: y <> ''), chr(10)) AS text FROM p)
"""

LINKS = f"""
x AS (SELECT page_id, regexp_extract_all(html, '{NAV_LINK}', 1) AS a, regexp_extract_all(html, '{NAV_LINK}', 2) AS b FROM (SELECT page_id, {{html}} AS html FROM pages)),
u AS (SELECT page_id, unnest(a) AS target, unnest(b) AS raw, generate_subscripts(a, 1) AS i FROM x)
"""

HOST = "coalesce(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '')"

CATALOG = "catalog AS (SELECT p_brand AS source, p_partkey AS id, p_name AS title FROM part)"
ASKED = """
asked AS (SELECT sha1(query) AS query_id, query FROM (SELECT unnest(string_split(p_name, ' ')) AS query FROM part
  UNION SELECT upper(p_name || ' ' || p_type) FROM part UNION SELECT text FROM benchmark))
"""
PAIRS = f"""
t AS (SELECT DISTINCT title, lower({strip('title')}) AS t FROM catalog),
pairs AS (SELECT query_id, query, title FROM asked, t WHERE t <> '' AND {strip('query')} <> '' AND
  (contains(t, lower({strip('query')})) OR contains(lower({strip('query')}), t)))
"""

PROGRESS = """
SELECT rel, arg_max(chapter, (ts, event_id)) AS chapter, arg_max(pct, (ts, event_id)) AS pct FROM e GROUP BY rel
"""


MARKS = ("\ue001", "\ue002", "\ue003")


def t2s(x: str) -> str:
    for a, mark in zip(("the", "sch", "qu"), MARKS):
        x = f"replace({x}, '{a}', '{mark}')"
    x = f"translate({x}, 'eaoé', '340e')"
    for mark, b in zip(MARKS, ("THE", "SH", "KW")):
        x = f"replace({x}, '{mark}', '{b}')"
    return x


def s2t(x: str) -> str:
    return f"replace(translate(replace({x}, 'st', '{MARKS[0]}'), 'st', 'z7'), '{MARKS[0]}', 'ST')"


def changed(a: str, b: str) -> str:
    """Differing positions plus the difference in length."""
    return (
        f"(abs(length({a}) - length({b})) + len(list_filter(list_zip(string_split({a}, '')[1:least(length({a}), length({b}))], "
        f"string_split({b}, '')[1:least(length({a}), length({b}))]), lambda z: z[1] <> z[2])))"
    )


def vote(chapters: str) -> str:
    return f"""
p AS (SELECT id, arg_min(left(text, 800), chapter_idx) FILTER (WHERE chapter_idx < 2 AND {strip('left(text, 800)')} <> '') AS probe FROM {chapters} GROUP BY id),
w AS (SELECT id, probe, {t2s('probe')} AS s, {s2t('probe')} AS t FROM p),
votes AS (SELECT id, CAST({changed('probe', 's')} AS INT) AS t2s_changes, CAST({changed('probe', 't')} AS INT) AS s2t_changes FROM w),
base AS (SELECT *, CASE WHEN t2s_changes IS NULL THEN NULL WHEN s2t_changes >= t2s_changes THEN 'simp' ELSE 'trad' END AS base FROM votes)
"""


CONV = "chapters AS (SELECT conv_id AS id, turn AS chapter_idx, role AS title, text FROM conversations)"
PARAS_BREAK = "string_split(regexp_replace(regexp_replace({x}, '\\n{{2,}}', chr(1), 'g'), '\\n([^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}])', chr(1) || '\\1', 'g'), chr(1))"


def paras(x: str) -> str:
    return f"list_filter(list_transform({PARAS_BREAK.format(x=x)}, lambda y: {strip('y')}), lambda y: y <> '')"


def direction(x: str) -> str:
    return f"CASE WHEN len(regexp_extract_all({x}, '[A-Za-z]{{2,}}')) >= 15 THEN 'en2zh' ELSE 'zh2en' END"


MEMBER = "'<h1>' || role || '</h1>' || repeat(chr(10), 4) || '<p>' || text || '</p>'"
NEWLINES = r"\n{3,}"

SQL: dict[str, str] = {
    "strip_tags": f"SELECT page_id, {one_line(unescape(tagless(drop_blocks('html'))))} AS text FROM pages",
    "page_links": f"""WITH {LINKS.format(html='html')},
k AS (SELECT page_id, target, {strip(unescape(tagless('raw')))} AS label, i FROM u),
f AS (SELECT page_id, target, label, min(i) AS i FROM k WHERE label <> '' GROUP BY 1, 2, 3)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS link_idx, target, label FROM f""",
    "page_cards": rf"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS card,
  generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) AS i FROM pages)
SELECT page_id, CAST(i - 1 AS INT) AS card_idx, {tagless('''regexp_extract(card, 'href="/([^"]*)"', 1)''')} AS target,
  left({one_line(unescape(tagless("regexp_extract(card, '(?s)<a[^>]*>(.*?)</a>', 1)")))}, 120) AS label
FROM c WHERE regexp_extract(card, 'href="/([^"]*)"', 1) <> ''""",
    "nav_region_links": f"""WITH {LINKS.format(html="regexp_extract(html, '(?s)<nav[^>]*>(.*?)(?:</nav>|$)', 1)")},
k AS (SELECT page_id, replace(url_decode(target), '_', ' ') AS title, {one_line(unescape(tagless('raw')))} AS label, i FROM u),
f AS (SELECT page_id, title, min(i) AS i FROM k WHERE label <> '' AND NOT starts_with(label, '#') GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS link_idx, title FROM f""",
    "main_text": f"WITH {MAIN_TEXT} SELECT page_id, title, text FROM main WHERE {strip('text')} <> ''",
    "page_sections": rf"""WITH m AS (SELECT page_id, regexp_replace({drop_blocks('html')}, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', chr(1) || '\1' || chr(2), 'g') AS x FROM pages),
p AS (SELECT page_id, string_split({unescape(tagless(r"regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|li)\s*>', chr(4), 'g'), '(?i)<(?:p|li)\b[^>]*>', chr(3), 'g')"))}, chr(1)) AS ps FROM m),
q AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
s AS (SELECT page_id, i, CASE WHEN i = 1 THEN '' ELSE {strip('split_part(piece, chr(2), 1)')} END AS title,
  string_split(CASE WHEN i = 1 THEN piece ELSE string_split(piece, chr(2))[-1] END, chr(4)) AS b FROM q),
r AS (SELECT page_id, i, title, array_to_string(list_filter(list_transform(b[1:len(b) - 1], lambda y: {strip('string_split(y, chr(3))[-1]')}), lambda y: y <> ''), chr(10)) AS text FROM s)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS chapter_idx, title, text FROM r WHERE title <> '' OR text <> ''""",
    "page_stats": f"""WITH {MAIN_TEXT}, books AS (SELECT page_id AS id, title AS title0, text AS content FROM main), {CHAPTERS}
SELECT {HOST} AS host, count(*) FILTER (WHERE chapter_idx = 0) AS pages, count(*) AS chapters, CAST(sum(length(e.text)) AS BIGINT) AS chars
FROM ensured e JOIN main ON e.id = main.page_id GROUP BY 1""",
    "challenge_flags": """SELECT page_id, regexp_matches(lower(left(html, 8192)), 'please confirm that you are human|just a moment|cf-challenge|challenge-platform|checking your browser|attention required|認證圖案|验证图案|verify you are human') AS challenge,
  regexp_matches(lower(left(html, 8192)), 'la que|of the|und die') AS marked FROM pages""",
    "reject_pages": """WITH f AS (SELECT 'page' AS kind, page_id AS id, ltrim(html, ' \t\n\r\f\x0b') AS c FROM pages
UNION ALL SELECT 'text', doc_id, ltrim(text, ' \t\n\r\f\x0b') FROM documents)
SELECT kind, id, starts_with(lower(left(c, 512)), '<!doctype') OR starts_with(lower(left(c, 512)), '<html') OR contains(lower(left(c, 512)), 'cloudflare') AS is_page FROM f""",
    "shell_counts": f"""WITH x AS (SELECT url, {tagless(unescape("regexp_extract(html, '(?s)lang=\"en\".*?<article[^>]*>(.*?)</article>', 1)"))} AS t FROM pages)
SELECT {HOST} AS host, count(*) FILTER (WHERE {strip('t')} <> '') AS kept, count(*) FILTER (WHERE {strip('t')} = '') AS shells FROM x GROUP BY 1""",
    "first_links": f"""WITH {LINKS.format(html='html')},
k AS (SELECT page_id, target, {strip(unescape(tagless('raw')))} AS label, i FROM u),
f AS (SELECT page_id, target, label, min(i) AS i FROM k WHERE label <> '' GROUP BY 1, 2, 3),
n AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS link_idx, target, label FROM f)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY target ORDER BY page_id, link_idx) = 1""",
    "page_cells": f"""WITH c AS (SELECT conv_id, turn, list_transform({lines('text')}, lambda y: {one_line("y || '·'")}) AS ls FROM conversations)
SELECT conv_id, turn, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_idx FROM c""",
    "card_notes": "SELECT p_partkey, 1 AS card_idx, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS author, 'note & ' || p_size AS note FROM part",
    "clean_titles": "SELECT p_partkey, p_name || ' &' AS title FROM part",
    "section_names": f"""WITH {DOC_BOOKS}, {CHAPTERS},
s AS (SELECT id AS doc_id, source, chapter_idx, CASE WHEN starts_with(cut.title, 'L') THEN '' ELSE cut.title END AS t, count(*) OVER (PARTITION BY id) AS n FROM cut JOIN documents ON doc_id = id)
SELECT doc_id, chapter_idx, CASE WHEN t = '' THEN source WHEN n > 1 THEN source || '·' || t ELSE t END AS title FROM s""",
    "render_converted": f"""WITH c AS (SELECT conv_id, turn, {t2s('role')} AS role, {t2s('text')} AS text FROM conversations)
SELECT conv_id AS id, CAST(0 AS BIGINT) AS part, count(*) AS n_chapters,
  CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) END AS content
FROM c GROUP BY conv_id""",
    "url_parts": f"SELECT page_id, {HOST} AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, url_encode(url) AS encoded, replace(url, '_', ' ') AS decoded FROM pages",
    "decode_text": "SELECT doc_id, text FROM documents",
    "split_chapters": f"WITH {DOC_BOOKS}, {CHAPTERS} SELECT id, chapter_idx, title, text FROM cut",
    "ensure_chapters": f"WITH {DOC_BOOKS}, {CHAPTERS} SELECT id, chapter_idx, title, text, from_headings FROM ensured",
    "rendered_roundtrip": f"""SELECT conv_id AS id, CAST(row_number() OVER w - 1 AS INT) AS chapter_idx,
  CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN CAST(conv_id AS VARCHAR) ELSE role END AS title, {strip('text')} AS text
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "render_txt": """SELECT conv_id AS id, CAST(0 AS BIGINT) AS part, count(*) AS n_chapters,
  CASE WHEN count(*) = 1 THEN min(text) ELSE string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) END AS content
FROM conversations GROUP BY conv_id""",
    "merge_chapters": f"""WITH m AS (SELECT conv_id AS id, CAST(0 AS BIGINT) AS part, count(*) AS n_chapters, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS content FROM conversations GROUP BY conv_id)
SELECT *, CAST(length(content) AS INT) AS chars, CAST(len({lines('content')}) AS INT) AS lines FROM m""",
    "chapter_ordinals": """WITH n AS (SELECT conv_id AS id, turn AS chapter_idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, role FROM conversations)
SELECT id, chapter_idx, ordinal, CASE WHEN role = 'user' THEN '第' || ordinal || '部分' ELSE role END AS title FROM n""",
    "chapter_xhtml": f"""WITH c AS (SELECT conv_id AS id, turn AS chapter_idx, role AS title, role || chr(10) || text || ' <&>' AS text FROM conversations),
b AS (SELECT *, array_to_string(list_transform(list_filter(list_transform({lines('text')}, lambda y: {strip('y')}), lambda y: y <> '' AND y <> title AND y <> '《' || title || '》'),
  lambda y: '<p>' || replace(replace(replace(y, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>'), chr(10)) AS body FROM c)
SELECT id, chapter_idx, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml">' || chr(10) ||
  '<head><meta charset="utf-8"/><title>' || title || '</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>' || title || '</h1>' || chr(10) || body || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS xhtml FROM b""",
    "book_manifest": f"""WITH c AS (SELECT conv_id AS id, turn AS chapter_idx, role, role = 'assistant' OR {strip('text')} = '' AS blank,
  min(turn) OVER (PARTITION BY conv_id) AS first, bool_and(role = 'assistant' OR {strip('text')} = '') OVER (PARTITION BY conv_id) AS allb FROM conversations),
k AS (SELECT id, chapter_idx, role, row_number() OVER (PARTITION BY id ORDER BY chapter_idx) AS play_order FROM c WHERE NOT blank OR (allb AND chapter_idx = first))
SELECT id, chapter_idx, play_order, 'chap' || play_order AS item_id, 'chap_' || lpad(CAST(play_order AS VARCHAR), CAST(greatest(length(CAST(play_order AS VARCHAR)), 4) AS INT), '0') || '.xhtml' AS href, role AS label FROM k""",
    "strip_dup_heading": f"""SELECT conv_id AS id, turn AS chapter_idx, role AS title,
  CASE WHEN len({lines('text')}) = 0 THEN role || chr(10) || text ELSE {strip(f"array_to_string({lines('text')}, chr(10))")} END AS text FROM conversations""",
    "paragraphs": f"""WITH p AS (SELECT doc_id, list_filter({paras('text')}, lambda y: y <> source AND y <> '《' || source || '》') AS ps FROM documents)
SELECT doc_id, unnest(ps) AS para, CAST(generate_subscripts(ps, 1) - 1 AS INT) AS para_idx FROM p""",
    "strip_boilerplate": r"""WITH s AS (SELECT doc_id, text, regexp_matches(text, '(?i)(?:\A|\n)(?:Licensed under|Released under|This work is licensed under)') AS found,
  regexp_replace(text, '(?is)\A(?:|.*?\n)(?:Licensed under|Released under|This work is licensed under)[^\n]*(?:\n|\z)', '') AS after FROM documents),
e AS (SELECT doc_id, trim(CASE WHEN found THEN regexp_replace(after, '(?is)(\A|\n)(?:The|Die|La|El)\b.*\z', '\1') ELSE text END, chr(10)) AS content FROM s)
SELECT doc_id, content, CASE WHEN content = '' THEN 'no text after strip' END AS reason FROM e""",
    "trans_direction": f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) AS INT) AS words, {direction('text')} AS direction,
  regexp_matches(text, '[一-鿿]') AS cjk FROM documents""",
    "normalize_text": "SELECT doc_id, text FROM documents",
    "xml_text": "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '&lt;&amp;&gt;' AS text FROM documents",
    "book_stats": f"SELECT source, count(*) AS books, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({lines('text')})) AS BIGINT) AS lines FROM documents GROUP BY source",
    "script_convert": f"SELECT doc_id, {t2s('text')} AS simplified, {s2t('text')} AS traditional FROM documents",
    "script_vote": f"WITH {DOC_BOOKS}, {CHAPTERS}, {vote('ensured')} SELECT id, t2s_changes, s2t_changes, base FROM base",
    "convert_away": f"""WITH {CONV}, {vote('chapters')} SELECT id, chapter_idx,
  CASE WHEN base = 'simp' THEN {s2t('title')} ELSE {t2s('title')} END AS title,
  CASE WHEN base = 'simp' THEN {s2t('text')} ELSE {t2s('text')} END AS text FROM chapters JOIN base USING (id)""",
    "lean_books": """SELECT conv_id AS id, CAST(0 AS BIGINT) AS part, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) AS INT) AS n_chapters,
  string_agg(role, '|' ORDER BY turn) AS titles FROM conversations GROUP BY conv_id""",
    "title_search": f"""WITH {CATALOG}, {ASKED}, {PAIRS},
r AS (SELECT query_id, source, id, title, CAST(row_number() OVER (PARTITION BY query_id ORDER BY title, source, id) AS INT) AS rank FROM pairs JOIN catalog USING (title))
SELECT query_id, rank, source, id, title FROM r WHERE rank <= 200""",
    "title_matches": f"WITH {CATALOG}, {ASKED}, {PAIRS} SELECT query, title FROM pairs",
    "search_summary": f"""WITH {CATALOG}, {ASKED}, {PAIRS}
SELECT query_id, count(c.id) AS hits, count(c.id) FILTER (WHERE c.source IN ('Brand#1', 'Brand#2')) AS foreign_hits
FROM asked LEFT JOIN pairs USING (query_id) LEFT JOIN catalog c USING (title) GROUP BY query_id""",
    "registry_search": """WITH r AS (SELECT p_name AS query_id, p_brand AS source, p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS INT) AS rank FROM part)
SELECT query_id, rank, source, id FROM r WHERE rank <= 20""",
    "search_hint": """WITH g AS (SELECT p_name AS query_id, count(*) FILTER (WHERE p_brand = 'Brand#1') AS fh, bool_or(p_brand IN ('Brand#1', 'Brand#2') AND length(p_name) > 10) AS fok FROM part GROUP BY 1),
k AS (SELECT query_id, CASE WHEN NOT fok OR fh > 0 THEN 'none' WHEN starts_with(query_id, 'b') THEN 'dict' ELSE 'plain' END AS hint_kind FROM g)
SELECT query_id, hint_kind, CASE hint_kind WHEN 'dict' THEN '外文源已按英文名「' || upper(query_id) || '」检索仍无结果——此书可能尚未进入公版（古登堡/维基文库只有公版书）'
  WHEN 'plain' THEN '外文原版源按英文书名索引，中文书名搜不到——试试英文原名直接搜' ELSE '' END AS hint FROM k""",
    "search_envelope": f"""WITH {CATALOG}, {ASKED}, {PAIRS},
r AS (SELECT query_id, source, id, title, row_number() OVER (PARTITION BY query_id ORDER BY title, source, id) AS rank FROM pairs JOIN catalog USING (title)),
g AS (SELECT query_id, count(*) AS n, list({{'source': source, 'id': id, 'title': title}} ORDER BY rank) FILTER (WHERE rank <= 200) AS results FROM r GROUP BY 1)
SELECT query_id, CAST(json_object('query', query, 'count', coalesce(n, 0), 'errors', json_object(), 'hint', '', 'results', coalesce(to_json(results), json_array())) AS VARCHAR) AS envelope
FROM asked LEFT JOIN g USING (query_id)""",
    "envelope_full": """WITH p AS (SELECT '書' || p_name AS q, * FROM part),
r AS (SELECT q, list({'source': p_brand, 'id': CAST(p_partkey AS VARCHAR), 'title': p_name, 'url': 'http://h/' || p_partkey, 'subtitle': p_type,
    'format_hint': 'txt', 'extra': {'size': CAST(p_size AS VARCHAR)}} ORDER BY p_brand, CAST(p_partkey AS VARCHAR)) AS results, count(*) AS n,
    to_json(list_sort(list(DISTINCT p_brand))) AS sources, any_value(p_name) AS name FROM p GROUP BY q),
e AS (SELECT q, to_json(map_from_entries(list((p_brand, 'late') ORDER BY p_brand))) AS errors FROM (SELECT DISTINCT q, p_brand FROM p WHERE p_size = 7) GROUP BY q)
SELECT q AS query_id, CAST(CASE WHEN name < 'm' THEN json_object('query', q, 'count', n, 'errors', coalesce(errors, json_object()), 'hint', 'look & see',
    'results', to_json(results), 'translated', json_object('to', name, 'via', 'dict'), 'sources', sources)
  ELSE json_object('query', q, 'count', n, 'errors', coalesce(errors, json_object()), 'hint', 'look & see', 'results', to_json(results), 'sources', sources) END AS VARCHAR) AS envelope
FROM r LEFT JOIN e USING (q)""",
    "resolve_unique": """WITH w AS (SELECT DISTINCT p_brand AS source, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS title FROM part),
c AS (SELECT p_brand AS source, p_name AS title, count(*) AS hits, min(p_partkey) AS id FROM part GROUP BY 1, 2)
SELECT w.source, w.title, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN id END AS id,
  CASE WHEN hits = 1 THEN 'ok' WHEN hits IS NULL THEN 'missing' ELSE 'ambiguous' END AS status FROM w LEFT JOIN c ON w.source = c.source AND w.title = c.title""",
    "editions": "SELECT p_brand AS source, p_name AS title, count(DISTINCT p_partkey) AS editions, min(p_partkey) AS first_id, max(p_partkey) AS last_id, count(DISTINCT p_partkey) > 1 AS ambiguous FROM part GROUP BY 1, 2",
    "query_translate": """SELECT c_custkey AS query_id, n_name AS query, r_name AS source,
  CASE WHEN r_name IN ('ASIA', 'EUROPE') AND n_nationkey > 4 THEN r_name ELSE n_name END AS asked,
  CASE WHEN r_name IN ('ASIA', 'EUROPE') AND n_nationkey > 4 THEN 'dict' END AS via
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "source_labels": "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS source, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20",
    "source_errors": """WITH a AS (SELECT lang AS query_id, source, bool_or(quality = 1 AND toxic = 1) AS ok, count(quality) AS n,
  bool_or(toxic = 0 AND quality IS NOT NULL) AS net FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT query_id, source, CASE WHEN source = 'src7' THEN 'unknown source' WHEN n = 0 THEN 'TimeoutError: source did not respond in 20s'
  WHEN net THEN '网络请求失败（已自动重试仍不通）——请检查网络或稍后重试' ELSE '内容解析异常——该源返回了无法处理的数据，可能已改版（ValueError）' END AS message
FROM a WHERE source = 'src7' OR NOT coalesce(ok, false)""",
    "dedup_names": r"""WITH i AS (SELECT p_brand AS source, p_partkey AS id, p_name AS stem, p_name || '.txt' AS name,
  row_number() OVER (PARTITION BY p_name ORDER BY sha1(p_brand || '|' || p_partkey)) - 1 AS k FROM part),
t AS (SELECT DISTINCT p_name AS stem, CAST(p_size AS BIGINT) AS number FROM part WHERE p_size > 0),
f AS (SELECT stem, number - (row_number() OVER (PARTITION BY stem ORDER BY number) - 1) AS f FROM t),
n AS (SELECT i.id, i.source, i.stem, i.k + count(f.f) AS number FROM i LEFT JOIN f ON i.stem = f.stem AND f.f <= i.k GROUP BY i.id, i.source, i.stem, i.k)
SELECT id, source, CASE WHEN number = 0 THEN stem || '.txt' ELSE stem || '(' || number || ').txt' END AS file_name FROM n""",
    "union_sources": """SELECT 'customer' AS source, c_custkey AS id, c_name AS title, c_mktsegment AS subtitle FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""",
    "validate_ids": r"""WITH v AS (SELECT doc_id, source, CASE WHEN n_chars > 1000 THEN CAST(doc_id AS VARCHAR) WHEN n_chars > 500 THEN md5(CAST(doc_id AS VARCHAR)) ELSE 'a/b:' || doc_id END AS id FROM documents),
o AS (SELECT *, CASE source WHEN 'src0' THEN regexp_matches(id, '^[0-9]+$') WHEN 'src1' THEN regexp_matches(id, '^[0-9a-f]{32}$') WHEN 'src2' THEN contains(id, ':') ELSE true END AS ok FROM v)
SELECT doc_id, source, id, ok, CASE WHEN NOT ok THEN 'bad ' || source || ' id: ' || id END AS reason FROM o""",
    "route_sources": """SELECT doc_id, source, CASE WHEN lang = 'en' THEN '未声明(权利状态不明，使用前自审)' ELSE lang END AS license FROM documents
WHERE source IN (SELECT source FROM documents WHERE lang = 'es') AND right(source, 1) IN ('1', '3', '7')""",
    "filter_ext": "SELECT p_partkey, p_name || '.' || left(p_type, 3) AS path FROM part WHERE left(p_type, 3) IN ('ECO', 'SMA')",
    "record_json": """SELECT md5(CAST(p_partkey AS VARCHAR)) AS id, p_name AS title, 'https://mirror.example.org/book/index.php?md5=' || md5(CAST(p_partkey AS VARCHAR)) AS url,
  array_to_string(list_filter([CASE WHEN p_type <> 'SMALL' THEN p_type ELSE '' END, CAST(p_size AS VARCHAR),
    CASE WHEN p_size > 10 THEN printf('%.1fMB', CAST(CAST(floor(p_retailprice * 1000) AS BIGINT) AS DOUBLE) / 1e6) ELSE '' END], lambda x: x <> ''), ' / ') AS subtitle,
  'txt' AS format_hint FROM part WHERE p_type <> 'ECONOMY'""",
    "wiki_json": f"""SELECT lang || ' ' || doc_id AS id, 'https://zh.example.org/wiki/' || lang || '_' || doc_id AS url,
  left({one_line(unescape(tagless("'<span>&quot;' || text || '</span>'")))}, 120) AS subtitle, CAST(doc_id AS VARCHAR) AS pageid FROM documents WHERE n_chars > 300""",
    "book_members": f"""WITH m AS (SELECT conv_id AS book, turn, role, {strip(f"regexp_replace({tagless(MEMBER)}, '{NEWLINES}', repeat(chr(10), 2), 'g')")} AS t,
  bool_or(role = 'assistant') OVER (PARTITION BY conv_id) AS spine FROM conversations),
k AS (SELECT book, CASE WHEN spine THEN 1000 - turn ELSE turn END AS place, role AS title, ltrim(substr(t, length(role) + 1), chr(10)) AS text FROM m WHERE NOT spine OR role = 'assistant')
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY place) - 1 AS INT) AS chapter_idx, title, text FROM k""",
    "file_paths": "SELECT p_partkey, p_name AS title, p_type AS folder, p_name || '.TXT' AS base FROM part",
    "split_cached": "SELECT source, doc_id AS id, doc_id IN (SELECT doc_id FROM labels) AS cached FROM documents",
    "pending_requests": "SELECT source, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "delete_books": "SELECT source, doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "default_headings": """WITH h AS (SELECT doc_id AS id, text, doc_id % 5 AS k, CASE doc_id % 5 WHEN 0 THEN '《' || source || '》' WHEN 1 THEN '第' || doc_id || '章'
            WHEN 2 THEN '三、' || source WHEN 3 THEN 'CHAPTER ' || doc_id ELSE '自序' END AS heading, source FROM documents)
        SELECT id, CAST(0 AS INT) AS chapter_idx, CASE WHEN k = 0 THEN source ELSE heading END AS title,
            'lead ' || id || chr(10) || heading || chr(10) || text || chr(10) || heading || CASE WHEN k = 2 THEN '。' ELSE ' x' END AS text FROM h
        UNION ALL SELECT id, 1, '后记', '后记' || chr(10) || 'end' FROM h""",
    "decode_legacy": "SELECT p_partkey, p_name || '渊海' AS text FROM part",
    "protected_words": "SELECT p_partkey, '乾坤 ' || p_name || ' 干杯 乾陽 阳 干' AS text FROM part",
    "references": "SELECT p_partkey, chr(p_size + 200) || 'éA' || p_name || '½' AS text FROM part",
    "page_subsections": """SELECT p_partkey, CAST(i AS INT) AS chapter_idx, ['', p_name, '二', 'last'][i + 1] AS title,
            ['lead', p_type, p_brand, p_name || chr(10) || 'z'][i + 1] AS text FROM part, range(4) r(i)""",
    "card_defaults": """SELECT p_partkey, CASE WHEN p_size > 20 THEN p_name ELSE 'record #' || p_partkey END AS title,
            CASE WHEN p_size < 40 THEN p_brand ELSE 'nobody' END AS author FROM part""",
    "library_cascade": """WITH l AS (SELECT doc_id, max(toxic) = 1 AS dead FROM labels GROUP BY 1), d AS (SELECT doc_id, dead FROM documents LEFT JOIN l USING (doc_id))
        SELECT 'file' AS kind, 'd' || doc_id || '.txt' AS rel FROM d WHERE NOT coalesce(dead, false)
        UNION ALL SELECT 'file', 'd' || doc_id || '.txt.part' FROM d WHERE doc_id % 2 = 0 AND dead IS NULL
        UNION ALL SELECT 'position', 'd' || doc_id || '.txt' FROM d WHERE dead IS NULL""",
    "translate_stored": """SELECT n_nationkey AS query_id, CASE WHEN n_regionkey % 2 = 0 THEN lower(n_name) WHEN n_nationkey % 3 <> 0 THEN 'the ' || n_name ELSE '國' || n_name END AS asked,
            CASE WHEN n_regionkey % 2 = 0 THEN 'dict' WHEN n_nationkey % 3 <> 0 THEN 'mt' END AS via FROM nation""",
    "ranked_hits": """WITH c AS (SELECT p_brand AS source, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '書' || p_name || '書' ELSE p_name END AS title FROM part),
        w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
        q AS (SELECT word AS query FROM w UNION SELECT '書' || word FROM w),
        m AS (SELECT sha1(query) AS query_id, source, id, title,
                CASE WHEN contains(query, '書') AND contains(title, '書') THEN 0 ELSE 1 END AS f
            FROM q, c WHERE contains(lower(trim(title)), lower(trim(query))) OR contains(lower(trim(query)), lower(trim(title))))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, title, source, id) AS INT) AS rank, source, id, title FROM m""",
    "toc_links": f"""WITH {LINKS.format(html="regexp_extract(html, '(?s)<nav>(.*?)(?:</nav>|$)', 1)")},
k AS (SELECT page_id, replace(url_decode(target), '_', ' ') AS title, {one_line(unescape(tagless('raw')))} AS label, i FROM u WHERE target <> ''),
f AS (SELECT page_id, title, min(i) AS i FROM k WHERE label <> '' AND NOT starts_with(label, '#') GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS link_idx, title FROM f""",
    "store_odd_keys": """WITH d AS (SELECT CASE WHEN source = 'src1' THEN '' WHEN source <> 'src2' THEN source END AS source,
            CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS INT) AS chars, l.doc_id IS NOT NULL AS labelled, coalesce(l.toxic = 1, false) AS dead
            FROM documents LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels) l USING (doc_id))
        SELECT source, id, CASE WHEN labelled AND source = '' THEN 0 WHEN labelled THEN -chars ELSE chars END AS chars,
            CASE WHEN labelled AND source = '' THEN 1 ELSE 0 END AS batch_id FROM d WHERE NOT dead""",
    "store_upsert": """SELECT source, CAST(d.doc_id AS VARCHAR) AS id, left(sha1(source || '|' || d.doc_id), 24) AS store_key, CAST(n_chars AS INT) AS chars,
  md5(CASE WHEN l.doc_id IS NULL THEN text ELSE text || '!' END) AS digest, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS batch_id
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) <> 1""",
    "resume_plan": """WITH c AS (SELECT l_orderkey, max(l_linenumber) AS idx FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT l_orderkey AS id, l_linenumber AS pos FROM lineitem LEFT JOIN c USING (l_orderkey) WHERE l_linenumber > coalesce(idx, -1)""",
    "checkpoint_state": """WITH c AS (SELECT l_orderkey, max(l_linenumber) AS idx FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN -o_orderkey ELSE o_orderkey END AS id, CAST(o_orderkey AS VARCHAR) AS title,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey <> 0 THEN 0 ELSE coalesce(idx + 1, 0) END AS INT) AS resume_from,
  o_orderpriority = '1-URGENT' AND o_orderkey <> 0 AND idx IS NOT NULL AS restart FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""",
    "freshness": """WITH y AS (SELECT *, TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 365 DAY < o_orderdate AS young FROM orders)
SELECT o_orderkey, CASE WHEN young AND o_orderstatus = 'F' THEN 'refuse' WHEN young THEN 'fresh' WHEN o_orderpriority = '2-HIGH' THEN 'refreshed'
  WHEN o_orderpriority = '5-LOW' THEN 'mark_dead' WHEN o_totalprice > 100000 THEN 'stale' ELSE 'fail' END AS action FROM y""",
    "sanitize_names": r"SELECT c_custkey, trim(regexp_replace(' .' || c_name || '?*', '[^\p{L}\p{N} ._\-()（）【】]', '_', 'g'), ' ._') AS file_name FROM customer",
    "store_keys": "SELECT doc_id, left(sha1(source || '|' || doc_id), 24) AS store_key, sha1(lang || '|' || source || '|' || text) AS full_key FROM documents",
    "size_labels": "SELECT doc_id, printf('%.1fMB', CAST(n_chars * 1000 AS DOUBLE) / 1e6) AS size_mb, greatest(1, n_chars // 1024) AS size_kb, '' AS bad FROM documents",
    "latest_progress": f"""WITH e AS (SELECT 'u' || user_id || '.txt' AS rel, CAST(event_id AS INT) AS chapter, CAST(floor(value) AS INT) AS pct, ts, event_id FROM events) {PROGRESS}""",
    "progress_pct": """WITH e AS (SELECT event_id, user_id AS n, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(floor(value) AS INT) AS p FROM events)
SELECT event_id, CASE WHEN n > 1 THEN CAST(least(100, greatest(1, floor((k + CAST(p AS DOUBLE) / 1000) / n * 100 + 0.5))) AS INT) END AS pct FROM e""",
    "shelf": f"""WITH e AS (SELECT 'c' || user_id || '.txt' AS rel, 3 AS chapter, CAST(floor(value) AS INT) AS pct, ts, event_id FROM events),
pr AS ({PROGRESS}),
f AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'c' || o_custkey || '.txt' WHEN 'O' THEN 'c' || o_custkey || '.txt.part' ELSE 'x/' || o_orderkey || '.epub' END AS rel,
  min(CAST(trunc(o_totalprice) AS BIGINT)) AS length FROM orders GROUP BY 1),
s AS (SELECT *, ends_with(rel, '.part') AS partial, regexp_replace(regexp_replace(rel, '^x/', ''), '(\\.txt\\.part|\\.txt|\\.epub)$', '') AS title, regexp_replace(rel, '\\.part$', '') AS key FROM f),
v AS (SELECT * FROM s WHERE NOT (partial AND title || '.txt' IN (SELECT rel FROM f))),
c AS (SELECT 'c' || l_orderkey || '.txt' AS rel, count(*) AS chapters FROM lineitem GROUP BY 1)
SELECT v.rel, v.title, CASE WHEN ends_with(v.rel, '.epub') THEN 'epub' ELSE 'txt' END AS format, greatest(1, length // 1024) AS size_kb, chapters, partial, chapter, pct,
  CASE WHEN chapter IS NOT NULL AND chapters > 1 THEN CAST(least(100, greatest(1, floor((chapter + CAST(pct AS DOUBLE) / 1000) / chapters * 100 + 0.5))) AS INT) END AS progress_pct
FROM v LEFT JOIN pr ON pr.rel = v.key LEFT JOIN c ON c.rel = v.rel""",
    "breaker_log": """WITH RECURSIVE r AS (SELECT user_id AS host, event_id AS id, event_type <> 'error' AS ok, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT host, id, ok, us, rn, CASE WHEN ok THEN 0 ELSE 1 END AS fails, CAST(NULL AS BIGINT) AS until, 'closed' AS state FROM r WHERE rn = 1
UNION ALL SELECT r.host, r.id, r.ok, r.us, r.rn,
  CASE WHEN r.us < s.until THEN s.fails WHEN r.ok THEN 0 WHEN (CASE WHEN s.until IS NULL THEN s.fails ELSE 0 END) + 1 >= 3 THEN 0 ELSE (CASE WHEN s.until IS NULL THEN s.fails ELSE 0 END) + 1 END,
  CASE WHEN r.us < s.until THEN s.until WHEN NOT r.ok AND (CASE WHEN s.until IS NULL THEN s.fails ELSE 0 END) + 1 >= 3 THEN r.us + 86400000000 END,
  CASE WHEN r.us < s.until THEN 'refused' WHEN NOT r.ok AND (CASE WHEN s.until IS NULL THEN s.fails ELSE 0 END) + 1 >= 3 THEN 'opened' ELSE 'closed' END
FROM s JOIN r ON r.host = s.host AND r.rn = s.rn + 1)
SELECT host, id, ok, state FROM s""",
    "pacing_audit": """WITH g AS (SELECT user_id AS host, event_id AS id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events)
SELECT host, id, gap_us, coalesce(gap_us < 3600000000, false) AS too_fast FROM g""",
    "job_status": """WITH j AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, arg_max(CAST(json_extract(props, '$.k') AS INT), (ts, event_id)) AS done FROM events GROUP BY 1)
SELECT status, count(*) AS jobs, CAST(sum(done) AS BIGINT) AS done, CAST(count(*) * 100 AS BIGINT) AS total FROM j GROUP BY 1""",
    "error_category": """SELECT event_id, CASE event_type WHEN 'error' THEN '网络请求失败（已自动重试仍不通）——请检查网络或稍后重试'
  WHEN 'view' THEN '源站要求人机验证（反爬拦截）——当前网络出口被源站标记；换个网络或代理节点后重试'
  WHEN 'click' THEN '内容解析异常——该源返回了无法处理的数据，可能已改版（click）' ELSE event_type || ': ' || props END AS message FROM events""",
    "classify_outcome": """WITH o AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN event_type = 'error' THEN 'network'
  WHEN event_type IN ('view', 'click') AND value > 20 THEN 'verification' WHEN event_type = 'view' THEN 'ok' WHEN event_type = 'click' THEN 'blocked'
  WHEN event_type = 'signup' THEN 'rate_limited' ELSE 'http_error' END AS outcome FROM events)
SELECT event_id, outcome, outcome = 'ok' AS ok, outcome IN ('network', 'rate_limited', 'http_error') AS retry,
  CASE WHEN outcome = 'rate_limited' THEN greatest(10, coalesce(k, 10)) END AS wait_s FROM o""",
    "translation_memory": f"""WITH d AS (SELECT doc_id, {direction('text')} AS direction, {paras('text')} AS ps FROM documents),
q AS (SELECT doc_id, direction, CAST(unnest(generate_series(1, len(ps))) - 1 AS INT) AS para_idx, unnest(ps) AS para FROM d),
b AS (SELECT text, {direction('text')} AS direction, {paras('text')} AS ps FROM benchmark),
m AS (SELECT direction, unnest(ps) AS para FROM b UNION SELECT direction, text FROM b UNION SELECT direction, para FROM q WHERE length(para) < 25)
SELECT doc_id, direction, para_idx, para, CASE WHEN m.para IS NOT NULL THEN '* ' || q.para END AS translation FROM (SELECT * FROM q) q LEFT JOIN m USING (direction, para)""",
    "bilingual": f"""WITH c AS (SELECT conv_id, turn, role, {direction("role || chr(10) || text")} AS direction, list_filter({paras('text')}, lambda y: y <> role AND y <> '《' || role || '》') AS ps FROM conversations),
q AS (SELECT conv_id, turn, role, direction, unnest(ps) AS para, generate_subscripts(ps, 1) AS i FROM c)
SELECT CAST(conv_id AS VARCHAR) AS rel, turn AS chapter_idx, direction, role <> 'assistant' AS translated, CAST(i - 1 AS INT) AS para_idx,
  CASE WHEN role <> 'assistant' THEN para || chr(10) || '* ' || para ELSE para END AS block FROM q""",
    "ingest_stream": f"WITH {MAIN_TEXT} SELECT {HOST} AS source, page_id AS id, title, text AS content FROM main WHERE {strip('text')} <> ''",
    "ingest_batches": f"""WITH {MAIN_TEXT} SELECT {HOST} AS source, page_id AS id, CAST(page_id % 3 AS BIGINT) AS batch_id,
  md5(text) AS digest FROM main WHERE {strip('text')} <> ''""",
    "store_compacted": """SELECT source, CAST(d.doc_id AS VARCHAR) AS id, md5(CASE WHEN l.doc_id IS NULL THEN text ELSE text || '?' END) AS digest,
  CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS batch_id
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) <> 1""",
    "txt_files": """WITH b AS (SELECT conv_id AS id, CASE WHEN count(*) = 1 THEN min(text)
    ELSE string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) END AS content FROM conversations GROUP BY conv_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY id % 7 ORDER BY sha1('s|' || id)) - 1 AS k FROM b)
SELECT 'b' || (id % 7) || CASE WHEN k > 0 THEN '(' || k || ')' ELSE '' END || '.txt' AS file_name, CAST(length(content) AS INT) AS chars, md5(content) AS digest FROM n""",
    "cards_by_rules": rf"""WITH p AS (SELECT page_id, 'h' || (page_id % 4) AS host, html, CASE page_id % 4 WHEN 0 THEN regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)
    WHEN 1 THEN regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1) WHEN 2 THEN regexp_extract_all(html, '(?s)<a ([^>]*>.*?)</a>', 1) ELSE [] END AS cards FROM pages),
  c AS (SELECT page_id, host, unnest(cards) AS card, generate_subscripts(cards, 1) AS i FROM p),
  v AS (SELECT page_id, host, i, CASE WHEN host = 'h1' THEN left({one_line(unescape(tagless('card')))}, 20)
      ELSE {tagless('''regexp_extract(card, 'href="/([^"]*)"', 1)''')} END AS id,
    CASE host WHEN 'h0' THEN left({strip(unescape(tagless("regexp_extract(card, '(?s)<a[^>]*>(.*?)</a>', 1)")))}, 3)
      WHEN 'h1' THEN '' ELSE {one_line(unescape(tagless("regexp_extract(card, '(?s)>(.*)$', 1)")))} END AS label FROM c)
SELECT page_id, host, CAST(i - 1 AS INT) AS card_idx, id, label FROM v WHERE id <> ''""",
    "library_scan": """WITH b AS (SELECT conv_id AS id, CASE WHEN count(*) = 1 THEN min(text)
    ELSE string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) END AS content FROM conversations GROUP BY conv_id)
SELECT 'b' || id || CASE id % 3 WHEN 0 THEN '.txt.part' ELSE '.TXT' END AS rel, octet_length(encode(content)) AS length FROM b WHERE id % 3 < 2""",
    "get_books": """WITH b AS (SELECT conv_id AS id, count(*) AS n_chapters, CASE WHEN count(*) = 1 THEN min(text)
    ELSE string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) END AS content FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY id % 7 ORDER BY sha1('s|' || id)) - 1 AS k FROM b)
SELECT id, 'b_' || (id % 7) || CASE WHEN k > 0 THEN '(' || k || ')' ELSE '' END || '.txt' AS name, CAST(0 AS BIGINT) AS part, n_chapters, md5(content) AS digest FROM n""",
    "tree_listing": """SELECT replace(p_brand, '#', '') || ':d/' || p_partkey || '.TXT' AS id, CAST(p_partkey AS VARCHAR) AS title,
  'https://github.com/' || replace(p_brand, '#', '') || '/blob/main/d/' || p_partkey || '.TXT' AS url, 'd' AS folder
FROM part WHERE p_size % 5 <> 0 AND p_size % 2 = 0""",
    "library_increment": """WITH b AS (SELECT conv_id AS id, CASE WHEN count(*) = 1 THEN min(text)
    ELSE string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) END AS content FROM conversations GROUP BY conv_id)
SELECT 'b' || id || '.txt' AS rel, md5(content) AS digest, CAST(CASE WHEN id % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS run FROM b""",
    "read_pages": f"SELECT page_id, {HOST} AS host, md5(html) AS digest FROM pages",
    "registered_extractor": """SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS title FROM pages
WHERE regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) <> ''""",
}
