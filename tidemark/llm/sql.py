"""DuckDB counterparts of the queries that SQL can express.

Token ids, trained models, packings and the fold of the mixture are not among them; their
queries are tested against brute force in ``tests/llm``. Of the archives it is what their records hold.
"""

from __future__ import annotations

import string
import zlib

_CLOSURE = """
    reach AS (SELECT id AS node, id AS other FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
    component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)"""

WARC = """WITH
    p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    r AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS response FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
        CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM r"""

_NODE = r"""(SELECT translate(m.scheme, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || m.who || translate(m.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(m.u, length(m.scheme || m.who || m.host) + 1)
        FROM (SELECT u, regexp_extract(u, '^([^:/?#]*://)', 1) AS scheme, regexp_extract(u, '^[^:/?#]*://([^/?#]*@)', 1) AS who, regexp_extract(u, '^[^:/?#]*://(?:[^/?#]*@)?([^/?#]*)', 1) AS host FROM (SELECT regexp_extract(%s, '^([^#]*)', 1) AS u)) m)"""

URLS = r"""WITH RECURSIVE
    p AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, """ + _NODE % "coalesce(url, '')" + r""" AS node FROM pages),
    tags AS (SELECT node, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE rest <> ''),
    named AS (SELECT node, CASE WHEN regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
        WHEN regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS target FROM tags),
    e AS (SELECT DISTINCT node AS a, """ + _NODE % "replace(target, '&amp;', '&')" + r""" AS b FROM named WHERE contains(target, '://')),
    links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    nodes AS (SELECT DISTINCT a AS id FROM links),""" + _CLOSURE + r""",
    every AS (SELECT node FROM p UNION SELECT id FROM nodes),
    parts AS (SELECT node, CASE WHEN contains(node, '://') THEN substr(node, instr(node, '://') + 3) ELSE '' END AS rest FROM every),
    split AS (SELECT node, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
    ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM split),
    acted AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS action FROM ruled),
    spread AS (SELECT component_id, bool_or(coalesce(action = 'block', false)) AND NOT bool_or(coalesce(action = 'allow', false)) AS inherits FROM component JOIN acted USING (node) GROUP BY component_id)
    SELECT p.page_id, a.host, a.path, a.rule, coalesce(a.action, CASE WHEN s.inherits THEN 'block' ELSE 'allow' END) AS verdict, c.component_id AS alias_group
    FROM p JOIN acted a USING (node) LEFT JOIN component c USING (node) LEFT JOIN spread s USING (component_id)"""

QUALITY = r"""WITH
    w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w),
    again AS (SELECT doc_id, k FROM i QUALIFY count(*) OVER (PARTITION BY doc_id, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]) > 1),
    covered AS (SELECT doc_id, count(DISTINCT k + d) AS n FROM again, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
    m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs
        FROM w LEFT JOIN covered USING (doc_id)),
    v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
        OR 100 * n_upper > 50 * word_chars OR 100 * n_bangs > 30 * n_words AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT failed AS kept FROM v"""

MINHASH = rf"""WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w),
    s AS (SELECT DISTINCT doc_id, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS g FROM i UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    nodes AS (SELECT doc_id AS id FROM documents),{_CLOSURE}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN component ON node = doc_id LEFT JOIN n USING (doc_id)"""

EMBEDDINGS = rf"""WITH RECURSIVE
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
    nodes AS (SELECT vec_id AS id FROM embeddings),{_CLOSURE},
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component ON node = vec_id LEFT JOIN counted USING (vec_id)"""

#: The table of CRC-32: the state that each byte leaves where it was zero.
_CRC = [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]

SPELLING = f"""WITH RECURSIVE
    r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
    d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
    b AS (SELECT *, list_transform(string_split(id || ':' || run, ''), lambda c: unicode(c)) AS points FROM d),
    h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(points, lambda c: CASE WHEN c < 128 THEN [c::BIGINT] ELSE [195::BIGINT, c::BIGINT - 64] END))),
        lambda s, c: xor(s >> 8, {_CRC}[(xor(s, c) & 255) + 1]::BIGINT))) AS h FROM b),
    s AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
    pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
    f AS (SELECT w.word, w.n, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n, coalesce(n_near, 0) AS n_near FROM w LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT c.word, c.onward, f.form FROM chain c JOIN f ON f.word = c.onward)
    SELECT f.*, root FROM f JOIN chain USING (word) WHERE onward IS NULL"""
