"""Comparison SQL: the derived tables as DuckDB CTEs.

``with_tables(body, ...)`` prefixes a query with the CTEs it names.  A CTE may
use those listed before it.
"""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}

TABLES["rd_pages"] = r"""
SELECT doc_id // 50 AS book_id, CAST(doc_id % 50 AS INT) AS page_index, text,
       (doc_id % 3 = 0) AS came_from_ocr,
       CASE WHEN doc_id % 50 < 4 THEN ['i','ii','iii','iv'][CAST(doc_id % 50 AS INT) + 1]
            ELSE CAST(doc_id % 50 - 3 AS VARCHAR) END AS page_label,
       lang, source, doc_id FROM documents
"""

TABLES["rd_lines"] = r"""
SELECT book_id, page_index, CAST(u.i - 1 AS INT) AS line_no, string_split(text, chr(10))[u.i] AS line
FROM rd_pages, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) u
"""

TABLES["rd_outline"] = r"""
SELECT book_id, CAST((page_index - 4) // 5 AS INT) AS ord, page_index,
       CASE page_index % 15 WHEN 4 THEN 0 WHEN 9 THEN 1 ELSE 2 END AS level,
       array_to_string(string_split(trim(string_split(text, chr(10))[1]), ' ')[1:4], ' ') AS title,
       page_index - 3 AS printed_page, 'arabic' AS page_style
FROM rd_pages WHERE page_index >= 4 AND page_index % 5 = 4
"""

TABLES["rd_toc_lines"] = r"""
SELECT book_id, 3 AS page_index, 0 AS line_no, 'Contents' AS line FROM (SELECT DISTINCT book_id FROM rd_outline)
UNION ALL
SELECT book_id, 3, 1 + ord * 2, CASE ord % 4
         WHEN 0 THEN 'Chapter ' || (ord + 1) || ' ' || title || ' ........ ' || printed_page
         WHEN 1 THEN (ord + 1) || '.1 ' || title || ' / ' || lpad(CAST(printed_page AS VARCHAR), 3, '0')
         WHEN 2 THEN (ord + 1) || '.1.1 ' || title || '  ' || printed_page
         ELSE 'Chapter ' || (ord + 1) || ' ' || title END FROM rd_outline
UNION ALL
SELECT book_id, 3, 2 + ord * 2, CAST(printed_page AS VARCHAR) FROM rd_outline WHERE ord % 4 = 3
"""

TABLES["rd_queries"] = r"""
SELECT item_id AS query_id, text AS query, item_id % (SELECT max(book_id) + 1 FROM rd_pages) AS book_id,
       CAST((item_id * 7) % 50 AS INT) AS focus_page,
       ['explanation','standard','context'][CAST(item_id % 3 AS INT) + 1] AS scope,
       ['economical','balanced','deep'][CAST((item_id // 3) % 3 AS INT) + 1] AS depth,
       (item_id % 4 = 0) AS whole_book,
       array_to_string(string_split(text, ' ')[2:4], ' ') AS phrase FROM benchmark
"""

TABLES["rd_words"] = r"""
WITH w AS (SELECT book_id, page_index, line_no, CAST(u.i - 1 AS INT) AS word_no, string_split(line, ' ')[u.i] AS word,
                  line FROM rd_lines, LATERAL (SELECT unnest(range(1, len(string_split(line, ' ')) + 1)) AS i) u),
     b AS (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY book_id, page_index, line_no ORDER BY word_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM w WHERE word <> '')
SELECT book_id, page_index, line_no, word_no, word AS text, 40 + (off % 220) * 10 AS x0,
       40 + (line_no * 3 + off // 220) * 17 AS y0, 40 + (off % 220) * 10 + length(word) * 10 AS x1,
       54 + (line_no * 3 + off // 220) * 17 AS y1, 60 + (word_no * 7 + line_no * 3) % 40 AS conf, 0 AS dup FROM b
UNION ALL
SELECT book_id, page_index, line_no, word_no, left(word, greatest(1, length(word) - 1)), 40 + (off % 220) * 10,
       40 + (line_no * 3 + off // 220) * 17, 30 + (off % 220) * 10 + length(word) * 10,
       54 + (line_no * 3 + off // 220) * 17, 50, 1 FROM b WHERE word_no % 9 = 0 AND length(word) > 2
"""

TABLES["rd_marks"] = r"""
SELECT l.doc_id AS mark_id, p.book_id, p.page_index, trim(string_split(p.text, chr(10))[1]) AS text,
       CASE WHEN l.toxic = 1 THEN 'annotation' ELSE 'highlight' END AS kind,
       ['yellow','red','blue'][CAST(l.doc_id % 3 AS INT) + 1] AS color,
       CASE WHEN l.quality = 1 THEN 'note ' || (l.doc_id % 11) END AS note,
       (l.doc_id % 7 = 0) AS exported, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * ((l.doc_id * 37) % 1440) AS created_at,
       p.page_index // 10 AS merge_group
FROM labels l JOIN rd_pages p USING (doc_id)
"""

TABLES["rd_turns"] = r"""
SELECT conv_id, turn, role, text AS content, conv_id % (SELECT max(book_id) + 1 FROM rd_pages) AS book_id,
       CASE WHEN role = 'user' THEN CAST((conv_id * 11 + turn) % 50 AS INT) END AS anchor_page,
       ((conv_id + turn) % 3 = 0) AS selected, ((conv_id * 7 + turn) % 5 = 0) AS exported
FROM conversations WHERE role IN ('user', 'assistant')
"""

TABLES["rd_usage_raw"] = r"""
SELECT conv_id, turn, length(content) AS n_chars, CASE conv_id % 4
  WHEN 0 THEN '{"usage":{"input_tokens":' || length(content) || ',"output_tokens":' || (turn + 1) * 9 || ',"input_tokens_details":{"cached_tokens":' || length(content) // 2 || '}}}'
  WHEN 1 THEN '{"usageMetadata":{"promptTokenCount":' || length(content) || ',"candidatesTokenCount":' || (turn + 1) * 5 || '}}'
  WHEN 2 THEN '{"data":{"usage":{"promptTokens":"' || length(content) || '","completionTokens":"' || (turn + 1) * 4 || '"}}}'
  ELSE '{"id":"no-usage"}' END AS payload FROM rd_turns WHERE role = 'assistant'
"""

TABLES["rd_activity"] = r"""
SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'toggle_bookmark'
         WHEN 'purchase' THEN 'navigate' WHEN 'signup' THEN 'open' ELSE 'delete' END AS action,
       CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 20 AS book_id,
       CAST(event_id % 50 AS INT) AS page_index FROM events
"""

TABLES["rd_speech"] = r"""
SELECT conv_id AS session_id, turn AS seq, (turn % 2 = 1) AS is_final,
       content AS text FROM rd_turns
"""


# The book text with the printed contents page in place of physical page 3.
TABLES["toc_book_lines"] = r"""
SELECT book_id, page_index, line_no, line FROM rd_lines WHERE page_index <> 3
UNION ALL SELECT book_id, page_index, CAST(line_no AS INT), line FROM rd_toc_lines
"""


def define(name: str, sql: str) -> None:
    TABLES[name] = sql


def with_tables(body: str, **local: str) -> str:
    """Prefix ``body`` with every CTE it needs, directly or not, in order of
    definition.  ``local`` adds CTEs of this query alone, after the others."""
    known = {**TABLES, **local}
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\b[a-z]\w*\b", sql)) & set(known):
            if name not in needed:
                needed.add(name)
                visit(known[name])

    visit(body)
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in known if n in needed)
    return f"WITH {ctes}\n{body.strip()}" if ctes else body.strip()


# --- text rules without look-around -------------------------------------------------------


def stripped(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def normalized(x: str) -> str:
    """N1 for text without CJK: every look-around becomes a captured neighbour,
    applied twice where neighbours can overlap."""
    t = x
    for _ in range(2):
        t = rf"regexp_replace({t}, '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '([。！？.!?；;：:])\s*\n\s*', '\1' || chr(10), 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([^。！？.!?；;：:\s])\s*\n\s*(\S)', '\1 \2', 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return stripped(t)


def despaced(x: str) -> str:
    """N2 for text without CJK: digits by captured neighbours, letter runs by a
    fence around the whole run."""
    t = x
    for _ in range(2):
        t = rf"regexp_replace({t}, '([0-9])[ \t]+([0-9])', '\1\2', 'g')"
    run = r"(^|[^\p{L}\p{N}\p{M}_])((?:[A-Za-z][ \t]+){2,}[A-Za-z])($|[^\p{L}\p{N}\p{M}_])"
    for _ in range(2):
        t = rf"regexp_replace({t}, '{run}', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    return (
        f"array_to_string(list_transform(string_split({t}, chr(1)), lambda s: "
        f"CASE WHEN contains(s, chr(2)) THEN "
        rf"regexp_replace(string_split(s, chr(2))[1], '[ \t]+', '', 'g') "
        f"|| array_to_string(string_split(s, chr(2))[2:], '') ELSE s END), '')"
    )


def inlined(x: str) -> str:
    """N3 for text without CJK."""
    t = rf"regexp_replace({x}, '[\t ]+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?[\n\r][ \n\r]*', chr(10), 'g')"
    t = f"trim({t}, ' ' || chr(10))"
    t = rf"regexp_replace({t}, '-\n([a-z])', '\1', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '([A-Za-z0-9_])\n([A-Za-z0-9_])', '\1 \2', 'g')"
    return despaced(f"replace({t}, chr(10), '')")


def key(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', '', 'g')"


def projection(x: str) -> str:
    return rf"regexp_replace(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}]', '', 'g')"


def token_estimate(x: str) -> str:
    """N7 for text without Han characters."""
    runs = rf"regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{N}}]+')"
    other = rf"regexp_replace({x}, '[\p{{L}}\p{{M}}\p{{N}}\s]', '', 'g')"
    units = (
        f"(coalesce(list_sum(list_transform({runs}, lambda r: greatest(20, length(r) * 5))), 0)"
        f" + length({other}) * 7)"
    )
    return f"CASE WHEN {x} = '' THEN 0 ELSE greatest(1, CAST(ceil({units} / 20) AS INT)) END"


def token_list(x: str) -> str:
    """N8 for text without Han characters."""
    return (
        rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), "
        "lambda w: length(w) >= 2 AND length(w) <= 40)"
    )
