"""Queries over contents pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagework.catalog import sql
from pagework.catalog.sql import with_tables
from pagework.functions import text as X
from pagework.operators import outline as O
from pagework.operators import toc as T
from pagework.plans.stage import stage
from pagework.sources import derived as D

QUERIES = {}
ORACLE = {}


def book_lines(spark, sf):
    """Lines of every book with the printed contents page as physical page 3."""
    lines = D.lines(spark, sf).where("page_index <> 3")
    return lines.unionByName(D.toc_lines(spark, sf))


def sizes(spark, sf):
    return D.pages(spark, sf).groupBy("book_id").agg(F.count("*").alias("n_pages"))


def detected(spark, sf):
    profiles = stage(T.page_profiles(book_lines(spark, sf)), "profiles")
    return profiles, T.toc_range(profiles, T.toc_seed(profiles, sizes(spark, sf)))


def book_pages(spark, sf):
    """The pages those lines make."""
    rows = D.toc_lines(spark, sf)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    page = rows.groupBy("book_id", "page_index").agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("text")
    )
    rest = D.pages(spark, sf).where("page_index <> 3").select("book_id", "page_index", "text")
    return rest.unionByName(page)


def t1_page_profile(spark, sf):
    return T.page_profiles(book_lines(spark, sf))


def t2_toc_seed(spark, sf):
    profiles = T.page_profiles(book_lines(spark, sf))
    return T.toc_seed(profiles, sizes(spark, sf))


def t3_toc_range(spark, sf):
    return detected(spark, sf)[1]


def t3_explicit_start(spark, sf):
    """Contents given by hand to start on page 5."""
    profiles = T.page_profiles(book_lines(spark, sf))
    seeds = sizes(spark, sf).select("book_id", F.lit(5).alias("seed_page"))
    return T.toc_range(profiles, seeds)


def t4_infer_toc_pages(spark, sf):
    profiles, found = detected(spark, sf)
    return T.infer_toc_pages(D.outline(spark, sf), book_pages(spark, sf), profiles, found)


def t5_build_toc_text(spark, sf):
    found = detected(spark, sf)[1]
    return T.build_toc_text(book_pages(spark, sf), found).select(
        "book_id", F.md5("toc_text").alias("digest")
    )


def t6_normalize_toc_lines(spark, sf):
    """Page numbers of the printed contents spaced digit by digit."""
    spaced = F.regexp_replace(
        F.regexp_replace("line", "(?<!\\d)(\\d)(\\d)(\\d)$", "$1 $2 $3"), "(?<!\\d)(\\d)(\\d)$", "$1 $2"
    )
    rows = T.normalize_toc_lines(D.toc_lines(spark, sf).withColumn("line", spaced))
    return rows.select("book_id", "line_no", "line")


def t7_split_combined(spark, sf):
    """Neighbouring entry lines glued together, then cut again: entry lines, and
    every line followed by a named part without a page."""
    lines = D.toc_lines(spark, sf).where("line_no % 2 = 1")
    named = lines.where("line <> 'Contents'").select(
        "book_id", (-1 - F.floor(F.col("line_no") / 4)).cast("int").alias("pair"),
        F.concat(F.lit("开始的故事 "), F.col("line_no"), F.lit("  附录")).alias("line"), "line_no",
    )
    pair = F.floor(F.col("line_no") / 4).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    glued = lines.groupBy("book_id", pair.alias("pair")).agg(
        F.array_join(F.transform(ordered, lambda e: F.trim(e["line"])), " ").alias("line")
    )
    glued = glued.unionByName(named.where("line_no % 4 = 1").select("book_id", "pair", "line"))
    return glued.select(
        "book_id", "pair", F.posexplode(T.split_combined("line")).alias("part_no", "line")
    )


def t8_title_and_page(spark, sf):
    rows = D.toc_lines(spark, sf).withColumn("e", T.title_and_page(T.clean_line("line")))
    return rows.where("e IS NOT NULL").select(
        "book_id", "line_no", "e.title", F.col("e.value").alias("page"), "e.style"
    )


def detached_lines(spark, sf):
    """The contents as two printed columns: all titles, then all pages."""
    o = D.outline(spark, sf)
    title = F.concat(F.lit("Chapter "), (F.col("ord") + 1).cast("string"), F.lit(" Topic"))
    titles = o.select("book_id", F.col("ord").cast("long").alias("seq"), title.alias("line"))
    numbers = o.select(
        "book_id", (F.col("ord") + 1000).cast("long").alias("seq"),
        F.col("printed_page").cast("string").alias("line"),
    )
    return titles.unionByName(numbers)


def t9_pair_detached(spark, sf):
    paired = T.pair_detached(T.describe(detached_lines(spark, sf)))
    return paired.select("book_id", "seq", "line")


def t10_parse_contents(spark, sf):
    return T.parse_contents(T.classify(D.toc_lines(spark, sf)))


def t11_inherit_page(spark, sf):
    """Every third entry lost its page; those of level 0 inherit, then all do."""
    lost = D.outline(spark, sf).withColumns(
        {
            "printed_page": F.when(F.col("ord") % 3 > 0, F.col("printed_page")),
            "inherits": F.col("level") == 0,
        }
    )
    one = T.inherit_division_page(lost).withColumn("rule", F.lit("division"))
    two = T.inherit_division_page(lost, True).withColumn("rule", F.lit("every gap"))
    return one.unionByName(two).select("rule", "book_id", "ord", "printed_page")


def t12_clean_entry_title(spark, sf):
    raw = F.concat(F.col("ord") + 1, F.lit(".2"), F.col("title"), F.lit("  · ...."))
    return D.outline(spark, sf).select("book_id", "ord", T.clean_entry_title(raw).alias("title"))


def t13_infer_levels(spark, sf):
    """Numbered titles; every second book also has parts."""
    n = (F.col("ord") + 1).cast("string")
    kind = F.col("ord") % 4
    title = (
        F.when((kind == 0) & (F.col("book_id") % 2 == 0), F.concat(F.lit("Part "), n))
        .when(kind == 0, F.concat(F.lit("Topic "), n))
        .when(kind == 1, F.concat(F.lit("Chapter "), n))
        .when(kind == 2, F.concat(n, F.lit(".1.2 Topic")))
        .otherwise(F.concat(F.lit("Section "), n))
    )
    rows = D.outline(spark, sf).withColumns({"title": title, "level": F.lit(0)})
    return T.infer_levels(rows).select("book_id", "ord", "title", "level")


def t14_parse_linewise(spark, sf):
    return T.parse_linewise(D.toc_lines(spark, sf))


def t15_pair_pages(spark, sf):
    """Pages of the outline in shuffled rows, with one restart, one row short
    in odd books and two rows long in even ones."""
    o = D.outline(spark, sf)
    half = F.col("ord") >= 5
    place = F.when(half, (F.col("ord") * 3) % 5 + 5).otherwise((F.col("ord") * 3) % 5)
    page = F.when(half, F.col("ord") - 4).otherwise(F.col("printed_page") + 30)
    rows = o.select(
        "book_id", place.cast("int").alias("ord"),
        F.concat(F.lit(".. "), page.cast("string")).alias("value"),
    )
    longer = o.where("ord < 2 AND book_id % 2 = 0").select(
        "book_id", (F.col("ord") + 10).alias("ord"), F.lit("99").alias("value"))
    numbers = rows.where("book_id % 2 = 0 OR ord <> 9").unionByName(longer).withColumn(
        "upper", F.lit(500))
    return T.pair_pages_by_row(o.select("book_id", "ord", "title"), numbers).select(
        "book_id", "ord", "printed_page", "missing", "surplus")


def two_parses(spark, sf):
    """The whole contents, and a second reading that lost every fourth entry,
    moved the levels and found one entry more."""
    a = stage(T.parse_contents(T.classify(D.toc_lines(spark, sf))), "parse")
    extra = a.where("ord = 2").withColumns(
        {"ord": F.lit(50), "title": F.lit("Appendix Z"), "printed_page": F.lit(12)})
    b = a.where("ord % 4 <> 3").withColumn("level", F.col("level") + 1).unionByName(extra)
    return a, b


def t16_choose_parse(spark, sf):
    a, b = two_parses(spark, sf)
    return T.choose_parse(a.where("ord % 5 <> 4 OR book_id % 2 = 0"), b)


def t17_merge_entries(spark, sf):
    a, b = two_parses(spark, sf)
    return T.merge_entries(b, a)


def t18_outline_plausible(spark, sf):
    """The outlines; one entry per page as another outline of every book."""
    per_page = D.pages(spark, sf).select(
        "book_id", "page_index", F.concat(F.lit("Page "), F.col("page_index") + 1).alias("title"))
    rows = D.outline(spark, sf).select("book_id", "page_index", "title")
    kinds = {"outline": rows, "pages": per_page}
    judged = [T.outline_plausible(r, sizes(spark, sf)).withColumn("kind", F.lit(k)) for k, r in kinds.items()]
    return judged[0].unionByName(judged[1])


def t20_edit_entries(spark, sf):
    o = D.outline(spark, sf)
    changes = o.where("ord % 2 = 0").select(
        "book_id", "ord", F.when(F.col("ord") % 4 == 0, F.col("level") + 4).alias("new_level"),
        F.when(F.col("ord") % 6 == 0, F.lit(-10)).alias("shift"))
    return T.edit_entries(o, changes).select("book_id", "ord", "level", "printed_page")


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _re(pattern: str) -> str:
    return f"regexp_matches(l, '{pattern}')"


sql.define("profiles", f"""
SELECT book_id, page_index, has_heading, same_line, structural, number_only, paged_lines, leaders,
  greatest(same_line, least(structural, number_only), paged_lines) AS entries,
  greatest(same_line, paged_lines) + number_only AS signal, round(short / lines, 6) AS short_share
FROM (SELECT book_id, page_index,
    bool_or(place <= 30 AND regexp_matches(strip_accents(lower(l)), '{T.HEADING}')) AS has_heading,
    {_count(_re(T.ENTRY) + ' OR ' + _re(T.COMPACT_ENTRY))} AS same_line,
    {_count(_re(T.STRUCTURAL))} AS structural, {_count(_re(T.NUMBER_ONLY))} AS number_only,
    {_count('length(l) <= 180 AND ' + _re(T.TRAILING))} AS paged_lines, {_count(_re(T.LEADERS))} AS leaders,
    {_count('length(l) BETWEEN 2 AND 100')} AS short, count(*) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY book_id, page_index ORDER BY line_no) AS place
    FROM (SELECT book_id, page_index, line_no, {sql.stripped('line')} AS l FROM toc_book_lines)
    WHERE l <> '') GROUP BY ALL)""")
sql.define("page_totals", "SELECT book_id, count(*) AS n_pages FROM rd_pages GROUP BY ALL")
sql.define("seeds", """
SELECT book_id, max_by(page_index, (has_heading, score, -page_index)) AS seed_page FROM (
  SELECT *, round(CASE WHEN has_heading THEN 20 ELSE 0 END + entries * 3 + leaders * 2 + signal + structural
    + short_share * 3 + 4 * (1 - page_index / n_pages), 6) AS score
  FROM profiles JOIN page_totals USING (book_id)
  WHERE has_heading OR (((leaders >= 3 AND entries >= 3) OR (signal >= 6 AND short_share >= 0.6)
    OR (structural >= 4 AND signal >= 3)) AND page_index < greatest(floor(n_pages / 2), 1))) GROUP BY ALL""")
_GO = """(has_heading OR leaders >= 2 OR same_line >= 4 OR (number_only >= 4 AND entries >= 4
  AND short_share >= 0.55) OR (structural >= 4 AND signal >= 3))"""


sql.define("going", f"SELECT book_id, page_index FROM profiles WHERE {_GO}")


def contiguous_sql(seeds: str) -> str:
    """A page is in range when every page between it and the seed continues."""
    return f"""
SELECT s.book_id, p.page_index FROM {seeds} s JOIN profiles p ON p.book_id = s.book_id
  AND p.page_index BETWEEN s.seed_page - 4 AND s.seed_page + 20
WHERE (SELECT count(*) FROM going g WHERE g.book_id = s.book_id AND g.page_index <> s.seed_page
    AND g.page_index BETWEEN least(p.page_index, s.seed_page) AND greatest(p.page_index, s.seed_page))
  = abs(p.page_index - s.seed_page)"""


sql.define("toc_found", contiguous_sql("seeds"))
sql.define("hand_seeds", "SELECT book_id, 5 AS seed_page FROM page_totals")
sql.define("book_texts", """
SELECT book_id, page_index, text FROM rd_pages WHERE page_index <> 3
UNION ALL SELECT book_id, 3, string_agg(line, chr(10) ORDER BY line_no) FROM rd_toc_lines GROUP BY book_id""")
ORACLE["t1_page_profile"] = with_tables("SELECT * FROM profiles")
ORACLE["t2_toc_seed"] = with_tables("SELECT book_id, seed_page FROM seeds")
ORACLE["t3_toc_range"] = with_tables("SELECT book_id, page_index FROM toc_found")
ORACLE["t3_explicit_start"] = with_tables(contiguous_sql("hand_seeds"))
_NOSEQ = (r"regexp_replace(title, '(?i)^(?:(?:chapter|part|section)\s+\S+|[0-9]+(?:\.[0-9]+)*)"
          r"[\s、.．:：\-]*', '')")
ORACLE["t4_infer_toc_pages"] = with_tables(
    """SELECT book_id, page_index FROM (SELECT *, bool_or(chosen) OVER (PARTITION BY book_id, run) AS grown FROM (
      SELECT *, page_index - row_number() OVER (PARTITION BY book_id ORDER BY page_index) AS run FROM judged
      WHERE chosen OR (m >= 1 AND (signal >= 1 OR entries >= 1)))) WHERE grown""",
    text_keys=f"SELECT book_id, page_index, {sql.key('text')} AS k FROM book_texts",
    entry_keys=f"SELECT book_id, ord, {sql.key('title')} AS k, {sql.key(_NOSEQ)} AS k2 FROM rd_outline",
    match_counts="""SELECT t.book_id, t.page_index, count(*) AS m FROM text_keys t JOIN entry_keys e
      ON e.book_id = t.book_id AND ((length(e.k) >= 2 AND contains(t.k, e.k))
        OR (length(e.k2) >= 2 AND contains(t.k, e.k2))) GROUP BY ALL""",
    judged="""SELECT p.book_id, p.page_index, p.signal, p.entries, coalesce(m.m, 0) AS m, f.page_index IS NOT NULL
      OR (early AND CASE WHEN n_entries <= 2 THEN coalesce(m.m, 0) = n_entries AND coalesce(m.m, 0) >= 2
        ELSE coalesce(m.m, 0) >= least(3, n_entries) END)
      OR (coalesce(m.m, 0) >= 2 AND (has_heading OR (early AND (signal >= 2 OR entries >= 2)))) AS chosen
      FROM (SELECT *, page_index < least(n_pages, greatest(80, ceil(n_pages * 0.35))) AS early
        FROM profiles JOIN page_totals USING (book_id)) p
      JOIN (SELECT book_id, count(*) AS n_entries FROM rd_outline GROUP BY ALL) USING (book_id)
      LEFT JOIN match_counts m USING (book_id, page_index)
      LEFT JOIN toc_found f USING (book_id, page_index)""",
)
ORACLE["t5_build_toc_text"] = with_tables(
    f"""SELECT book_id, md5(string_agg('[P' || (page_index + 1) || ']' || chr(10) || t, chr(10) || chr(10)
      || '---' || chr(10) || chr(10) ORDER BY page_index)) AS digest
    FROM (SELECT book_id, page_index, {sql.stripped('text')} AS t FROM book_texts
      JOIN toc_found USING (book_id, page_index)) WHERE t <> '' GROUP BY book_id"""
)
ORACLE["t6_normalize_toc_lines"] = with_tables("SELECT book_id, line_no, line FROM rd_toc_lines")
ORACLE["t7_split_combined"] = with_tables(
    r"""SELECT book_id, CAST(line_no // 4 AS INT) AS pair, CASE WHEN line_no % 4 = 1 THEN 0 ELSE 1 END AS part_no,
      trim(line) AS line FROM rd_toc_lines WHERE line_no % 2 = 1
    UNION ALL SELECT book_id, CAST(-1 - line_no // 4 AS INT), n, CASE n WHEN 0 THEN '开始的故事 ' || line_no ELSE '附录' END
    FROM rd_toc_lines, (VALUES (0), (1)) AS parts(n) WHERE line_no % 4 = 1 AND line <> 'Contents'"""
)
_TAIL = r"(?:p\.?\s*)?[（(\[【{]?\s*([0-9]{1,4}|[ivxlcdm]{1,10})\s*[）)\]】}]?\s*$"
_SEP = r"(?:\.{2,}|…+|·{2,}|[/／]+|\s{2,}|[-—–]\s*|\s+)"
sql.define("clean_toc_lines", rf"""
SELECT book_id, line_no, {sql.stripped(rf"regexp_replace(regexp_replace(line, '(?i)[／/]+\s*((?:p\.?\s*)?[0-9]{{1,4}}\s*)$', ' \1'), '[\t ]+', ' ', 'g')")} AS l
FROM rd_toc_lines WHERE line <> 'Contents'""")
sql.define("full_toc_lines", rf"""
SELECT book_id, line_no, l, trim(left(l, n)) AS title, lower(regexp_extract(substr(l, n + 1), '(?i)^(?:\.|{_SEP}){_TAIL}', 1)) AS p
FROM (SELECT *, list_filter(range(1, least(181, length(l))), lambda n:
    regexp_matches(substr(l, n + 1), '(?i)^{_SEP}{_TAIL}')
    OR (NOT regexp_matches(l[n], '[0-9]') AND regexp_matches(substr(l, n + 1), '(?i)^\.{_TAIL}')))[1] AS n
  FROM clean_toc_lines) WHERE n IS NOT NULL""")
_ROMAN = ("(list_sum(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN i < length(p) AND "
          "{v}[p[i]] < {v}[p[i + 1]] THEN -{v}[p[i]] ELSE {v}[p[i]] END)))").replace(
    "{v}", "MAP {'i': 1, 'v': 5, 'x': 10, 'l': 50, 'c': 100, 'd': 500, 'm': 1000}")
sql.define("valued_toc_lines", f"""
SELECT *, CAST(CASE WHEN regexp_matches(p, '^[0-9]') THEN CAST(p AS INT) ELSE {_ROMAN} END AS INT) AS page,
  CASE WHEN regexp_matches(p, '^[0-9]') THEN 'arabic' ELSE 'roman' END AS style FROM full_toc_lines""")
ORACLE["t8_title_and_page"] = with_tables(
    "SELECT book_id, line_no, title, page, style FROM valued_toc_lines WHERE title <> '' AND page > 0"
)
ORACLE["t9_pair_detached"] = with_tables(
    "SELECT book_id, ord AS seq, 'Chapter ' || (ord + 1) || ' Topic ' || printed_page AS line FROM rd_outline"
)
_CLEAN = rf"trim(regexp_replace(regexp_replace({sql.despaced('t')}, '[.·…\s]+$', ''), '\s+', ' ', 'g'))"
ORACLE["t10_parse_contents"] = with_tables(
    f"""SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY line_no) - 1 AS INT) AS ord, title,
      printed_page, page_style, level FROM (
      SELECT book_id, line_no, {_CLEAN} AS title, page AS printed_page, style AS page_style,
        CASE WHEN regexp_matches(t, '^[0-9]') THEN length(regexp_extract(t, '^[0-9.]+'))
          - length(replace(regexp_extract(t, '^[0-9.]+'), '.', '')) ELSE 0 END AS level
      FROM (SELECT book_id, line_no, title AS t, page, style FROM valued_toc_lines
          WHERE line_no % 2 = 1 AND title <> '' AND page > 0
        UNION ALL SELECT a.book_id, a.line_no, a.l, CAST(b.l AS INT), 'arabic' FROM clean_toc_lines a
          JOIN clean_toc_lines b ON b.book_id = a.book_id AND b.line_no = a.line_no + 1 AND a.line_no % 2 = 1
          WHERE NOT EXISTS (SELECT 1 FROM valued_toc_lines v WHERE v.book_id = a.book_id
            AND v.line_no = a.line_no AND v.title <> '' AND v.page > 0)))"""
)
ORACLE["t11_inherit_page"] = with_tables(
    """SELECT 'division' AS rule, book_id, ord, CASE WHEN p IS NULL AND level = 0 THEN nxt ELSE p END
      AS printed_page FROM gaps
    UNION ALL SELECT 'every gap', book_id, ord, coalesce(p, nxt, prv) FROM gaps""",
    gaps="""SELECT *, first_value(p IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ord ROWS BETWEEN CURRENT ROW
        AND UNBOUNDED FOLLOWING) AS nxt, last_value(p IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY ord) AS prv
      FROM (SELECT *, CASE WHEN ord % 3 > 0 THEN printed_page END AS p FROM rd_outline)""",
)
ORACLE["t12_clean_entry_title"] = with_tables(
    rf"""SELECT book_id, ord, regexp_replace({_CLEAN}, '^([0-9]+\.2)([A-Za-z])', '\1 \2') AS title
    FROM (SELECT book_id, ord, (ord + 1) || '.2' || title || '·....' AS t FROM rd_outline)"""
)
ORACLE["t13_infer_levels"] = with_tables(
    """SELECT book_id, ord, CASE ord % 4 WHEN 0 THEN CASE WHEN book_id % 2 = 0 THEN 'Part ' ELSE 'Topic ' END
        || (ord + 1) WHEN 1 THEN 'Chapter ' || (ord + 1) WHEN 2 THEN (ord + 1) || '.1.2 Topic'
        ELSE 'Section ' || (ord + 1) END AS title,
      CAST(CASE ord % 4 WHEN 0 THEN 0 WHEN 1 THEN part WHEN 2 THEN part * chapter + 2 ELSE part + 1 END AS INT)
        AS level
    FROM (SELECT *, CAST(bool_or(book_id % 2 = 0 AND ord % 4 = 0) OVER (PARTITION BY book_id) AS INT) AS part,
      CAST(bool_or(ord % 4 = 1) OVER (PARTITION BY book_id) AS INT) AS chapter FROM rd_outline)"""
)
ORACLE["t15_pair_pages"] = with_tables(
    """SELECT book_id, ord, CASE WHEN ord < 5 THEN printed_page + 30
      WHEN book_id % 2 = 1 THEN [1, 2, 3, 5, NULL][ord - 4] ELSE ord - 4 END AS printed_page,
      book_id % 2 AS missing, 2 - 2 * (book_id % 2) AS surplus FROM rd_outline"""
)
ORACLE["t18_outline_plausible"] = with_tables(
    "SELECT book_id, u >= 0.35 AND d < 0.45 AS plausible, 'outline' AS kind FROM rates "
    "UNION ALL SELECT DISTINCT book_id, false, 'pages' FROM rd_pages",
    rates=r"""SELECT book_id, count(DISTINCT lower(trim(title))) / count(*) AS u, count(*) FILTER (WHERE
      regexp_matches(trim(title), '(?i)^(?:page|p\.?)?\s*[ivxlcdm0-9]+\s*$')) / count(*) AS d
      FROM rd_outline GROUP BY ALL""",
)
ORACLE["t20_edit_entries"] = with_tables(
    """SELECT book_id, ord, CASE WHEN ord % 4 = 0 THEN least(5, level + 4) ELSE level END AS level,
      CASE WHEN ord % 6 = 0 THEN greatest(1, printed_page - 10) ELSE printed_page END AS printed_page
    FROM rd_outline WHERE trim(title) <> ''"""
)
for _fn in (t1_page_profile, t2_toc_seed, t3_toc_range, t3_explicit_start, t4_infer_toc_pages,
            t5_build_toc_text, t6_normalize_toc_lines, t7_split_combined, t8_title_and_page,
            t9_pair_detached, t10_parse_contents, t11_inherit_page, t12_clean_entry_title,
            t13_infer_levels, t14_parse_linewise, t15_pair_pages, t16_choose_parse,
            t17_merge_entries, t18_outline_plausible, t20_edit_entries):
    QUERIES[_fn.__name__] = _fn
