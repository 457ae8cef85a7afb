"""Contents pages: detection, parsing, repair.

Lines are (book_id, page_index, line_no, line); entries are (book_id, ord,
title, printed_page, page_style, level).  A detected contents range has at
most 25 pages, which bounds the contents lines and parsed entries of a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.plans.containment import contains_pairs
from pagework.plans.running import (
    PAGES_PER_BLOCK, block_of, keep_first, numbered, running,
)
from pagework.plans.stage import stage

# Line patterns of printed contents pages.
PAGE = "(?:[0-9]{1,4}|[ivxlcdm]{1,10})"
HEADING = (
    "(?i)^(?:(?:目\\s*[录錄次])(?:\\s*contents)?|contents|table\\s+of\\s+contents|sommaire"
    "|inhaltsverzeichnis|indice|目録)(?:\\s+[0-9ivxlcdm]+)?$"
)
ENTRY = f"(?i)^.{{2,160}}?(?:\\.{{2,}}|…+|·{{2,}}|\\s{{2,}})\\s*{PAGE}\\s*$"
COMPACT_ENTRY = (
    "(?i)^(?:第.{1,20}[篇部卷章节]|chapter\\s+\\S+|part\\s+\\S+"
    "|[0-9]{1,3}(?:\\.[0-9]{1,3}){0,3}\\s+\\S).{1,120}\\s+[0-9]{1,4}\\s*$"
)
STRUCTURAL = (
    "(?i)^(?:第.{1,60}[篇部卷章节]|chapter\\s+\\S+|part\\s+\\S+"
    "|[0-9]{1,3}(?:\\.[0-9]{1,3}){0,3}\\s+\\S)"
)
NUMBER_ONLY = f"(?i)^[\\[（(]?\\s*{PAGE}\\s*[\\]）)]?$"
TRAILING = f"(?i)(?:\\.+|…+|·+|[-—:/／]|\\s)\\s*{PAGE}\\s*$"
LEADERS = f"(?i)(?:\\.{{2,}}|…+|·{{2,}})\\s*{PAGE}\\s*$"
NOISE = "(?i)^(?:目\\s*[录錄次]|contents|table of contents|目録)$"
OPEN, CLOSE = "[（(\\[【{]?", "[）)\\]】}]?"
PAGE_ONLY = f"(?i)^(?:[/／]\\s*)?(?:p\\.?\\s*)?(?:[/／]\\s*)?{OPEN}\\s*{PAGE}\\s*{CLOSE}$"
TITLE_AND_PAGE = (
    "(?i)^(.{1,180}?)(?:(?<!\\d)\\.|\\.{2,}|…+|·{2,}|[/／]+|\\s{2,}|[-—–]\\s*|\\s+)"
    f"(?:p\\.?\\s*)?{OPEN}\\s*({PAGE})\\s*{CLOSE}\\s*$"
)
ENTRY_START = (
    "(?i)^(?:第.{1,30}(?:部分|篇|部|卷|章|节)|[上中下前后](?:篇|部|卷)|chapter\\s+\\S+|part\\s+\\S+"
    "|(?:\\d+\\.)*\\d+\\s+|序言|前言|引言|导言|导论|绪论|结语|后记|附录|参考文献|索引)"
)
PART = "(?i)^(?:第.{1,20}(?:部分|篇|部|卷)|[上中下前后](?:篇|部|卷)|part\\s+\\S+)"
UNITS = [
    f"(?i)^(?:第\\s*[{T.NUMERALS}]+\\s*(?:篇|部|卷|部分)|[上中下前后](?:篇|部|卷)|part\\s+\\S+)",
    f"(?i)^(?:第\\s*[{T.NUMERALS}]+\\s*章|chapter\\s+\\S+)",
    f"(?i)^(?:第\\s*[{T.NUMERALS}]+\\s*节|section\\s+\\S+)",
]
ENUMERATION = "^(?:[一二三四五六七八九十百千零〇两]+|[0-9]+)[、.．。)）]\\s*\\S"
# A number in front of a title.  Four parts are an address, and part of the title before
# them, unless they open the line or follow a led page; no start lies inside one.
LED_PAGE = "(?:\\.{2}|…|·{2}|[/／]|\\s{2}|(?<!\\d)\\.)\\s{0,3}\\d{1,4}\\s{1,3}"
NUMBERED = (
    f"(?:(?<=^\\s{{0,8}})|(?<={LED_PAGE})|(?<![0-9])(?<![0-9]\\.)(?!{T.ADDRESS}))"
    "[0-9]{1,3}(?:\\.[0-9]{1,3})+\\s+(?=\\S)"
)
COMBINED = (
    f"(?i)(?<![\\p{{IsHan}}A-Za-z])(第\\s*[{T.NUMERALS}]+\\s*[篇部卷章节]|chapter\\s+[0-9ivxlcdm]+"
    f"|part\\s+[0-9ivxlcdm]+|section\\s+[0-9]+(?:\\.[0-9]+)*|{NUMBERED}"
    "|序言|前言|引言|导言|导论|绪论|结语|后记|附录|参考文献|索引)"
)
NAMED = (
    "(?i)(?<=[0-9ivxlcdm])\\s+(?=(?:序言|前言|引言|导言|导论|绪论|结语|后记|附录|参考文献|索引)(?:\\s|。|$))"
)
BACK, FORWARD = 4, 20


def page_profiles(lines: DataFrame) -> DataFrame:
    """T1. One row of counts per page; pages without text count nothing."""
    trimmed = lines.select("book_id", "page_index", "line_no", T.strip("line").alias("line"))
    filled = trimmed.where("line <> ''")
    line = F.col("line")
    # A heading counts among the first 30 lines with text: only numbers are
    # shuffled, no line is.
    thirtieth = F.get(F.array_sort(F.collect_list("line_no")), F.lit(29))
    heading = F.min(F.when(T.fold("line").rlike(HEADING), F.col("line_no")))

    def total(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counted = filled.groupBy("book_id", "page_index").agg(
        F.coalesce(heading <= thirtieth, heading.isNotNull()).alias("has_heading"),
        total(line.rlike(ENTRY) | line.rlike(COMPACT_ENTRY)).alias("same_line"),
        total(line.rlike(STRUCTURAL)).alias("structural"),
        total(line.rlike(NUMBER_ONLY)).alias("number_only"),
        total((F.length(line) <= 180) & line.rlike(TRAILING)).alias("paged_lines"),
        total(line.rlike(LEADERS)).alias("leaders"),
        total(F.length(line).between(2, 100)).alias("_short"),
        F.count("*").alias("_lines"),
    )
    return counted.select(
        "book_id",
        "page_index",
        "has_heading",
        "same_line",
        "structural",
        "number_only",
        "paged_lines",
        "leaders",
        F.greatest("same_line", F.least("structural", "number_only"), "paged_lines").alias("entries"),
        (F.greatest("same_line", "paged_lines") + F.col("number_only")).alias("signal"),
        F.round(F.col("_short") / F.col("_lines"), 6).alias("short_share"),
    )


def is_strong() -> Column:
    return (
        ((F.col("leaders") >= 3) & (F.col("entries") >= 3))
        | ((F.col("signal") >= 6) & (F.col("short_share") >= 0.6))
        | ((F.col("structural") >= 4) & (F.col("signal") >= 3))
    )


def is_continuation() -> Column:
    return (
        F.col("has_heading")
        | (F.col("leaders") >= 2)
        | (F.col("same_line") >= 4)
        | ((F.col("number_only") >= 4) & (F.col("entries") >= 4) & (F.col("short_share") >= 0.55))
        | ((F.col("structural") >= 4) & (F.col("signal") >= 3))
    )


def toc_seed(profiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """T2. (book_id, seed_page): the best page with a heading, else the best
    strong page of the first half; the first of equals.  ``sizes``: n_pages."""
    n = F.col("n_pages")
    rows = profiles.join(sizes, "book_id")
    score = F.round(
        F.when(F.col("has_heading"), 20).otherwise(0)
        + F.col("entries") * 3 + F.col("leaders") * 2 + F.col("signal") + F.col("structural")
        + F.col("short_share") * 3
        + 4 * (1 - F.col("page_index") / F.greatest(n, F.lit(1))),
        6,
    )
    early = F.col("page_index") < F.greatest(F.floor(n / 2), F.lit(1))
    seed = rows.where(F.col("has_heading") | (is_strong() & early))
    order = F.struct(F.col("has_heading"), score, (-F.col("page_index")).alias("p"))
    return seed.groupBy("book_id").agg(F.max_by("page_index", order).alias("seed_page"))


def toc_range(profiles: DataFrame, seeds: DataFrame) -> DataFrame:
    """T3. Contents pages: the unbroken run of continuation pages around the
    seed, at most 4 back and 20 on.  ``seeds`` may also be given by hand."""
    near = profiles.withColumn("_go", is_continuation()).join(seeds, "book_id").where(
        F.col("page_index").between(F.col("seed_page") - BACK, F.col("seed_page") + FORWARD)
    )
    page, seed = F.col("page_index"), F.col("seed_page")
    stops = near.where(~F.col("_go")).groupBy("book_id").agg(
        F.max(F.when(page < seed, page)).alias("_low"),
        F.min(F.when(page > seed, page)).alias("_high"),
    )
    # A page without any text has no profile and breaks the run as well.
    gaps = near.groupBy("book_id", "seed_page").agg(F.collect_set("page_index").alias("_set"))
    window = F.sequence(F.greatest(F.lit(0), seed - BACK), seed + FORWARD)
    empty = F.filter(window, lambda p: ~F.array_contains("_set", p))
    gaps = gaps.select(
        "book_id",
        F.array_max(F.filter(empty, lambda p: p < seed)).alias("_low_gap"),
        F.array_min(F.filter(empty, lambda p: p > seed)).alias("_high_gap"),
    )
    bounded = near.join(stops, "book_id", "left").join(gaps, "book_id")
    low = F.coalesce(F.greatest("_low", "_low_gap"), F.lit(-1))
    high = F.coalesce(F.least("_high", "_high_gap"), F.lit(2**31 - 1))
    return bounded.where((page > low) & (page < high)).select("book_id", "page_index")


def detect_toc(lines: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, contents pages)."""
    profiles = page_profiles(lines)
    return profiles, toc_range(profiles, toc_seed(profiles, sizes))


def title_keys(entries: DataFrame) -> DataFrame:
    """(book_id, ord, needle): key of a title, and without its sequence."""
    keys = F.array_distinct(
        F.array(
            T.comparison_key("title"), T.comparison_key(T.title_without_sequence("title"))
        )
    )
    return entries.select("book_id", "ord", F.explode(keys).alias("needle")).where(
        F.length("needle") >= 2
    )


def infer_toc_pages(entries: DataFrame, pages: DataFrame, profiles: DataFrame,
                    detected: DataFrame) -> DataFrame:
    """T4. Pages that name many known titles, and their neighbours that name one."""
    needles = title_keys(entries)
    texts = pages.select("book_id", "page_index", "text")
    pairs = contains_pairs(needles, texts, ["book_id"], ["page_index"], T.comparison_key)
    matches = pairs.join(needles, ["book_id", "needle"]).groupBy("book_id", "page_index").agg(
        F.countDistinct("ord").alias("matches")
    )
    sizes = pages.groupBy("book_id").agg(F.count("*").alias("n_pages"))
    known = entries.groupBy("book_id").agg(F.count("*").alias("n_entries"))
    rows = (
        profiles.select("book_id", "page_index", "has_heading", "signal", "entries")
        .join(matches, ["book_id", "page_index"], "left")
        .join(sizes, "book_id").join(known, "book_id")
        .join(detected.withColumn("_found", F.lit(True)), ["book_id", "page_index"], "left")
    )
    m, n = F.coalesce("matches", F.lit(0)), F.col("n_entries")
    early = F.col("page_index") < F.least(
        F.col("n_pages"), F.greatest(F.lit(80), F.ceil(F.col("n_pages") * F.lit(0.35)))
    )
    enough = early & F.when(n <= 2, (m == n) & (m >= 2)).otherwise(m >= F.least(F.lit(3), n))
    paired = (m >= 2) & (
        F.col("has_heading") | (early & ((F.col("signal") >= 2) | (F.col("entries") >= 2)))
    )
    chosen = F.coalesce("_found", F.lit(False)) | enough | paired
    eligible = (m >= 1) & ((F.col("signal") >= 1) | (F.col("entries") >= 1))
    kept = rows.select(
        "book_id", "page_index", chosen.alias("_chosen"), (chosen | eligible).alias("_keep")
    ).where("_keep")
    # Growth to neighbours: a run of kept pages counts when it holds a chosen one.
    placed = numbered(kept, ["book_id"], ["page_index"],
                      block_of("page_index", PAGES_PER_BLOCK), "_n")
    runs = placed.withColumn("_run", F.col("page_index") - F.col("_n"))
    grown = runs.where("_chosen").select("book_id", "_run").distinct()
    return runs.join(grown, ["book_id", "_run"]).select("book_id", "page_index")


def build_toc_text(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """T5. Text of the contents pages of each book with page markers."""
    rows = pages.join(chosen, ["book_id", "page_index"], "left_semi").select(
        "book_id", "page_index", T.strip("text").alias("text")
    ).where("text <> ''")
    block = F.concat(F.lit("[P"), (F.col("page_index") + 1).cast("string"), F.lit("]\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("page_index", block.alias("block"))))
    return rows.groupBy("book_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n---\n\n").alias("toc_text")
    )


def join_trailing_digits(c: Column | str) -> Column:
    """A page number printed as spaced digits at the end of a line.  A digit that a
    wider gap parts from single-spaced ones is not of that number."""
    blank = "[ \\t　]"
    return F.regexp_replace(
        T.col(c),
        f"(?<!\\d)(\\d)(?!{blank}{{2,}}\\d{blank}\\d){blank}+(\\d)(?:{blank}+(\\d))?(?:{blank}+(\\d))?{blank}*$",
        "$1$2$3$4",
    )


ENTRY_AHEAD = "(?=\\S.{0,160}(?:[/／]|\\.+|…|·)\\s*\\d{1,4}(?:\\s|$))"


def normalize_toc_lines(lines: DataFrame) -> DataFrame:
    """T6. Digits joined, ``Chapter1`` spaced, vertical or flattened contents
    headings removed; a flattened line is broken after its page numbers.

    Adds ``sub_no``: the place of a piece in its line.
    """
    spaced = F.regexp_replace(
        T.nfkc("line"), "(?i)\\b(part|chapter|section)(?=[0-9ivxlcdm]+(?:\\s|$|\\p{IsHan}))", "$1 "
    )
    spaced = F.regexp_replace(spaced, "(?i)^\\s*c\\s+ontents\\s*$", "Contents")
    rows = lines.withColumn("line", join_trailing_digits(F.translate(spaced, "​⁠\r", "")))
    page = Window.partitionBy("book_id", "page_index")
    filled = F.when(F.trim("line") != "", F.col("line_no"))
    heads = rows.where("trim(line) <> ''").withColumn(
        "_place", F.row_number().over(page.orderBy("line_no"))
    ).where("_place <= 2").groupBy("book_id", "page_index").agg(
        F.max_by("line", -F.col("_place")).alias("_first"),
        F.max_by("line", "_place").alias("_second"),
        F.min("line_no").alias("_first_no"),
        F.max("line_no").alias("_second_no"),
    ).where(
        F.ltrim("_first").startswith("目") & F.ltrim("_second").rlike("^[录錄]")
        & (F.col("_first_no") < F.col("_second_no"))
    )
    joined = rows.join(heads.drop("_first", "_second"), ["book_id", "page_index"], "left")
    line = (
        F.when(F.col("line_no") == F.col("_first_no"), F.regexp_replace("line", "^\\s*目\\s*", ""))
        .when(F.col("line_no") == F.col("_second_no"),
              F.regexp_replace("line", "^\\s*[录錄]\\s*", ""))
        .otherwise(F.col("line"))
    )
    stripped = joined.withColumn("line", line).withColumn(
        "_flat",
        F.regexp_replace(
            F.regexp_replace("line", f"^\\s*目\\s+{ENTRY_AHEAD}", ""),
            f"(?<=\\d)\\s+[录錄]\\s+{ENTRY_AHEAD}", " ",
        ),
    )
    broken = F.regexp_replace("_flat", "((?:[/／]|(?<!\\d)\\.)\\s*\\d{1,4})\\s+(?=\\S)", "$1\n")
    pieces = F.split(F.when(F.col("_flat") != F.col("line"), broken).otherwise(F.col("line")), "\n")
    return stripped.select(
        "book_id", "page_index", "line_no", F.posexplode(pieces).alias("sub_no", "line")
    )


def clean_line(c: Column | str) -> Column:
    t = F.regexp_replace(T.nfkc(c), "(?i)^\\s*(?:目\\s*[录錄次]|contents|table\\s+of\\s+contents)\\s*(?=\\S)", "")
    t = F.regexp_replace(
        t, f"(?i)[／/]+\\s*(?=(?:p\\.?\\s*)?{OPEN}\\s*{PAGE}\\s*{CLOSE}\\s*$)", " "
    )
    t = F.regexp_replace(t, "^[•●▪◆◇※*#]+\\s*", "")
    return T.strip(F.regexp_replace(t, "[\\t ]+", " "))


# A single dot also ends a sentence, and words like "mi" are roman digits: no page.
SINGLE_LEADER = f"(?:(?<!\\d)\\.\\s*[0-9]{{1,4}}|(?:\\.{{2,}}|…+|·{{2,}}|[/／])\\s*{PAGE})"


def split_combined(c: Column | str) -> Column:
    """T7. Array of entries of a line that holds several.

    A line with two or more entry starts is cut at each; words like "contents"
    before the first are no entry.  Any other line is cut where a page is followed
    by a named part, and behind a led page that another led entry follows.
    """
    x = T.col(c)
    marked = F.regexp_replace(x, COMBINED, "\n$1")
    cuts = F.length(marked) - F.length(x)
    named = F.regexp_replace(x, NAMED, "\n")
    led = F.regexp_replace(
        named, f"(?i)({SINGLE_LEADER})\\s+(?=\\S.{{1,160}}?{SINGLE_LEADER}\\s*$)", "$1\n"
    )

    def parts(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda s: s != "")

    started = T.bound(parts(marked), lambda p: F.filter(p, lambda s, i: (i > 0) | ~s.rlike(NOISE)))
    return F.when(F.length(x) < 6, parts(x)).when(cuts >= 2, started).otherwise(parts(led))


def title_and_page(c: Column | str) -> Column:
    """T8. ``struct(title, value, style)`` of a complete line, or null."""
    x = T.col(c)
    title = T.strip(F.regexp_extract(x, TITLE_AND_PAGE, 1))
    page = T.printed_page(F.lower(F.regexp_extract(x, TITLE_AND_PAGE, 2)))
    return F.when(
        (title != "") & page.isNotNull(),
        F.struct(title.alias("title"), page["value"].alias("value"), page["style"].alias("style")),
    )


def page_only(c: Column | str) -> Column:
    x = T.strip(c)
    return F.when(x.rlike(PAGE_ONLY), T.printed_page(T.printed_page_token(x)))


def clean_entry_title(c: Column | str) -> Column:
    """T12."""
    t = F.regexp_replace(T.remove_spurious_spaces(T.nfkc(c)), "\\s*([•·])\\s*", "$1")
    t = F.regexp_replace(t, "[.·…\\s]+$", "")
    t = T.strip(F.regexp_replace(t, "\\s+", " "))
    n = T.NUMERALS
    for pattern in (
        f"^(第\\s*[{n}]+\\s*(?:部分|篇|部|卷|章|节))(?=\\S)",
        "^([上中下前后](?:篇|部|卷))(?=\\S)",
        "^([0-9]{1,3}(?:\\.[0-9]{1,3})+)(?=[\\p{IsHan}A-Za-z])",
        "^([0-9]{1,3})(?=[\\p{IsHan}A-Za-z])",
        f"^([{n}]+[、．。)）])(?=\\S)",
    ):
        t = F.regexp_replace(t, pattern, "$1 ")
    return F.regexp_replace(t, "(?i)^(part|chapter|section)\\s*([0-9ivxlcdm]+)\\s+(?=\\S)", "$1 $2 ")


def classify(lines: DataFrame) -> DataFrame:
    """Contents lines ready for parsing: cleaned, split, without noise, with
    what each line is.  Adds ``seq``, the place of the line in its book."""
    pieces = normalize_toc_lines(lines).select(
        "book_id", "page_index", "line_no", "sub_no",
        F.posexplode(split_combined(clean_line("line"))).alias("part_no", "line"),
    ).where((F.col("line") != "") & ~F.col("line").rlike(NOISE))
    rows = numbered(
        pieces, ["book_id"], ["page_index", "line_no", "sub_no", "part_no"],
        block_of("page_index", PAGES_PER_BLOCK), "seq",
    )
    return describe(rows.select("book_id", "seq", "line"))


def describe(rows: DataFrame) -> DataFrame:
    tagged = rows.withColumns({"alone": page_only("line"), "full": title_and_page("line")})
    division = F.col("full").isNull() & clean_entry_title("line").rlike(PART)
    return tagged.withColumns(
        {
            "division": division,
            "starts": F.coalesce(F.col("full.title"), F.col("line")).rlike(ENTRY_START),
        }
    )


def pair_detached(rows: DataFrame) -> DataFrame:
    """T9. A run of at least two page-only lines right after as many plain
    titles is zipped with them, division titles left out.

    Segments start after every line that ends a run of titles; inside one, the
    last titles meet the pages by rank from the end.
    """
    page = F.col("alone").isNotNull()
    bad = (~page & F.col("full").isNotNull()) | (~page & ~F.length("line").between(2, 180))
    kind = F.when(page, "p").when(bad, "x").otherwise("t")
    tagged = rows.withColumn("_kind", kind)
    keys, block = ["book_id"], block_of("seq")
    seen = running(tagged, keys, ["seq"], block, last={"_prev": F.col("_kind")}, inclusive=False)
    fresh = (F.col("_kind") == "x") | ((F.col("_kind") == "t") & (F.col("_prev") != "t"))
    segments = running(
        seen.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("long")),
        keys, ["seq"], block, total={"_seg": F.col("_fresh")},
    )
    plain = (F.col("_kind") == "t") & ~F.col("division")
    within = Window.partitionBy("book_id", "_seg")
    back = within.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = segments.withColumns(
        {
            "_titles": F.count(F.when(plain, 1)).over(within),
            "_pages": F.count(F.when(page, 1)).over(within),
            "_t": F.when(plain, F.sum(plain.cast("int")).over(back)),
            "_p": F.when(page, F.sum(page.cast("int")).over(back)),
        }
    )
    zipped = (F.col("_pages") >= 2) & (F.col("_titles") >= F.col("_pages"))
    pages = ranked.where(zipped & F.col("_p").isNotNull()).select(
        "book_id", "_seg", F.col("_p").alias("_t"), F.col("line").alias("_number")
    )
    joined = ranked.where(~(zipped & F.col("_p").isNotNull())).join(
        pages, ["book_id", "_seg", "_t"], "left"
    )
    line = F.when(
        F.col("_number").isNotNull(), F.concat("line", F.lit(" "), "_number")
    ).otherwise(F.col("line"))
    return joined.select("book_id", "seq", line.alias("line"))


RAW = "array<struct<title:string,value:int,style:string,inherits:boolean>>"


def parse_contents(rows: DataFrame) -> DataFrame:
    """T10 and T11. Entries (book_id, ord, title, printed_page, page_style, level).

    ``rows`` are classified contents lines.  The reading of lines is a state
    machine (titles wait for their page), folded per book over the lines of
    its contents range.
    """
    item = F.struct(
        "seq", "line", "division", "starts",
        F.col("alone").isNotNull().alias("is_page"),
        F.col("full").isNotNull().alias("is_full"),
        F.coalesce("full.value", "alone.value").alias("value"),
        F.coalesce("full.style", "alone.style").alias("style"),
        F.col("full.title").alias("title"),
    )
    gathered = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("wait"),
        F.expr(f"cast(array() as {RAW})").alias("out"),
    )

    def entry(title: Column, row: Column, paged: bool) -> Column:
        return F.struct(
            title.alias("title"),
            (row["value"] if paged else F.lit(None).cast("int")).alias("value"),
            (row["style"] if paged else F.lit(None).cast("string")).alias("style"),
            (F.lit(False) if paged else row["division"]).alias("inherits"),
        )

    def step(state: Column, row: Column) -> Column:
        wait, out = state["wait"], state["out"]
        n = F.size(wait)
        newest = F.get(wait, n - 1)
        shorter = F.slice(wait, F.lit(1), F.greatest(n - 1, F.lit(0)))

        def made(w: Column, o: Column) -> Column:
            return F.struct(w.alias("wait"), o.alias("out"))

        absorbs = ~row["starts"] & (n > 0)
        full = F.when(
            absorbs,
            made(shorter, F.array_append(out, entry(F.concat(newest, F.lit(" "), row["title"]), row, True))),
        ).otherwise(made(wait, F.array_append(out, entry(row["title"], row, True))))
        alone = F.when(n == 0, state).otherwise(
            made(F.slice(wait, F.lit(2), n), F.array_append(out, entry(F.get(wait, F.lit(0)), row, True)))
        )
        grown = F.array_append(shorter, F.concat(newest, F.lit(" "), row["line"]))
        title = F.when(
            row["starts"] | (n == 0) | (F.length(row["line"]) > 90),
            made(F.array_append(wait, row["line"]), out),
        ).otherwise(made(grown, out))
        return (
            F.when(row["division"] & ~row["is_page"],
                   made(wait, F.array_append(out, entry(row["line"], row, False))))
            .when(row["is_page"], alone)
            .when(row["is_full"], full)
            .otherwise(title)
        )

    def finish(state: Column) -> Column:
        rest = F.transform(
            state["wait"],
            lambda t: F.struct(
                t.alias("title"), F.lit(None).cast("int").alias("value"),
                F.lit(None).cast("string").alias("style"), F.lit(False).alias("inherits"),
            ),
        )
        return F.concat(state["out"], rest)

    parsed = gathered.select(
        "book_id", F.posexplode(F.aggregate("_items", start, step, finish)).alias("ord", "e")
    ).select(
        "book_id", "ord", "e.title", F.col("e.value").alias("printed_page"),
        F.col("e.style").alias("page_style"), "e.inherits",
    )
    parsed = stage(parsed, "parsed")
    # Cleaning joins numbers, also an address to the number before it.
    numbered_title = F.regexp_replace("title", f"(?<=\\d)\\s+{T.ADDRESS}", "")
    paged = inherit_division_page(parsed).withColumn("_numbered", clean_entry_title(numbered_title))
    cleaned = paged.withColumn("title", clean_entry_title("title")).where(
        F.length("title").between(2, 180)
        & (F.col("printed_page").isNotNull() | F.col("title").rlike(ENTRY_START))
    )
    key = F.concat(T.comparison_key("title"), F.lit("|"),
                   F.coalesce(F.col("printed_page").cast("string"), F.lit("nil")))
    unique = keep_first(cleaned.withColumn("_key", key), ["book_id", "_key"], ["ord"])
    parts = parsed.groupBy("book_id").agg(F.max(F.col("title").rlike(PART)).alias("_has_part"))
    return unique.join(parts, "book_id").select(
        "book_id", "ord", "title", "printed_page", "page_style",
        raw_level(F.col("title"), F.col("_has_part"), F.col("_numbered")).alias("level"),
    )


def raw_level(title: Column, has_part: Column, numbered_title: Column | None = None) -> Column:
    """T13, raw variant: the level a single line suggests; its number is read from
    ``numbered_title``, by default the title."""
    number = title if numbered_title is None else numbered_title
    digits = F.regexp_extract(number, "^\\d+(?:\\.\\d+)*", 0)
    depth = F.least(F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit(""))), F.lit(5))
    return (
        F.when(title.rlike(PART), 0)
        .when(title.rlike("(?i)^(?:第.{1,30}章|chapter\\s+\\S+)"), F.when(has_part, 1).otherwise(0))
        .when(title.rlike("^第.{1,30}节"), F.when(has_part, 2).otherwise(1))
        .when(digits != "", depth)
        .otherwise(0)
    )


def inherit_division_page(entries: DataFrame, every_gap: bool = False) -> DataFrame:
    """T11. An unpaged division takes page and style of the next paged entry;
    ``every_gap`` fills all gaps, from the next entry, then from the last one."""
    keys, block = ["book_id"], block_of("ord")
    page = F.when(F.col("printed_page").isNotNull(), F.struct("printed_page", "page_style"))
    filled = running(entries, keys, ["ord"], block, last={"_next": page}, reverse=True)
    source = F.col("_next")
    if every_gap:
        filled = running(filled, keys, ["ord"], block, last={"_last": page})
        source = F.coalesce("_next", "_last")
        takes = F.col("printed_page").isNull()
    else:
        takes = F.col("printed_page").isNull() & F.col("inherits")
    return filled.withColumns(
        {
            "printed_page": F.when(takes, source["printed_page"]).otherwise(F.col("printed_page")),
            "page_style": F.when(takes, source["page_style"]).otherwise(F.col("page_style")),
        }
    ).drop("_next", "_last", "inherits")


def infer_levels(entries: DataFrame) -> DataFrame:
    """T13. Levels from the numbering system the whole book uses."""
    title = F.col("title")
    rank = F.when(title.rlike(UNITS[0]), 0).when(title.rlike(UNITS[1]), 1).when(
        title.rlike(UNITS[2]), 2)
    ranked = entries.withColumn("_rank", rank)
    book = ranked.groupBy("book_id").agg(
        F.coalesce(F.max(F.col("_rank") == 0), F.lit(False)).alias("_part"),
        F.coalesce(F.max(F.col("_rank") == 1), F.lit(False)).alias("_chapter"),
    )
    part, chapter = F.col("_part").cast("int"), F.col("_chapter").cast("int")
    digits = F.regexp_extract(title, "^[0-9]+(?:\\.[0-9]+)*", 0)
    depth = F.least(F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit(""))), F.lit(5))
    inferred = (
        F.when(F.col("_rank") == 0, 0)
        .when(F.col("_rank") == 1, part)
        .when(F.col("_rank") == 2, part + 1)
        .when(digits != "", F.least(F.lit(5), part * chapter + depth))
        .when(title.rlike(ENUMERATION), F.when(F.col("_chapter"), 1 + part).otherwise(0))
        .otherwise(F.col("level"))
    )
    level = F.least(F.lit(5), F.greatest(F.lit(0), F.col("level"), inferred))
    return ranked.join(book, "book_id").withColumn("level", level.cast("int")).select(
        *entries.columns
    )


def linewise_page(token: Column) -> Column:
    edge = "[()\\[\\]{}（）【】,，、:：/／]+"
    t = F.regexp_replace(F.lower(T.nfkc(token)), f"^{edge}|{edge}$", "")
    t = F.regexp_replace(t, "^(?:页码[:：]?|p\\.?)\\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, "^第(?=\\d+页$)", ""), "页$", "")
    return T.printed_page(T.printed_page_token(t))


def clean_sequence(token: Column) -> Column:
    edge = "[()\\[\\]{}（）【】,，、:：]+"
    return F.regexp_replace(F.regexp_replace(token, f"^{edge}|{edge}$", ""), "[、．。]$", "")


def linewise_body(c: Column) -> Column:
    """One entry line as single-spaced tokens: numbers loose, leaders gone."""
    t = F.regexp_replace(
        c, f"(?i)(?<=\\S)([（(\\[【{{]\\s*{PAGE}\\s*[）)\\]】}}])\\s*$", " $1")
    t = F.regexp_replace(t, "(?<=\\S)(第\\d{1,4}页)\\s*$", " $1")
    t = F.regexp_replace(t, "(?<![pP]\\.)(?<=[^\\d\\s])(\\d{1,4})\\s*$", " $1")
    t = F.regexp_replace(t, "^(\\d{1,4})(?=第|[\\p{IsHan}A-Za-z])", "$1 ")
    t = F.regexp_replace(t, "^(\\d+(?:\\.\\d+)+)(?=[^\\d.\\s])", "$1 ")
    t = F.regexp_replace(t, "(?<=[^\\dpP])\\.(?=\\s*\\d{1,4}\\s*$)", " ")
    t = F.regexp_replace(t, "(?:\\.{2,}|…+|·{2,}|\\||[/／]+)", " ")
    t = F.regexp_replace(t, "^[•●▪◆◇※*#]+\\s*", "")
    return T.strip(F.regexp_replace(t, "\\s+", " "))


def parse_linewise(lines: DataFrame) -> DataFrame:
    """T14. One entry per line; whether the sequence number is the first or the
    last of several numbers is decided per book; entries are put in sequence
    order when their pages are not increasing."""
    half = T.nfkc("line")
    rows = normalize_toc_lines(lines).select(
        "book_id", "page_index", "line_no", "sub_no",
        F.least(F.length(F.regexp_extract(half, "^[ \\t　]*", 0)), F.lit(5)).alias("level"),
        T.strip(half).alias("body"),
    ).where((F.col("body") != "") & ~F.col("body").rlike(NOISE))
    rows = rows.withColumn("_tokens", F.split(linewise_body(F.col("body")), " "))
    rows = rows.where(F.size("_tokens") >= 2).withColumn(
        "_pages", F.transform("_tokens", linewise_page)
    )
    places = F.filter(
        F.transform("_pages", lambda p, i: F.when(p.isNotNull(), i)), lambda i: i.isNotNull()
    )
    rows = rows.withColumn("_at", places).where(F.size("_at") > 0)
    rows = numbered(rows, ["book_id"], ["page_index", "line_no", "sub_no"],
                    block_of("page_index", PAGES_PER_BLOCK), "ord")
    # Read by the book's decision and by the entries: staged once.
    rows = stage(rows, "linewise")
    several = F.size("_at") >= 2

    def head(place: Column) -> Column:
        key = T.sequence_token_key(F.lower(clean_sequence(F.get("_tokens", place))))
        return F.when(several, F.get(key, F.lit(0)))

    rows = rows.withColumns(
        {"_first": head(F.get("_at", F.lit(0))), "_last": head(F.element_at("_at", -1))}
    )

    def score(c: str) -> Column:
        n, distinct = F.count(c), F.countDistinct(c)
        span = F.max(c).cast("double") - F.min(c).cast("double") + 1
        dense = distinct / F.greatest(span, F.lit(1.0))
        return F.when(
            (n >= 2) & (n == distinct), dense + F.when(F.min(c) <= 2, 0.35).otherwise(0.0)
        ).otherwise(0.0)

    books = rows.groupBy("book_id").agg(
        (score("_last") > score("_first") + 0.15).alias("_sequence_last")
    )
    joined = rows.join(books, "book_id")
    page_at = F.when(~several | F.col("_sequence_last"), F.get("_at", F.lit(0))).otherwise(
        F.element_at("_at", -1))
    sequence_at = F.when(several, F.when(F.col("_sequence_last"), F.element_at("_at", -1)).otherwise(
        F.get("_at", F.lit(0))))
    joined = joined.withColumns({"_page_at": page_at, "_sequence_at": sequence_at})
    rest = F.filter(
        "_tokens",
        lambda t, i: (i != F.col("_page_at"))
        & ~i.eqNullSafe(F.col("_sequence_at")),
    )
    sequence = F.coalesce(clean_sequence(F.get("_tokens", F.col("_sequence_at"))), F.lit(""))
    joined = joined.withColumns({"_rest": rest, "_sequence": sequence}).where(F.size("_rest") > 0)
    named = F.get("_rest", F.lit(0)).rlike("(?i)^(?:chapter|part|section)$")
    words = (
        F.when(F.col("_sequence") == "", F.col("_rest"))
        .when(named, F.concat(F.slice("_rest", 1, 1), F.array("_sequence"),
                              F.slice(F.col("_rest"), F.lit(2), F.size("_rest"))))
        .otherwise(F.concat(F.array("_sequence"), F.col("_rest")))
    )
    page = F.get("_pages", F.col("_page_at"))
    entries = joined.select(
        "book_id", "ord", "level", "_sequence",
        clean_entry_title(F.array_join(words, " ")).alias("title"),
        page["value"].alias("printed_page"), page["style"].alias("page_style"),
    ).where(F.length("title").between(2, 180))
    key = F.coalesce(
        T.sequence_token_key(F.lower(F.col("_sequence"))), T.sequence_key("title")
    )
    staged = stage(entries.withColumn("_key", key), "linewise-entries")
    return reorder_by_sequence(staged).drop("_sequence", "_key")


def reorder_by_sequence(entries: DataFrame) -> DataFrame:
    """Entries with a sequence key swap places until their keys increase, in
    books whose pages do not, when keys are unique."""
    keys = ["book_id"]
    seen = running(entries, keys, ["ord"], block_of("ord"),
                   last={"_before": F.col("printed_page")}, inclusive=False)
    books = seen.groupBy("book_id").agg(
        (
            F.coalesce(F.max(F.col("printed_page") < F.col("_before")), F.lit(False))
            & (F.count("_key") >= 2)
            & (F.count("_key") == F.countDistinct(F.array_join("_key", ".")))
        ).alias("_sort")
    )
    tagged = entries.join(books, "book_id")
    moving = F.col("_sort") & F.col("_key").isNotNull()
    staying = tagged.where(~moving).drop("_sort")
    moved = tagged.where(moving).drop("_sort")
    by_place = numbered(moved, keys, ["ord"], block_of("ord"), "_n").select("book_id", "_n", "ord")
    by_key = numbered(moved, keys, ["_key", "ord"],
                      F.floor(F.col("_key")[0] / 4096).cast("long"), "_n").drop("ord")
    return staying.unionByName(by_key.join(by_place, ["book_id", "_n"]).drop("_n"))


def pair_pages_by_row(titles: DataFrame, numbers: DataFrame) -> DataFrame:
    """T15. Zip titles with one number per row; values are sorted inside each
    run, a run ends at the first strong drop.

    ``titles``: book_id, ord from 0; ``numbers``: book_id, ord, value text,
    upper (largest page).  Adds printed_page, and per book ``missing`` and
    ``surplus`` counts.
    """
    value = F.regexp_replace("value", "\\D", "").cast("long")
    limit = titles.groupBy("book_id").agg(F.count("*").alias("_titles"))
    rows = numbers.join(limit, "book_id").withColumn(
        "_v", F.when((value > 0) & (value <= F.col("upper")) & (F.col("ord") < F.col("_titles")),
                     value.cast("int"))
    )
    surplus = rows.groupBy("book_id").agg(
        F.count(F.when(F.col("ord") >= F.col("_titles"), 1)).alias("surplus"),
        (F.max("_titles") - F.count("_v")).alias("missing"),
    )
    kept = rows.where("_v IS NOT NULL").select("book_id", "ord", "_v")
    keys, block = ["book_id"], block_of("ord")
    seen = running(kept, keys, ["ord"], block, last={"_p": F.col("_v")}, inclusive=False)
    drop = (F.col("_v") < F.col("_p")) & (
        F.col("_v") <= F.greatest(F.lit(12), F.floor(F.col("_p") / 2))
    )
    runs = running(seen.withColumn("_drop", F.coalesce(drop, F.lit(False)).cast("long")),
                   keys, ["ord"], block, total={"_run": F.col("_drop")})
    runs = runs.select("book_id", "ord", "_v", F.least("_run", F.lit(1)).alias("_run"))
    run = ["book_id", "_run"]
    places = numbered(runs, run, ["ord"], block, "_n").select(*run, "_n", "ord")
    values = numbered(runs.select(*run, "ord", "_v"), run, ["_v", "ord"],
                      F.floor(F.col("_v") / 4096).cast("long"), "_n").select(*run, "_n", "_v")
    sorted_pages = places.join(values, [*run, "_n"]).select(
        "book_id", "ord", F.col("_v").alias("printed_page")
    )
    return titles.join(sorted_pages, ["book_id", "ord"], "left").join(surplus, "book_id", "left")


def monotonic_ratio(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over page styles of the share of non-decreasing neighbours."""
    style = F.coalesce("page_style", F.lit("arabic"))
    paged = entries.where("printed_page IS NOT NULL").withColumn("_style", style)
    group = [*keys, "_style"]
    seen = running(paged, group, ["ord"], block_of("ord"),
                   last={"_p": F.col("printed_page")}, inclusive=False)
    shares = seen.groupBy(*group).agg(
        F.count("*").alias("_n"),
        F.count(F.when(F.col("printed_page") >= F.col("_p"), 1)).alias("_up"),
    ).where("_n >= 2")
    return shares.groupBy(*keys).agg(
        F.avg(F.col("_up") / (F.col("_n") - 1)).alias("ratio")
    )


def parse_scores(entries: DataFrame, keys: list[str]) -> DataFrame:
    counts = entries.groupBy(*keys).agg(
        (F.count("printed_page") * 6
         + F.count(F.when(F.length("title").between(2, 120), 1)) * 2).alias("_base")
    )
    return counts.join(monotonic_ratio(entries, keys), keys, "left").select(
        *keys,
        F.coalesce("ratio", F.lit(1.0)).alias("ratio"),
        F.round(F.col("_base") + F.coalesce("ratio", F.lit(1.0)) * 10, 6).alias("score"),
    )


def choose_parse(flexible: DataFrame, linewise: DataFrame) -> DataFrame:
    """T16. Per book the parse with the higher score, joined with the other
    one's new entries unless that makes the page order worse."""
    a = flexible.withColumn("parser", F.lit("flexible"))
    b = linewise.withColumn("parser", F.lit("linewise"))
    both = stage(a.unionByName(b.select(*a.columns)), "parses")
    scores = parse_scores(both, ["book_id", "parser"])
    order = F.struct(F.col("score"), (F.col("parser") == "flexible").alias("first"))
    best = scores.groupBy("book_id").agg(F.max_by("parser", order).alias("parser"))
    primary = both.join(best, ["book_id", "parser"]).drop("parser")
    other = both.join(best.withColumnRenamed("parser", "_best"), "book_id").where(
        F.col("parser") != F.col("_best")).drop("parser", "_best")
    merged = stage(merge_entries(primary, other), "merged")
    before = parse_scores(primary, ["book_id"]).select("book_id", F.col("ratio").alias("_before"))
    after = parse_scores(merged, ["book_id"]).select("book_id", F.col("ratio").alias("_after"))
    better = before.join(after, "book_id").where(F.col("_after") + 0.001 >= F.col("_before"))
    accepted = merged.join(better, "book_id", "left_semi")
    kept = primary.join(better, "book_id", "left_anti")
    return accepted.unionByName(kept.select(*accepted.columns))


def merge_entries(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """T17. Equal titles, or titles of the same page that contain each other,
    fill page and style and take the secondary level; the others go after the
    last entry whose page is not larger, else to the end."""
    p = primary.withColumn("_key", T.comparison_key("title"))
    s = secondary.withColumn("_key", T.comparison_key("title"))
    left = p.select("book_id", F.col("ord").alias("_ord"), F.col("_key").alias("_pk"),
                    F.col("printed_page").alias("_pp"))
    right = s.select("book_id", F.col("ord").alias("_from"), "_key", "printed_page", "page_style",
                     "level")
    same = right.join(left, (right["book_id"] == left["book_id"]) & (F.col("_key") == F.col("_pk"))
                      ).drop(left["book_id"])
    near = right.join(
        left, (right["book_id"] == left["book_id"]) & F.col("printed_page").eqNullSafe(F.col("_pp"))
    ).drop(left["book_id"]).where(
        (F.least(F.length("_key"), F.length("_pk")) >= 3)
        & (F.contains("_key", "_pk") | F.contains("_pk", "_key"))
    )
    columns = ["book_id", "_from", "_ord", "printed_page", "page_style", "level"]
    hits = keep_first(same.select(*columns).unionByName(near.select(*columns)),
                      ["book_id", "_from"], ["_ord"])
    hits = stage(hits, "same-entries")
    updates = hits.groupBy("book_id", F.col("_ord").alias("ord")).agg(
        F.min_by("printed_page", F.when(F.col("printed_page").isNotNull(), F.col("_from"))).alias("_np"),
        F.min_by("page_style", F.when(F.col("page_style").isNotNull(), F.col("_from"))).alias("_ns"),
        F.max_by("level", "_from").alias("_nl"),
    )
    kept = p.join(updates, ["book_id", "ord"], "left").select(
        "book_id", F.col("ord").alias("_a"), F.lit(-1).cast("long").alias("_b"), "title",
        F.coalesce("printed_page", "_np").alias("printed_page"),
        F.coalesce("page_style", "_ns").alias("page_style"),
        F.coalesce("_nl", "level").alias("level"),
    )
    fresh = s.join(hits.select("book_id", F.col("_from").alias("ord")), ["book_id", "ord"], "left_anti")
    # As-of placement by page: the largest position among entries up to the page.
    points = fresh.where("printed_page IS NOT NULL").select(
        "book_id", F.col("printed_page").alias("_page"), F.lit(1).alias("_kind"),
        F.col("ord").alias("_id"), F.lit(None).cast("long").alias("_pos"))
    heads = p.where("printed_page IS NOT NULL").select(
        "book_id", F.col("printed_page").alias("_page"), F.lit(0).alias("_kind"),
        F.col("ord").alias("_id"), F.col("ord").cast("long").alias("_pos"))
    placed = running(
        points.unionByName(heads), ["book_id"], ["_page", "_kind", "_id"],
        F.floor(F.col("_page") / 4096).cast("long"), high={"_after": F.col("_pos")},
    ).where("_kind = 1").select("book_id", F.col("_id").alias("ord"), "_after")
    added = fresh.join(placed, ["book_id", "ord"], "left").select(
        "book_id", F.coalesce("_after", F.lit(2**40)).alias("_a"), F.col("ord").cast("long").alias("_b"),
        "title", "printed_page", "page_style", "level",
    )
    both = kept.unionByName(added)
    return numbered(both, ["book_id"], ["_a", "_b"], block_of("_a"), "_n").select(
        "book_id", (F.col("_n") - 1).cast("int").alias("ord"), "title", "printed_page",
        "page_style", "level",
    )


# Fixed value: a title that is only a page.
PAGE_TITLE = "(?i)^(?:page|p\\.?|第)?\\s*[ivxlcdm一二三四五六七八九十百千零〇0-9]+\\s*(?:页)?$"


def outline_plausible(outline: DataFrame, sizes: DataFrame) -> DataFrame:
    """T18. (book_id, plausible): not a list of pages in disguise."""
    keys = ["book_id"]
    titles = outline.withColumn("_title", T.strip("title"))
    counts = titles.groupBy("book_id").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("_title").rlike(PAGE_TITLE), 1)).alias("page_titles"),
        F.countDistinct(F.lower("_title")).alias("unique_titles"),
    )
    inside = outline.join(sizes, "book_id").where("page_index >= 0 AND page_index < n_pages")
    pages = inside.select("book_id", "page_index").distinct()
    seen = running(pages, keys, ["page_index"], block_of("page_index", PAGES_PER_BLOCK),
                   last={"_p": F.col("page_index")}, inclusive=False)
    runs = seen.groupBy("book_id").agg(
        F.count("*").alias("n_pages_hit"),
        F.count(F.when(F.col("page_index") - F.col("_p") == 1, 1)).alias("steps"),
    )
    rows = counts.join(runs, "book_id").join(sizes, "book_id")
    n = F.col("n")
    reject = (
        (F.col("page_titles") / n >= 0.45)
        | ((n >= 12) & (F.col("n_pages_hit") / F.greatest(F.col("n_pages"), F.lit(1)) >= 0.72))
        | ((F.col("n_pages_hit") >= 12) & (F.col("steps") / (F.col("n_pages_hit") - 1) >= 0.82))
        | (F.col("unique_titles") / n < 0.35)
    )
    return rows.select("book_id", (~reject).alias("plausible"))


def edit_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """T20. ``changes``: book_id, ord, new_level, shift (null to keep); levels
    stay in 0-5, pages at least 1, entries without a title go."""
    joined = entries.join(changes, ["book_id", "ord"], "left")
    level = F.least(F.lit(5), F.greatest(F.lit(0), F.coalesce("new_level", "level")))
    page = F.when(
        F.col("printed_page").isNotNull() & F.col("shift").isNotNull(),
        F.greatest(F.lit(1), F.col("printed_page") + F.col("shift")),
    ).otherwise(F.col("printed_page"))
    return joined.withColumns({"level": level, "printed_page": page}).where(
        T.strip("title") != "").drop("new_level", "shift")
