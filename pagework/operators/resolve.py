"""Printed page -> physical page.

Entries are (book_id, ord, title, printed_page, page_style, level) with ord
from 0; they come from at most 25 contents pages of a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.operators.toc import title_keys
from pagework.plans.containment import contains_pairs
from pagework.plans.running import block_of, keep_first, running, top_rows
from pagework.plans.stage import stage

HEAD_LINES, HEAD_CHARS = 18, 900
ENOUGH, KEPT = 0.82, 6


def repair_page_digits(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """R1. ``1ddd`` beyond the book's length is ``ddd`` when that exists."""
    joined = entries.join(sizes.select("book_id", "n_pages"), "book_id")
    page = F.col("printed_page")
    wrong = (
        ~F.coalesce("page_style", F.lit("arabic")).eqNullSafe("roman")
        & (page > F.col("n_pages"))
        & page.between(1001, 1999)
        & (page - 1000).between(1, F.col("n_pages"))
    )
    return joined.withColumn("printed_page", F.when(wrong, page - 1000).otherwise(page)).drop(
        "n_pages"
    )


def pagination_segments(entries: DataFrame) -> DataFrame:
    """R2. ``segment`` grows where the style changes or the numbers restart,
    compared with the last entry that has a page."""
    style = F.coalesce("page_style", F.lit("arabic"))
    page = F.col("printed_page")
    here = F.when(page.isNotNull(), F.struct(page.alias("page"), style.alias("style")))
    keys, block = ["book_id"], block_of("ord")
    seen = running(entries, keys, ["ord"], block, last={"_p": here}, inclusive=False)
    before = F.col("_p.page")
    restart = (before - page >= 5) & (page <= F.greatest(F.lit(3), F.floor(before / 3)))
    cut = page.isNotNull() & before.isNotNull() & ((F.col("_p.style") != style) | restart)
    cut = F.coalesce(cut, F.lit(False)).cast("long")
    return running(
        seen.withColumn("_cut", cut), keys, ["ord"], block, total={"segment": F.col("_cut")}
    ).drop("_p", "_cut")


def bigrams(key: Column) -> Column:
    """The distinct pairs of neighbouring characters, found in one pass."""
    pairs = F.regexp_extract_all(key, F.lit("(?s)(?=(..))."), F.lit(1))
    return F.when(F.length(key) < 2, F.array(key)).otherwise(F.array_distinct(pairs))


def head_key(text: Column | str) -> Column:
    head = F.left(F.substring_index(T.col(text), "\n", HEAD_LINES), F.lit(HEAD_CHARS))
    return T.comparison_key(F.replace(head, F.lit("\n"), F.lit(" ")))


def reach(title: Column) -> Column:
    """How many characters of a head may be similar to a title."""
    return F.greatest(F.length(title) * 4, F.lit(100))


def similar_pairs(needles: DataFrame, heads: DataFrame) -> DataFrame:
    """(book_id, needle, page_index) that may share enough bigrams.

    A title with g bigrams must share at least ceil(.82 g) of them, so one of
    its g - ceil(.82 g) + 1 rarest ones must occur: only those are joined, and
    common bigrams never meet all pages.  Heads offer the bigrams of the part
    that the book's longest title may be compared with.
    """
    wanted = needles.select("book_id", "needle").distinct().withColumn(
        "_grams", bigrams(F.col("needle"))
    )
    size = F.size("_grams")
    listed = wanted.select(
        "book_id", "needle", F.explode("_grams").alias("_gram"),
        (size - F.ceil(size * F.lit(ENOUGH)) + 1).cast("int").alias("_n"),
    )
    # Heads meet the book's wanted bigrams in their own row and offer only those.
    asked = listed.groupBy("book_id").agg(
        F.collect_set("_gram").alias("_asked"), F.max(reach(F.col("needle"))).alias("_reach"))
    held = F.array_intersect(bigrams(F.left("head", "_reach")), F.col("_asked"))
    # Read for the frequencies and for the pairs.
    offered = stage(heads.join(asked, "book_id").select(
        "book_id", "page_index", F.explode(held).alias("_gram")), "head-grams")
    frequency = offered.groupBy("book_id", "_gram").agg(F.count("*").alias("_df"))
    # A gram no page has leaves the title with fewer that can be shared; it
    # ranks first and simply finds nothing.
    ranked = top_rows(
        listed.join(frequency, ["book_id", "_gram"], "left"),
        ["book_id", "needle"], [F.coalesce("_df", F.lit(0)), "_gram"], F.col("_n"),
    )
    return offered.join(ranked.select("book_id", "needle", "_gram"), ["book_id", "_gram"]).select(
        "book_id", "needle", "page_index"
    ).distinct()


def line_score(lines: Column, title: Column) -> Column:
    """How well a title's key fits the best of a page's line keys."""
    size = F.length(title)
    return (
        F.when(F.exists(lines, lambda k: k == title), 1.0)
        .when(F.exists(lines, lambda k: k.startswith(title) & (F.length(k) <= size + 12)), 0.99)
        .when(F.exists(lines, lambda k: F.contains(k, title) & (F.length(k) <= size * 3 + 8)), 0.97)
        .otherwise(0.0)
    )


def head_score(head: Column, title: Column) -> Column:
    """How well a title's key fits the head of a page."""
    size = F.length(title)
    looked = bigrams(F.left(head, reach(title)))
    shared = T.bound(
        bigrams(title), lambda grams: F.size(F.array_intersect(grams, looked)) / F.size(grams))
    return (
        F.when(size <= 3, 0.0)
        .when(head.startswith(title), 1.0)
        .when(F.contains(head, title), 0.94)
        .otherwise(shared)
    )


def title_candidates(entries: DataFrame, pages: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """R3. The best six pages of each title: (book_id, ord, page_index, score).

    A title that a page's key contains is scored inside the page's row; a line
    that fits holds the title, and so does the page's key.  Titles that a head
    may share enough bigrams with are scored on the head alone.
    """
    key = ["book_id", "page_index"]
    searchable = pages.select(*key, "text").join(toc_pages, key, "left_anti").join(
        entries.select("book_id").distinct(), "book_id", "left_semi"
    )
    needles = stage(title_keys(entries), "needles")
    head, title = F.col("head"), F.col("needle")

    def scores(held: Column, _searched: Column) -> Column:
        lines = F.filter(F.transform(F.split("text", "\n"), T.comparison_key), lambda k: k != "")
        return T.bound(F.struct(lines.alias("lines"), head_key("text").alias("head")), lambda p: F.transform(
            held, lambda n: F.struct(n.alias("needle"), F.when(p["head"] != "", F.greatest(
                line_score(p["lines"], n), head_score(p["head"], n))).alias("score"))))

    whole = contains_pairs(
        needles, searchable, ["book_id"], ["page_index"], T.comparison_key, scores
    )
    # Filtered when read: a filter before would make every head twice.
    heads = stage(
        searchable.select(*key, head_key("text").alias("head")), "page-heads"
    ).where("head <> ''")
    near = similar_pairs(needles.where("length(needle) > 3"), heads).join(heads, key).select(
        *key, "needle", head_score(head, title).alias("score")
    )
    scored = whole.select(*key, "needle", "score").unionByName(near).select(
        *key, "needle", F.round("score", 6).alias("score")
    ).where(F.col("score") >= ENOUGH)
    best = scored.join(needles, ["book_id", "needle"]).groupBy("book_id", "ord", "page_index").agg(
        F.max("score").alias("score")
    )
    return top_rows(best, ["book_id", "ord"], [F.desc("score"), "page_index"], KEPT).drop("_rank")


def first_content(entries: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """(book_id, toc_start, first_page): contents bounds of every book, 0 without."""
    bounds = toc_pages.groupBy("book_id").agg(
        F.min("page_index").alias("toc_start"), (F.max("page_index") + 1).alias("first_page")
    )
    return entries.select("book_id").distinct().join(bounds, "book_id", "left").select(
        "book_id", "toc_start", F.coalesce("first_page", F.lit(0)).alias("first_page")
    )


def offset_consensus(segments: DataFrame, candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """R4. (book_id, segment, offset): the distance between physical and
    printed pages that most entries support within one page, at least two."""
    group = ["book_id", "segment"]
    votes = candidates.join(
        segments.where("printed_page IS NOT NULL").select("book_id", "ord", "segment", "printed_page"),
        ["book_id", "ord"],
    ).withColumn("offset", F.col("page_index") - F.col("printed_page"))
    near = votes.select(
        *group, "ord", "score",
        F.explode(F.array(F.col("offset") - 1, F.col("offset"), F.col("offset") + 1)).alias("offset"),
    )
    support = (
        near.groupBy(*group, "offset", "ord").agg(F.max("score").alias("score"))
        .groupBy(*group, "offset")
        .agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("weight"))
        .join(votes.select(*group, "offset").distinct(), [*group, "offset"], "left_semi")
    )
    final = segments.groupBy("book_id").agg(F.max("segment").alias("_final"))
    rows = support.join(final, "book_id").join(bounds, "book_id")
    preferred = F.when(F.col("segment") == F.col("_final"), F.col("first_page") - 1).otherwise(-1)
    order = [F.desc("n"), F.desc("weight"), F.abs(preferred - F.col("offset")), "offset"]
    return keep_first(rows, group, order).where("n >= 2").select(*group, "offset")


def monotonic_anchors(segments: DataFrame, candidates: DataFrame, offsets: DataFrame) -> DataFrame:
    """R5. (book_id, ord, segment, anchor): in entry order, the best candidate
    at or after the previous pick.  Each pick depends on the one before, so a
    segment's entries, at most six candidates each, are folded in order."""
    group = ["book_id", "segment"]
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("o"), "page_index", "score"))
    )
    listed = candidates.groupBy("book_id", "ord").agg(ordered.alias("_options"))
    rows = segments.join(listed, ["book_id", "ord"])
    gathered = rows.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("ord", "printed_page", "_options"))).alias("_items")
    ).join(offsets, group, "left")
    start = F.struct(
        F.lit(None).cast("int").alias("page"),
        F.lit(None).cast("int").alias("printed"),
        F.expr("cast(array() as array<struct<ord:int,anchor:int>>)").alias("out"),
    )

    def step(state: Column, item: Column) -> Column:
        options, printed = item["_options"], item["printed_page"]
        later = F.filter(options, lambda c: state["page"].isNull() | (c["page_index"] >= state["page"]))
        pool = F.when(F.size(later) > 0, later).otherwise(options)

        def value(c: Column, i: Column) -> Column:
            distance = F.abs(c["page_index"] - printed - F.col("offset"))
            vote = F.when(
                F.col("offset").isNotNull() & printed.isNotNull(),
                F.when(distance <= 1, 5.0).otherwise(distance * -0.7),
            ).otherwise(0.0)
            steady = F.when(
                state["page"].isNotNull() & (printed >= state["printed"]),
                F.abs((c["page_index"] - state["page"]) - (printed - state["printed"])) * -0.08,
            ).otherwise(c["page_index"] * -0.0001)
            return F.struct(
                F.round(c["score"] * 20 + vote + steady, 9).alias("v"),
                (-i).alias("i"),
                c["page_index"].alias("page"),
            )

        best = F.array_max(F.transform(pool, value))["page"]
        return T.bound(
            best,
            lambda page: F.struct(
                page.alias("page"),
                printed.alias("printed"),
                F.array_append(
                    state["out"], F.struct(item["ord"].alias("ord"), page.alias("anchor"))
                ).alias("out"),
            ),
        )

    folded = F.aggregate("_items", start, step, lambda s: s["out"])
    return gathered.select(*group, F.explode(folded).alias("a")).select(*group, "a.ord", "a.anchor")


def page_label_map(pages: DataFrame) -> DataFrame:
    """R6. (book_id, value, style, page_index) of declared labels, for books
    where any label differs from the page's own number; first page wins."""
    parsed = pages.where("page_label IS NOT NULL").select(
        "book_id", "page_index", T.printed_page(T.page_label_token("page_label")).alias("l")
    ).where("l IS NOT NULL").select("book_id", "page_index", "l.value", "l.style")
    plain = (F.col("style") == "arabic") & (F.col("value") == F.col("page_index") + 1)
    custom = parsed.where(~plain).select("book_id").distinct()
    return parsed.join(custom, "book_id", "left_semi").groupBy("book_id", "value", "style").agg(
        F.min("page_index").alias("page_index")
    )


def estimate_page(segments: DataFrame, anchors: DataFrame, bounds: DataFrame) -> DataFrame:
    """R7. (book_id, ord, estimate): between anchors linear, next to one anchor
    by printed distance, without anchors from the start of the book or of the
    text after the contents."""
    group, block = ["book_id", "segment"], block_of("ord")
    rows = segments.join(anchors.select("book_id", "ord", "anchor"), ["book_id", "ord"], "left")
    here = F.when(
        F.col("anchor").isNotNull(), F.struct("ord", "printed_page", F.col("anchor").alias("page"))
    )
    rows = running(rows, group, ["ord"], block, last={"_a": here}, inclusive=False)
    rows = running(rows, group, ["ord"], block, last={"_b": here}, inclusive=False, reverse=True)
    side = anchors.join(bounds, "book_id").groupBy(*group).agg(
        F.count(F.when(F.col("anchor") < F.col("first_page"), 1)).alias("_early"),
        F.count("*").alias("_anchors"),
    )
    final = segments.groupBy("book_id").agg(F.max("segment").alias("_final"))
    rows = rows.join(side, group, "left").join(final, "book_id").join(bounds, "book_id")
    a, b, printed = F.col("_a"), F.col("_b"), F.col("printed_page")
    between = b["printed_page"] > a["printed_page"]
    ratio = (printed - a["printed_page"]) / (b["printed_page"] - a["printed_page"])
    linear = F.round(a["page"] + ratio * (b["page"] - a["page"])).cast("int")
    nearest = (
        F.when(a.isNull(), b).when(b.isNull(), a)
        .when(F.col("ord") - a["ord"] <= b["ord"] - F.col("ord"), a).otherwise(b)
    )
    later = F.col("_final") > F.col("segment")
    plain = F.when(later, printed - 1).otherwise(F.col("first_page") + printed - 1)
    raw = F.when(between, linear).when(
        nearest["printed_page"].isNotNull(), nearest["page"] + printed - nearest["printed_page"]
    ).otherwise(plain)
    front = F.when(
        F.col("_anchors") > 0, F.col("_early") > F.floor(F.col("_anchors") / 2)
    ).otherwise(later)
    estimate = F.when(
        front & F.col("toc_start").isNotNull(),
        F.least(raw, F.greatest(F.col("toc_start") - 1, F.lit(0))),
    ).otherwise(F.greatest(raw, F.col("first_page")))
    return rows.select(
        "book_id", "ord", F.when(printed.isNotNull(), estimate).cast("int").alias("estimate")
    )


def resolve_outline(entries: DataFrame, pages: DataFrame, toc_pages: DataFrame,
                    keep_unmatched: bool = False) -> DataFrame:
    """R1-R8. (book_id, ord, title, page_index, level): a declared label of the
    roman or the last arabic run, else the title's anchor, else the estimate."""
    sizes = pages.groupBy("book_id").agg(
        F.count("*").alias("n_pages"),
        F.min("page_index").alias("_min"),
        F.max("page_index").alias("_max"),
    )
    segments = stage(pagination_segments(repair_page_digits(entries, sizes)), "segments")
    candidates = stage(title_candidates(segments, pages, toc_pages), "candidates")
    bounds = first_content(segments, toc_pages)
    offsets = offset_consensus(segments, candidates, bounds)
    anchors = stage(monotonic_anchors(segments, candidates, offsets), "anchors")
    estimates = estimate_page(segments, anchors, bounds)
    body = segments.where(
        ~F.coalesce("page_style", F.lit("arabic")).eqNullSafe("roman")
        & F.col("printed_page").isNotNull()
    ).groupBy("book_id").agg(F.max_by("segment", "ord").alias("_body"))
    labels = page_label_map(pages).select(
        "book_id", F.col("value").alias("printed_page"), F.col("style").alias("_style"),
        F.col("page_index").alias("_label"),
    )
    rows = (
        segments.withColumn("_style", F.coalesce("page_style", F.lit("arabic")))
        .join(labels, ["book_id", "printed_page", "_style"], "left")
        .join(anchors.select("book_id", "ord", "anchor"), ["book_id", "ord"], "left")
        .join(estimates, ["book_id", "ord"], "left")
        .join(body, "book_id", "left").join(bounds, "book_id").join(sizes, "book_id")
    )
    label = F.when(
        (F.col("_style") == "roman") | (F.col("segment") == F.col("_body")), F.col("_label")
    )
    page = F.coalesce(label, "anchor", "estimate")
    if keep_unmatched:
        page = F.coalesce(page, "first_page")
    placed = rows.withColumn("title", T.strip("title")).where(F.length("title").between(2, 180))
    placed = placed.withColumn(
        "page_index", F.least(F.greatest(page, F.col("_min")), F.col("_max")).cast("int")
    ).where(page.isNotNull())
    unique = keep_first(
        placed.withColumn("_key", T.comparison_key("title")),
        ["book_id", "_key", "page_index"], ["ord"],
    )
    level = F.least(F.lit(5), F.greatest(F.lit(0), F.col("level"))).cast("int")
    return unique.select("book_id", "ord", "title", "page_index", level.alias("level"))


def calibration_pages(segments: DataFrame, pages: DataFrame, toc_pages: DataFrame) -> DataFrame:
    """T19. Pages to recognise again before calibration: three around the
    estimate of each top-level entry, inside the book, not contents, not
    recognised yet."""
    bounds = first_content(segments, toc_pages)
    final = segments.groupBy("book_id").agg(F.max("segment").alias("_final"))
    top = segments.where("level <= 1 AND printed_page > 0").join(final, "book_id").join(
        bounds, "book_id"
    )
    start = F.when(F.col("segment") < F.col("_final"), 0).otherwise(F.col("first_page"))
    estimate = start + F.col("printed_page") - 1
    around = top.select(
        "book_id", F.explode(F.sequence(estimate - 3, estimate + 3)).alias("page_index")
    ).distinct()
    fresh = pages.where("NOT came_from_ocr").select("book_id", "page_index")
    return around.join(fresh, ["book_id", "page_index"], "left_semi").join(
        toc_pages, ["book_id", "page_index"], "left_anti"
    )
