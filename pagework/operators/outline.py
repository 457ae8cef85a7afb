"""Outline structure and chapter lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.plans.running import PAGES_PER_BLOCK, block_of, numbered, running

MAX_LEVEL = 5
LEVELS = range(MAX_LEVEL + 1)


def outline_paths(outline: DataFrame) -> DataFrame:
    """O1. Title path of every entry.

    A stack is not needed: with positions i from 0 the clamped level is
    ``i + min(0, min over j <= i of (level j - j))``, and the ancestor at depth
    d is the last title seen at that depth.
    """
    level = F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), F.col("level")))
    where = (["book_id"], ["ord"], block_of("ord"))
    placed = numbered(outline, *where, "_n").withColumn("_i", F.col("_n") - 1)
    clamped = running(placed, *where, low={"_low": level - F.col("_i")})
    clamped = clamped.withColumn(
        "_depth", (F.col("_i") + F.least(F.lit(0), F.col("_low"))).cast("int")
    )
    seen = running(
        clamped,
        *where,
        last={f"_t{d}": F.when(F.col("_depth") == d, F.col("title")) for d in LEVELS},
    )
    ancestors = F.array(*[F.col(f"_t{d}") for d in LEVELS])
    return seen.select(
        *outline.columns,
        F.slice(ancestors, F.lit(1), F.col("_depth") + 1).alias("path"),
    )


def page_positions(pages: DataFrame) -> DataFrame:
    return pages.select("book_id", "page_index")


def _with_points(points: DataFrame, paths: DataFrame, before: bool) -> DataFrame:
    """Points (book_id, page_index) and headings in one ordered table; a point
    sorts before the headings of its page when ``before``, else after them."""
    heads = paths.select(
        "book_id",
        "page_index",
        F.lit(1).alias("_kind"),
        "ord",
        F.struct("ord", "page_index", "level", "title", "path").alias("heading"),
    )
    marks = points.select(
        "book_id",
        "page_index",
        F.lit(0 if before else 2).alias("_kind"),
        F.lit(-1).alias("ord"),
        F.lit(None).cast(heads.schema["heading"].dataType).alias("heading"),
    )
    return marks.unionByName(heads)


def last_heading(points: DataFrame, paths: DataFrame, before: bool = False) -> DataFrame:
    """As-of join: for each distinct point the last heading, in outline order,
    on a page at or before it (``before``: the last by page, strictly before).

    Union plus a running value over page blocks; a book of any length is
    spread over its blocks.
    """
    union = _with_points(points, paths, before)
    order = ["page_index", "_kind", "ord"]
    block = block_of("page_index", PAGES_PER_BLOCK)
    value = {"heading": F.col("_h")}
    union = union.withColumnRenamed("heading", "_h")
    found = running(union, ["book_id"], order, block,
                    **({"last": value} if before else {"high": value}))
    return found.where(F.col("ord") == -1).select("book_id", "page_index", "heading")


def chapter_for_page(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """O2 without selected text: on a page that opens a sub-heading the page
    belongs to the parent, otherwise to the last heading so far."""
    found = last_heading(page_positions(pages), paths)
    h = F.col("heading")
    opens = h["page_index"] == F.col("page_index")
    on_page = paths.select("book_id", "page_index").distinct().withColumn("_opens", F.lit(True))
    joined = found.join(on_page, ["book_id", "page_index"], "left")
    path = (
        F.when(h.isNull(), F.expr("cast(array() as array<string>)"))
        .when((F.coalesce("_opens", F.lit(False)) | opens) & (h["level"] > 0),
              F.slice(h["path"], F.lit(1), F.size(h["path"]) - 1))
        .otherwise(h["path"])
    )
    return joined.select("book_id", "page_index", path.alias("path"))


def squeeze(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(T.normalize_text(c), "\\s", ""))


def chapter_for_passage(passages: DataFrame, paths: DataFrame) -> DataFrame:
    """O2 with selected text: among several headings on the page the last one
    whose title occurs in the text, else the last heading so far.

    ``passages`` has (book_id, page_index, passage_id, text).
    """
    found = last_heading(page_positions(passages).distinct(), paths)
    crowded = paths.withColumn("_key", squeeze("title")).groupBy("book_id", "page_index").agg(
        F.array_sort(F.collect_list(F.struct("ord", "_key", "path"))).alias("_heads")
    ).where(F.size("_heads") > 1)
    joined = passages.join(found, ["book_id", "page_index"], "left").join(
        crowded, ["book_id", "page_index"], "left"
    ).withColumn("_text", F.when(F.col("_heads").isNotNull(), squeeze("text")))
    hits = F.filter("_heads", lambda e: F.contains(F.col("_text"), e["_key"]))
    path = F.when(F.size(hits) > 0, F.element_at(hits, -1)["path"]).otherwise(
        F.coalesce(F.col("heading")["path"], F.expr("cast(array() as array<string>)"))
    )
    return joined.select("book_id", "page_index", "passage_id", path.alias("path"))


def heading_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(T.nfkc(c)), "[^\\p{L}\\p{M}\\p{N}]", "")


def page_segments(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """O3. Cut each page at its headings.

    ``pages`` carries the text that chunks are cut from.  Entries of a page are
    folded in order, each searched after the one before; the text before the
    first heading keeps the path of the last heading on an earlier page.
    Pages without a heading, the bulk, are never searched.
    """
    titled = paths.withColumn("_key", heading_key(T.strip("title")))
    entries = titled.groupBy("book_id", "page_index").agg(
        F.array_sort(
            F.collect_list(F.struct("ord", T.strip("title").alias("title"), "_key", "path"))
        ).alias("_entries")
    )
    previous = last_heading(page_positions(pages), paths, before=True).select(
        "book_id", "page_index", F.col("heading")["path"].alias("_previous")
    )
    joined = pages.join(previous, ["book_id", "page_index"]).join(
        entries, ["book_id", "page_index"], "left"
    )
    none = F.expr("cast(array() as array<string>)")
    before = F.coalesce("_previous", none)
    folded = F.when(F.col("_entries").isNotNull(), F.lower(T.nfkc_same_length("text")))
    joined = joined.withColumn("_fold", folded)

    def line_match(key: Column, start: Column) -> Column:
        """Start of the first matching line in the text from ``start`` on."""
        rest = F.split(F.substring(F.col("text"), start, F.length("text")), "\n")
        state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hit"))

        def step(s: Column, line: Column) -> Column:
            k = heading_key(line)
            longer = F.greatest(F.length(k), F.length(key))
            close = F.least(F.length(k), F.length(key)) / longer >= 0.65
            good = (F.length(k) >= 3) & close & (F.contains(k, key) | F.contains(key, k))
            return F.struct(
                (s["at"] + F.length(line) + 1).alias("at"),
                F.when((s["hit"] == 0) & good, start + s["at"]).otherwise(s["hit"]).alias("hit"),
            )

        return F.when(F.length(key) >= 3, F.aggregate(rest, state, step, lambda s: s["hit"])
                      ).otherwise(0)

    def place(state: Column, entry: Column) -> Column:
        exact = F.when(entry["title"] == "", 0).otherwise(
            F.call_function(
                "locate", F.lower(T.nfkc_same_length(entry["title"])), F.col("_fold"),
                state["start"]
            )
        )
        found = F.transform(
            F.array(exact),
            lambda e: F.when(e > 0, e).otherwise(line_match(entry["_key"], state["start"])),
        )
        return F.transform(
            found,
            lambda at: F.when(at == 0, state).otherwise(
                F.struct(
                    (at + 1).alias("start"),
                    F.array_append(
                        state["cuts"], F.struct(at.alias("at"), entry["path"].alias("path"))
                    ).alias("cuts"),
                )
            ),
        )[0]

    empty = F.struct(
        F.lit(1).alias("start"),
        F.expr("cast(array() as array<struct<at:int,path:array<string>>>)").alias("cuts"),
    )
    cuts = F.aggregate("_entries", empty, place, lambda s: s["cuts"])
    joined = joined.withColumn("_cuts", F.when(F.col("_entries").isNotNull(), cuts))

    n = F.size("_cuts")
    opening_path = F.when(F.size(before) == 0, F.col("_cuts")[0]["path"]).otherwise(before)
    opening = F.when(
        F.col("_cuts")[0]["at"] > 1,
        F.array(
            F.struct(
                T.strip(F.substring(F.col("text"), F.lit(1), F.col("_cuts")[0]["at"] - 1)).alias(
                    "text"
                ),
                opening_path.alias("path"),
            )
        ),
    ).otherwise(F.expr("cast(array() as array<struct<text:string,path:array<string>>>)"))

    def body(cut: Column, i: Column) -> Column:
        end = F.when(i + 1 < n, F.get(F.col("_cuts"), i + 1)["at"]).otherwise(
            F.length("text") + 1
        )
        return F.struct(
            T.strip(F.substring(F.col("text"), cut["at"], end - cut["at"])).alias("text"),
            cut["path"].alias("path"),
        )

    whole = F.array(
        F.struct(
            F.col("text"),
            F.when(F.col("_entries").isNotNull(), F.col("_entries")[0]["path"])
            .otherwise(before)
            .alias("path"),
        )
    )
    segments = F.when(F.coalesce(n, F.lit(0)) <= 0, whole).otherwise(
        F.concat(opening, F.transform("_cuts", body))
    )
    filled = F.filter(segments, lambda s: s["text"] != "")
    return joined.select(
        "book_id", "page_index", F.posexplode(filled).alias("seg_no", "segment")
    ).select("book_id", "page_index", "seg_no", "segment.text", "segment.path")


def chapter_spans(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """O5. ``[start_page, end_page)`` of every entry: up to the next page with
    an entry of its level or higher, else the end of the book.

    Per page the smallest level is kept; for each level the next such page is a
    running value from the back.
    """
    heads = outline.groupBy("book_id", "page_index").agg(F.min("level").alias("_level"))
    following = running(
        heads,
        ["book_id"],
        ["page_index"],
        block_of("page_index", PAGES_PER_BLOCK),
        last={
            f"_next{d}": F.when(F.col("_level") <= d, F.col("page_index")) for d in LEVELS
        },
        reverse=True,
        inclusive=False,
    ).select(
        "book_id", "page_index", F.array(*[F.col(f"_next{d}") for d in LEVELS]).alias("_next")
    )
    joined = outline.join(following, ["book_id", "page_index"]).join(page_counts, "book_id")
    return joined.select(
        *outline.columns,
        F.col("page_index").alias("start_page"),
        F.coalesce(F.get(F.col("_next"), F.col("level")), F.col("n_pages"))
        .cast("int")
        .alias("end_page"),
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id").agg((F.max("page_index") + 1).alias("n_pages"))


SPAN_PAGES = 64


def rows_in_spans(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Range join of rows (by page) to spans, on shared page buckets."""
    low = F.floor(F.col("start_page") / SPAN_PAGES).cast("long")
    high = F.floor((F.col("end_page") - 1) / SPAN_PAGES).cast("long")
    cut = spans.where("end_page > start_page").drop("page_index").withColumn(
        "_bucket", F.explode(F.sequence(low, high))
    )
    right = rows.withColumn("_bucket", F.floor(F.col("page_index") / SPAN_PAGES).cast("long"))
    joined = right.join(cut, ["book_id", "_bucket"])
    return joined.where(
        (F.col("page_index") >= F.col("start_page")) & (F.col("page_index") < F.col("end_page"))
    ).drop("_bucket")


def count_in_spans(spans: DataFrame, rows: DataFrame, size: Column | None = None) -> DataFrame:
    """Rows before the start and the end of every span (``first_row``,
    ``end_row``), and with ``size`` the total size inside (``n_size``), from
    running totals at the two ends: no pair of span and row is ever formed."""
    measure = F.lit(0) if size is None else size
    per_page = rows.groupBy("book_id", "page_index").agg(
        F.count("*").alias("n"), F.sum(measure).cast("long").alias("size")
    )
    zero = F.lit(0).cast("long")
    ends = (
        spans.select("book_id", F.explode(F.array("start_page", "end_page")).alias("page_index"))
        .distinct()
        .select("book_id", "page_index", zero.alias("n"), zero.alias("size"))
    )
    merged = per_page.withColumn("_end", F.lit(1)).unionByName(ends.withColumn("_end", F.lit(0)))
    counted = running(
        merged,
        ["book_id"],
        ["page_index", "_end"],
        block_of("page_index", PAGES_PER_BLOCK),
        total={"rows_before": F.col("n"), "size_before": F.col("size")},
    ).where("_end = 0")
    first = counted.select("book_id", F.col("page_index").alias("start_page"),
                           F.col("rows_before").alias("first_row"),
                           F.col("size_before").alias("_size0"))
    stop = counted.select("book_id", F.col("page_index").alias("end_page"),
                          F.col("rows_before").alias("end_row"),
                          F.col("size_before").alias("_size1"))
    joined = spans.join(first, ["book_id", "start_page"]).join(stop, ["book_id", "end_page"])
    return joined.withColumn("n_size", F.col("_size1") - F.col("_size0")).drop("_size0", "_size1")


def siblings(outline: DataFrame) -> DataFrame:
    """O6. Previous and next entry of the same level in the book."""
    me = F.struct("ord", "title")
    keys, block = ["book_id", "level"], block_of("ord")
    back = running(outline, keys, ["ord"], block, last={"previous": me}, inclusive=False)
    return running(
        back, keys, ["ord"], block, last={"following": me}, inclusive=False, reverse=True
    )


DIGEST_BLOCK = 4096


def ordered_digest(rows: DataFrame, keys: list[str], position: str, line: Column,
                   name: str) -> DataFrame:
    """sha256 of a group's block digests in order, where a block's digest is the
    sha256 of its lines in order; one rule for all sizes, and no task holds a
    group whole."""
    listed = F.array_sort(F.collect_list(F.struct(position, line.alias("line"))))
    joined = F.array_join(F.transform(listed, lambda r: r["line"]), "\x1e")
    blocks = (
        rows.withColumn("_block", block_of(position, DIGEST_BLOCK))
        .groupBy(*keys, "_block")
        .agg(F.sha2(joined, 256).alias("digest"))
    )
    digests = F.array_sort(F.collect_list(F.struct("_block", "digest")))
    return blocks.groupBy(*keys).agg(
        F.transform(digests, lambda d: d["digest"]).alias("_d")
    ).select(
        *keys,
        F.sha2(F.array_join("_d", "\x1e"), 256).alias(name),
    )


def outline_signature(outline: DataFrame) -> DataFrame:
    """O7."""
    line = F.concat_ws(
        "|",
        F.col("ord").cast("string"),
        F.col("page_index").cast("string"),
        F.col("level").cast("string"),
        F.col("title"),
    )
    return ordered_digest(outline, ["book_id"], "ord", line, "signature")


NOTE_PREFIXES = range(48, 7, -4)


def _place_in_key(needle: Column, key: Column) -> Column:
    """0-based place of a passage in the page key: its first 48, 44 ... 8
    characters, the longest that occurs; null when too short or absent."""
    size = F.least(F.length(needle), F.lit(48))
    lengths = F.sequence(size, F.least(size, F.lit(8)), F.lit(-4))
    found = F.filter(
        F.transform(lengths, lambda n: F.call_function("locate", F.left(needle, n), key)),
        lambda at: at > 0,
    )
    return F.when(F.length(needle) >= 4, F.get(found, F.lit(0)) - 1)


def note_chapter(passages: DataFrame, pages: DataFrame, outline: DataFrame) -> DataFrame:
    """O4. Chapter title of a passage: (passage_id, chapter).

    ``passages``: passage_id, book_id, page_index, text.  Page text is needed
    only for pages that open a heading and hold a passage.
    """
    paths = outline_paths(outline)
    found = last_heading(page_positions(passages).distinct(), paths)
    heads = outline.select(
        "book_id", "page_index", "ord", "level", "title",
        T.comparison_key("title").alias("_key"),
        T.comparison_key(T.title_without_sequence("title")).alias("_bare"),
    )
    on_page = heads.groupBy("book_id", "page_index").agg(
        F.array_sort(F.collect_list(F.struct("ord", "level", "title", "_key", "_bare"))).alias(
            "_heads"
        )
    )
    parents = outline_parents(outline)
    opened = pages.join(on_page, ["book_id", "page_index"]).join(
        passages.select("book_id", "page_index").distinct(), ["book_id", "page_index"], "left_semi"
    ).select("book_id", "page_index", "_heads", T.comparison_key("text").alias("_page"))
    first = F.col("_heads")[0]
    opened = opened.withColumn("ord", first["ord"]).join(parents, ["book_id", "ord"], "left").drop(
        "ord"
    )
    joined = (
        passages.join(found, ["book_id", "page_index"], "left")
        .join(opened, ["book_id", "page_index"], "left")
        .withColumn("_needle", T.comparison_key("text"))
        .withColumn("_at", _place_in_key(F.col("_needle"), F.col("_page")))
    )
    placed = F.transform(
        "_heads",
        lambda h: F.struct(
            F.coalesce(
                _place_in_key(h["_key"], F.col("_page")),
                F.when(h["_bare"] != h["_key"], _place_in_key(h["_bare"], F.col("_page"))),
            ).alias("at"),
            (-h["ord"]).alias("order"),
            h["title"].alias("title"),
        ),
    )
    before = F.array_max(F.filter(placed, lambda h: h["at"] <= F.col("_at")))
    lowest = F.array_min(
        F.transform(
            "_heads",
            lambda h: F.struct(h["level"].alias("level"), h["ord"].alias("ord"),
                               h["title"].alias("title")),
        )
    )
    chapter = (
        F.when(F.col("_heads").isNull(), F.col("heading")["title"])
        .when(F.col("_at").isNotNull() & before.isNotNull(), before["title"])
        .when((F.col("_heads")[0]["level"] > 0) & F.col("parent").isNotNull(), F.col("parent"))
        .otherwise(lowest["title"])
    )
    return joined.select("passage_id", chapter.alias("chapter"))


def outline_parents(outline: DataFrame) -> DataFrame:
    """(book_id, ord, parent): the last earlier entry of a lower level number."""
    keys, block = ["book_id"], block_of("ord")
    entry = F.struct("ord", "title")
    seen = running(
        outline, keys, ["ord"], block,
        last={f"_p{d}": F.when(F.col("level") == d, entry) for d in LEVELS},
        inclusive=False,
    )
    options = [
        F.when(F.col("level") > d, F.col(f"_p{d}")) for d in LEVELS
    ]
    return seen.select("book_id", "ord", F.greatest(*options)["title"].alias("parent"))
