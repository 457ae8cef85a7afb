"""Recognised boxes: clean-up, rows, columns, reading order.

Boxes are flat columns x0, y0, x1, y1 with the origin top left.  Everything is
local to a page (book_id, page_index), and a page is one source row, so page
windows stay small however long a book is.  A source that has all boxes of a page in
its row gives them to ``page_rows`` without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from pagework.functions import text as T
from pagework.operators import pageboxes as P
from pagework.operators.search import needle_pattern, needles, ranges_or_all
from pagework.plans.containment import contains_pairs
from pagework.plans.stage import small_batches

PAGE = ["book_id", "page_index"]
BOX = ["x0", "y0", "x1", "y1"]
SMALLEST = 0.0001
BYTES_AT_ONCE = 1 << 20


def gathered(boxes: DataFrame) -> DataFrame:
    """(book_id, page_index, boxes): the boxes of a page in one row."""
    small_batches(boxes.sparkSession)
    fields = F.struct(*[c for c in boxes.columns if c not in PAGE])
    return boxes.groupBy(*PAGE).agg(F.collect_list(fields).alias("boxes"))


def page_rows(pages: DataFrame, make: Callable[[pa.RecordBatch], pa.Array], fields: StructType,
              keys: list[str] = PAGE) -> DataFrame:
    """(page, fields): what ``make`` lists for each page of a batch.  A page is one row, and
    only a few pages are worked on at a time."""
    small_batches(pages.sparkSession)
    kinds = pages.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, len(batch) * BYTES_AT_ONCE // max(batch.nbytes, 1))
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                lists = make(some)
                page = pa.array(np.repeat(np.arange(len(some)), P.sizes_of(lists)))
                found = lists.flatten()
                columns = [*(some.column(c).take(page) for c in keys), *(found.field(c) for c in fields.names)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, *fields.names])

    return pages.mapInArrow(rows, StructType([*(kinds[c] for c in keys), *fields]))


def normalize_boxes(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """G1. Boxes as shares of the page, clamped; empty text or sides go."""

    def share(c: str, size: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.lit(float(size))))

    x0, y0 = share("x0", width), share("y0", height)
    x1, y1 = F.greatest(x0, share("x1", width)), F.greatest(y0, share("y1", height))
    scaled = boxes.withColumns({"text": T.strip("text"), "x0": x0, "y0": y0, "x1": x1, "y1": y1})
    return scaled.where(
        (F.col("text") != "")
        & (F.col("x1") - F.col("x0") >= SMALLEST)
        & (F.col("y1") - F.col("y0") >= SMALLEST)
    )


def rotate_boxes(boxes: DataFrame, rotation: Column) -> DataFrame:
    """G2. Normalised boxes turned by a multiple of 90 degrees, negatives too."""
    turn = F.pmod(rotation, F.lit(360))
    x0, y0, x1, y1 = (F.col(c) for c in BOX)

    def pick(quarter: Column, half: Column, three: Column, none: Column) -> Column:
        return F.when(turn == 90, quarter).when(turn == 180, half).when(
            turn == 270, three).otherwise(none)

    return boxes.withColumns(
        {
            "x0": pick(1 - y1, 1 - x1, y0, x0),
            "y0": pick(x0, 1 - y1, 1 - x1, y0),
            "x1": pick(1 - y0, 1 - x0, y1, x1),
            "y1": pick(x1, 1 - y0, 1 - x0, y1),
        }
    )


def dedupe_boxes(boxes: DataFrame, key: list[str]) -> DataFrame:
    """G3. Of two boxes that cover the same region (72 % of the smaller one)
    with one text inside the other, the less certain one goes.

    Boxes meet only in the grid cells they touch, not all over the page; a cell
    is twice the page's mean box, whatever the unit.  The rule is pairwise; in
    chains of duplicates a box may be dropped by one that is dropped itself.
    """
    fields = StructType([f for f in boxes.schema if f.name not in PAGE])
    stay = page_rows(gathered(boxes), lambda pages: P.deduped(pages["boxes"], key, fields.names), fields)
    return stay.select(*boxes.columns)


def joined_text(order: list[str]) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return F.array_join(F.transform(listed, lambda p: p["text"]), " ")


def extent() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"),
            F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def assemble_rows(pieces: DataFrame, page_height: float = 1.0) -> DataFrame:
    """G4. (page, row_no, text, box): one line per visual row.

    Boxes come from top to bottom.  A box may join a row of which a member overlaps
    it by SHARED of the smaller height, or has its centre within SHARED of the
    larger one; two entries that are complete (letters and a page at the end) never
    share a row.  Of several rows the one whose nearest member is farthest counts,
    then the first.  Boxes taller than TALL times their width (and 0.018 of the
    page) stay lines of their own.

    The choice depends on the rows so far: it is a fold over the boxes of one page.
    """
    fields = StructType([pieces.schema[c] for c in ("text", *BOX)]).add("row_no", LongType())
    return page_rows(
        gathered(pieces.select(*PAGE, "text", *BOX)), lambda pages: P.assembled(pages["boxes"], page_height), fields)


def split_rows_by_gutter(pieces: DataFrame) -> DataFrame:
    """G5. Rows, in order of y, begin where y moves on by more than 0.55 of the height;
    they are cut where the gap to everything before exceeds max(9, 1.35 x height);
    one line per part."""
    kinds = pieces.schema
    numbers = StructType().add("row_no", LongType()).add("part_no", LongType())
    fields = StructType([*numbers, *(kinds[c] for c in ("text", *BOX))])
    return page_rows(gathered(pieces.select(*PAGE, "text", *BOX)), lambda pages: P.parts_of_rows(pages["boxes"]), fields)


def column_order(lines: DataFrame, width: float) -> DataFrame:
    """G6. ``place`` of each line: header, left column, right column, footer
    when the page has two columns that overlap vertically, else top down."""
    kept = [f for f in lines.schema if f.name not in PAGE]
    fields = StructType(kept).add("column_no", IntegerType()).add("place", IntegerType())
    placed = page_rows(gathered(lines), lambda pages: P.in_columns(pages["boxes"], width), fields)
    return placed.select(*lines.columns, "column_no", "place")


def is_tall() -> Column:
    return F.col("y1") - F.col("y0") > (F.col("x1") - F.col("x0")) * 1.35


def vertical_order(lines: DataFrame) -> DataFrame:
    """G7. ``place`` on pages of vertical text: horizontal lines first, then
    columns from right to left; other pages are not returned."""
    page = lines.groupBy(*PAGE).agg(
        F.count(F.when(is_tall(), 1)).alias("_tall"), F.count("*").alias("_n")
    ).where("_tall >= greatest(3, floor(_n / 3))")
    middle = F.when(is_tall(), -(F.col("x0") + F.col("x1")) / 2)
    order = Window.partitionBy(*PAGE).orderBy(
        is_tall(), middle.asc_nulls_first(), "y0", "x0", "text"
    )
    return lines.join(page.select(*PAGE), PAGE, "left_semi").withColumn(
        "place", F.row_number().over(order)
    )


# Fixed value: a page number that ends a line.  Behind a country code like +1 a number
# in brackets is an area code.
TRAILING_PAGE = "(?:^|[/／.·…:\\s])\\s*(?:(?<!\\+\\d{1,3}\\s{1,4})[（(\\[【{])?\\s*(\\d{1,4})\\s*[）)\\]】}]?\\s*$"


def best_layout(orders: DataFrame) -> DataFrame:
    """G8. (book_id, page_index, tag, score) of the reading order that looks
    most like a list of contents.  ``orders``: tag, place, text.  Entries are
    the lines with a page number, counted once more by themselves."""
    page = F.regexp_extract("text", TRAILING_PAGE, 1)
    rows = orders.withColumn("_page", F.when(page != "", page.cast("int")))
    paged = rows.where("_page IS NOT NULL")
    order = Window.partitionBy(*PAGE, "tag").orderBy("place")
    steps = paged.withColumn("_up", (F.col("_page") >= F.lag("_page").over(order)).cast("int"))
    scores = steps.groupBy(*PAGE, "tag").agg(
        F.count("*").alias("_n"), F.sum("_up").alias("_ups")
    )
    share = F.coalesce(F.col("_ups") / F.greatest(F.col("_n") - 1, F.lit(1)), F.lit(0.0))
    scored = orders.select(*PAGE, "tag").distinct().join(scores, [*PAGE, "tag"], "left").select(
        *PAGE, "tag", F.round(F.coalesce(F.col("_n") * 5 + share * 8, F.lit(0.0)), 6).alias("score")
    )
    return scored.groupBy(*PAGE).agg(
        F.max(F.struct("score", F.col("tag").alias("tag"))).alias("b")
    ).select(*PAGE, "b.tag", "b.score")


# Fixed value: a chapter label alone on its line.
CHAPTER_ALONE = f"(?i)^(?:chapter\\s+[0-9ivxlcdm]+|第\\s*[{T.NUMERALS}]+\\s*章)$"


def attach_chapter_label(lines: DataFrame) -> DataFrame:
    """G9. Lone chapter labels join the line before them when that ends in a page
    number, any number of labels; else the last of them joins the next line.  A
    label that ends in a number is such a line for the labels right after it.
    ``lines``: place, text, box, conf.
    """
    order = Window.partitionBy(*PAGE).orderBy("place")
    alone, paged = F.col("text").rlike(CHAPTER_ALONE), F.col("text").rlike(TRAILING_PAGE)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tagged = lines.withColumns({"_alone": alone, "_paged": paged}).withColumns({
        "_line": F.last(F.when(~F.col("_alone"), F.struct("place", "_paged")), ignorenulls=True).over(before),
        "_next": F.when(~F.lead("_alone").over(order), F.lead("place").over(order)),
        "_run": F.sum((~F.col("_alone")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    run = Window.partitionBy(*PAGE, "_run")
    tagged = tagged.withColumn("_open", F.min(F.when(F.col("_alone") & F.col("_paged"), F.col("place"))).over(run))
    base = (
        F.when(~F.col("_alone"), F.col("place"))
        .when(F.col("_line._paged"), F.col("_line.place"))
        .when(F.col("place") > F.col("_open"), F.col("_open"))
        .otherwise(F.coalesce("_next", "place"))
    )
    # Labels lead the line they join, the latest first.
    place = F.col("place")
    lead = F.when(place > F.col("_base"), F.struct(F.lit(0).alias("a"), (-place).alias("b"))).when(
        place < F.col("_base"), F.struct(F.lit(1).alias("a"), place.alias("b"))).otherwise(
        F.struct(F.lit(2).alias("a"), place.alias("b")))
    parts = F.array_sort(F.collect_list(F.struct(lead.alias("lead"), "text")))
    return tagged.withColumn("_base", base).groupBy(*PAGE, "_base").agg(
        F.min("place").alias("place"),
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
        *extent(),
        F.max("conf").alias("conf"),
    ).drop("_base")


def merge_fragments(rects: DataFrame) -> DataFrame:
    """G10. Rectangles of one visual line joined: (page, box, n).

    Fragments come in reading order.  Each joins the first open rectangle that it
    overlaps by SAME_LINE of the smaller height, across a gap of at most
    max(LEAST_GAP, GAP x the smaller height); the rectangle then covers both, and
    the next fragment is held against its whole extent.  Exact copies (to a quarter
    unit) count once; empty rectangles are left out.
    """
    kinds = rects.schema
    fields = StructType([kinds[c] for c in BOX]).add("n", LongType())
    return page_rows(gathered(rects.select(*PAGE, *BOX)), lambda pages: P.merged(pages["boxes"]), fields)


def search_hit_boxes(asks: DataFrame, words: DataFrame) -> DataFrame:
    """G11. Boxes of the matched characters of every hit: word boxes cut in
    proportion, along y when the word is vertical.

    ``words``: line_no, word_no, text, box; a line's text is its words joined
    by blanks.
    """
    placed = F.array_sort(F.collect_list(F.struct("word_no", "text", *BOX)))
    lines = words.groupBy(*PAGE, "line_no").agg(placed.alias("words")).withColumn(
        "text", F.array_join(F.transform("words", lambda w: w["text"]), " "))
    return hit_boxes(asks, lines, F.col("text"), ["words"], lambda rows: rows["words"], words.schema["word_no"])


def hit_boxes(asks: DataFrame, lines: DataFrame, joined: Column, kept: list[str],
              words_of: Callable[[pa.RecordBatch], pa.Array], word_no: StructField) -> DataFrame:
    """``search_hit_boxes`` of lines (page, line_no, text) whose words, ``joined`` by blanks,
    are searched.  ``words_of`` makes the boxes of the words from the columns ``kept``, of
    lines that are hit only."""
    line = [*PAGE, "line_no"]
    wanted = needles(asks)

    def ranges(held: Column, _searched: Column) -> Column:
        return T.bound(T.fold(joined), lambda folded: F.transform(held, lambda n: F.struct(
            n.alias("needle"), ranges_or_all(folded, needle_pattern(n)).alias("ranges"), *kept)))

    found = contains_pairs(
        wanted, lines.select(*line, *dict.fromkeys(["text", *kept])), ["book_id"], line[1:], T.search_projection, ranges)
    fields = StructType([word_no]).add("start", IntegerType())
    for c in BOX:
        fields = fields.add(c, DoubleType())
    cut = page_rows(found, lambda rows: P.cut_words(rows["ranges"], words_of(rows)), fields, [*line, "needle"])
    return cut.join(wanted, ["book_id", "needle"]).select(
        "query_id", *line, "word_no", "start", *[F.round(c, 6).alias(c) for c in BOX])


def filter_repair_lines(lines: DataFrame, least: float = 0.45) -> DataFrame:
    """G12. Doubtful lines go; a misread separator before a trailing page
    number is put right."""
    t = F.regexp_replace(T.strip("text"), "(?<=[^0-9\\s])[iIlL|](?=\\s*\\d{1,4}\\s*$)", " / ")
    t = F.regexp_replace(t, "[;；:：]\\s*(?=[0-9]{1,4}\\s*$)", " ")
    t = F.regexp_replace(t, "(?<=[^0-9\\s])(?=1[0-9]{3}\\s*$)", " ")
    return lines.where(F.col("conf") >= least).withColumn("text", t).where("text <> ''")
