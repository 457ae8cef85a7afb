"""Page text: choice, upsert, running heads, clean-up, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T


def visible_length(c: Column | str) -> Column:
    return F.length(F.regexp_replace(T.col(c), "\\s", ""))


def choose_page_text(embedded: DataFrame, ocr: DataFrame) -> DataFrame:
    """S1. Embedded text unless it has fewer than 24 visible characters and the
    recognised text has at least as many.

    Only suspicious pages can take the other text, so the wide recognised
    side is reduced to those pages before its text is shuffled.
    """
    count = visible_length("text")
    doubtful = embedded.where(count < 24).select("book_id", "page_index")
    candidates = ocr.join(doubtful, ["book_id", "page_index"], "left_semi").withColumnRenamed(
        "text", "ocr_text"
    )
    joined = embedded.join(candidates, ["book_id", "page_index"], "left")
    swap = F.col("ocr_text").isNotNull() & (visible_length("ocr_text") >= count) & (count < 24)
    return joined.withColumn("came_from_ocr", F.coalesce(swap, F.lit(False))).withColumn(
        "text", F.when(F.col("came_from_ocr"), F.col("ocr_text")).otherwise(F.col("text"))
    ).drop("ocr_text")


def merge_refreshed_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """S4. Upsert by page; the label of the old page stays when the new is null."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, ["book_id", "page_index"], "full_outer")
    fresh = F.col("n.text").isNotNull()
    return both.select(
        "book_id",
        "page_index",
        F.when(fresh, F.col("n.text")).otherwise(F.col("o.text")).alias("text"),
        F.when(fresh, F.col("n.came_from_ocr"))
        .otherwise(F.col("o.came_from_ocr"))
        .alias("came_from_ocr"),
        F.coalesce("n.page_label", "o.page_label").alias("page_label"),
    )


def edge_key(c: Column | str) -> Column:
    """Comparable form of a running head: page numbers become ``#``."""
    t = F.regexp_replace(F.lower(T.col(c)), "\\s+", " ")
    return T.strip(F.regexp_replace(t, "\\b[ivxlcdm0-9]+\\b", "#"))


def repeated_edge_lines(pages: DataFrame) -> DataFrame:
    """C1. (book_id, edge_key, n) of first or last lines that recur.

    First and last line come from the page row itself, so only one short key
    per edge is shuffled, and counts combine before the shuffle.
    """
    filled = F.filter(F.split("text", "\n"), lambda line: line != "")
    edges = pages.withColumn("_lines", filled).select(
        "book_id",
        F.explode(
            F.when(
                F.size("_lines") > 0,
                F.array(F.col("_lines")[0], F.element_at("_lines", -1)),
            )
        ).alias("line"),
    )
    keyed = edges.select("book_id", edge_key("line").alias("edge_key")).where(
        F.length("edge_key").between(2, 90) & ~F.col("edge_key").rlike("^\\p{N}*$")
    )
    counts = keyed.groupBy("book_id", "edge_key").agg(F.count("*").alias("n"))
    sizes = pages.groupBy("book_id").agg(F.count("*").alias("n_pages")).where("n_pages >= 4")
    threshold = F.greatest(F.lit(3), F.ceil(F.col("n_pages") * F.lit(0.12)))
    return counts.join(sizes, "book_id").where(F.col("n") >= threshold).select(
        "book_id", "edge_key", "n"
    )


def drop_repeated_edges(pages: DataFrame) -> DataFrame:
    """The first half of C2: page text without any line whose key recurs.

    A recurring key fills at least 12 % of the pages and a page has two edges,
    so a book has at most 16 of them: they travel as one small array per book
    and lines are filtered inside the page row.
    """
    keys = repeated_edge_lines(pages).groupBy("book_id").agg(
        F.collect_set("edge_key").alias("_keys")
    )
    kept = F.filter(
        F.split("text", "\n"), lambda line: ~F.array_contains(F.col("_keys"), edge_key(line))
    )
    cleaned = F.when(F.col("_keys").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return pages.join(keys, "book_id", "left").withColumn("text", cleaned).drop("_keys")


def compact_text(c: Column | str) -> Column:
    return T.strip(T.join_wrapped_lines(T.single_spaced(c)))


def compact_pages(pages: DataFrame) -> DataFrame:
    """C2."""
    return drop_repeated_edges(pages).withColumn("text", compact_text("text"))


def heading_line(level: Column | str, title: Column | str) -> Column:
    depth = F.greatest(F.lit(2), F.least(F.lit(6), T.col(level) + 2))
    return F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), T.col(title))


def page_headings(outline: DataFrame) -> DataFrame:
    """Heading lines of each page in outline order."""
    line = heading_line("level", "title")
    return outline.groupBy("book_id", "page_index").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))),
            lambda e: e["line"],
        ).alias("headings")
    )


def render_book_markdown(pages: DataFrame, outline: DataFrame, titles: DataFrame) -> DataFrame:
    """S5. Markdown as ordered blocks: the title (position -1), then one block
    per non-empty page.  A book's file is its blocks joined by line breaks, so
    no book is ever held in one string."""
    filled = pages.where("text <> ''").join(
        page_headings(outline), ["book_id", "page_index"], "left"
    )
    heads = F.flatten(
        F.transform(
            F.coalesce("headings", F.expr("cast(array() as array<string>)")),
            lambda h: F.array(h, F.lit("")),
        )
    )
    marker = F.concat(F.lit("<!-- P"), (F.col("page_index") + 1).cast("string"), F.lit(" -->"))
    body = filled.select(
        "book_id",
        F.col("page_index").alias("position"),
        F.array_join(F.concat(heads, F.array(marker, F.col("text"), F.lit(""))), "\n").alias(
            "block"
        ),
    )
    top = titles.select(
        "book_id",
        F.lit(-1).alias("position"),
        F.concat(F.lit("# "), "title", F.lit("\n")).alias("block"),
    )
    return top.unionByName(body)


def write_book_markdown(blocks: DataFrame, path: str) -> None:
    """One folder per book; file order inside a folder is block order."""
    ordered = blocks.repartitionByRange("book_id", "position").sortWithinPartitions(
        "book_id", "position"
    )
    ordered.select("book_id", "block").write.partitionBy("book_id").mode("overwrite").text(path)
