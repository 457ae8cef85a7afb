"""Reading tables derived from the given parquet tables.

Fifty consecutive documents form one book; every table below follows from
``documents``, ``benchmark``, ``labels``, ``conversations`` or ``events``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pagework.plans.stage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = (F.col("doc_id") % 50).cast("int")
    documents = spread(table(spark, sf_dir, "documents"), "doc_id")
    return documents.select(
        F.floor(F.col("doc_id") / 50).cast("long").alias("book_id"),
        index.alias("page_index"),
        "text",
        (F.col("doc_id") % 3 == 0).alias("came_from_ocr"),
        F.when(index < 4, pick(["i", "ii", "iii", "iv"], F.least(index, F.lit(3)) + 1))
        .otherwise((index - 3).cast("string"))
        .alias("page_label"),
        "lang",
        "source",
        "doc_id",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(pages(spark, sf_dir))


def lines_of(pages: DataFrame) -> DataFrame:
    return pages.select(
        "book_id", "page_index", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).where((F.col("page_index") >= 4) & (F.col("page_index") % 5 == 4))
    words = F.split(F.trim(F.split("text", "\n")[0]), " ")
    return p.select(
        "book_id",
        F.floor((F.col("page_index") - 4) / 5).cast("int").alias("ord"),
        "page_index",
        F.when(F.col("page_index") % 15 == 4, 0)
        .when(F.col("page_index") % 15 == 9, 1)
        .otherwise(2)
        .alias("level"),
        F.array_join(F.slice(words, 1, 4), " ").alias("title"),
        (F.col("page_index") - 3).alias("printed_page"),
        F.lit("arabic").alias("page_style"),
    )


def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed contents page (physical page 3) in four layouts."""
    o = outline(spark, sf_dir)
    number = (F.col("ord") + 1).cast("string")
    printed = F.col("printed_page").cast("string")
    chapter = F.concat(F.lit("Chapter "), number, F.lit(" "), F.col("title"))
    kind = F.col("ord") % 4
    body = (
        F.when(kind == 0, F.concat(chapter, F.lit(" ........ "), printed))
        .when(
            kind == 1,
            F.concat(number, F.lit(".1 "), F.col("title"), F.lit(" / "), F.lpad(printed, 3, "0")),
        )
        .when(kind == 2, F.concat(number, F.lit(".1.1 "), F.col("title"), F.lit("  "), printed))
        .otherwise(chapter)
    )
    page = F.lit(3).alias("page_index")
    heading = o.select("book_id").distinct().select(
        "book_id", page, F.lit(0).alias("line_no"), F.lit("Contents").alias("line")
    )
    entry = o.select("book_id", page, (1 + F.col("ord") * 2).alias("line_no"), body.alias("line"))
    alone = o.where(kind == 3).select(
        "book_id", page, (2 + F.col("ord") * 2).alias("line_no"), printed.alias("line")
    )
    return heading.unionByName(entry).unionByName(alone)


def book_count(spark: SparkSession, sf_dir: str) -> F.Column:
    """One more than the largest book id, as a scalar subquery."""
    return table(spark, sf_dir, "documents").agg(
        F.floor(F.max("doc_id") / 50).cast("long") + 1
    ).scalar()


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    words = F.split("text", " ")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"),
        F.col("text").alias("query"),
        (item % book_count(spark, sf_dir)).alias("book_id"),
        ((item * 7) % 50).cast("int").alias("focus_page"),
        pick(["explanation", "standard", "context"], (item % 3).cast("int") + 1).alias("scope"),
        pick(["economical", "balanced", "deep"], (F.floor(item / 3) % 3).cast("int") + 1).alias(
            "depth"
        ),
        (item % 4 == 0).alias("whole_book"),
        F.array_join(F.slice(words, 2, 3), " ").alias("phrase"),
    )


@F.arrow_udf(ArrayType(IntegerType()))
def word_offsets(lines: pa.Array) -> pa.Array:
    """Where each word of a line begins when its words are joined by one blank;
    empty words take no place."""
    size = pc.fill_null(pc.utf8_length(lines.flatten()), 0)
    ends = np.cumsum(np.where(size, pc.add(size, 1), 0), dtype=np.int64)
    before = np.concatenate(([0], ends))
    count = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    off = before[:-1] - np.repeat(before[first[:-1]], count)
    return pa.ListArray.from_arrays(pa.array(first), pa.array(off.astype(np.int32)))


def words(spark: SparkSession, sf_dir: str, copies: bool = True) -> DataFrame:
    """Word boxes in pixels on a 2400 x 3200 page; with ``copies`` every ninth word
    also occurs as a shorter copy of lower confidence.  A line's words are placed in
    its own row: nothing is shuffled."""
    split = lines(spark, sf_dir).select(
        "book_id", "page_index", "line_no", F.split("line", " ").alias("word")
    ).withColumn("off", word_offsets("word"))
    b = split.select(
        "book_id", "page_index", "line_no",
        F.posexplode(F.arrays_zip("word", "off")).alias("word_no", "w"),
    ).select("book_id", "page_index", "line_no", "word_no", "w.word", "w.off").where("word <> ''")
    across = (F.col("off") % 220) * 10
    down = (F.col("line_no") * 3 + F.floor(F.col("off") / 220)) * 17
    key = ["book_id", "page_index", "line_no", "word_no"]
    box = [(40 + across).cast("long").alias("x0"), (40 + down).cast("long").alias("y0")]
    low = (54 + down).cast("long").alias("y1")
    full = [
        F.col("word").alias("text"), *box,
        (40 + across + F.length("word") * 10).cast("long").alias("x1"), low,
        (60 + (F.col("word_no") * 7 + F.col("line_no") * 3) % 40).cast("int").alias("conf"),
        F.lit(0).alias("dup"),
    ]
    if not copies:
        return b.select(*key, *full)
    short = [
        F.expr("left(word, greatest(1, length(word) - 1))").alias("text"), *box,
        (30 + across + F.length("word") * 10).cast("long").alias("x1"), low,
        F.lit(50).alias("conf"),
        F.lit(1).alias("dup"),
    ]
    copied = (F.col("word_no") % 9 == 0) & (F.length("word") > 2)
    boxes = F.when(copied, F.array(F.struct(*full), F.struct(*short))).otherwise(F.array(F.struct(*full)))
    return b.select(*key, F.explode(boxes).alias("b")).select(*key, "b.*")


def placed_words(texts: pa.Array, copies: bool, first: pa.Array | None = None) -> pa.Array:
    """The boxes of ``words`` of each text, as one list a text.  ``first``: the number of
    each text's first line, where the texts are parts of pages."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    words = pc.split_pattern(lines.flatten(), " ")
    lines_of_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    words_of_line = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), lines_of_text)
    line = np.repeat(np.arange(len(text)), words_of_line)
    first_line = np.cumsum(lines_of_text) - lines_of_text
    first_word = np.cumsum(words_of_line) - words_of_line
    line_of_text = np.arange(len(text)) - first_line[text]
    if first is not None:
        line_of_text = line_of_text + first.to_numpy(zero_copy_only=False)[text]
    words = words.flatten()
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(np.where(size, size + 1, 0))))
    off = ends[:-1] - ends[first_word][line]
    word_no = np.arange(len(size)) - first_word[line]
    copied = (word_no % 9 == 0) & (size > 2) & copies
    # A word and then its copy; empty words are left out.
    at = np.repeat(np.arange(len(size)), np.where(size > 0, 1 + copied, 0))
    dup = np.zeros(len(at), np.int32)
    dup[1:] = at[1:] == at[:-1]
    short = pc.utf8_slice_codeunits(words.take(pa.array(np.flatnonzero(copied))), 0, -1)
    spelled = pa.concat_arrays([words, short])
    spelled = spelled.take(pa.array(np.where(dup, len(size) + np.cumsum(copied)[at] - 1, at)))
    line_no, word_no, off, size = line_of_text[line[at]], word_no[at], off[at], size[at]
    x, y = 40 + off % 220 * 10, 40 + (line_no * 3 + off // 220) * 17
    conf = np.where(dup, 50, 60 + (word_no * 7 + line_no * 3) % 40)
    fields = {
        "line_no": line_no.astype(np.int32), "word_no": word_no.astype(np.int32), "text": spelled,
        "x0": x, "y0": y, "x1": x + size * 10 - 10 * dup, "y1": y + 14, "conf": conf.astype(np.int32), "dup": dup,
    }
    boxes = pa.StructArray.from_arrays([pa.array(f) for f in fields.values()], list(fields))
    per_text = np.bincount(text[line[at]], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_text))).astype(np.int32)), boxes)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, page_index, text), for what is made of a page's words in its row."""
    return pages(spark, sf_dir).select("book_id", "page_index", "text")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    joined = table(spark, sf_dir, "labels").join(pages(spark, sf_dir), "doc_id")
    return joined.select(
        doc.alias("mark_id"),
        "book_id",
        "page_index",
        F.trim(F.split("text", "\n")[0]).alias("text"),
        F.when(F.col("toxic") == 1, "annotation").otherwise("highlight").alias("kind"),
        pick(["yellow", "red", "blue"], (doc % 3).cast("int") + 1).alias("color"),
        F.when(F.col("quality") == 1, F.concat(F.lit("note "), (doc % 11).cast("string"))).alias(
            "note"
        ),
        (doc % 7 == 0).alias("exported"),
        F.timestamp_add("MINUTE", ((doc * 37) % 1440).cast("int"),
                        F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
        F.floor(F.col("page_index") / 10).cast("int").alias("merge_group"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role").isin("user", "assistant"))
        .select(
            "conv_id",
            "turn",
            "role",
            F.col("text").alias("content"),
            (conv % book_count(spark, sf_dir)).alias("book_id"),
            F.when(F.col("role") == "user", ((conv * 11 + turn) % 50).cast("int")).alias(
                "anchor_page"
            ),
            ((conv + turn) % 3 == 0).alias("selected"),
            ((conv * 7 + turn) % 5 == 0).alias("exported"),
        )
    )


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider usage payloads in four shapes."""
    n, turn = F.length("content"), F.col("turn")
    kind = F.col("conv_id") % 4
    payload = (
        F.when(kind == 0, F.format_string(
            '{"usage":{"input_tokens":%d,"output_tokens":%d,'
            '"input_tokens_details":{"cached_tokens":%d}}}',
            n, (turn + 1) * 9, F.floor(n / 2)))
        .when(kind == 1, F.format_string(
            '{"usageMetadata":{"promptTokenCount":%d,"candidatesTokenCount":%d}}',
            n, (turn + 1) * 5))
        .when(kind == 2, F.format_string(
            '{"data":{"usage":{"promptTokens":"%d","completionTokens":"%d"}}}',
            n, (turn + 1) * 4))
        .otherwise('{"id":"no-usage"}')
    )
    return turns(spark, sf_dir).where("role = 'assistant'").select(
        "conv_id", "turn", n.alias("n_chars"), payload.alias("payload")
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_of(table(spark, sf_dir, "events"))


def activity_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        F.when(kind == "view", "open")
        .when(kind == "click", "toggle_bookmark")
        .when(kind == "purchase", "navigate")
        .when(kind == "signup", "open")
        .otherwise("delete")
        .alias("action"),
        k.alias("k"),
        (k % 20).alias("book_id"),
        (F.col("event_id") % 50).cast("int").alias("page_index"),
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        (F.col("turn") % 2 == 1).alias("is_final"),
        F.col("content").alias("text"),
    )
