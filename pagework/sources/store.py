"""Reader state as partitioned tables (S6), and the other file formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from pagework.functions import text as T
from pagework.plans.stage import shared_folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/pagework/{label}-{uuid.uuid4().hex}"


def write_state(rows: DataFrame, path: str) -> None:
    """Replace the state of exactly the books in ``rows``; each partition is
    swapped in by the commit, readers never see half of it."""
    (
        rows.repartition("book_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("book_id")
        .parquet(path)
    )


def read_state(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """Missing optional columns read as null, unreadable files as empty."""
    return (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .parquet(path)
    )


def read_json_state(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """State saved as JSON lines; a broken record reads as no record."""
    broken = S.StructType(schema.fields + [S.StructField("_broken", S.StringType())])
    rows = (
        spark.read.schema(broken)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )
    return rows.where(F.col("_broken").isNull()).drop("_broken")


# Columns of the word table of an OCR run.
TSV = (
    "level INT, page_num INT, block_num INT, par_num INT, line_num INT, word_num INT, "
    "left DOUBLE, top DOUBLE, width DOUBLE, height DOUBLE, conf DOUBLE, text STRING"
)
WORD_LEVEL = 5
# Layout labels that carry text, and headings of a contents list.
LAYOUT_LABELS = ["text", "title", "section_header", "list_item", "paragraph"]
CONTENTS = "(?i)^(?:目\\s*[录錄次]|contents|table of contents)$"


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S2. The word table, one file per page image."""
    words = spark.read.schema(TSV).option("sep", "\t").option("header", "true").option(
        "quote", ""
    ).csv(path)
    return words.withColumn("source_file", F.input_file_name())


def ocr_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """S2. Words to lines: text in word order, box by extremes, mean confidence.
    A line is part of one page image, so its words are a small group."""
    finite = F.lit(True)
    for c in ("left", "top", "width", "height"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    # Words of visible ASCII characters only are in that form already.
    text = F.when(F.col("text").rlike("^[!-~]+\\z"), F.col("text")).otherwise(T.single_spaced(T.normalize_text("text")))
    kept = words.where((F.col("level") == WORD_LEVEL) & finite & (F.col("width") > 0)
                       & (F.col("height") > 0)).withColumn("text", text).where("text <> ''")
    keys = [*page, "block_num", "par_num", "line_num"]
    ordered = F.array_sort(F.collect_list(F.struct("word_num", "text")))
    return kept.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
        F.avg(F.coalesce(F.nanvl("conf", F.lit(0.0)), F.lit(0.0))).alias("confidence"),
    )


LAYOUT = (
    "texts ARRAY<STRUCT<label: STRING, text: STRING, orig: STRING, "
    "prov: ARRAY<STRUCT<page_no: INT>>>>"
)


def read_layout_json(spark: SparkSession, path: str) -> DataFrame:
    """S3. Layout documents, one JSON document per file."""
    return spark.read.schema(LAYOUT).option("multiLine", "true").json(path).withColumn(
        "source_file", F.input_file_name()
    )


def layout_pages(layout: DataFrame, page_map: DataFrame, document: str) -> DataFrame:
    """S3. Accepted blocks joined per source page, in document order.

    Page numbers count from 1 in the processed excerpt; a number that is not
    in the map is tried as counting from 0.  ``page_map``: document, excerpt
    position from 1, page_index.
    """
    blocks = layout.select(document, F.posexplode("texts").alias("ord", "block")).select(
        document,
        "ord",
        F.coalesce("block.label", F.lit("text")).alias("label"),
        T.strip(F.coalesce("block.text", "block.orig")).alias("text"),
        F.get(F.col("block.prov"), F.lit(0))["page_no"].alias("page_no"),
    )
    kept = blocks.where(
        F.lower("label").isin(LAYOUT_LABELS) & (F.col("text") != "") & ~F.col("text").rlike(CONTENTS)
    )
    one = page_map.select(document, F.col("position").alias("page_no"), F.col("page_index").alias("_one"))
    zero = page_map.select(
        document, (F.col("position") - 1).alias("page_no"), F.col("page_index").alias("_zero")
    )
    placed = kept.join(one, [document, "page_no"], "left").join(zero, [document, "page_no"], "left")
    placed = placed.withColumn("page_index", F.coalesce("_one", "_zero")).where(
        "page_index IS NOT NULL"
    )
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return placed.groupBy(document, "page_index").agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text")
    )
