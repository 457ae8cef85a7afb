"""Highlights and annotations (M1-M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.plans.running import ENTRIES_PER_BLOCK, running


def filter_marks(marks: DataFrame, shown: str = "all", query: str = "") -> DataFrame:
    """M1. By colour (whatever the kind) or ``annotation``, and by text or note."""
    needle = T.strip(F.lower(T.nfkc(F.lit(query))))

    def holds(c: str) -> Column:
        return F.contains(F.lower(T.nfkc(F.coalesce(c, F.lit("")))), needle)

    wanted = F.lit(shown == "all") | (F.col("color") == shown)
    if shown == "annotation":
        wanted = wanted | (F.col("kind") == "annotation")
    return marks.where(wanted & ((needle == "") | holds("text") | holds("note")))


def merge_headers(marks: DataFrame, keys: list[str]) -> DataFrame:
    """M2. One merged record per group of at least two, without its text: that
    is the group's ``merge_parts`` in order, so a large group never becomes
    one value in one task."""
    place = F.struct("page_index", "created_at", "mark_id")
    highlight = F.when(F.col("kind") == "highlight", place)
    return (
        marks.groupBy(*keys)
        .agg(
            F.count("*").alias("n_parts"),
            F.min_by("mark_id", place).alias("mark_id"),
            F.min("page_index").alias("page_index"),
            F.min_by("created_at", place).alias("created_at"),
            F.when(F.every(F.col("kind") == "annotation"), "annotation")
            .otherwise("highlight")
            .alias("kind"),
            F.coalesce(F.min_by("color", highlight), F.min_by("color", place)).alias("color"),
            F.count(F.when(F.col("note") != "", 1)).alias("n_notes"),
        )
        .where("n_parts >= 2")
    )


def numbered_in_group(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the group's size and the row's place in reading order."""
    sizes = marks.groupBy(*keys).agg(F.count("*").alias("n_parts"))
    placed = running(
        marks, keys, ["page_index", "created_at", "mark_id"],
        F.floor(F.col("page_index") / ENTRIES_PER_BLOCK).cast("long"),
        total={"part_no": F.lit(1).cast("long")},
    )
    return placed.join(sizes, keys)


def merge_parts(marks: DataFrame, keys: list[str]) -> DataFrame:
    """M2. The bulleted text and note lines of merged groups, in order."""
    note = T.inline("note")
    return numbered_in_group(marks, keys).where("n_parts >= 2").select(
        *keys,
        "part_no",
        "mark_id",
        F.concat(F.lit("• "), T.inline("text")).alias("text_line"),
        F.when(F.col("note") != "", F.concat(F.lit("• "), note)).alias("note_line"),
    )


def unmerged(marks: DataFrame, keys: list[str]) -> DataFrame:
    """M2. Marks that no merge consumed."""
    consumed = marks.groupBy(*keys).count().where("count >= 2").select(*keys)
    return marks.join(consumed, keys, "left_anti")


def selection_part(c: Column | str) -> Column:
    t = F.regexp_replace(T.normalize_text(c), "\\s*\\n\\s*", " ")
    return T.strip(F.regexp_replace(t, "\\s+", " "))


def selection_lines(marks: DataFrame, keys: list[str]) -> DataFrame:
    """M3. A lone part stays plain, several become bullets, one row each."""
    parts = marks.withColumn("text", selection_part("text")).where("text <> ''")
    placed = numbered_in_group(parts, keys)
    line = F.when(F.col("n_parts") > 1, F.concat(F.lit("• "), "text")).otherwise(F.col("text"))
    return placed.select(*keys, "part_no", line.alias("line"))


def pending(rows: DataFrame, exported: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """M4. Rows not in the export log, counted."""
    return rows.join(exported, keys, "left_anti").groupBy(*by).agg(F.count("*").alias("pending"))


def update_marks(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """M5. ``changes``: mark_id with new color, kind and note, null to keep."""
    c = changes.select(
        "mark_id", *[F.col(name).alias(f"_{name}") for name in ("color", "kind", "note")]
    )
    joined = marks.join(c, "mark_id", "left")
    new = {name: F.coalesce(f"_{name}", name) for name in ("color", "kind", "note")}
    return joined.withColumns(new).drop("_color", "_kind", "_note")


def delete_marks(marks: DataFrame, ids: DataFrame) -> DataFrame:
    return marks.join(ids, "mark_id", "left_anti")
