"""Keys, caches and incremental state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.operators.outline import ordered_digest
from pagework.plans.running import top_rows

UNIT = "\x1f"


def answer_cache_key(question: Column, context: Column, history: Column, *, provider: Column,
                     model: Column, depth: Column, web: Column, whole_book: Column) -> Column:
    """D1. sha256 over everything that shapes an answer."""
    parts = [F.lit("v4"), provider, model, depth, web.cast("string"), whole_book.cast("string"),
             T.inline(question), context, history]
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def probe_cache(asks: DataFrame, cache: DataFrame) -> DataFrame:
    """D1. Reuse the stored answer of the same book and key, except with web search."""
    found = asks.join(cache.select("book_id", "cache_key", "answer"), ["book_id", "cache_key"],
                      "left")
    return found.withColumn("answer", F.when(~F.col("web"), F.col("answer")))


def evict_cache(cache: DataFrame, newest_first: list[Column], keep: int = 160) -> DataFrame:
    """D2. The newest entries of each book; the rank limit runs before the shuffle."""
    return top_rows(cache, ["book_id"], newest_first, keep).drop("_rank")


def source_fingerprint(pages: DataFrame) -> DataFrame:
    """Digest of a book's pages from per-page digests, in blocks."""
    digest = pages.select("book_id", "page_index", F.md5("text").alias("line"))
    return ordered_digest(digest, ["book_id"], "page_index", F.col("line"), "fingerprint")


def stale_books(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """D3. Books whose (fingerprint, signature, version) is not in the manifest."""
    return current.join(
        manifest, ["book_id", "fingerprint", "signature", "version"], "left_anti"
    ).select("book_id")


def invalidate_derived(states: DataFrame, outline_version: int, summary_version: int) -> DataFrame:
    """D4. Drop automatic outlines and summaries of other versions; manual
    outlines and everything the reader made stay."""
    drop_outline = (
        F.col("has_outline")
        & ~F.coalesce("manual_outline", F.lit(False))
        & ~F.col("outline_version").eqNullSafe(outline_version)
    )
    drop_summary = ~F.col("summary_version").eqNullSafe(summary_version)
    return states.withColumns(
        {
            "has_outline": F.col("has_outline") & ~drop_outline,
            "outline_version": F.when(drop_outline, outline_version).otherwise(
                F.col("outline_version")
            ),
            "has_summaries": F.col("has_summaries") & ~drop_summary,
            "summary_version": F.lit(summary_version),
        }
    )


def latest() -> Column:
    return F.struct("ts", "event_id")


def bookshelf(activity: DataFrame, keep: int = 80) -> DataFrame:
    """D5. Newest opening per user and book, the newest ``keep`` books."""
    opened = activity.where("action = 'open'").groupBy("user_id", "book_id").agg(
        F.max(latest()).alias("last")
    )
    shelf = top_rows(opened, ["user_id"], [F.desc("last"), "book_id"], keep, "place")
    return shelf.select("user_id", "place", "book_id", F.col("last.ts").alias("opened_at"))


def tombstones(activity: DataFrame) -> DataFrame:
    """Books whose latest opening or deletion is a deletion."""
    last = activity.where("action IN ('open', 'delete')").groupBy("book_id").agg(
        F.max_by("action", latest()).alias("action")
    )
    return last.where("action = 'delete'").select("book_id")


def delete_books(derived: DataFrame, deleted: DataFrame) -> DataFrame:
    """D6. Derived rows of deleted books go; sources are another table."""
    return derived.join(deleted, "book_id", "left_anti")


def bookmarks_from_log(activity: DataFrame) -> DataFrame:
    """D7. A page is marked when it was toggled an odd number of times."""
    toggled = activity.where("action = 'toggle_bookmark'").groupBy(
        "user_id", "book_id", "page_index"
    ).agg(F.count("*").alias("n"), F.max("ts").alias("created_at"))
    return toggled.where("n % 2 = 1").drop("n")


def last_position(activity: DataFrame, sizes: DataFrame) -> DataFrame:
    """D8. Last visited page per user and book, inside the book."""
    seen = activity.where("action IN ('open', 'navigate')").groupBy("user_id", "book_id").agg(
        F.max_by("page_index", latest()).alias("page_index")
    )
    clamped = F.least(F.col("page_index"), F.greatest(F.col("n_pages") - 1, F.lit(0)))
    return seen.join(sizes, "book_id", "left").select(
        "user_id", "book_id", F.coalesce(clamped, F.col("page_index")).alias("page_index")
    )


def opaque_book_id(path: Column | str) -> Column:
    """D9. sha256 of the path."""
    return F.sha2(T.col(path), 256)


def public_book_id(path: Column | str) -> Column:
    return F.left(opaque_book_id(path), F.lit(32))


def path_prefixes(path: Column) -> Column:
    """Every prefix that ends at a separator boundary, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def longest_prefix_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """D10. The longest registered root that is the path or contains it, by an
    equi-join on exploded prefixes; ties go to open, then newest roots.
    ``roots``: root, is_open, opened_at."""
    exploded = paths.select("path", F.explode(path_prefixes(F.col("path"))).alias("root"))
    found = exploded.join(roots, "root")
    order = [F.desc(F.length("root")), F.desc("is_open"), F.desc("opened_at")]
    return top_rows(found, ["path"], order, 1).select("path", "root")
