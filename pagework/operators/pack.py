"""Context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.functions.text import bound
from pagework.plans.running import top_rows

LONGEST_OVERLAP = 260
SHORTEST_OVERLAP = 24


def without_overlap(previous: Column, current: Column) -> Column:
    """P1. Drop the longest start of ``current`` that ends ``previous``."""
    ends = F.right(previous, F.lit(LONGEST_OVERLAP))
    starts = F.left(current, F.lit(LONGEST_OVERLAP))

    def longest(pair: Column) -> Column:
        tail, head = pair["tail"], pair["head"]
        most = F.least(F.length(tail), F.length(head))
        sizes = F.when(
            most >= SHORTEST_OVERLAP, F.sequence(most, F.lit(SHORTEST_OVERLAP), F.lit(-1))
        ).otherwise(F.expr("cast(array() as array<int>)"))
        return F.coalesce(
            F.get(F.filter(sizes, lambda n: F.right(tail, n) == F.left(head, n)), F.lit(0)),
            F.lit(0),
        )

    drop = bound(F.struct(ends.alias("tail"), starts.alias("head")), longest)
    return F.when(previous.isNull(), current).otherwise(
        bound(
            drop,
            lambda n: F.when(n == 0, current).otherwise(
                T.strip(F.substring(current, n + 1, F.length(current)))
            ),
        )
    )


def trim_overlap(rows: DataFrame, keys: list[str]) -> DataFrame:
    """P1 on ordered rows: against the row before it of the same key, page and
    path.  A page bounds the group."""
    window = Window.partitionBy(*keys, "page_index", "chapter_path").orderBy("chunk_no")
    before = rows.withColumn("_before", F.lag("text").over(window))
    return before.withColumn("text", without_overlap(F.col("_before"), F.col("text"))).drop(
        "_before"
    )


MOST_EXCERPTS = 14


def pack_context(rows: DataFrame) -> DataFrame:
    """P1 and P2. ``rows`` has query_id, chunk_no, page_index, chapter_title,
    chapter_path, text, token_budget, with at most 14 rows per question.

    Repeated texts go, the rest is folded against the budget in order: stop
    when fewer than 80 tokens are left, cut the text that overflows.
    """
    trimmed = trim_overlap(rows, ["query_id"]).withColumn("_key", F.lower(T.inline("text")))
    kept = top_rows(trimmed.where("_key <> ''"), ["query_id", "_key"], ["chunk_no"], 1)
    item = F.struct(
        "chunk_no",
        "page_index",
        "chapter_title",
        "text",
        (12 + F.when(F.col("chapter_title").isNull(), 0).otherwise(
            T.estimated_tokens("chapter_title"))).alias("cost"),
        T.estimated_tokens("text").alias("tokens"),
    )
    gathered = kept.groupBy("query_id").agg(
        F.first("token_budget").alias("token_budget"),
        F.array_sort(F.collect_list(item)).alias("_items"),
    )
    packed = "array<struct<chunk_no:bigint,page_index:int,chapter_title:string,text:string,tokens:int>>"
    start = F.struct(
        F.col("token_budget").alias("remaining"),
        F.lit(False).alias("full"),
        F.expr(f"cast(array() as {packed})").alias("out"),
    )

    def step(state: Column, row: Column) -> Column:
        available = state["remaining"] - row["cost"]
        share = F.floor(F.length(row["text"]) * available / row["tokens"]).cast("int")
        short = F.left(row["text"], F.greatest(F.lit(80), share))

        def add(text: Column) -> Column:
            tokens = F.when(row["tokens"] <= available, row["tokens"]).otherwise(
                T.estimated_tokens(text)
            )
            return bound(
                tokens,
                lambda n: F.struct(
                    (available - n).alias("remaining"),
                    F.lit(False).alias("full"),
                    F.array_append(
                        state["out"],
                        F.struct(
                            row["chunk_no"].alias("chunk_no"),
                            row["page_index"].alias("page_index"),
                            row["chapter_title"].alias("chapter_title"),
                            text.alias("text"),
                            n.alias("tokens"),
                        ),
                    ).alias("out"),
                ),
            )

        text = F.when(row["tokens"] <= available, row["text"]).otherwise(short)
        stopped = F.struct(
            state["remaining"].alias("remaining"), F.lit(True).alias("full"),
            state["out"].alias("out"),
        )
        return F.when(state["full"], state).when(available < 80, stopped).otherwise(
            bound(text, add)
        )

    folded = F.aggregate("_items", start, step, lambda s: s["out"])
    return gathered.select(
        "query_id", F.posexplode(folded).alias("position", "item")
    ).select("query_id", "position", "item.*")


def outline_map(outline: DataFrame, limit: int | None = None) -> DataFrame:
    """All, or the first ``limit``, outline lines of each book, indented by level."""
    line = F.concat(
        F.repeat(F.lit("  "), F.least(F.col("level"), F.lit(5))),
        F.lit("- P"),
        (F.col("page_index") + 1).cast("string"),
        F.lit(" "),
        F.col("title"),
    )
    first = outline.withColumn("line", line)
    if limit is not None:
        first = top_rows(first, ["book_id"], ["ord"], limit)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return first.groupBy("book_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("outline_map")
    )


def assemble_prompt(asks: DataFrame, excerpts: DataFrame, outline: DataFrame,
                    history: DataFrame | None = None,
                    outline_lines: int | None = None) -> DataFrame:
    """P3. One prompt row per question.

    ``asks`` has query_id, book_id, whole_book, focus_page, passage (or null)
    and request; ``history`` has query_id and history.  The first excerpt that
    holds the passage gets it marked; if none does, the passage leads.
    """
    joined = excerpts.join(asks.select("query_id", "passage"), "query_id")
    at = F.when(
        F.col("passage").isNotNull() & (F.col("passage") != ""),
        F.call_function("locate", F.lower("passage"), F.lower("text")),
    ).otherwise(0)
    found = joined.withColumn("_at", at)
    first = F.min(F.when(F.col("_at") > 0, F.col("position"))).over(
        Window.partitionBy("query_id")
    )
    found = found.withColumn("_first", first)
    marked = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("_at") - 1),
        F.lit("⟦"),
        F.col("passage"),
        F.lit("⟧"),
        F.substring(F.col("text"), F.col("_at") + F.length("passage"), F.length("text")),
    )
    text = F.when(F.col("position") == F.col("_first"), marked).otherwise(F.col("text"))
    heading = F.when(
        F.col("chapter_title").isNotNull(), F.concat(F.lit("## "), "chapter_title", F.lit("\n"))
    ).otherwise("")
    block = F.concat(
        heading, F.lit("[P"), (F.col("page_index") + 1).cast("string"), F.lit("]\n"), text
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", block.alias("block"))))
    body = found.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["block"]), "\n\n").alias("excerpts"),
        F.max(F.col("_first").isNotNull()).alias("marked"),
    )
    out = asks.join(body, "query_id", "left").join(outline_map(outline, outline_lines), "book_id", "left")
    out = out.join(history, "query_id", "left") if history is not None else out.withColumn(
        "history", F.lit(None).cast("string")
    )
    scope = F.when(F.col("whole_book"), F.concat(F.lit("Outline:\n"), "outline_map", F.lit("\n\n")))
    earlier = F.when(F.col("history") != "", F.concat(F.lit("Earlier:\n"), "history", F.lit("\n\n")))
    focus = F.when(
        F.col("passage").isNotNull() & ~F.coalesce("marked", F.lit(False)),
        F.concat(F.lit("Passage [P"), (F.col("focus_page") + 1).cast("string"), F.lit("]:\n"),
                 "passage", F.lit("\n\n")),
    )
    prompt = F.concat(
        F.coalesce(scope, F.lit("")),
        F.coalesce(earlier, F.lit("")),
        F.coalesce(focus, F.lit("")),
        F.lit("Excerpts:\n"),
        F.coalesce("excerpts", F.lit("")),
        F.lit("\n\n"),
        F.col("request"),
    )
    return out.select("query_id", prompt.alias("prompt"))


CHAPTER_LIMIT = 36_000


def even_sample(spans: DataFrame, chunks: DataFrame, limit: int = CHAPTER_LIMIT) -> DataFrame:
    """P4. Blocks of each chapter that fit the limit, spread evenly.

    ``spans`` has book_id, ord, first_row, end_row, n_size (total block size);
    ``chunks`` has book_id, chunk_no, size.  Only the evenly spaced candidates
    of a long chapter are looked up; the limit bounds how many there are, so
    the fold that skips what overflows works on a short array.
    """
    n = F.col("end_row") - F.col("first_row")
    average = F.greatest(F.lit(1), F.floor(F.col("n_size") / n))
    wanted = F.greatest(F.lit(2), F.least(n, F.floor(F.lit(limit) / average))).cast("int")
    filled = spans.where("end_row > first_row").withColumn("_m", wanted)
    short = filled.where(F.col("n_size") <= limit).select(
        "book_id", "ord", F.explode(F.sequence(F.col("first_row"), F.col("end_row") - 1)).alias(
            "chunk_no")
    )
    last = (F.col("end_row") - F.col("first_row") - 1).cast("long")
    middle = F.when(
        F.col("_m") > 2,
        F.transform(
            F.sequence(F.lit(1), F.col("_m") - 2),
            lambda p: F.floor(p * last / (F.col("_m") - 1) + 0.5).cast("long"),
        ),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    order = F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), last), middle))
    candidates = (
        filled.where(F.col("n_size") > limit)
        .select("book_id", "ord", "first_row", F.posexplode(order).alias("place", "index"))
        .select("book_id", "ord", "place", (F.col("first_row") + F.col("index")).alias("chunk_no"))
        .join(chunks.select("book_id", "chunk_no", "size"), ["book_id", "chunk_no"])
    )
    items = F.array_sort(F.collect_list(F.struct("place", "chunk_no", "size")))
    start = F.struct(
        F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("out")
    )

    def fit(state: Column, item: Column) -> Column:
        total = state["used"] + item["size"]
        return F.when(total > limit, state).otherwise(
            F.struct(total.alias("used"),
                     F.array_append(state["out"], item["chunk_no"]).alias("out"))
        )

    chosen = candidates.groupBy("book_id", "ord").agg(items.alias("_items")).select(
        "book_id",
        "ord",
        F.aggregate("_items", start, fit, lambda s: s["out"]).alias("_chosen"),
        F.col("_items")[0]["chunk_no"].alias("_fallback"),
    )
    # Nothing fits: the first block, which the caller cuts to the limit.
    long = chosen.select(
        "book_id",
        "ord",
        F.explode(
            F.when(F.size("_chosen") > 0, F.col("_chosen")).otherwise(F.array("_fallback"))
        ).alias("chunk_no"),
    )
    return short.unionByName(long)
