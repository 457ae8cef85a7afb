"""Scoped retrieval for batches of questions over many books (Q1-Q7).

Vocabulary: ``chunks`` are index rows (book_id, chunk_no, page_index,
chapter_title, chapter_path, text); ``asks`` are questions (query_id, book_id,
query); a *pool* is a set of chunks that is searched, named by (book_id,
pool_id) and shared by all questions that search it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagework.functions import text as T
from pagework.operators.outline import squeeze
from pagework.plans.containment import contains_pairs
from pagework.plans.running import PAGES_PER_BLOCK, block_of, running, top_rows
from pagework.plans.stage import stage

WHOLE = "book"


def effective_path(path: Column, title: Column) -> Column:
    return F.when(F.size(path) > 0, path).when(title.isNotNull(), F.array(title)).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def term_counts(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    exploded = df.select(*keys, F.explode(tokens).alias("token"))
    return exploded.groupBy(*keys, "token").agg(F.count("*").alias("tf"))


@dataclass
class Postings:
    """Token statistics of one batch: what its questions ask for, and where
    those tokens occur.  Tokens nobody asks for are dropped before any shuffle
    of chunk tokens."""

    terms: DataFrame  # query_id, book_id, token, qtf
    rows: DataFrame  # book_id, chunk_no, token, tf
    lengths: DataFrame  # book_id, chunk_no, page_index, length
    bonus: DataFrame  # query_id, book_id, chunk_no, bonus


def title_hits(asks: DataFrame, chunks: DataFrame, form) -> DataFrame:
    """(query_id, book_id, title) for chapter titles that occur in a question,
    both in the comparable ``form``."""
    titles = (
        chunks.select("book_id", F.explode(
            F.array_distinct(F.concat(
                F.coalesce("chapter_path", F.expr("cast(array() as array<string>)")),
                F.when(F.col("chapter_title").isNotNull(), F.array("chapter_title")).otherwise(
                    F.expr("cast(array() as array<string>)"))))).alias("title"))
        .distinct()
    )
    titles = stage(titles, "titles").withColumn("needle", form("title"))
    texts = asks.select("book_id", "query_id", F.col("query").alias("text"))
    pairs = contains_pairs(titles, texts, ["book_id"], ["query_id"], form)
    return pairs.join(titles, ["book_id", "needle"]).select("query_id", "book_id", "title")


def phrase_hits(asks: DataFrame, chunks: DataFrame, form) -> DataFrame:
    """(query_id, book_id, chunk_no) where the first 160 characters of the
    question, if it has at least 8, occur in the chunk."""
    needles = asks.select("query_id", "book_id", form("query").alias("_q")).where(
        F.length("_q") >= 8
    ).select("query_id", "book_id", F.left("_q", F.lit(160)).alias("needle"))
    texts = chunks.select("book_id", "chunk_no", "text")
    pairs = contains_pairs(needles, texts, ["book_id"], ["chunk_no"], form)
    return pairs.join(needles, ["book_id", "needle"]).select("query_id", "book_id", "chunk_no")


def inline_form(c) -> Column:
    return F.lower(T.inline(c))


def build_postings(asks: DataFrame, chunks: DataFrame, method: str = "bm25") -> Postings:
    """Tokenise a batch once, for all pools it will search."""
    tokens = T.tokens if method == "bm25" else T.simple_tokens
    form = inline_form if method == "bm25" else squeeze
    terms = term_counts(asks, ["query_id", "book_id"], tokens("query")).withColumnRenamed(
        "tf", "qtf"
    )
    asked = chunks.join(asks.select("book_id").distinct(), "book_id", "left_semi")
    # Every chunk is tokenised once; counts and lengths are read from this table.
    listed = stage(asked.select(
        "book_id", "chunk_no", "page_index", tokens("text").alias("_tokens")
    ).withColumn("length", F.size("_tokens")), "chunk-tokens")
    needed = terms.select("book_id", "token").distinct()
    rows = (
        listed.select("book_id", "chunk_no", F.explode("_tokens").alias("token"))
        .join(needed, ["book_id", "token"], "left_semi")
        .groupBy("book_id", "chunk_no", "token")
        .agg(F.count("*").alias("tf"))
    )
    lengths = listed.select("book_id", "chunk_no", "page_index", "length")

    titles = title_hits(asks, chunks, form)
    element = F.col("element")
    path = F.coalesce("chapter_path", F.expr("cast(array() as array<string>)"))
    if method == "bm25":
        weights = F.concat(
            F.transform(path, lambda t: F.struct(t.alias("title"), F.lit(2).alias("weight"))),
            F.when(
                F.col("chapter_title").isNotNull(),
                F.array(F.struct(F.col("chapter_title").alias("title"), F.lit(5).alias("weight"))),
            ).otherwise(F.expr("cast(array() as array<struct<title:string,weight:int>>)")),
        )
        reduce = F.sum("element.weight")
    else:
        weights = F.transform(path, lambda t: F.struct(t.alias("title"), F.lit(7).alias("weight")))
        reduce = F.max("element.weight")
    by_title = (
        asked.select("book_id", "chunk_no", F.explode(weights).alias("element"))
        .withColumn("title", element["title"])
        .join(titles, ["book_id", "title"])
        .groupBy("query_id", "book_id", "chunk_no")
        .agg(reduce.cast("double").alias("bonus"))
    )
    by_phrase = phrase_hits(asks, chunks, form).withColumn("bonus", F.lit(12.0))
    bonus = by_title.unionByName(by_phrase).groupBy("query_id", "book_id", "chunk_no").agg(
        F.sum("bonus").alias("bonus")
    )
    return Postings(
        stage(terms, "terms"),
        stage(rows, "postings"),
        lengths,
        stage(bonus, "bonus"),
    )


def whole_book_pools(asks: DataFrame) -> DataFrame:
    return asks.select("query_id", "book_id", F.lit(WHOLE).alias("pool_id"))


def whole_book_members(postings: Postings) -> DataFrame:
    return postings.lengths.withColumn("pool_id", F.lit(WHOLE))


def rank_pool(
    postings: Postings,
    members: DataFrame,
    assigned: DataFrame,
    limit: Column | int,
    widest: int,
    method: str = "bm25",
) -> DataFrame:
    """Q1 / Q2. The best chunks of each question's pool, ranked from 1.

    ``members`` is (book_id, pool_id, chunk_no, page_index, length);
    ``assigned`` is (query_id, book_id, pool_id) plus what ``limit`` reads.
    Chunk count, document frequency and average length belong to the pool.  A
    question without tokens gets the first chunks of its pool.  ``widest`` is
    the largest limit in the batch; it lets the rank filter run before the
    shuffle.
    """
    pool = ["book_id", "pool_id"]
    used = members.join(assigned.select(*pool).distinct(), pool, "left_semi")
    stats = used.groupBy(*pool).agg(
        F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean_length")
    )
    pooled = used.join(postings.rows, ["book_id", "chunk_no"])
    frequency = pooled.groupBy(*pool, "token").agg(F.count("*").alias("df"))
    terms = postings.terms.join(assigned.select("query_id", *pool), ["query_id", "book_id"])
    weighted = terms.join(frequency, [*pool, "token"]).join(stats, pool)
    boost = F.least(F.lit(1.6), 1 + F.log(F.col("qtf")))
    if method == "bm25":
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        saturation = F.col("tf") * 2.2 / (
            F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean_length"))
        )
    else:
        idf = F.log(1 + (F.col("n") + 0.5) / (F.col("df") + 0.5))
        saturation = F.least(F.lit(3), F.col("tf"))
    weighted = weighted.select("query_id", *pool, "token", (idf * boost).alias("weight"),
                               "mean_length")
    found = (
        pooled.join(weighted, [*pool, "token"])
        .groupBy("query_id", *pool, "chunk_no")
        .agg(F.sum(F.col("weight") * saturation).alias("score"))
    )
    extra = (
        postings.bonus.join(assigned.select("query_id", *pool), ["query_id", "book_id"])
        .join(used.select(*pool, "chunk_no"), [*pool, "chunk_no"], "left_semi")
        .select("query_id", *pool, "chunk_no", F.col("bonus").alias("score"))
    )
    scored = (
        found.unionByName(extra)
        .groupBy("query_id", *pool, "chunk_no")
        .agg(F.round(F.sum("score"), 6).alias("score"))
        .where("score > 0")
    )
    silent = assigned.select("query_id", *pool).join(
        postings.terms.select("query_id").distinct(), "query_id", "left_anti"
    )
    first = top_rows(used, pool, ["chunk_no"], widest).select(*pool, "chunk_no")
    unscored = silent.join(first, pool).select(
        "query_id", *pool, "chunk_no", F.lit(0.0).alias("score")
    )
    # A score can only come from a query term, so the two parts never overlap.
    placed = scored.unionByName(unscored).join(
        used.select(*pool, "chunk_no", "page_index"), [*pool, "chunk_no"]
    )
    best = top_rows(
        placed, ["query_id"], [F.desc("score"), "page_index", "chunk_no"], widest, "rank"
    )
    if isinstance(limit, int):
        return best.where(F.col("rank") <= limit)
    limits = assigned.select("query_id", limit.alias("_limit"))
    return best.join(limits, "query_id").where("rank <= _limit").drop("_limit")


def retrieve(asks: DataFrame, chunks: DataFrame, k: int, method: str = "bm25") -> DataFrame:
    """Top ``k`` chunks of the whole book for every question."""
    postings = build_postings(asks, chunks, method)
    return rank_pool(
        postings, whole_book_members(postings), whole_book_pools(asks), k, k, method
    )


def page_pools(asks: DataFrame) -> DataFrame:
    return asks.select(
        "query_id", "book_id", F.concat(F.lit("page:"), "focus_page").alias("pool_id")
    )


def page_members(asks: DataFrame, postings: Postings) -> DataFrame:
    pages = asks.select("book_id", F.col("focus_page").alias("page_index")).distinct()
    return postings.lengths.join(pages, ["book_id", "page_index"], "left_semi").withColumn(
        "pool_id", F.concat(F.lit("page:"), "page_index")
    )


def best_on_page(asks: DataFrame, postings: Postings) -> DataFrame:
    """(query_id, chunk_no): the best chunk of the focus page, if any scores."""
    found = rank_pool(postings, page_members(asks, postings), page_pools(asks), 1, 1)
    return found.select("query_id", "chunk_no")


def focus_chunk(asks: DataFrame, postings: Postings, best: DataFrame) -> DataFrame:
    """Q3. Best chunk of the focus page, else its first, else the last chunk at
    or before it: (query_id, book_id, chunk_no), null when the book starts later."""
    per_page = postings.lengths.groupBy("book_id", "page_index").agg(
        F.min("chunk_no").alias("first_no"), F.max("chunk_no").alias("last_no")
    )
    points = asks.select("book_id", F.col("focus_page").alias("page_index")).distinct()
    merged = per_page.withColumn("_point", F.lit(0)).unionByName(
        points.withColumn("_point", F.lit(1)), allowMissingColumns=True
    )
    before = running(
        merged,
        ["book_id"],
        ["page_index", "_point"],
        block_of("page_index", PAGES_PER_BLOCK),
        last={"here": F.when(F.col("_point") == 0, F.struct("page_index", "first_no", "last_no"))},
    ).where("_point = 1")
    fallback = before.select(
        "book_id",
        F.col("page_index").alias("focus_page"),
        F.when(F.col("here.page_index") == F.col("page_index"), F.col("here.first_no"))
        .otherwise(F.col("here.last_no"))
        .alias("_fallback"),
    )
    return (
        asks.join(best, "query_id", "left")
        .join(fallback, ["book_id", "focus_page"])
        .select("query_id", "book_id", F.coalesce("chunk_no", "_fallback").alias("chunk_no"))
    )


def path_key(path: Column) -> Column:
    return F.array_join(path, "\x1f")


def prefixes(path: Column, proper: bool = False) -> Column:
    longest = F.size(path) - (1 if proper else 0)
    return F.when(
        longest >= 1,
        F.transform(F.sequence(F.lit(1), longest), lambda n: path_key(F.slice(path, F.lit(1), n))),
    ).otherwise(F.expr("cast(array() as array<string>)"))


def scope_pools(asks: DataFrame, chunks: DataFrame, focus: DataFrame) -> DataFrame:
    """Q4. The pool of each question: (query_id, book_id, pool_id).

    ``book``; or the chapter of the focus chunk, widened to its parent when it
    has no descendants; or the pages around the focus when it has no chapter.
    """
    path = effective_path(F.col("chapter_path"), F.col("chapter_title"))
    paths = chunks.select("book_id", "chunk_no", path.alias("path"))
    inner = (
        paths.select("book_id", "path").distinct()
        .select("book_id", F.explode(prefixes(F.col("path"), proper=True)).alias("_key"))
        .distinct()
        .withColumn("_inner", F.lit(True))
    )
    located = focus.join(paths, ["book_id", "chunk_no"], "left").withColumn(
        "_key", path_key(F.col("path"))
    )
    located = located.join(inner, ["book_id", "_key"], "left")
    joined = asks.join(located.drop("book_id"), "query_id", "left")
    keep = F.coalesce("_inner", F.lit(False)) | (F.size("path") == 1)
    scope = F.when(keep, F.col("path")).otherwise(
        F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    )
    pool = (
        F.when(F.col("whole_book"), F.lit(WHOLE))
        .when(F.size("path") > 0, F.concat(F.lit("path:"), path_key(scope)))
        .otherwise(F.concat(F.lit("near:"), F.col("focus_page").cast("string")))
    )
    return joined.select("query_id", "book_id", pool.alias("pool_id"))


def pool_members(pools: DataFrame, chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Chunks of every distinct pool: (book_id, pool_id, chunk_no, page_index, length)."""
    named = pools.select("book_id", "pool_id").distinct()
    whole = lengths.join(named.where(F.col("pool_id") == WHOLE), "book_id")
    path = effective_path(F.col("chapter_path"), F.col("chapter_title"))
    by_path = (
        chunks.select("book_id", "chunk_no", F.explode(prefixes(path)).alias("_key"))
        .withColumn("pool_id", F.concat(F.lit("path:"), "_key"))
        .join(named.where("pool_id LIKE 'path:%'"), ["book_id", "pool_id"], "left_semi")
        .select("book_id", "chunk_no", "pool_id")
        .join(lengths, ["book_id", "chunk_no"])
    )
    page = F.substring("pool_id", 6, 12).cast("int")
    near = (
        named.where("pool_id LIKE 'near:%'")
        .withColumn("page_index", F.explode(F.sequence(page - 3, page + 3)))
        .join(lengths, ["book_id", "page_index"])
    )
    columns = ["book_id", "pool_id", "chunk_no", "page_index", "length"]
    return whole.select(*columns).unionByName(by_path.select(*columns)).unionByName(
        near.select(*columns)
    )


# Depth -> chunks, history turns, output tokens; token budget by
# depth and scope; seeds, radius and cap by scope.
DEPTHS = [("economical", 6, 4, 1500), ("balanced", 9, 8, 3000), ("deep", 14, 12, 5000)]
BUDGETS = {
    ("economical", "explanation"): 3200,
    ("economical", "standard"): 5000,
    ("economical", "context"): 6500,
    ("balanced", "explanation"): 4800,
    ("balanced", "standard"): 7200,
    ("balanced", "context"): 9600,
    ("deep", "explanation"): 6500,
    ("deep", "standard"): 10000,
    ("deep", "context"): 14000,
}
SCOPES = {
    "explanation": {"seeds": (3, 4), "radius": 0, "cap": (4, 6)},
    "standard": {"seeds": (5, 7), "radius": 1, "cap": (6, 10)},
    "context": {"seeds": (7, 10), "radius": 2, "cap": (9, 14)},
}
WIDEST_SEEDS = 10
WIDEST_CAP = 14


def reading_budgets(asks: DataFrame) -> DataFrame:
    """Q7. Limits of each question, as plain conditions: nine cases need no join."""
    depth, scope = F.col("depth"), F.col("scope")
    whole = F.col("whole_book")

    def by_depth(position: int) -> Column:
        out = None
        for row in DEPTHS:
            out = (F if out is None else out).when(depth == row[0], row[position])
        return out

    budget = None
    for (d, s), value in BUDGETS.items():
        case = (depth == d) & (scope == s)
        budget = (F if budget is None else budget).when(
            case, F.when(whole, value * 112 // 100).otherwise(value)
        )

    def by_scope(name: str) -> Column:
        out = None
        for s, limits in SCOPES.items():
            value = limits[name]
            chosen = F.lit(value) if isinstance(value, int) else F.when(
                whole, value[1]).otherwise(value[0])
            out = (F if out is None else out).when(scope == s, chosen)
        return out

    limit = by_depth(1)
    return asks.select(
        *asks.columns,
        limit.alias("context_limit"),
        by_depth(2).alias("history_limit"),
        by_depth(3).alias("output_limit"),
        budget.alias("token_budget"),
        by_scope("seeds").alias("seed_limit"),
        by_scope("radius").alias("radius"),
        F.greatest(F.lit(1), F.least(limit, by_scope("cap"))).alias("cap"),
    )


def expand_neighbours(asks: DataFrame, seeds: DataFrame, pools: DataFrame,
                      members: DataFrame) -> DataFrame:
    """Q5. Seeds with their neighbours in chunk order, and the chunks on pages
    around the focus, all inside the pool: (query_id, chunk_no, page_index)."""
    pool = ["book_id", "pool_id"]
    limits = asks.select("query_id", "radius", "focus_page")
    no, radius, focus = F.col("chunk_no"), F.col("radius"), F.col("focus_page")
    around = (
        seeds.select("query_id", *pool, "chunk_no")
        .join(limits, "query_id")
        .select("query_id", *pool, F.explode(F.sequence(no - radius, no + radius)).alias("chunk_no"))
        .distinct()
        .join(members.select(*pool, "chunk_no", "page_index"), [*pool, "chunk_no"])
    )
    nearby = (
        pools.join(limits, "query_id")
        .select("query_id", *pool,
                F.explode(F.sequence(focus - radius, focus + radius)).alias("page_index"))
        .join(members.select(*pool, "chunk_no", "page_index"), [*pool, "page_index"])
    )
    columns = ["query_id", *pool, "chunk_no", "page_index"]
    return around.select(*columns).unionByName(nearby.select(*columns)).distinct()


def prioritise_and_cap(asks: DataFrame, selected: DataFrame, seeds: DataFrame, best: DataFrame,
                       pools: DataFrame, members: DataFrame) -> DataFrame:
    """Q6. Best focus chunk, then seeds by rank, then by page distance and
    order, cut to the cap.  With nothing selected, the first chunks of the pool."""
    marked = (
        selected.join(asks.select("query_id", "focus_page", "cap"), "query_id")
        .join(seeds.select("query_id", "chunk_no", F.col("rank").alias("_seed")),
              ["query_id", "chunk_no"], "left")
        .join(best.withColumn("_best", F.lit(0)), ["query_id", "chunk_no"], "left")
    )
    tier = F.coalesce("_best", "_seed", F.lit(WIDEST_SEEDS + 1))
    ranked = top_rows(
        marked,
        ["query_id"],
        [tier, F.abs(F.col("page_index") - F.col("focus_page")), "chunk_no"],
        WIDEST_CAP,
    ).where("_rank <= cap")
    empty = pools.join(selected.select("query_id").distinct(), "query_id", "left_anti")
    pool = ["book_id", "pool_id"]
    first = top_rows(
        members.join(empty.select(*pool).distinct(), pool, "left_semi"), pool, ["chunk_no"],
        WIDEST_CAP,
    )
    plain = (
        empty.join(asks.select("query_id", "cap"), "query_id")
        .join(first.select(*pool, "chunk_no", "page_index", "_rank"), pool)
        .where("_rank <= cap")
    )
    columns = ["query_id", "book_id", "chunk_no", "page_index"]
    return ranked.select(*columns).unionByName(plain.select(*columns))


def retrieve_for_reading(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Q3-Q7 together: (query_id, book_id, chunk_no, page_index) of every
    question's context.  ``asks`` adds focus_page, scope, depth, whole_book."""
    asks = reading_budgets(asks)
    postings = build_postings(asks, chunks)
    best = stage(best_on_page(asks, postings), "best")
    focus = focus_chunk(asks, postings, best)
    pools = stage(scope_pools(asks, chunks, focus), "pools")
    members = stage(pool_members(pools, chunks, postings.lengths), "members")
    assigned = pools.join(asks.select("query_id", "seed_limit"), "query_id")
    seeds = stage(
        rank_pool(postings, members, assigned, F.col("seed_limit"), WIDEST_SEEDS), "seeds"
    )
    selected = expand_neighbours(asks, seeds, pools, members)
    return prioritise_and_cap(asks, selected, seeds, best, pools, members)
