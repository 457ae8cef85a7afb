"""Running values over long ordered groups, without one task per long group.

Every group is split into blocks: each block is reduced before the shuffle, the
carry runs over one row per block, and the rows are finished inside their
blocks.  A group that holds a third of all rows is spread over as many tasks as
it has blocks; only its block summaries meet in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRIES_PER_BLOCK = 4096
PAGES_PER_BLOCK = 1024


def block_of(position: Column | str, size: int = ENTRIES_PER_BLOCK) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / size).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    low: Mapping[str, Column] | None = None,
    high: Mapping[str, Column] | None = None,
    reverse: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Append running columns: ``last`` non-null value, ``total``, ``low`` (min)
    and ``high`` (max) up to each row, or from it on when ``reverse``.

    ``order`` must be unique inside a group and ``block`` non-decreasing in it.
    The rows are read twice, once for the block summaries; callers stage what is
    dear to compute.
    """
    last, total, low, high = (dict(m or {}) for m in (last, total, low, high))
    keys, order = list(keys), list(order)

    def ranked(columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if reverse else F.col(c).asc() for c in columns]

    end = 0 if inclusive else -1
    place = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if reverse else F.max_by
    summary = []
    for name, value in last.items():
        summary.append(pick(value, F.when(value.isNotNull(), place)).alias(f"_b_{name}"))
    summary += [F.sum(value).alias(f"_b_{name}") for name, value in total.items()]
    summary += [F.min(value).alias(f"_b_{name}") for name, value in low.items()]
    summary += [F.max(value).alias(f"_b_{name}") for name, value in high.items()]

    tagged = df.withColumn("_block", block)
    before = (
        Window.partitionBy(*keys).orderBy(*ranked(["_block"])).rowsBetween(
            Window.unboundedPreceding, -1
        )
    )
    carried = tagged.groupBy(*keys, "_block").agg(*summary)
    carried = carried.select(
        *keys,
        "_block",
        *[F.last(f"_b_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last],
        *[F.sum(f"_b_{n}").over(before).alias(f"_c_{n}") for n in total],
        *[F.min(f"_b_{n}").over(before).alias(f"_c_{n}") for n in low],
        *[F.max(f"_b_{n}").over(before).alias(f"_c_{n}") for n in high],
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*ranked(order))
        .rowsBetween(Window.unboundedPreceding, end)
    )
    joined = tagged.join(carried, [*keys, "_block"])
    out = {}
    for name, value in last.items():
        out[name] = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col(f"_c_{name}"))
    for name, value in total.items():
        local = F.coalesce(F.sum(value).over(inside), F.lit(0))
        out[name] = local + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
    for name, value in low.items():
        out[name] = F.least(F.min(value).over(inside), F.col(f"_c_{name}"))
    for name, value in high.items():
        out[name] = F.greatest(F.max(value).over(inside), F.col(f"_c_{name}"))
    columns = [c for c in df.columns if c not in out]
    return joined.select(*columns, *[value.alias(name) for name, value in out.items()])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    name: str,
) -> DataFrame:
    """1-based position of each row in its group."""
    return running(df, keys, order, block, total={name: F.lit(1).cast("long")})


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key.  The rank filter is pushed below the shuffle by the
    optimizer, so every task sends one row per key at most."""
    return top_rows(df, keys, order, 1).drop("_rank")


def top_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    limit: int | Column,
    name: str = "_rank",
) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
