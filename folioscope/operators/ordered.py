"""Ordered operators that survive a key holding a large share of all rows.

A plain window over a hot key sorts that whole key in one task. Here each key is first cut
into buckets that follow the order; work inside a bucket is a window over (key, bucket), and
only one small row per bucket is combined across the key. ``bucket`` must be monotone in the
leading order column (for pages: ``page div n``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_BUCKET = 256


def page_bucket(page: Column | str = "page") -> Column:
    page = F.col(page) if isinstance(page, str) else page
    return F.floor(page / PAGE_BUCKET).cast("int")


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "ordinal"
) -> DataFrame:
    """Dense 0-based position of every row inside its key."""
    keys = list(keys)
    local = df.withColumn("_bucket", bucket).withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    )
    sizes = df.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").count()
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    return (
        local.join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_offset")
    )


def with_neighbour(
    df: DataFrame, keys: Sequence[str], ordinal: str, columns: dict[str, str], offset: int
) -> DataFrame:
    """Attach columns of the row ``offset`` places away (negative = earlier), NULL at the ends.

    An equi-join on (key, ordinal): rows of one key spread over all tasks.
    """
    other = df.select(
        *keys,
        (F.col(ordinal) - F.lit(offset)).alias(ordinal),
        *[F.col(c).alias(alias) for c, alias in columns.items()],
    )
    return df.join(other, [*keys, ordinal], "left")


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: str,
    name: str,
    strict: bool = False,
) -> DataFrame:
    """Latest non-NULL ``value`` at or before each row of the key; with ``strict``, before it."""
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    if strict:
        inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_bucket", bucket).withColumn(
        "_seen", F.last(value, ignorenulls=True).over(inside)
    )
    closing = (
        df.withColumn("_bucket", bucket)
        .filter(F.col(value).isNotNull())
        .groupBy(*keys, "_bucket")
        .agg(F.max_by(F.col(value), F.struct(*order)).alias("_closing"))
    )
    buckets = df.select(*keys, bucket.alias("_bucket")).distinct()
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.join(closing, [*keys, "_bucket"], "left").select(
        *keys, "_bucket", F.last("_closing", ignorenulls=True).over(across).alias("_carried")
    )
    return (
        local.join(carried, [*keys, "_bucket"])
        .withColumn(name, F.coalesce("_seen", "_carried"))
        .drop("_bucket", "_seen", "_carried")
    )
