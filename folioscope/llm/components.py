"""Connected components of a large edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import discard, durable, shuffles_deleted


def components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (a, b: long) the smallest node that it reaches, as (node, component).

    Alternating rounds of large and small stars: every node points its neighbours to the smallest
    of them, so the edge table shrinks to one star per component in a number of rounds that grows
    with the logarithm of the component's size. Each round is a few shuffles of two longs per edge; a
    hub with any number of edges is aggregated to its minimum before it meets them again. Loops,
    repeated and null edges are ignored; a node without another is not returned.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = durable(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.distinct()
        lowest = small.groupBy("u").agg(F.min("v").alias("m"))
        star = (
            small.join(lowest, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
            .where("u <> v")
            .distinct()
        )
        after = durable(star)
        discard(pairs)
        pairs = after
        with shuffles_deleted(pairs.sparkSession):
            state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())


def smallest_reached(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index that each of n rows reaches by the links u - v."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            return label
