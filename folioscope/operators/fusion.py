"""Weighted reciprocal-rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.topk import rank_within


def reciprocal_rank_fusion(
    semantic: DataFrame,
    lexical: DataFrame,
    semantic_weight: float = 3.0,
    lexical_weight: float = 1.0,
    rrf_k: int = 20,
) -> DataFrame:
    """Union of both rankings with ``hybrid_score`` and ``fused_rank``; a missing side adds 0.

    Equal scores keep semantic rows first, by semantic then lexical rank. Both inputs are
    already limited per query, so the full outer join is small.
    """
    both = semantic.drop("candidate_language").join(lexical, ["query_id", "chunk_ord"], "full_outer")

    def part(weight: float, rank: str):
        return F.coalesce(F.lit(weight) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))

    scored = both.withColumn(
        "hybrid_score", part(semantic_weight, "semantic_rank") + part(lexical_weight, "lexical_rank")
    )
    order = [
        F.col("hybrid_score").desc(),
        F.col("semantic_rank").asc_nulls_last(),
        F.col("lexical_rank").asc_nulls_last(),
    ]
    return rank_within(scored, ["query_id"], order, "fused_rank")
