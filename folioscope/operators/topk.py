"""Ranking operators: per-group top-k, quotas, interleaving and first-wins dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
# Spark pre-limits a row_number filter on the map side only up to this many rows.
GROUP_LIMIT = 1000


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """Best ``k`` rows per group with their 1-based rank.

    Spark prunes each map task to ``k`` rows per group before the shuffle, so a hot group
    ships at most ``k`` x tasks rows. Larger ``k`` gets the same shape from explicit salts.
    """
    if k > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        df = (
            rank_within(salted, [*keys, "_salt"], order, "_local")
            .filter(F.col("_local") <= k)
            .drop("_salt", "_local")
        )
    return rank_within(df, keys, order, name).filter(F.col(name) <= k)


def first_wins(df: DataFrame, keys: Sequence[str], identity: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of every identity, in order (partial min per map task, no sort)."""
    names = [f"_id{i}" for i in range(len(identity))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(identity, names)])
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        tagged.groupBy(*keys, *names)
        .agg(F.min_by(row, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def chunk_identity() -> list[Column]:
    """Identity of a retrieved row: its chunk id, or the location and text when it has none."""
    missing = F.coalesce(F.col("chunk_id"), F.lit("")) == ""
    parts = ["document", "page_start", "page_end", "section", "text"]
    return [
        F.when(~missing, F.col("chunk_id")),
        F.when(missing, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})),
    ]


def diversified(
    ranked: DataFrame,
    keys: Sequence[str],
    rank: str,
    language: str,
    target_k: int = 50,
    global_k: int = 30,
    per_language_k: int = 10,
    languages: Sequence[str] = ("en", "bg"),
    name: str = "candidate_rank",
) -> DataFrame:
    """Global head, then per-language heads in the given order, then the best of the rest.

    A row can be taken only if it is among the first ``target_k`` overall or among the first
    ``per_language_k`` of its language, so both windows work on an already limited input.
    """
    if target_k <= 0:
        return ranked.withColumn(name, F.lit(None).cast("int")).filter(F.lit(False))
    by_rank = [F.col(rank)]
    head = ranked.filter(F.col(rank) <= target_k)
    quota = (
        top_k(ranked.filter(F.col(language).isin(*languages)), [*keys, language], by_rank, per_language_k, "_quota")
        .drop("_quota")
        .filter(F.col(rank) > target_k)
    )
    pool = rank_within(head.unionByName(quota), [*keys, language], by_rank, "_quota")
    stage = F.when(F.col(rank) <= global_k, 0)
    for i, code in enumerate(languages, start=1):
        stage = stage.when((F.col(language) == code) & (F.col("_quota") <= per_language_k), i)
    staged = pool.withColumn("_stage", stage.otherwise(len(languages) + 1))
    return top_k(staged, keys, [F.col("_stage"), F.col(rank)], target_k, name).drop("_stage", "_quota")


def interleave(df: DataFrame, keys: Sequence[str], rank: str, group_order: str, name: str = "position") -> DataFrame:
    """Round-robin: all first-ranked rows in group order, then all second-ranked, and so on."""
    return rank_within(df, keys, [F.col(rank), F.col(group_order)], name)
