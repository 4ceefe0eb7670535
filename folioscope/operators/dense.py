"""Exact inner-product ranking of chunk vectors for a batch of queries.

Vectors stay where they are: each task multiplies its Arrow batches with the query matrix and
keeps only the best rows per query. Queries travel in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.topk import diversified, top_k
from folioscope.session import durable

SLICE = 2048  # queries per slice, about 16 MB of doubles at 1,024 dimensions
SCORE_DIGITS = 9
SCHEMA = "query_id STRING, chunk_ord BIGINT, candidate_language STRING, semantic_score DOUBLE"


def _slices(queries: DataFrame) -> Iterator[DataFrame]:
    slices = -(-queries.count() // SLICE)
    if slices <= 1:
        yield queries
        return
    for i in range(slices):
        yield queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)


class _Batch:
    """One slice of queries, shipped to the tasks: ids, unit matrix and routes."""

    def __init__(self, rows: pa.Table):
        self.ids = rows["query_id"].to_pylist()
        self.routes = [frozenset(f or ()) for f in rows["query_funds"].to_pylist()]
        vectors = rows["query_vector"].to_pylist()
        self.matrix = np.asarray(vectors, dtype=np.float64).reshape(len(self.ids), -1)

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rounded scores and route mask, both queries x rows."""
        n = batch.num_rows
        flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
        vectors = flat.astype(np.float64).reshape(n, -1)
        scores = np.round(self.matrix @ vectors.T, SCORE_DIGITS)
        funds = batch.column("fund").to_pylist()
        names = {name: i for i, name in enumerate(dict.fromkeys(funds))}
        codes = np.fromiter((names[f] for f in funds), dtype=np.int64, count=n)
        pools: dict[frozenset, np.ndarray] = {}
        mask = np.empty_like(scores, dtype=bool)
        for i, route in enumerate(self.routes):
            if route not in pools:
                by_name = [(f is None) if not route else (f in route) for f in names]
                pools[route] = np.asarray(by_name, dtype=bool)[codes]
            mask[i] = pools[route]
        return scores, mask


def _head(scores: np.ndarray, ords: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ords, -scores))[:k]


def semantic_rank(
    vectors: DataFrame,
    queries: DataFrame,
    pool_size: int,
    per_language_k: int = 0,
    languages: tuple[str, ...] = ("en", "bg"),
) -> DataFrame:
    """``query_id, chunk_ord, candidate_language, semantic_score, semantic_rank``.

    The ``pool_size`` best chunks per query, score first, then chunk order. With
    ``per_language_k`` the best rows of each language are added with their exact rank.
    ``vectors`` needs ``chunk_ord, fund, candidate_language, embedding``; ``queries`` needs
    ``query_id, query_funds, query_vector``.
    """
    slim = vectors.select("chunk_ord", "fund", "candidate_language", "embedding").filter(
        F.col("embedding").isNotNull()
    )
    parts = [
        _rank_slice(slim, part, pool_size, per_language_k, languages) for part in _slices(queries)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _rank_slice(slim, queries, pool_size, per_language_k, languages) -> DataFrame:
    spark = slim.sparkSession
    rows = queries.select(F.col("query_id").cast("string"), "query_funds", "query_vector").toArrow()
    if rows.num_rows == 0:
        return spark.createDataFrame([], SCHEMA + ", semantic_rank INT")
    shipped = spark.sparkContext.broadcast(_Batch(rows))
    groups = [None, *languages] if per_language_k else [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = shipped.value
        best: dict[tuple, tuple] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores, mask = work.scores(batch)
            ords = batch.column("chunk_ord").to_numpy(zero_copy_only=False)
            langs = np.asarray(batch.column("candidate_language").to_pylist(), dtype=object)
            of_language = {g: langs == g for g in groups if g is not None}
            for i in range(len(work.ids)):
                for group in groups:
                    keep = mask[i] if group is None else mask[i] & of_language[group]
                    where = np.flatnonzero(keep)
                    if where.size == 0:
                        continue
                    limit = pool_size if group is None else per_language_k
                    s, o, lang = scores[i, where], ords[where], langs[where]
                    if (i, group) in best:
                        bs, bo, bl = best[i, group]
                        s, o, lang = np.concatenate([bs, s]), np.concatenate([bo, o]), np.concatenate([bl, lang])
                    head = _head(s, o, limit)
                    best[i, group] = (s[head], o[head], lang[head])
        for i, qid in enumerate(work.ids):
            seen: dict[int, tuple] = {}
            for group in groups:
                if (i, group) in best:
                    for s, o, lang in zip(*best[i, group]):
                        seen[int(o)] = (float(s), lang)
            if seen:
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array([qid] * len(seen), pa.string()),
                        "chunk_ord": pa.array(list(seen), pa.int64()),
                        "candidate_language": pa.array([v[1] for v in seen.values()], pa.string()),
                        "semantic_score": pa.array([v[0] for v in seen.values()], pa.float64()),
                    }
                )

    local = slim.mapInArrow(run, SCHEMA)
    if per_language_k:  # read several times below; at most (pool + quotas) rows per task and query
        local = durable(local)
    order = [F.col("semantic_score").desc(), F.col("chunk_ord")]
    ranked = top_k(local, ["query_id"], order, pool_size, "semantic_rank")
    if not per_language_k:
        return ranked
    quota = top_k(
        local.filter(F.col("candidate_language").isin(*languages)),
        ["query_id", "candidate_language"], order, per_language_k, "_q",
    ).drop("_q")
    beyond = quota.join(ranked.select("query_id", "chunk_ord"), ["query_id", "chunk_ord"], "left_anti")
    return ranked.unionByName(_exact_ranks(slim, shipped, beyond))


def _exact_ranks(slim: DataFrame, shipped, few: DataFrame) -> DataFrame:
    """Rank of a few rows per query among all routed rows: a counting pass, nothing sorted.

    ``few`` is bounded by queries per slice x languages x quota, so it travels to the tasks.
    """
    spark = slim.sparkSession
    few = durable(few)
    table = few.select("query_id", "chunk_ord", "semantic_score").toArrow()
    thresholds: dict[str, list[tuple[float, int]]] = {}
    for qid, o, s in zip(*(table[c].to_pylist() for c in ("query_id", "chunk_ord", "semantic_score"))):
        thresholds.setdefault(qid, []).append((s, o))
    if not thresholds:
        return few.withColumn("semantic_rank", F.lit(None).cast("int"))
    marks = spark.sparkContext.broadcast(thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, wanted = shipped.value, marks.value
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores, mask = work.scores(batch)
            ords = batch.column("chunk_ord").to_numpy(zero_copy_only=False)
            for i, qid in enumerate(work.ids):
                for s, o in wanted.get(qid, ()):
                    ahead = mask[i] & ((scores[i] > s) | ((scores[i] == s) & (ords < o)))
                    counts[qid, o] = counts.get((qid, o), 0) + int(ahead.sum())
        if counts:
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array([k[0] for k in counts], pa.string()),
                    "chunk_ord": pa.array([k[1] for k in counts], pa.int64()),
                    "ahead": pa.array(list(counts.values()), pa.int64()),
                }
            )

    ranks = (
        slim.mapInArrow(run, "query_id STRING, chunk_ord BIGINT, ahead BIGINT")
        .groupBy("query_id", "chunk_ord")
        .agg((F.sum("ahead") + 1).cast("int").alias("semantic_rank"))
    )
    return few.join(ranks, ["query_id", "chunk_ord"])


def candidate_rank(
    vectors: DataFrame,
    queries: DataFrame,
    candidate_k: int = 50,
    global_k: int = 30,
    per_language_k: int = 10,
    languages: tuple[str, ...] = ("en", "bg"),
) -> DataFrame:
    """Diversified candidates with ``candidate_rank`` and their rank in the full pool."""
    ranked = semantic_rank(vectors, queries, max(candidate_k, 1), per_language_k, languages)
    return diversified(
        ranked, ["query_id"], "semantic_rank", "candidate_language",
        candidate_k, global_k, per_language_k, languages,
    ).withColumnRenamed("semantic_rank", "candidate_dense_rank")
