"""Routed retrieval for a batch of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import detect_language, model_prefixes, passage_text
from folioscope.operators.dense import candidate_rank, semantic_rank
from folioscope.operators.fusion import reciprocal_rank_fusion
from folioscope.operators.lexical import lexical_rank, term_statistics, token_table
from folioscope.operators.postings import LexicalIndex, stored_rank
from folioscope.operators.names import detect_entities, strip_entities
from folioscope.operators.topk import rank_within
from folioscope.plans.index import DEFAULT_MODEL, encoder_column
from folioscope.session import durable

MODES = ("auto", "semantic", "lexical", "hybrid", "reranked")
LANGUAGES = ("en", "bg")

Score = Callable[[str, list[str]], list[float]]


class Retriever:
    """Ranks chunks for queries.

    ``chunks`` needs ``chunk_ord, chunk_id, document, fund, section, page_start, page_end, text``;
    ``vectors`` needs ``chunk_ord, embedding``. Queries come as ``query_id, query`` with an
    optional ``query_funds`` (an empty array means the entity-free pool, a missing column means
    detection) and an optional ``query_vector``; without it ``load_encoder`` embeds the search
    text. ``lexical`` may replace the BM25 ranking by another one with the same signature. With a stored ``index``
    no text is tokenised and languages come from it.
    """

    def __init__(
        self, chunks: DataFrame, registry: DataFrame, vectors: DataFrame | None = None,
        load_encoder: Callable | None = None, load_reranker: Callable[[], Score] | None = None,
        model_name: str = DEFAULT_MODEL, lexical: Callable | None = None,
        languages: Sequence[str] = LANGUAGES, index: LexicalIndex | None = None,
    ):
        self.registry = registry
        self.load_encoder, self.load_reranker = load_encoder, load_reranker
        self.query_prefix, _ = model_prefixes(model_name)
        self.languages = tuple(languages)
        self._lexical = lexical
        self.index = index
        self.chunks = chunks.withColumn("lexical_text", passage_text("section", "text"))
        if "candidate_language" not in chunks.columns:
            self.chunks = self.chunks.withColumn("candidate_language", detect_language("lexical_text"))
        self._vectors = vectors

    @cached_property
    def vectors(self) -> DataFrame:
        """Vectors with owner and language; a stored index already carries both, without a join."""
        if self._vectors is None:
            raise ValueError("semantic ranking needs vectors")
        if {"fund", "candidate_language"} <= set(self._vectors.columns):
            return self._vectors
        return durable(self.owners.join(self._vectors.select("chunk_ord", "embedding"), "chunk_ord"))

    @cached_property
    def owners(self) -> DataFrame:
        """Owner and language per chunk, read from the token index when that exists."""
        columns = ["chunk_ord", "fund", "candidate_language"]
        if self.index is not None:
            return self.index.owners
        if "tokens" in self.__dict__:
            return self.tokens.select(*columns)
        return durable(self.chunks.select(*columns))

    @cached_property
    def tokens(self) -> DataFrame:
        """Token lists of all chunks: the lexical index, built once and kept on storage."""
        return durable(token_table(self.chunks.select("chunk_ord", "fund", "candidate_language", "lexical_text")))

    @cached_property
    def statistics(self) -> DataFrame:
        """Corpus-wide term statistics, computed once and kept on storage."""
        return durable(term_statistics(self.tokens))

    @cached_property
    def pool_languages(self) -> DataFrame:
        """Languages seen per entity: a small table that answers every pool question."""
        return durable(self.owners.select("fund", "candidate_language").distinct())

    def resolve(self, queries: DataFrame, mode: str = "auto") -> DataFrame:
        """Add entities, search text, language and effective mode; empty pools drop out."""
        if mode not in MODES:
            raise ValueError("mode must be " + ", ".join(MODES))
        named = queries if "query_funds" in queries.columns else detect_entities(queries, self.registry)
        stripped = strip_entities(named, self.registry).withColumn("query_language", detect_language("search_query"))
        wanted = stripped.select("query_id", F.explode_outer("query_funds").alias("fund"))
        pool = wanted.join(
            self.pool_languages.select(F.col("fund").alias("_fund"), "candidate_language"),
            F.col("fund").eqNullSafe(F.col("_fund")),
        ).groupBy("query_id").agg(
            F.count_distinct(F.when(F.col("candidate_language").isin(*self.languages), F.col("candidate_language"))).alias("_n")
        )
        auto = F.when(F.col("_n") > 1, "semantic").otherwise("hybrid")
        effective = auto if mode == "auto" else F.lit(mode)
        return stripped.join(pool, "query_id").withColumn("effective_mode", effective).drop("_n")

    def _embedded(self, resolved: DataFrame) -> DataFrame:
        if "query_vector" in resolved.columns:
            return resolved
        if self.load_encoder is None:
            raise ValueError("semantic ranking needs query_vector or an encoder")
        return resolved.withColumn(
            "query_vector", encoder_column(F.col("search_query"), self.load_encoder, self.query_prefix)
        )

    def candidate_set(
        self, queries: DataFrame, candidate_k: int = 50, global_k: int = 30, per_language_k: int = 10
    ) -> DataFrame:
        """Diversified high-recall candidates with their dense rank."""
        resolved = durable(self._embedded(self.resolve(queries, "semantic")))
        return self._candidates(resolved, candidate_k, global_k, per_language_k)

    def _candidates(self, resolved, candidate_k, global_k, per_language_k) -> DataFrame:
        ranked = candidate_rank(self.vectors, resolved, candidate_k, global_k, per_language_k, self.languages)
        info = resolved.select("query_id", "query_language", "query_funds", "search_query")
        chunks = self.chunks.drop("candidate_language", "lexical_text")
        return ranked.join(info, "query_id").join(chunks, "chunk_ord")

    def retrieve(
        self, queries: DataFrame, k: int = 5, mode: str = "auto", pool_size: int = 100,
        semantic_weight: float = 3.0, lexical_weight: float = 1.0, rrf_k: int = 20,
        candidate_k: int = 50, global_k: int = 30, per_language_k: int = 10,
    ) -> DataFrame:
        """Top ``k`` chunks per query with scores, ranks and the route taken."""
        if mode in ("auto", "lexical", "hybrid") and self.index is None:
            _ = self.tokens  # built first, so that owners and languages come from it
        resolved = self.resolve(queries, mode)
        if mode == "lexical":
            resolved = durable(resolved)
        else:
            resolved = durable(self._embedded(resolved))
        if mode == "reranked":
            ranked = self._reranked(resolved, candidate_k, global_k, per_language_k)
        else:
            ranked = self._fused(resolved, mode, pool_size, semantic_weight, lexical_weight, rrf_k)
        info = resolved.select("query_id", "query_funds", "query_language", "search_query", "effective_mode")
        top = ranked.filter(F.col("rank") <= k).join(info, "query_id")
        hybrid = F.col("effective_mode") == "hybrid"
        columns = [
            "query_id", "rank", "chunk_ord", "query_funds", "query_language", "candidate_language",
            F.when(F.size("query_funds") == 0, "no_fund").otherwise("fund").alias("route"),
            "search_query", F.lit(mode).alias("requested_mode"), "effective_mode", "semantic_score", "bm25_score",
            F.when(hybrid, F.col("hybrid_score")).alias("hybrid_score"), "semantic_rank",
            F.when(hybrid, F.col("lexical_rank")).alias("lexical_rank"), "candidate_dense_rank", "reranker_score",
        ]
        chunks = self.chunks.drop("lexical_text")
        wide = top.join(chunks, "chunk_ord")
        rest = [c for c in chunks.columns if c not in ("chunk_ord", "candidate_language")]
        return wide.select(*columns, *rest)

    def _fused(self, resolved, mode, pool_size, semantic_weight, lexical_weight, rrf_k) -> DataFrame:
        spark = resolved.sparkSession
        semantic = spark.createDataFrame(
            [], "query_id STRING, chunk_ord BIGINT, candidate_language STRING, semantic_score DOUBLE, semantic_rank INT"
        )
        lexical = spark.createDataFrame([], "query_id STRING, chunk_ord BIGINT, bm25_score DOUBLE, lexical_rank INT")
        if mode != "lexical":
            semantic = semantic_rank(
                self.vectors, resolved.filter(F.col("effective_mode").isin("semantic", "hybrid")), pool_size
            )
        if mode != "semantic":
            asked = resolved.filter(F.col("effective_mode").isin("lexical", "hybrid"))
            if self._lexical is not None:
                lexical = self._lexical(self.tokens, asked, pool_size)
            elif self.index is not None:
                lexical = stored_rank(self.index, asked, pool_size)
            else:
                lexical = lexical_rank(self.tokens, asked, pool_size, self.statistics)
        fused = reciprocal_rank_fusion(semantic, lexical, semantic_weight, lexical_weight, rrf_k)
        none = F.lit(None)
        return fused.withColumnRenamed("fused_rank", "rank").withColumn(
            "candidate_dense_rank", none.cast("int")
        ).withColumn("reranker_score", none.cast("double"))

    def _reranked(self, resolved, candidate_k, global_k, per_language_k) -> DataFrame:
        if self.load_reranker is None:
            raise ValueError("reranked mode needs a reranker")
        load, state = self.load_reranker, {}

        @F.arrow_udf(T.DoubleType())
        def score(queries: pa.Array, passages: pa.Array) -> pa.Array:
            if "model" not in state:
                state["model"] = load()
            by_query: dict[str, list[int]] = {}
            asked, texts = queries.to_pylist(), passages.to_pylist()
            for i, q in enumerate(asked):
                by_query.setdefault(q, []).append(i)
            out = [0.0] * len(asked)
            for q, places in by_query.items():
                for i, s in zip(places, state["model"](q, [texts[i] for i in places])):
                    out[i] = float(s)
            return pa.array(out, pa.float64())

        candidates = self._candidates(resolved, candidate_k, global_k, per_language_k)
        scored = candidates.withColumn(
            "reranker_score", score(F.col("search_query"), passage_text("section", "text"))
        )
        order = [F.col("reranker_score").desc(), F.col("candidate_rank")]
        none = F.lit(None)
        return rank_within(scored, ["query_id"], order, "rank").select(
            "query_id", "rank", "chunk_ord", "semantic_score", "candidate_dense_rank", "reranker_score",
            none.cast("double").alias("bm25_score"), none.cast("double").alias("hybrid_score"),
            none.cast("int").alias("semantic_rank"), none.cast("int").alias("lexical_rank"),
        )

    def retrieve_per_fund(self, queries: DataFrame, k_per_fund: int = 3, mode: str = "auto", **options) -> DataFrame:
        """Independent top ``k_per_fund`` for every entity of every query.

        Adds ``fund_order``, the entity's place in the query; ``query_id`` stays the caller's.
        """
        named = queries if "query_funds" in queries.columns else detect_entities(queries, self.registry)
        single = named.select(
            *[c for c in named.columns if c != "query_funds"], F.posexplode("query_funds").alias("fund_order", "_fund")
        )
        keyed = single.withColumn("_of", F.col("query_id")).withColumn(
            "query_id", F.format_string("%s#%d", "query_id", "fund_order")
        ).withColumn("query_funds", F.array("_fund"))
        keys = keyed.select("query_id", "_of", "fund_order")
        ranked = self.retrieve(keyed.drop("_of", "fund_order", "_fund"), k_per_fund, mode, **options)
        joined = ranked.join(keys, "query_id")
        return joined.select(F.col("_of").alias("query_id"), "fund_order", *[c for c in ranked.columns if c != "query_id"])
