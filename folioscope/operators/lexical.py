"""BM25 over a chunk table.

Statistics are corpus-wide; scoring touches only postings of query terms. Matched tokens are
shuffled once by chunk, after which term counting, scoring and the per-query pre-limit run in
one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import tokens_of_folded, tokenize
from folioscope.operators.topk import top_k
from folioscope.session import durable

# Fixed values of the ranking formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_DIGITS = 9


def token_table(chunks: DataFrame, text: str = "lexical_text", folded: bool = False) -> DataFrame:
    """Chunk rows with ``tokens`` and their number; other columns ride along."""
    tokens = tokens_of_folded(text) if folded else tokenize(text)
    return chunks.withColumn("tokens", tokens).withColumn("dl", F.size("tokens")).drop(text)


def corpus_totals(token_rows: DataFrame) -> DataFrame:
    return token_rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_statistics(token_rows: DataFrame) -> DataFrame:
    """``term, df, idf`` with negative idf replaced by a share of the mean idf."""
    # one pass over the tokens; the vocabulary is small next to them and is read twice below
    df = durable(
        token_rows.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    return with_idf(df, corpus_totals(token_rows).select("n_docs").scalar())


def with_idf(df: DataFrame, n) -> DataFrame:
    """``term, df, idf`` from stored document frequencies among ``n`` documents."""
    raw = df.withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw_idf")).scalar()
    return raw.select(
        "term", "df", F.when(F.col("raw_idf") < 0, EPSILON * mean).otherwise(F.col("raw_idf")).alias("idf")
    )


def query_terms(queries: DataFrame, text: str = "search_query") -> DataFrame:
    """``query_id, query_language, route, term, qtf``: one row per pool the query may use.

    ``route`` is an entity, or NULL for the entity-free pool. A chunk has one owner, so it meets
    a query through at most one route.
    """
    return (
        queries.select("query_id", "query_funds", "query_language", F.explode(tokenize(text)).alias("term"))
        .groupBy("query_id", "query_funds", "query_language", "term")
        .agg(F.count("*").alias("qtf"))
        .select("query_id", "query_language", F.explode_outer("query_funds").alias("route"), "term", "qtf")
    )


def compatible(query_language: str = "query_language", language: str = "candidate_language"):
    """Language gate: a mixed query sees everything, others their own language and mixed."""
    return (
        (F.col(query_language) == "mixed") | (F.col(language) == "mixed") | (F.col(language) == F.col(query_language))
    )


def bm25_scores(token_rows: DataFrame, terms: DataFrame, avgdl) -> DataFrame:
    """``query_id, chunk_ord, bm25_score`` for routed, language-compatible, positive chunks.

    ``token_rows`` needs ``chunk_ord, fund, candidate_language, tokens, dl``; ``terms`` comes
    from ``query_terms`` with ``idf`` added. Term and owner are both join keys, so a common
    word only meets the queries that may use that chunk.
    """
    needed = terms.select("term", "route").distinct()
    tokens = token_rows.select("chunk_ord", "fund", "candidate_language", "dl", F.explode("tokens").alias("term"))
    postings = (
        tokens.join(needed, (tokens.term == needed.term) & tokens.fund.eqNullSafe(needed.route), "left_semi")
        .repartition("chunk_ord")
        .groupBy("chunk_ord", "fund", "candidate_language", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    tf = F.col("tf").cast("double")
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    return (
        postings.join(terms, (postings.term == terms.term) & postings.fund.eqNullSafe(terms.route))
        .filter(compatible())
        .groupBy("chunk_ord", "query_id")
        .agg(F.round(F.sum(F.col("qtf") * F.col("idf") * weight), SCORE_DIGITS).alias("bm25_score"))
        .filter(F.col("bm25_score") > 0)
    )


def lexical_rank(token_rows: DataFrame, queries: DataFrame, pool_size: int, statistics: DataFrame | None = None) -> DataFrame:
    """Top ``pool_size`` chunks per query with ``lexical_rank``."""
    statistics = term_statistics(token_rows) if statistics is None else statistics
    avgdl = corpus_totals(token_rows).select("avgdl").scalar()
    terms = durable(query_terms(queries).join(statistics.select("term", "idf"), "term"))
    scores = bm25_scores(token_rows, terms, avgdl)
    return top_k(scores, ["query_id"], [F.col("bm25_score").desc(), F.col("chunk_ord")], pool_size, "lexical_rank")


def shared_token_rank(token_rows: DataFrame, queries: DataFrame, pool_size: int) -> DataFrame:
    """Drop-in for ``lexical_rank`` that scores by the number of distinct shared tokens."""
    terms = query_terms(queries)
    tokens = token_rows.select(
        "chunk_ord", "fund", "candidate_language", F.explode(F.array_distinct("tokens")).alias("term")
    )
    scores = (
        tokens.join(terms, (tokens.term == terms.term) & tokens.fund.eqNullSafe(terms.route))
        .filter(compatible())
        .groupBy("chunk_ord", "query_id")
        .agg(F.count("*").cast("double").alias("bm25_score"))
    )
    return top_k(scores, ["query_id"], [F.col("bm25_score").desc(), F.col("chunk_ord")], pool_size, "lexical_rank")
