"""A stored inverted index for BM25, read term by term and block by block.

A posting row has the chunks of one block that contain a term, for one owner and language, with the greatest
weight among them. The index lies in folders by term hash, so a batch of queries opens only the folders of its terms.
Block bounds alone (no chunk lists) say what a block can give a query at best; the blocks that promise most are scored
first, and of the others only those whose bound reaches the k-th score found so far. Results equal a full pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.lexical import K1, B, SCORE_DIGITS, compatible, query_terms, with_idf
from folioscope.operators.topk import top_k
from folioscope.session import durable

BUCKETS = 64
#: Chunks of one block, by their order.
BLOCK = 1024
#: Tokens of a corpus for which each bucket is dealt in one more part.
PART_TOKENS = 1 << 26
#: Blocks of a query that are scored before any is skipped.
LEAD = 4
#: Scores are rounded; a bound this much below the k-th score is still looked at.
SLACK = 1e-6

POSTINGS = (
    "term STRING, fund STRING, candidate_language STRING, block BIGINT, df BIGINT, most DOUBLE, "
    "chunks ARRAY<STRUCT<chunk_ord: BIGINT, weight: DOUBLE>>, bucket INT"
)
TABLES = ("lexical_postings", "lexical_terms", "lexical_totals", "lexical_owners")


def _bucket():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


#: The terms of a chunk with how often it has each, from its tokens in order.
_COUNTED = (
    "flatten(transform(array(sort_array(tokens)), s -> flatten(transform("
    "array(filter(slice(sequence(1, size(s) + 1), 1, size(s)), i -> i = 1 OR s[i - 1] <> s[i - 2])), "
    "firsts -> transform(firsts, (i, k) -> named_struct('term', s[i - 1], 'tf', coalesce(get(firsts, k + 1), size(s) + 1) - i))))))"
)


def posting_rows(token_rows: DataFrame, avgdl: float, parts: int = 1) -> DataFrame:
    """``bucket, term, fund, candidate_language, block, df, most, chunks`` from token rows (see ``lexical.token_table``).

    A chunk's terms are counted in its row, and postings are moved once, to one of the ``parts`` of their bucket.
    """
    tf = F.col("tf").cast("double")
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    block = F.expr(f"chunk_ord div {BLOCK}").alias("block")
    counted = token_rows.selectExpr("chunk_ord", "fund", "candidate_language", "dl", f"inline({_COUNTED})")
    each = counted.select(_bucket().alias("bucket"), "term", "fund", "candidate_language", block, "chunk_ord", weight.alias("weight"))
    # blocks share out a term that most chunks have
    part = F.pmod(F.hash("term", "block"), F.lit(parts)).cast("int").alias("part")
    dealt = each.select(part, "*").repartition(BUCKETS * parts, "bucket", "part")
    return dealt.groupBy("bucket", "part", "term", "fund", "candidate_language", "block").agg(
        F.count("*").alias("df"), F.max("weight").alias("most"), F.collect_list(F.struct("chunk_ord", "weight")).alias("chunks")
    ).drop("part")


@dataclass
class LexicalIndex:
    """``postings``; ``terms`` (term, df, idf); ``owners`` (chunk_ord, fund, candidate_language)."""

    postings: DataFrame
    terms: DataFrame
    owners: DataFrame


def save_lexical_index(token_rows: DataFrame, root: str) -> None:
    """Write the index of ``token_rows`` below ``root``. Statistics come from sums over blocks, so parts of a corpus add up."""
    root = root.rstrip("/")
    totals = token_rows.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"))
    totals.write.mode("overwrite").parquet(f"{root}/lexical_totals")
    row = token_rows.sparkSession.read.parquet(f"{root}/lexical_totals").first()
    avgdl = (row["n_tokens"] or 0) / max(1, row["n_docs"])
    token_rows.select("chunk_ord", "fund", "candidate_language").write.mode("overwrite").parquet(f"{root}/lexical_owners")
    dealt = posting_rows(token_rows, avgdl, 1 + (row["n_tokens"] or 0) // PART_TOKENS).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/lexical_postings")
    postings = token_rows.sparkSession.read.schema(POSTINGS).parquet(f"{root}/lexical_postings")
    df = postings.groupBy("term").agg(F.sum("df").alias("df"))
    with_idf(durable(df), row["n_docs"]).write.mode("overwrite").parquet(f"{root}/lexical_terms")


def load_lexical_index(spark: SparkSession, root: str) -> LexicalIndex:
    postings, terms, _, owners = (f"{root.rstrip('/')}/{name}" for name in TABLES)
    return LexicalIndex(spark.read.schema(POSTINGS).parquet(postings), spark.read.parquet(terms), spark.read.parquet(owners))


def query_bounds(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """``query_id, block, bound``: no chunk of the block can score more for the query. Reads no chunk lists."""
    gain = F.greatest(F.col("qtf") * F.col("idf"), F.lit(0.0)) * F.col("most")
    met = _met(index, terms, "block", "most")
    by_kind = met.groupBy("query_id", "block", "candidate_language", "route").agg(F.sum(gain).alias("bound"))
    return by_kind.groupBy("query_id", "block").agg(F.max("bound").alias("bound"))  # a chunk has one owner and one language


def _met(index: LexicalIndex, terms: DataFrame, *columns: str) -> DataFrame:
    """Postings of the queries' terms, routes and languages; only the folders of these terms are opened."""
    folders = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
    postings = index.postings.where(F.col("bucket").isin(folders)).select(
        F.col("bucket").alias("_bucket"), F.col("term").alias("_term"), "fund", "candidate_language", *columns
    )
    same = (F.col("_bucket") == F.col("bucket")) & (F.col("_term") == F.col("term")) & F.col("fund").eqNullSafe(F.col("route"))
    return terms.join(postings, same).where(compatible())


def _scores(index: LexicalIndex, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    met = _met(index, terms, "block", "chunks").join(blocks.select("query_id", "block"), ["query_id", "block"])
    rows = met.select("query_id", (F.col("qtf") * F.col("idf")).alias("gain"), F.inline("chunks"))
    total = F.round(F.sum(F.col("gain") * F.col("weight")), SCORE_DIGITS)
    return rows.groupBy("query_id", "chunk_ord").agg(total.alias("bm25_score")).where("bm25_score > 0")


def kept_blocks(index: LexicalIndex, terms: DataFrame, pool_size: int) -> DataFrame:
    """``query_id, block, bound`` of the blocks that can hold one of the ``pool_size`` best chunks of the query."""
    bounds = durable(query_bounds(index, terms))
    first = top_k(bounds, ["query_id"], [F.col("bound").desc(), F.col("block")], LEAD)
    scored = top_k(_scores(index, terms, first), ["query_id"], [F.col("bm25_score").desc(), F.col("chunk_ord")], pool_size)
    least = scored.where(F.col("rank") == pool_size).select("query_id", F.col("bm25_score").alias("least"))
    return bounds.join(least, "query_id", "left").where(F.col("bound") >= F.coalesce(F.col("least") - SLACK, F.lit(0.0))).drop("least")


def stored_rank(index: LexicalIndex, queries: DataFrame, pool_size: int) -> DataFrame:
    """Top ``pool_size`` chunks per query with ``lexical_rank``, as ``lexical.lexical_rank`` gives them, from the stored index."""
    terms = durable(query_terms(queries).join(index.terms.select("term", "idf"), "term").withColumn("bucket", _bucket()))
    scores = _scores(index, terms, durable(kept_blocks(index, terms, pool_size)))
    return top_k(scores, ["query_id"], [F.col("bm25_score").desc(), F.col("chunk_ord")], pool_size, "lexical_rank")
