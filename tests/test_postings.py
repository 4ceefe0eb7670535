"""The stored inverted index against a full pass over all tokens."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import lexical, postings

TOKENS = "chunk_ord BIGINT, fund STRING, candidate_language STRING, tokens ARRAY<STRING>, dl INT"
QUERIES = "query_id STRING, search_query STRING, query_language STRING, query_funds ARRAY<STRING>"


@pytest.fixture(scope="module")
def corpus(spark):
    """900 chunks in which rare words stand in few places, two owners and three languages; some chunks are empty or equal."""
    rng = random.Random(7)
    rows = []
    for k in range(900):
        words = [rng.choice(["the", "of", f"w{rng.randint(0, 40)}", f"r{k // 60}"]) for _ in range(0 if k % 97 == 0 else rng.randint(3, 60))]
        rows.append((k, [None, "A", "B"][k % 3], ["en", "bg", "mixed"][k % 7 % 3], words if k % 11 else ["the", "w1", "w1"], 0))
    queries = [
        ("1", "the r3 w5", "en", []), ("2", "r14 r14 w1 of", "mixed", ["A", "B"]), ("3", "w1", "bg", ["B"]), ("4", "unknown words", "en", []),
        ("5", "", "en", ["A"]), ("6", "the of", "mixed", []),
    ]
    return spark.createDataFrame(rows, TOKENS).withColumn("dl", F.size("tokens")), spark.createDataFrame(queries, QUERIES)


@pytest.mark.parametrize("block,k", [(1024, 5), (16, 5), (16, 400)])
def test_equals_a_full_pass(spark, corpus, tmp_path, monkeypatch, block, k):
    monkeypatch.setattr(postings, "BLOCK", block)
    tokens, queries = corpus
    postings.save_lexical_index(tokens, str(tmp_path))
    index = postings.load_lexical_index(spark, str(tmp_path))
    rows = lambda df: sorted((r.query_id, r.lexical_rank, r.chunk_ord, round(r.bm25_score, 7)) for r in df.collect())
    expected = rows(lexical.lexical_rank(tokens, queries, k))
    assert rows(postings.stored_rank(index, queries, k)) == expected and len(expected) > 10
    assert rows(index.terms.selectExpr("term AS query_id", "df AS lexical_rank", "0 AS chunk_ord", "idf AS bm25_score")) == rows(
        lexical.term_statistics(tokens).selectExpr("term AS query_id", "df AS lexical_rank", "0 AS chunk_ord", "idf AS bm25_score")
    )


def test_blocks_are_skipped_and_folders_pruned(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    tokens, queries = corpus
    postings.save_lexical_index(tokens, str(tmp_path))
    index = postings.load_lexical_index(spark, str(tmp_path))
    one = queries.where("query_id = '1'")
    terms = lexical.query_terms(one).join(index.terms.select("term", "idf"), "term").withColumn("bucket", postings._bucket())
    every, kept = postings.query_bounds(index, terms), postings.kept_blocks(index, terms, 3)
    assert 0 < kept.count() < every.count() / 2
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "chunks" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_empty_index(spark, corpus, tmp_path):
    tokens, queries = corpus
    postings.save_lexical_index(tokens.limit(0), str(tmp_path))
    assert postings.stored_rank(postings.load_lexical_index(spark, str(tmp_path)), queries, 3).count() == 0


def test_postings_move_once_and_count_every_term(spark, corpus, capsys):
    """Terms are counted in the row of their chunk, so there is one shuffle; parts only deal them differently."""
    from collections import Counter

    tokens, _ = corpus
    rows = tokens.collect()
    expected = {(r.chunk_ord, w): n for r in rows for w, n in Counter(r.tokens).items()}
    dl = {r.chunk_ord: r.dl for r in rows}
    for parts in (1, 3):
        got = postings.posting_rows(tokens, 20.0, parts)
        got.explain()
        assert capsys.readouterr().out.count("Exchange ") == 1
        each = [(c.chunk_ord, p.term, c.weight, p.most, p.df, len(p.chunks)) for p in got.collect() for c in p.chunks]
        assert len(each) == len(expected) and {e[:2] for e in each} == set(expected)
        for k, term, weight, most, df, n in each:
            tf = expected[k, term]
            assert weight == pytest.approx(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl[k] / 20.0))) and weight <= most and df == n
