import random

from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import classification, dense, names

REG = "canonical_name STRING, aliases ARRAY<STRING>, evidence_count BIGINT"


def test_longest_spelling_wins_and_rejected_matches_do_not_block(spark):
    reg = spark.createDataFrame([("K&H egészség", [], 0), ("K&H egészség 2", [], 0)], REG)
    q = spark.createDataFrame([("1", "Aim of K&H egészség 2?"), ("2", "k&h EGÉSZSÉG and K&H egészség 2")], "query_id STRING, query STRING")
    got = {r.query_id: r for r in names.strip_entities(names.detect_entities(q, reg), reg).collect()}
    assert got["1"].query_funds == ["K&H egészség 2"] and got["1"].search_query == "Aim of ?"
    assert got["2"].query_funds == ["K&H egészség", "K&H egészség 2"]
    spans = spark.createDataFrame([([(0, 10, "", "a"), (8, 14, "", "b"), (13, 16, "", "c")],)], "m ARRAY<STRUCT<start: INT, stop: INT, place: STRING, fund: STRING>>")
    kept = spans.select(names.greedy_longest(F.col("m"))).first()[0]
    assert [(k.start, k.stop) for k in kept] == [(0, 10), (13, 16)]


def test_substring_join_matches_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cd") for _ in range(60)) for _ in range(40)]
    texts = [" ".join(t.split()) for t in texts]
    needles = ["a", "ab", "b c", "a b", "dd a", "cab", "bc da", "a d c", "zz"]
    left = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    right = spark.createDataFrame([(n,) for n in needles], "n STRING")
    got = {(r.i, r.n) for r in names.find_substrings(left, ["i"], "t", right, "n").collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in needles if n in t}


def test_names_with_one_suffix_cost_their_hits_only(spark):
    """300 names share a phrase; a text that holds the phrase meets only the names that are in it."""
    needles = spark.createDataFrame([(f"name{k} global equity index fund",) for k in range(300)], "n STRING")
    texts = ["the name7 global equity index fund and name70 global equity index fund", "no global equity index fund", None, ""]
    left = spark.createDataFrame(list(enumerate(texts * 50)), "i INT, t STRING")
    hits = names.occurrences(left, ["i"], "t", needles, "n")
    assert hits.count() == 100
    assert {r.n for r in hits.collect()} == {"name7 global equity index fund", "name70 global equity index fund"}
    starts = sorted((r.i, r.start) for r in names.occurrences(left.where("i = 0"), ["i"], "t", needles, "n", places=True).collect())
    assert starts == [(0, 5), (0, 40)]


def test_needles_in_slices(spark, monkeypatch):
    """Several passes find what one does; each text is read once for each slice and hits are stored between."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    needles = spark.createDataFrame([(w,) for w in [*words, "", *words[:5]]], "n STRING")
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    left = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    expected = {(i, w) for i, t in enumerate(texts) for w in words if w in t}
    monkeypatch.setattr(names, "SLICE_CHARS", 60)
    assert names.sliced(needles, "n")[1] > 4
    got = names.find_substrings(left, ["i"], "t", needles, "n", lambda c: F.upper(F.lower(F.col(c))))
    assert {tuple(r) for r in got.collect()} == {(i, w) for i, t in enumerate(texts) for w in words if w in t.upper()}
    got = names.find_substrings(left, ["i"], "t", needles, "n", lambda c: F.lower(F.col(c)))
    assert {tuple(r) for r in got.collect()} == expected
    assert names.find_substrings(left, ["i"], "t", needles.limit(0), "n").count() == 0


def test_equal_places_go_by_folded_name(spark):
    reg = spark.createDataFrame([("Zeta Fund", ["Common Name"], 0), ("alpha fund", ["common name"], 0), ("Beta Fund", ["COMMON NAME"], 0)], REG)
    q = spark.createDataFrame([("1", "On the common name now")], "query_id STRING, query STRING")
    assert names.detect_entities(q, reg).first().query_funds == ["alpha fund"]


def test_mentions_cross_short_pages(spark):
    reg = spark.createDataFrame([("Alpha Beta Gamma Delta", [], 0), ("Omega Fund", [], 0)], REG)
    parts = [("a", 1, "see Alpha,"), ("a", 2, "x"), ("b", 1, "the Alpha"), ("b", 2, "Beta"), ("b", 3, ""), ("b", 4, "Gamma"), ("b", 5, "Delta."), ("c", 1, "Omega\nfund")]
    pages = spark.createDataFrame([(d, p, t, [], [], [], [], t) for d, p, t in parts], schemas.PAGES)
    got = {tuple(r) for r in classification.document_mentions(pages, reg).collect()}
    assert got == {("b", "Alpha Beta Gamma Delta"), ("c", "Omega Fund")}


def test_dense_ranking_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8)).astype("float32")
    funds = [None if i % 3 == 0 else f"f{i % 3}" for i in range(60)]
    langs = ["bg" if i % 10 == 0 else "en" for i in range(60)]
    vectors = spark.createDataFrame(
        [(i, funds[i], langs[i], v[i].tolist()) for i in range(60)],
        "chunk_ord BIGINT, fund STRING, candidate_language STRING, embedding ARRAY<FLOAT>",
    )
    q = rng.normal(size=(2, 8)).astype("float32")
    queries = spark.createDataFrame([("n", [], q[0].tolist()), ("f", ["f1", "f2"], q[1].tolist())], "query_id STRING, query_funds ARRAY<STRING>, query_vector ARRAY<FLOAT>")
    got = dense.candidate_rank(vectors, queries, 8, 4, 2).collect()
    for name, row, pool in (("n", 0, [i for i in range(60) if funds[i] is None]), ("f", 1, [i for i in range(60) if funds[i]])):
        scores = v.astype("float64") @ q[row].astype("float64")
        order = sorted(pool, key=lambda i: (-round(scores[i], 9), i))
        want = []
        for part in (order[:4], [i for i in order if langs[i] == "en"][:2], [i for i in order if langs[i] == "bg"][:2], order):
            want += [i for i in part if i not in want]
        mine = sorted((r for r in got if r.query_id == name), key=lambda r: r.candidate_rank)
        assert [r.chunk_ord for r in mine] == want[:8]
        assert [r.candidate_dense_rank for r in mine] == [order.index(i) + 1 for i in want[:8]]


def test_many_names_take_one_pass(spark):
    """Names of some 2.4 million characters, most with one long beginning: one sieve of bounded size, true hits only."""
    needles = spark.range(60_000).selectExpr("concat(if(id % 5 = 0, '', 'the société générale of funds number '), id, ' é', id * 7919, ' fund') n")
    assert names.sliced(needles, "n")[1] == 1
    sieve = names.sieve_of(needles.withColumnRenamed("n", "needle"))
    assert sieve.table.nbytes == 1 << 18
    wanted = [r.n for r in needles.where("id % 997 = 0").collect()]
    texts = [f"žž {w} and {w[3:]}" for w in wanted] + ["the société générale of funds number "] * 200
    left = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    every = [r.n for r in needles.collect()]
    got = {tuple(r) for r in names.occurrences(left, ["i"], "t", needles, "n").collect()}
    few = {w for w, _ in zip(every, range(12_000), strict=False)}
    assert {g for g in got if g[1] in few} == {(i, w) for i, t in enumerate(texts[: len(wanted)]) for w in few if w in t}
    assert {(i, w) for i, w in enumerate(wanted)} <= got and all(w in texts[i] for i, w in got)


def test_sieve_over_blocks_and_bytes(monkeypatch):
    """Names of 1 to 300 bytes around the ends of blocks and rows, among letters of one to four bytes."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    monkeypatch.setattr(names, "BLOCK", 37)
    texts = ["".join(rng.choice("ab éж😀") for _ in range(rng.randint(0, 200))) for _ in range(40)] + [None, ""]
    words = {t[a : a + n] for t in texts if t for a, n in ((rng.randrange(len(t)), rng.choice([1, 2, 3, 7, 8, 9, 31, 60, 150])) for _ in range(5))}
    table, lengths = np.full(1 << 10, np.uint64(2**64 - 1)), sorted({len(w.encode()) for w in words})
    data, at = names._utf8(pa.array(texts))
    got = set()
    for rows, starts, sizes in names.Sieve(table, lengths).found(data, at):
        got |= {(int(r), int(s - at[r]), c) for r, s, c in zip(rows, starts, names._cut_out(data, starts, sizes).to_pylist(), strict=True)}
    got = {g for g in got if g[2] in words}
    expected = {(i, len(t[:a].encode()), w) for i, t in enumerate(texts) if t for w in words for a in range(len(t)) if t.startswith(w, a)}
    assert got == expected
