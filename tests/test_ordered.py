import random

from pyspark.sql import functions as F

from folioscope.operators import ordered
from folioscope.operators.topk import diversified, first_wins, interleave, top_k


def test_two_level_operators_match_plain_order(spark):
    rng = random.Random(3)
    rows = [(k, p, rng.choice([None, f"v{p}"])) for k in "ab" for p in rng.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "k STRING, page INT, v STRING")
    bucket = F.floor(F.col("page") / 7)
    placed = ordered.with_ordinal(df, ["k"], [F.col("page")], bucket)
    prev = ordered.with_neighbour(placed, ["k"], "ordinal", {"page": "prev"}, -1)
    filled = ordered.carry_forward(prev, ["k"], [F.col("page")], bucket, "v", "seen").collect()
    for key in "ab":
        mine = sorted((r for r in filled if r.k == key), key=lambda r: r.page)
        last, before = None, None
        for i, r in enumerate(mine):
            last = r.v if r.v is not None else last
            assert (r.ordinal, r.prev, r.seen) == (i, before, last)
            before = r.page


def brute_diversify(ranked, target, head, quota, languages):
    chosen = []
    pools = [ranked[:head]] + [[x for x in ranked if x[1] == lang][:quota] for lang in languages] + [ranked]
    for pool in pools:
        for x in pool:
            if x not in chosen and len(chosen) < target:
                chosen.append(x)
    return chosen


def test_diversified_matches_brute_force(spark):
    rng = random.Random(9)
    for target, head, quota in ((10, 4, 3), (5, 8, 2), (30, 6, 9)):
        data = {q: [(i, rng.choice(["en", "en", "en", "bg", "mixed"])) for i in range(40)] for q in "xy"}
        rows = [(q, o, lang, i + 1) for q, ranked in data.items() for i, (o, lang) in enumerate(ranked)]
        df = spark.createDataFrame(rows, "query_id STRING, chunk_ord BIGINT, lang STRING, rank INT")
        got = diversified(df, ["query_id"], "rank", "lang", target, head, quota).orderBy("candidate_rank").collect()
        for q, ranked in data.items():
            assert [r.chunk_ord for r in got if r.query_id == q] == [
                x[0] for x in brute_diversify(ranked, target, head, quota, ("en", "bg"))
            ]


def test_top_k_beyond_the_group_limit_keeps_everything(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = top_k(df, ["g"], [F.col("id").desc()], 1500).groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    assert sorted(map(tuple, got.collect())) == [(0, 1500, 2000), (1, 1500, 2001)]


def test_interleave_and_first_wins(spark):
    df = spark.createDataFrame(
        [("q", 1, 0, "a"), ("q", 2, 0, "b"), ("q", 1, 1, "c"), ("q", 2, 1, "a")],
        "query_id STRING, rank INT, fund_order INT, chunk_id STRING",
    )
    mixed = interleave(df, ["query_id"], "rank", "fund_order")
    assert [r.chunk_id for r in mixed.orderBy("position").collect()] == ["a", "c", "b", "a"]
    kept = first_wins(mixed, ["query_id"], [F.col("chunk_id")], [F.col("position")]).orderBy("position").collect()
    assert [r.chunk_id for r in kept] == ["a", "c", "b"]
