"""The pipeline, the ring and the row choice of the Jaccard join against plain Python."""

import functools
import itertools
import math
import re
import struct
import tempfile
import warnings
import zlib
from collections import Counter, defaultdict, deque

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import incidence, raking, ring, rules
from folioscope.llm.queries import MIX, MIX_KEEP, SHARDS

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def hashed(*parts):
    """Spark's xxhash64 of an int, long or string column after the other, unsigned."""
    seed = 42
    for p in parts:
        if p is not None:
            data = p.encode() if isinstance(p, str) else struct.pack("<i" if p[0] == "i" else "<q", p[1])
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed


# Stage 1
def statistics(text):
    data = (text or "").encode()
    size, words = len(data), [w.encode() for w in words_of(text)]
    lines = [x for x in re.split(rb"[\n\r]+", data.lower()) if x]
    count = {name: sum(b in own for b in data) for name, own in rules._CLASSES.items()}
    count["beyond_ascii"] = sum(b > 127 for b in data)
    classed = sum(count.values())
    out = {name: n / max(classed, 1) for name, n in count.items()}
    out["beyond_ascii"] = count["beyond_ascii"] / max(size, 1)
    out["log_bytes"], out["log_words"] = math.log1p(size), math.log1p(len(words))
    out["word_bytes"] = size / (len(words) + 1)
    out["distinct_words"] = len(set(words)) / max(len(words), 1)
    out["top_word"] = max(Counter(words).values(), default=0) / max(len(words), 1)
    out["repeated_next"] = sum(a == b for a, b in itertools.pairwise(words)) / max(len(words), 1)
    out["distinct_lines"] = len(set(lines)) / max(len(lines), 1)
    out["line_words"] = math.log1p(len(words) / max(len(lines), 1))
    out["longest_word"] = math.log1p(max(map(len, words), default=0))
    return out


def good(text, model):
    found, odds = statistics(text), model.intercept
    for rule, weight in model.rules:
        if all(found[name] > value if greater else found[name] <= value for name, greater, value in rule):
            odds += weight
    return 1 / (1 + math.exp(-odds)) >= 0.3


# Stage 2
def shingles(text):
    words = words_of(text)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    sets, label = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    best = {}
    for k, r in enumerate(rows):
        rank = (r["doc_id"] is None, r["doc_id"] or 0)
        if sets[k] and (label[k] not in best or rank < best[label[k]][0]):
            best[label[k]] = (rank, k)
    stay = {k for _, k in best.values()}
    return [r for k, r in enumerate(rows) if not sets[k] or k in stay]


# Stage 3
def clean(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = set()
    for text in items:
        words = words_of(text, pattern)
        grams |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()
    lengths = {len(g) for g in grams}

    def hit(text):
        words = words_of(text, pattern)
        return any(tuple(words[k : k + n]) in grams for n in lengths for k in range(len(words) - n + 1))

    return [r for r in rows if not hit(r["text"])]


# Stage 4
def topic(text):
    text = text or ""
    if re.search(r"(?i)\blicen[cs]e\b", text):
        return "licence"
    for name, pattern, times in (("table", r" \| ", 40), ("noise", r"[#$%&*]{3}", 40), ("capitals", r"\p{Lu}", 3)):
        if len(regex.findall(pattern, text)) * times > len(text):
            return name
    return "short prose" if len(text) < 400 else "prose"


def mixed(rows, powers, keep):
    cell = [(r["source"], r["lang"], topic(r["text"])) for r in rows]
    tokens = Counter()
    for c, r in zip(cell, rows, strict=True):
        tokens[c] += len(words_of(r["text"]))
    weight = {c: n / tokens.total() for c, n in tokens.items() if n}
    for _ in range(2000):
        for d, power in enumerate(powers.values()):
            sums, now = Counter(), Counter()
            for c, w in weight.items():
                sums[c[d]] += tokens[c]
                now[c[d]] += w
            share = {v: n**power for v, n in sums.items()}
            weight = {c: w * share[c[d]] / sum(share.values()) / now[c[d]] for c, w in weight.items()}
    rate = {c: w / tokens[c] for c, w in weight.items()}
    low, high = 0.0, 1e12
    for _ in range(200):  # the scale at which cells, none more than whole, give the wanted tokens
        scale = (low + high) / 2
        given = sum(min(1, scale * rate[c]) * tokens[c] for c in rate)
        low, high = (scale, high) if given < keep * tokens.total() else (low, scale)
    out = []
    for c, r in zip(cell, rows, strict=True):
        u = hashed(("i", 3), None if r["doc_id"] is None else str(r["doc_id"]), ("q", zlib.crc32((r["text"] or "").encode()))) >> 11
        if u / (1 << 53) < min(1, high * rate.get(c, 0)):
            out.append(r)
    return out


# Stage 5
def dealt(rows, shards, virtual_nodes=ring.VIRTUAL_NODES):
    """(doc_id, crc32) -> shards, row by row: every shard keeps of its arcs what its bound allows, the rest walks on."""
    places, owner = ring.ring(shards, virtual_nodes)
    arcs = defaultdict(list)
    for r in rows:
        place = hashed("\0" if r["doc_id"] is None else str(r["doc_id"])) >> 2
        data = (r["text"] or "").encode()
        arc = next((k for k, p in enumerate(places) if p >= place), 0)
        arcs[arc].append((place, r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(data), len(data) + 8))
    most = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    own = Counter()
    for arc, held in arcs.items():
        own[owner[arc]] += len(held)
    room, where, kept = list(most), defaultdict(Counter), {}
    for arc, held in sorted(arcs.items()):
        s = owner[arc]
        kept[arc] = len(held) if own[s] <= most[s] else len(held) * most[s] // own[s]
        room[s] -= kept[arc]
    for arc, held in sorted(arcs.items()):
        more = min(room[owner[arc]], len(held) - kept[arc])
        kept[arc] += more
        room[owner[arc]] -= more
    walking = deque()
    for lap in range(2):
        for arc in range(len(owner)):
            s, held = owner[arc], sorted(arcs.get(arc, ()))
            while walking and room[s]:
                where[walking.popleft()[2:4]][int(s)] += 1
                room[s] -= 1
            if lap == 0:
                for k, row in enumerate(held):
                    if k < kept[arc]:
                        where[row[2:4]][int(s)] += 1
                    else:
                        walking.append(row)
    assert not walking
    return where


@pytest.fixture(scope="module")
def tables(spark):
    """The small tables with planted copies, repeats, missing ids and texts, benchmark passages and clashing columns."""
    folder = tempfile.mkdtemp(prefix="run-")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    passage = benchmark.orderBy(F.length("text").desc()).first()["text"]
    long = sorted((r for r in rows if r["text"]), key=lambda r: -len(r["text"].split()))[:6]
    planted = [
        {**long[0]}, {**long[0], "doc_id": None}, {**long[1], "doc_id": 900_001, "text": long[1]["text"].upper()},
        {**long[2], "doc_id": 900_002, "text": long[2]["text"] + " one more word"}, {**long[3], "doc_id": long[4]["doc_id"]},
        {**long[5], "doc_id": 900_003, "text": long[5]["text"] + " " + passage}, {**long[5], "doc_id": 900_004, "text": None}, {**long[5], "doc_id": None, "text": ""},
    ]
    rows = [{**r, "score": 7.5, "probability": k, "_u": "x"} for k, r in enumerate(rows + planted)]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    given = spark.createDataFrame([tuple(r.values()) for r in rows], f"{kinds}, score double, probability int, _u string")
    given.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder, rows, [r["text"] for r in benchmark.collect()]


def ids(rows):
    """Rows by id and text; which of those that repeat both stays doesn't matter."""
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_every_stage_and_the_whole(spark, tables, monkeypatch):
    folder, rows, items = tables
    models = []

    @functools.wraps(rules.fit)
    def fit(*args, plain=rules.fit, **options):
        models.append(plain(*args, **options))
        return models[-1]

    monkeypatch.setattr(rules, "fit", fit)
    given = spark.read.parquet(f"{folder}/documents.parquet")
    docs, counts = given, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = corpus_pipeline.durable(stage(spark, docs, folder))
        got = [r.asDict() for r in after.collect()]
        rows = [lambda r: [x for x in r if good(x["text"], models[0])], one_of_each, lambda r: clean(r, items), lambda r: mixed(r, MIX, MIX_KEEP)][k](rows)
        assert after.columns == given.columns and ids(got) == ids(rows), name
        by_row = {r["probability"]: r for r in rows}
        assert all(r["score"] == 7.5 and r["_u"] == "x" for r in got), name
        if k == 0:
            assert all(by_row[r["probability"]] == r for r in got)
        rows = got
        docs = after
        counts.append(len(got))
    assert sorted(counts, reverse=True) == counts and counts[-1] > 0 and len(set(counts[:3])) == 3
    final = [(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, folder).collect()]
    where = dealt(rows, SHARDS)
    assert {(i or 0, c, s): n for i, c, s, _ in final for n in [1]}.keys() == {(i, c, s) for (i, c), x in where.items() for s in x}
    assert len(final) == len(rows)
    for shard in {f[2] for f in final}:
        slots = sorted(f[3] for f in final if f[2] == shard)
        assert slots == list(range(len(slots)))


def test_empty_tables(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.count() == 0


@pytest.mark.parametrize("shards,virtual_nodes", [(3, 4), (5, 16)])
def test_ring_row_by_row(spark, shards, virtual_nodes):
    """A hot id, null ids and repeated rows among others."""
    rows = [{"doc_id": k if k % 3 else 7, "text": f"t{k % 5}"} for k in range(90)] + [{"doc_id": None, "text": None}] * 12
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, text string")
    got = defaultdict(Counter)
    for r in ring.assign(docs, shards, virtual_nodes=virtual_nodes).collect():
        got[r["doc_id"] or 0, r["text_crc32"]][r["shard"]] += 1
    assert got == dealt(rows, shards, virtual_nodes)


def test_rows_of_one_id_have_their_own_fate(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    rows = [(5, a, 1), (5, a, 2), (3, a.upper(), 3), (5, b, 4), (None, b, 5), (None, a, 6), (None, "alone here", 7), (None, "alone here", 8), (9, None, 9), (9, "", 10), (9, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    kept = sorted(r["key"] for r in incidence.one_of_each(docs).collect())
    assert kept in ([3, 4, 7, 9, 9, 10], [3, 4, 8, 9, 9, 10])
    hot = spark.range(3000).selectExpr("1L doc_id", f"'{a}' text", "cast(id % 3 as int) key")
    assert incidence.one_of_each(hot).count() == 1


def test_only_rows_that_may_go_are_shuffled_with_their_texts(spark, tmp_path, monkeypatch):
    """Rows that no join has to decide on stay in the task that reads them, also where the joins are too large to broadcast."""
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(30)), "x") for k in range(400)]
    rows += [(1000 + k, rows[k][1], "copy") for k in range(5)] + [(7, rows[7][1], "again"), (8, None, "null"), (None, rows[9][1], "no id"), (None, "", "empty")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = incidence.one_of_each(docs)
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in kept.collect())
        nodes, shuffled = [kept._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
            nodes += [node.children().apply(k) for k in range(node.children().size())]
            names = [c.name() for c in (node.output().apply(k) for k in range(node.output().size()))]
            if node.nodeName() == "Exchange" and "text" in names:
                shuffled.append(node.metrics().apply("shuffleRecordsWritten").value())
        assert got == sorted([(r[0], r[1]) for r in rows[:400]] + [(8, ""), (-1, "")])
        assert shuffled and sum(shuffled) <= 20
        with monkeypatch.context() as m:  # a sieve that catches everything leaves it all to the joins
            m.setattr(incidence, "SIEVE", 64)
            again = incidence.one_of_each(docs)
            assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in again.collect()) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_targets_that_contradict_are_told(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "source string, lang string, tokens long")
    with pytest.warns(UserWarning, match="marginal"):
        raking.rake(cells, {"source": {"a": 1.0, "b": 3.0}, "lang": {"x": 1.0, "y": 1.0}}, rounds=5)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        raking.rake(cells, {"source": {"a": 1.0, "b": 3.0}, "lang": {"x": 1.0, "y": 3.0}})
