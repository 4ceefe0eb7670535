"""Each operator against brute force on small rows, with nulls, empty texts, ties, repeats, empty tables and extra columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, html_paths, incidence, ppm, raking, ring, rules, transcripts, vector_passes, wordbytes
from folioscope.llm.components import components
from folioscope.llm.wordbytes import BLANKS, NON_ALPHANUMERIC, Words, byte_view

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, mark long, n_words long, score double"


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def corpus():
    base = [f"w{k}é" for k in range(60)]
    near = base[:30] + ["Other"] + base[31:]
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", " \t\n", "One two", "one  TWO", "x" * 30_000, " ".join(base[::-1])]
    texts += [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(3, 60, 7)]
    return [(k, t, "en", "s", 0, 1, 2, 3, 0.5) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def joined(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("table,pattern", [(BLANKS, r"[^\x20\x09-\x0D]+"), (NON_ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(table, pattern):
    texts = ["Hello  World é1", None, "", "a-b\x00c ", "日本 語", "HELLO world"]
    data, offsets = byte_view(pa.array(texts))
    words = Words(data, offsets, table)
    found = [lower(bytes(data[a:b]).decode()) for a, b in zip(words.start, words.end, strict=True)]
    expected = [re.findall(pattern, lower(t or "")) for t in texts]
    assert found == [w for ws in expected for w in ws]
    assert words.counts().tolist() == [len(w) for w in expected]
    assert len(set(words.hash.tolist())) == len(set(found))


def test_words_inside_long_texts(monkeypatch):
    """Words and statistics are the same however the bytes are cut into portions."""
    texts = ["", "one two  one\nÉ!x", "y" * 50, None, " ", "a|b 12 " * 9, ""]
    data, offsets = wordbytes.byte_view(pa.array(texts))
    whole, stats = wordbytes.Words(data, offsets, wordbytes.BLANKS), rules._statistics(data, offsets)
    for size in (1, 3, 16):
        monkeypatch.setattr(wordbytes, "PORTION", size)
        monkeypatch.setattr(rules, "PORTION", size)
        cut, again = wordbytes.Words(data, offsets, wordbytes.BLANKS), rules._statistics(data, offsets)
        assert all((getattr(whole, k) == getattr(cut, k)).all() for k in ("start", "end", "hash", "first"))
        assert all((stats[k] == again[k]).all() for k in stats)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_sets(rows):
    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = joined(near, sets)
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_incidence(docs, none):
    rows = [(r[0], r[1]) for r in corpus()]
    assert {r[0]: (r[1], r[2]) for r in incidence.similar_sets(docs).collect()} == brute_sets(rows)
    assert incidence.similar_sets(none).count() == 0
    kept = incidence.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_sets(rows).items() if i == c}


def test_incidence_large_groups(spark, monkeypatch):
    """Groups beyond every bound: common columns, several tiles, size classes."""
    monkeypatch.setattr(incidence, "COMMON", 3)
    monkeypatch.setattr(incidence, "TILE_ROWS", 4)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        words = [f"b{j}" for j in range(80)][: 80 - 20 * (k % 2)]
        for place in rng.integers(0, len(words), rng.integers(0, 4)):
            words[place] = f"v{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join([f"p{j}" for j in range(12)] + [f"u{k}_{j}" for j in range(40)])) for k in range(20)]  # one shared passage
    got = incidence.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute_sets(rows)


def test_crowded_columns_are_counted_before_anything_moves(spark, monkeypatch):
    monkeypatch.setattr(incidence, "RUN", 200)
    entries = spark.range(0, 3000, numPartitions=3).selectExpr("if(id % 3 = 0, 7L, if(id % 100 = 1, 8L, 1000 + id)) h", "id mark", "1 n")
    assert [tuple(r) for r in incidence._crowded(entries).collect()] == [(7, 1000)]  # 8 has 20 entries
    singles = entries.where("h > 8")
    assert incidence._crowded(singles).count() == 0
    moved = singles.mapInArrow(lambda batches: batches, "h long, mark long, n int")  # what a task counts once stays in it
    assert incidence._crowded(moved.union(entries.where("h = 7"))).collect()[0]["rows"] == 1000


def test_incidence_null_ids_and_repeats(spark):
    text = " ".join(f"k{j}" for j in range(20))
    got = incidence.similar_sets(spark.createDataFrame([(None, text), (4, text), (4, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r[0] is None, r[0] or 0, r[2]) for r in got if r[0]) == [(False, 2, 2), (False, 4, 2), (False, 4, 2)]
    assert [r[2] for r in got if r[0] is None] == [None]


def test_decontaminate(spark, docs, none):
    items = [(1, "W5é w6é w7é w8é w9é w10é w11é w12é w13é w14é w15é"), (2, "one TWO"), (30, None), (4, "!"), (5, "one-two"), (None, "other")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    grams = defaultdict(set)
    for i, text in items:
        words = word(text)
        for k in range(max(1, len(words) - 9) if words else 0):
            grams[tuple(words[k : k + 10])].add(i)
    expected = {}
    for i, text in ((r[0], r[1]) for r in corpus()):
        words, hit, ids = word(text), set(), set()
        for a in range(len(words)):
            for b in range(a + 1, min(a + 10, len(words)) + 1):
                if tuple(words[a:b]) in grams:
                    hit.update(range(a, b))
                    ids |= grams[tuple(words[a:b])]
        ids = sorted(str(x) for x in ids if x is not None)
        expected[i] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    for told in (1000, 1):
        got = decontaminate.contamination(docs, benchmark, windows_told=told)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and {r[0] for r in clean.collect()} == {i for i, e in expected.items() if not e[4]}
    cut = decontaminate.cut_spans(docs, benchmark)
    assert cut.count() == docs.count() and not decontaminate.contamination(cut, benchmark).where("contaminated").count()
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert not decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count()


def test_ppm(spark, docs, none):
    rows = [(r[0], r[1]) for r in corpus()]
    model = ppm.train(docs.where("doc_id % 3 <> 0"))
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None]
    padded = lambda t: bytes([ppm.START] * ppm.ORDER) + (t or "").encode() + bytes([ppm.END])
    counts, contexts = Counter(), [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for i, text in rows:
        if i % 3:
            counts.update(tokens(text))
            b = padded(text)
            for p, j in itertools.product(range(ppm.ORDER, len(b)), range(ppm.ORDER + 1)):
                contexts[j][b[p - j : p]][b[p]] += 1
    total = sum(counts.values())
    for leaves, words in ((ppm.LEAVES_TOLD, ppm.WORDS_TOLD), (200, 3)):
        for r in ppm.score(docs.drop("score"), model, leaves_told=leaves, words_told=words).collect():
            text = dict(rows)[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(text)), sum(t in counts for t in tokens(text)), total)
            assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in tokens(text)), rel_tol=1e-9)
            b, log = padded(text), 0.0
            for p in range(ppm.ORDER, len(b)):
                left = set()
                for j in range(ppm.ORDER, -1, -1):
                    free = {s: c for s, c in contexts[j].get(b[p - j : p], {}).items() if s not in left}
                    if free and b[p] in free:
                        log += math.log10((2 * free[b[p]] - 1) / (2 * sum(free.values())))
                        break
                    if free:
                        log += math.log10(len(free) / (2 * sum(free.values())))
                        left |= set(free)
                else:
                    log -= math.log10(ppm.SYMBOLS - len(left))
            assert math.isclose(r["score"], log, rel_tol=1e-9)
    assert ppm.score(none, model).count() == 0
    assert ppm.score(docs, ppm.train(none)).where("score is null").count() == 0
    adaptive = {r["doc_id"]: r["adaptive_score"] for r in ppm.adaptive_scores(docs).collect()}
    assert adaptive[0] == adaptive[2] and adaptive[3] == adaptive[4] < 0 and adaptive[8] / 30_000 > -0.01


def test_vector_passes(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 16))
    vectors = [(centre[k % 6] + 0.08 * rng.standard_normal(16)).tolist() for k in range(300)] + [rng.standard_normal(16).tolist() for _ in range(50)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(900, vectors[0]), (901, vectors[0]), (902, None), (903, [0.0] * 16), (904, [math.nan] * 16), (905, [None] * 16), (906, []), (907, [1.0, 2.0])]
    got = {r[0]: tuple(r)[1:] for r in vector_passes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = [(k, np.array(v) / np.linalg.norm(v)) for k, v in rows if k < 902]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(good, 2) if x @ y >= 0.95]
    label, n = joined(links, [k for k, _ in rows]), Counter(itertools.chain(*links))
    assert got == {k: (n[k], label[k], k == label[k]) for k, _ in rows}


def test_ring(docs, none):
    rows = ring.assign(docs, 4, virtual_nodes=16).collect()
    sizes = {i: len((t or "").encode()) + 8 for i, t, *_ in corpus()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    assert all(r["text_crc32"] == zlib.crc32((dict((x[0], x[1]) for x in corpus())[r["doc_id"]] or "").encode()) for r in rows)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    assert rows[0].asDict() in [r.asDict() for r in ring.assign(docs.repartition(5), 4, virtual_nodes=16).collect()]
    assert ring.assign(none, 4).count() == 0


def test_ring_moves_little():
    loads = np.random.default_rng(1).integers(0, 100, 24 * 64).tolist()
    _, owner = ring.ring(24, 64)
    parts = ring.fill(loads, owner.tolist(), ring.bounds(sum(loads), 24, 0.0))
    held = Counter()
    for arc, begin, end, shard in parts:
        held[shard] += end - begin
    assert max(held.values()) - min(held.values()) <= 1 and sum(held.values()) == sum(loads)
    assert sum(e - b for a, b, e, s in parts if s == owner[a]) > 0.7 * sum(loads)


def test_rules(spark, none):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeinrst"), 5))
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = [word() + ("###" if bad else "") for _ in range(rng.integers(5, 60))]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    rows += [(1000, None), (1001, ""), (None, "plain words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marked = spark.createDataFrame([*labels, (5, None)], "doc_id long, quality int")
    got = rules.quality(docs, marked, F.col("doc_id") % 5 == 0).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400)
    assert rules.quality(docs, marked.limit(0), F.lit(False)).where("score <> 0.5").count() == 0
    assert rules.quality(none, marked, F.lit(False)).count() == 0


def test_tree_paths():
    printed = "Tree 0\n  If (feature 1 <= 2.0)\n   If (feature 1 <= 1.0)\n    Predict\n   Else (feature 1 > 1.0)\n    Predict\n  Else (feature 1 > 2.0)\n"
    name = rules.STATISTICS[1]
    assert rules.tree_paths(printed) == [((name, False, 2.0),), ((name, False, 1.0),), ((name, False, 2.0), (name, True, 1.0)), ((name, True, 2.0),)]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=1>Home</a></ul></nav><div class="ad">Buy this, now.</div><article><h1>Title &amp; more</h1><p><b>First,  line&nbsp;one.<br>two<p>Second <a href="x>y">link</a>.
<ul><li>Item, one.<li>Item two.</ul></article><section class="comments"><article><p>I disagree, fully.</p></article></section><form><p>Mail?</p></form>
<aside><p>See also this.</p></aside><footer>&copy; me</footer>"""


def test_html(spark):
    assert html_paths.main_text(PAGE) == "Title & more\n\nFirst, line one. two\n\nSecond link.\n\nItem, one.\n\nItem two."
    plain = "<div class=menu><p>Home, now.</p></div><div><p>Some words, and more.</p><p>Again, words.</p></div><div><ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul></div>"
    assert html_paths.main_text(plain) == "Some words, and more.\n\nAgain, words."
    assert [html_paths.main_text(x) for x in (None, "", "<", "<!-- x", "<script>a", "<p", "a < b")] == ["", "", "<", "", "", "<p", "a < b"]
    rows = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "clash")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_paths.extract(rows).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "" and got[2]["n_chars"] == 0
    assert html_paths.main_text("<article>" + "<div>" * 2000 + "<p>Deep, text." + "</div>" * 2000 + "</article>") == "Deep, text."


def test_transducer(spark, docs, none):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from folioscope.llm import transducer

    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = np.random.default_rng(8)
    parts = ["a", "S", "'s", "'re", "'l", "l", " ", "  ", "\n", "\t", "1", "²", "!", "'", "é", "日", " ", "<|endoftext|>", "\x1c", "the "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(1500)] + ["x" * 5000, " " * 999, "ab" * 3000, *(r[1] for r in corpus())]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in transducer.token_counts(rows, path, 1024).collect()}
    for k, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[k] == (len((text or "").encode()), n, n > 1024), repr(text)
    assert transducer.token_counts(none, path, 1024).count() == 0
    kinds = np.array([transducer.LETTER, transducer.SPACE, transducer.SPACE, transducer.LETTER, transducer.STOP])
    to, out = transducer.compile_splitter()
    assert [transducer.split(kinds, to, out, step).tolist() for step in (1, 2, 3, 64)] == [[True, True, True, False, True]] * 4


def test_transcripts(spark, monkeypatch):
    rows = []
    for c in range(40):
        rows += [(c, t, ("user", "assistant")[t % 2], f"Line {t} of it here?" if t % 2 == 0 else f"well, an answer {t}.\nit goes on.\n\nand on.") for t in range(2 + c % 5)]
    rows += [(99, t, ("user", "assistant")[t % 2], "Long talk?" if t % 2 == 0 else "sure.\nyes.") for t in range(60)]
    rows += [(200, 0, "user", None), (201, 0, "ghost", "who am I"), (None, 0, "user", "No id?"), (7, None, "user", "No turn?"), (3, 0, "user", "Line 0 of it here?")]
    talks = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("state", F.lit("clash"))
    whole = {(r["conv_id"], r["turn"]): tuple(r)[2:] for r in transcripts.recovered(talks, 3).collect()}
    monkeypatch.setattr(transcripts, "BLOCK", 5)
    assert {(r["conv_id"], r["turn"]): tuple(r)[2:] for r in transcripts.recovered(talks, 3).collect()} == whole  # blocks don't matter
    lines = sum(v[3] for v in whole.values())
    assert lines == sum(len([x for x in (t or "").split("\n") if x.strip()]) for *_, t in rows)
    assert sum(v[4] for v in whole.values()) > 0.85 * lines
    assert all(v[2] == f"<|{v[0]}|>\n{v[1]}\n<|end|>\n" for v in whole.values())
    assert transcripts.recovered(talks.limit(0), 3).count() == 0


def test_raw_transcripts(spark):
    talks = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"words {t}") for t in range(20)], "conv_id long, turn int, role string, text string")
    rows = transcripts.marked_lines(talks, 0)
    model = transcripts.estimate(rows.withColumn("state", F.col("truth")))
    raw = spark.createDataFrame([(5, "User: hello\n\nAssistant: hi there\nmore\nUser: bye"), (6, None)], "conv_id long, text string")
    got = [(r["turn"], r["role"], r["text"]) for r in transcripts.parse(raw, model).orderBy("turn").collect()]
    assert (got[0][1], got[0][2], got[-1][1], got[-1][2]) == ("user", "hello", "user", "bye")


def test_raking(spark, none, docs, monkeypatch):
    cells = [(f"s{a}", f"l{b}", (a + 1) * (b + 2) * 10) for a in range(5) for b in range(3)] + [("s0", None, 7), ("s9", "l0", 0)]
    table = spark.createDataFrame(cells, "source string, lang string, tokens long")
    targets = {"source": {f"s{a}": float(a + 1) for a in range(4)}, "lang": 0.5}
    here = {(r[0], r[1]): r[3] for r in raking.rake(table, targets).collect()}
    there = {(r[0], r[1]): r[3] for r in raking.rake(table, targets, cells_told=0).collect()}
    assert all(math.isclose(here[k], there[k], abs_tol=1e-6) for k in here) and len(here) == len(cells)
    for a in range(4):
        assert math.isclose(sum(w for (s, _), w in here.items() if s == f"s{a}"), (a + 1) / 10, abs_tol=1e-5)
    assert here["s4", "l0"] == here["s9", "l0"] == 0
    rated = raking.rates(raking.rake(table, targets), 0.3).collect()
    assert all(0 <= r["probability"] <= 1 for r in rated)
    assert math.isclose(sum(r["probability"] * r["tokens"] for r in rated), 0.3 * sum(c[2] for c in cells), rel_tol=1e-6)
    mix = {"source": 0.5, "lang": 0.7, "topic": 0.8}
    one = {r["doc_id"]: (r["kept"], round(r["probability"], 9)) for r in raking.mixed(docs, mix, 0.5).collect()}
    assert len(one) == docs.count()
    assert {r["doc_id"] for r in raking.sample(docs, mix, 0.5).collect()} == {k for k, (kept, _) in one.items() if kept}
    monkeypatch.setattr(raking, "CELLS_TOLD", 0)
    assert {r["doc_id"]: (r["kept"], round(r["probability"], 9)) for r in raking.mixed(docs, mix, 0.5).collect()} == one
    assert raking.mixed(none, mix, 0.5).count() == 0 and raking.sample(none, mix, 0.5).columns == docs.columns


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.durable(stage(spark, docs, sf))
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
