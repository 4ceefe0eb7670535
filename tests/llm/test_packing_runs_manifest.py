"""Retrieval packing, periodic runs and the manifest against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import manifest, periodic, queries, retrieval_packing
from folioscope.llm.wordbytes import CASED, Words, byte_view
from folioscope.session import durable

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, place long, start long, signature long, runs int"


def rows(texts, ids=None):
    return [(k if ids is None else ids[k], t, "en", "s", 0, 7, "x", 8, 9, 10, 11) for k, t in enumerate(texts)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest


def plain_manifest(docs, fields, fanout, changed=lambda d: d):
    """The contract row by row: docs are dicts."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: sha(*(part(d[f]) for f in fields))
    groups = defaultdict(list)
    for d in docs:
        groups[d["lang"]].append((d["doc_id"] is not None, d["doc_id"] or 0, leaf(d), leaf(changed(d)), d["doc_id"]))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            level = levels[-1]
            levels.append([sha(*level[k : k + fanout]) for k in range(0, len(level), fanout)])
        return levels

    def steps(levels, at):
        for level in levels[:-1]:
            run = level[at // fanout * fanout : at // fanout * fanout + fanout]
            yield "".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])
            at //= fanout

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, own, seen, i) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*steps(trees[g], at), *steps(top, k)]
            folded = seen
            for left, right in path:
                folded = sha(left, folded, right)
            out.append((i, own, trees[g][-1][0], top[-1][0], sha(*(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_manifest(spark, fanout):
    langs = ["en"] * 19 + ["de"] * 9 + ["", None, "é", "z", None, "fr"]
    docs = [{"doc_id": (k * 7) % 31, "lang": g, "source": None if k % 4 == 0 else f"s{k}", "text": [None, "", "ABC def", f"Té {k}"][k % 4]} for k, g in enumerate(langs)]
    docs += [{**docs[5]}, {**docs[5]}, {"doc_id": None, "lang": "en", "source": None, "text": None}]
    table = spark.createDataFrame([(d["doc_id"], d["lang"], d["source"], d["text"], 1, 2, 3) for d in docs], "doc_id long, lang string, source string, text string, grp int, pos int, node int")
    fields = ["doc_id", "source", "lang", "text"]
    tampered = {"text": F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))}
    got = sorted(str(tuple(r)) for r in manifest.manifest(table, fields, tampered=tampered, fanout=fanout).collect())
    expected = plain_manifest(docs, fields, fanout, lambda d: {**d, "text": d["text"].lower()} if d["text"] and d["doc_id"] % 2 == 0 else d)
    assert got == expected
    clean = manifest.manifest(table, fields, fanout=fanout)
    assert clean.where("not verified or folded_root <> root").count() == 0
    one = spark.createDataFrame([(3, None, "s", "A")], "doc_id long, lang string, source string, text string")
    assert [str(tuple(r)) for r in manifest.manifest(one, fields, fanout=fanout).collect()] == plain_manifest([{"doc_id": 3, "lang": None, "source": "s", "text": "A"}], fields, fanout)
    assert manifest.manifest(table.limit(0), fields, fanout=fanout).count() == 0


def test_places_of_many_equal_rows(spark):
    """Rows that are equal in all that orders them still spread over partitions and get places of their own in their group."""
    table = spark.createDataFrame([("a" if k % 3 else "b", 1) for k in range(3000)], "grp string, x long").repartition(5)
    for r in manifest.placed(durable(table), "x").groupBy("grp").agg(F.sort_array(F.collect_list("pos")).alias("pos"), F.max("size").alias("size")).collect():
        assert r["size"] == {"a": 2000, "b": 1000}[r["grp"]] and r["pos"] == list(range(r["size"]))


# --- periodic runs


def plain_runs(words):
    """(start, period, length) by comparing each word with those before it."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def stitched_plainly(found):
    """What the shuffle does with fragments, for one text."""
    whole = defaultdict(list)
    for _, q, a, b, _, _ in sorted(found.T.tolist(), key=lambda x: (x[1], x[2])):
        if whole[q] and a <= whole[q][-1][1]:
            whole[q][-1][1] = max(b, whole[q][-1][1])
        else:
            whole[q].append([a, b])
    out = {}
    for q, parts in sorted(whole.items()):
        for a, b in parts:
            if b - a >= 3 * q and b - a + q >= 6:
                out.setdefault((a, b - a + q), q)
    return sorted((s, q, n) for (s, n), q in out.items())


@pytest.mark.parametrize("cells", [periodic.CELLS, 7, 64])
def test_fragments(cells):
    rng = np.random.default_rng(cells)
    texts = []
    for k in range(120):
        n = int(rng.integers(0, 160))
        words = rng.integers(0, [1, 2, 3, 9][k % 4] + 1, n).tolist()
        if k % 3 == 0 and n > 20:
            a, p = int(rng.integers(0, n // 2)), int(rng.integers(1, 14))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        texts.append([f"w{w}" for w in words])
    data, offsets = byte_view(pa.array([" ".join(t) for t in texts]))
    words = Words(data, offsets, CASED)
    found = periodic.fragments(words.hash, words.first, cells)
    for k, t in enumerate(texts):
        assert stitched_plainly(found[:, found[0] == k]) == plain_runs(t), k


def test_periodic_runs(spark):
    line = "a b c d e "
    texts = [None, "", " \t\n", "one", "x x x x x", "x x x x x x", "X x X x X x X x X x", "x" * 30_000, line * 3, line * 4, "q " + line * 40 + "z z z z z z z b", "p q " * 5000, "p q " * 5000]
    texts += ["y y " * 6, " ".join(f"u{k}" for k in range(3000)) + " " + "k l m " * 700]
    docs = spark.createDataFrame(rows(texts) + [(None, "t t t t t t", *rows([""])[0][2:])], DOCS)
    found = periodic.periodic_runs(docs).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        words = ("t " * 6 if r["doc_id"] is None else texts[r["doc_id"]] or "").encode().split()
        runs = plain_runs(words)
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == runs
        gone = {k for s, q, n in runs for k in range(s + q, s + n)}
        assert r["collapsed"] == b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    short = {r["doc_id"]: r["collapsed"] for r in periodic.periodic_runs(docs, finish=lambda b: str(len(b)).encode()).collect()}
    assert all(short[r["doc_id"]] == str(len(r["collapsed"].encode())) for r in found)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_stitching_pieces_from_anywhere(spark):
    parts = [(1, 2, 0, 4), (1, 2, 3, 9), (1, 2, 9, 12), (1, 2, 14, 20), (1, 4, 0, 10), (1, 3, 0, 8), (2, 1, 5, 10), (3, 1, 0, 4)]
    got = periodic.stitched(spark.createDataFrame(parts, "row long, period long, start long, stop long").repartition(5)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 14, 2), (1, 14, 8, 2), (2, 5, 6, 1)]


def test_one_repeated_word_costs_no_square():
    import time

    hashes, first = np.full(300_000, 5, np.uint64), np.array([0, 300_000])
    began = time.process_time()
    assert stitched_plainly(periodic.fragments(hashes, first)) == [(0, 1, 300_000)]
    assert time.process_time() - began < 60


def test_repeated_tails(spark):
    texts = [f"a{k} Bé c  d\te " * (k % 5) for k in range(300)] + [None]
    got = {r["doc_id"]: r["text"] for r in queries.repeated_tails(spark.createDataFrame(rows(texts), DOCS)).collect()}
    changed = 0
    for k, t in enumerate(texts):
        h, w = zlib.crc32(str(k).encode()), (t or "").encode().split()
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert (got[k] or "").encode().split() == w
    assert changed > 10


# --- packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_signs_behind_letters_are_learned_once(library):
    """Words that differ by a last sign share what is learned, and marks between words never change ids, also if a text has them."""
    texts = ["Aé. aé, aé; aé! aé? aé: aé", "9. × ×. ÷, .. a.. …. я, 中. b\x01 \x01 \x01. 's. 't, a's. '.", "", ". , é.", "x" * 3 + ". " + "ÿ! " * 3000]
    words = retrieval_packing.WordTokens(WORDS)
    data, offsets = byte_view(pa.array(texts[:1]))
    words.encode(data, offsets, 2)
    assert len(words.keys) == 7  # one word and six signs
    for part in (texts, texts[2:]):
        data, offsets = byte_view(pa.array(part))
        ids, begins = words.encode(data, offsets, 2)
        for k, text in enumerate(part):
            assert ids[begins[k] : begins[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_word_tokens(library):
    texts = ["It's HERE  now", None, "", "É́té  x y ΣΑΣ Σ", "a<|endoftext|>b <|startoftext|>", "́ mark", "x" * 3000, "\x00\x1c tab\x85", "naïve 日本語 12345 'll", "It's HERE  now"]
    words = retrieval_packing.WordTokens(WORDS)
    for _ in range(2):  # unknown words, then kept ones
        ids, begins = words.encode(*byte_view(pa.array(texts)), 2)
        for k, t in enumerate(texts):
            assert ids[begins[k] : begins[k + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]


def test_refuses_tokenizers_that_see_blanks():
    with pytest.raises(ValueError, match="depend on"):
        retrieval_packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def plain_packing(docs, idf, mean, window, terms_asked):
    """Greedy filling with dictionaries; ``docs`` are id lists with an end token."""
    tf = [Counter(d[:-1]) for d in docs]
    weight = [{t: idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * (len(d) - 1) / mean)) for t, c in f.items()} for d, f in zip(docs, tf, strict=True)]
    unused, out, sequence, filled, asked = list(range(len(docs))), [], 0, 0, []
    while unused:
        score = {d: sum(weight[d].get(t, 0) for t in asked) for d in unused} if filled else {}
        best = max(score, key=lambda d: (score[d], -d), default=None)
        doc = best if best is not None and score[best] > 0 else unused[0]
        unused.remove(doc)
        start = 0
        while start < len(docs[doc]):
            if not filled:
                asked = sorted(weight[doc], key=lambda t: (-weight[doc][t], t))[:terms_asked]
            n = min(len(docs[doc]) - start, window - filled)
            out.append((doc, start, n, sequence, filled))
            start, filled = start + n, filled + n
            if filled == window:
                sequence, filled = sequence + 1, 0
    return out


def test_greedy_filling_as_by_hand():
    rng = np.random.default_rng(2)
    docs = [[*(rng.zipf(1.3, int(n)) % 400 + 3).tolist(), 2] for n in rng.integers(0, 90, 150)] + [[2], [2]]
    df = Counter(t for d in docs for t in set(d[:-1]))
    idf = np.array([math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) if df[t] > 1 else 0 for t in range(500)])
    mean = sum(len(d) - 1 for d in docs) / len(docs)
    ids, begins = np.array([i for d in docs for i in d], "<u2"), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    packer = retrieval_packing.Packer(64, idf, mean, 0)
    assert list(map(tuple, packer.pack(ids, begins).tolist())) == plain_packing(docs, idf, mean, 64, retrieval_packing.QUERY_TERMS)
    again = packer.pack(ids, begins)  # the open window goes on with the next shard
    assert again[0, 4] > 0 and again[0, 3] * 64 + again[0, 4] == begins[-1]


def test_pieces_cover_everything(spark, library):
    rng = np.random.default_rng(4)
    words = np.array([f"{a}{b}" for a in ("river", "stone", "cloud", "market") for b in ("s", "ed", "ing", "ful", " lane")])
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 400, 120)] + [None, "", "word " * 9000, "x" * 20_000] + ["same text here"] * 40
    ids = [*range(len(texts) - 1), None]
    docs = spark.createDataFrame(rows(texts, ids), DOCS).repartition(6)
    pieces = retrieval_packing.pack(docs, WORDS, 2).collect()
    expected = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in zip(ids, texts, strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        own = expected[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and bytes(r["ids"]) == own[r["start"] : r["start"] + r["length"]].tobytes()
    for i, own in expected.items():
        spans = sorted((r["start"], r["length"]) for r in by_doc[i])
        assert [s for s, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist() and sum(n for _, n in spans) == len(own)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts[:-1])]).tolist()
        assert total <= retrieval_packing.WINDOW and total & (total - 1) == 0
    assert retrieval_packing.pack(docs.limit(0), WORDS, 2).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("body"))
    assert retrieval_packing.pack(named, WORDS, 2, "key", "body").agg(F.sum("length")).first()[0] == sum(map(len, expected.values()))


def test_shards_and_open_windows():
    kind = np.dtype("<u2")
    sizes = [3, 5, 2, 40, 1, 7, 9]
    ids = np.arange(sum(sizes), dtype="<u2")
    begins = np.concatenate([[0], np.cumsum(sizes)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), retrieval_packing._binary(ids, begins)], ["id", "tokens"])
    whole = retrieval_packing.SHARD_TOKENS
    try:
        retrieval_packing.SHARD_TOKENS = 10
        shards = list(retrieval_packing._shards(iter([batch.slice(0, 2), batch.slice(2)]), kind))
    finally:
        retrieval_packing.SHARD_TOKENS = whole
    assert [s[0].to_pylist() for s in shards] == [[0, 1, 2], [3], [4, 5], [6]]
    assert np.concatenate([s[1] for s in shards]).tolist() == ids.tolist()
    pieces = np.array([[0, 0, 8, 5, 0], [1, 0, 5, 6, 0], [2, 3, 6, 6, 5]])
    closed = retrieval_packing._closed(pieces, 11, 6)
    assert closed.tolist() == [[0, 0, 8, 5, 0], [1, 0, 5, 6, 0], [2, 3, 3, 6, 5], [2, 6, 2, 7, 0], [2, 8, 1, 8, 0]]
