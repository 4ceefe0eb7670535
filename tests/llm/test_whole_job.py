"""Cases in which operators once did less than the whole job."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import html_paths, ppm, vector_passes
from folioscope.llm.tables import find
from folioscope.llm.wordbytes import BLANKS, Words


@pytest.mark.parametrize("n,share,tile", [(20_000, 0.85, vector_passes.REST_TILE), (4000, 0.5, 40)])
def test_vectors_with_a_common_direction(spark, monkeypatch, n, share, tile):
    """Lone pairs are found however much direction the vectors share, by tiles or, where those cost more, by further passes."""
    monkeypatch.setattr(vector_passes, "REST_TILE", tile)
    rng = np.random.default_rng(11)
    size, planted = 64, 400
    common = rng.standard_normal(size)
    x = np.sqrt(share) * common / np.linalg.norm(common) + np.sqrt((1 - share) / size) * rng.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.standard_normal((planted, size))
    aside -= (aside * x[:planted]).sum(axis=1, keepdims=True) * x[:planted]
    x[n - planted :] = 0.955 * x[:planted] + np.sqrt(1 - 0.955**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    expected = {k: 0 for k in range(n)}
    for begin in range(0, n, 2000):
        near = x[begin : begin + 2000] @ x.T >= 0.95
        expected.update(zip(range(begin, begin + 2000), (near.sum(axis=1) - 1).tolist(), strict=True))
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vector_passes.near_duplicates(rows).collect()}
    assert sum(expected.values()) >= 2 * planted
    missed = sum(got[k] != expected[k] for k in expected)
    assert missed <= 0.01 * 2 * planted


def test_signs_needed():
    keys = np.array([0, 0, 0, 1 << 47, 1 << 47, (1 << 47) + (1 << 46)], np.int64)
    assert vector_passes.signs_needed(keys, 2, True, True).tolist() == [1, 1, 1, 1, 1, 1]
    assert vector_passes.signs_needed(keys, 1, True, True).tolist() == [49, 49, 49, 2, 2, 2]
    assert vector_passes.signs_needed(keys, 5, True, True).tolist() == [0] * 6
    assert vector_passes.signs_needed(keys, 2, False, True).tolist() == [49, 49, 49, 1, 1, 1]
    assert vector_passes.signs_needed(keys, 2, True, False).tolist() == [1, 1, 1, 2, 2, 49]


LONG = "A long sentence, with its marks, goes on. " * 250


@pytest.mark.parametrize("tag", ["article", "div"])
def test_short_blocks_between_long_paragraphs(tag):
    """Title, list, table and linked text of an article stay however long its paragraphs are."""
    body = f"<h1>Ox</h1><p>{LONG}</p><ul><li>Twelve chars<li>Other twelve</ul><p>{LONG}</p><table><tr><td>abc<td>12</table><p>{LONG}</p><h2><a href=1>Linked</a></h2><ul><li><a href=2>Source</a></ul>"
    expected = ["Ox", LONG.strip(), "Twelve chars", "Other twelve", LONG.strip(), "abc", "12", LONG.strip(), "Linked", "Source"]
    assert html_paths.main_text(f"<body><{tag}>{body}</{tag}><div><a href=3>Elsewhere</a></div></body>").split("\n\n") == expected


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "overflow-hidden", "elementor-widget", "ad-free", "search-open", "sidebar", "layout hidden"])
def test_wrappers_with_telling_names(name):
    """A page's text isn't lost by the class of an element around it."""
    text = "<h1>Title</h1><p>Some words, and more.</p><p>Again, words.</p>"
    expected = "Title\n\nSome words, and more.\n\nAgain, words."
    for page in (f"<article>{text}</article>", f"<div>{text}</div>"):
        assert html_paths.main_text(f"<body><div class='{name}'><div class=ad>Buy, now.</div>{page}<div class='site-footer'>Ours.</div></div>") == expected


def test_teasers_beside_the_text():
    """Teaser cards in ``article`` don't stand for the page; comments stay out, also longer ones."""
    text = "".join(f"<p>Paragraph {k}, of the text, has words.</p>" for k in range(9))
    got = html_paths.main_text(f"<body><article><p>Teaser, one.</p></article><div class='content'>{text}</div>")
    assert all(f"Paragraph {k}, of the text, has words." in got for k in range(9))
    talk = f"<section class='comments'><article>{text}</article></section>"
    assert html_paths.main_text(f"<body><article><p>Short, whole.</p></article>{talk}") == "Short, whole."


def test_context_model_over_batches_of_several_pieces(spark):
    """Batches above CHUNK, one text above CHUNK among them, give each row what it gets alone in its batch."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(400)])
    sizes = [30_000, 1, 200_000, 0, 40_000, 150_000, 30_000, 600_000, 5]
    texts = [" ".join(rng.choice(words, n)) for n in sizes]
    assert len(texts[7]) > ppm.CHUNK and sum(map(len, texts[:6])) < 2 * ppm.CHUNK
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    together = docs.coalesce(1)
    model = ppm.train(together)
    assert model.tokens == sum(sizes) + len(sizes) and model.distinct == len({w for t in texts for w in t.split()}) + 1
    alone = {r["key"]: r["n"] for r in ppm.train(docs.repartition(len(texts), "doc_id")).counts.where("kind = 1").collect()}
    assert {r["key"]: r["n"] for r in model.counts.where("kind = 1").collect()} == alone
    counts = Counter(w for t in texts for w in t.split())
    base = {w: math.log10((n + 1) / (model.tokens + model.distinct + 1)) for w, n in counts.items()}
    end = math.log10((len(texts) + 1) / (model.tokens + model.distinct + 1))
    split = {r["doc_id"]: r["score"] for r in ppm.score(docs.repartition(len(texts), "doc_id"), model).collect()}
    for r in ppm.score(together, model).collect():
        own = texts[r["doc_id"]].split()
        assert (r["n_tokens"], r["n_known"]) == (len(own) + 1, len(own) + 1)
        assert r["base_score"] == pytest.approx(sum(base[w] for w in own) + end)
        assert r["score"] == pytest.approx(split[r["doc_id"]])


def test_words_take_whole_bytes_only():
    data, offsets = np.frombuffer(b"some words", np.uint8), np.array([0, 4, 10])
    with pytest.raises(ValueError, match="not over all"):
        Words(data, offsets[:2], BLANKS)
    with pytest.raises(ValueError, match="not over all"):
        Words(data, offsets[1:], BLANKS)


def test_driver_holds_one_level_of_the_trie_at_a_time():
    rng = np.random.default_rng(5)
    text = rng.choice(np.frombuffer(b"etaoinshrdlucmfw ", np.uint8), 2_000_000)
    keys, n = np.unique(ppm._runs(text, np.arange(0, len(text) + 1, 500))[0], return_counts=True)
    symbols = np.bincount((keys & np.uint64(255)).astype(int), n, 256).astype(np.int64)
    place = rng.permutation(len(keys))
    leaves = pa.table({"key": keys[place].view(np.int64), "n": n[place]})
    tracemalloc.start()
    trie = ppm._trie_of(leaves, symbols)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 125 * len(keys)  # 143 when all levels were held with the counts behind them
    found, value = find(trie["leaves"], keys)
    context = keys >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(keys))))
    assert found.all() and np.allclose(value, np.log10((2 * n - 1) / (2 * total)), rtol=0, atol=1e-12)
