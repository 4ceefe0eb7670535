import random
import re
import time

import pandas as pd
import pytest

from folioscope.operators import chunking, evaluation, segmentation
from folioscope.operators import registry as R
from folioscope.operators.components import components
from folioscope.functions.text import _fold, LABEL_EDGES

CANDIDATES = "name STRING, document STRING, page INT, method STRING, evidence STRING, seq BIGINT"


def linked(a, b):
    """Whether a short prefix with the word fund turns one folded name into the other."""
    heads = [x[: -len(y)].split() for x, y in ((a, b), (b, a)) if x.endswith(y)]
    return a == b or any(0 < len(h) <= R.UMBRELLA_WORDS and re.search(r"(?i)\b(fund|фонд)\b", " ".join(h)) for h in heads)


def brute(candidates):
    """Sequential clustering, one candidate at a time."""
    norm = lambda s: _fold(s, LABEL_EDGES)
    ordered = sorted(
        candidates, key=lambda c: (R.PRIORITY.get(c[3], R.UNKNOWN_PRIORITY), c[1], c[2], norm(c[0]), c[5])
    )
    groups = []
    for c in ordered:
        home = next((g for g in groups if any(linked(norm(c[0]), norm(o[0])) for o in g)), None)
        if home is None:
            home = []
            groups.append(home)
        home.append(c)
    entries = []
    for g in groups:
        listed = [c[0] for c in g if c[3] == "fund_list_table"]
        related = [c[0] for c in g if c[3] == "relation"]
        best = listed[-1] if listed else related[-1] if related else g[0][0]
        entries.append((best, tuple(sorted({c[0] for c in g}, key=lambda n: (norm(n), n))), len(g)))
    return sorted(entries)


def built(spark, candidates):
    entries, _ = R.build_registry(spark.createDataFrame(candidates, CANDIDATES))
    return sorted((r.canonical_name, tuple(r.aliases), r.evidence_count) for r in entries.collect())


def test_similar_names_stay_apart_and_umbrella_names_merge(spark):
    rows = ["k&h egészség", "k&h egészség 2", "prime fund world select 100", "world select 100", "prime house world select 100", "a b c d fund world select", "world select"]
    pairs = R.umbrella_links(spark.createDataFrame([(r,) for r in rows], "norm STRING")).collect()
    assert [tuple(p) for p in pairs] == [("prime fund world select 100", "world select 100")]


def test_components_of_long_chains(spark, monkeypatch):
    """A chain's rounds grow with the logarithm of its length, whatever the order of its names."""
    rounds = []
    from folioscope.operators import components as module

    monkeypatch.setattr(module, "durable", lambda df, own=module.durable: (rounds.append(1), own(df))[1])
    names = [f"n{(k * 7919) % 1000:04d}" for k in range(400)]
    edges = [*zip(names, names[1:]), ("x", "y"), ("y", "x"), ("z", "z"), (None, "q"), ("x", "y")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a STRING, b STRING")).collect()}
    assert got == {**dict.fromkeys(names, min(names)), "x": "x", "y": "x"}
    assert len(rounds) <= 14


def test_replay_costs_its_links():
    """A hundred thousand names behind one short name: linear work, not one scan of all groups for each."""
    n = 100_000
    names = [f"fund {k} core" for k in range(n)]
    arrivals = pd.DataFrame([(3, "d", k, name, 0, "c") for k, name in enumerate([*names, "core", *names[:5]])], columns=[*R._PARTS, "component"])
    links = pd.DataFrame({"component": "c", "norm": names, "short": "core"})
    began = time.process_time()
    steps = R._replay(arrivals, links)
    assert time.process_time() - began < 20
    last = steps[~steps["wants_after"]].groupby("norm")["group"].last()
    assert last[names[0]] == last["core"] == last[names[4]] != last[names[5]]
    assert steps["wants_after"].sum() == n - 1


def test_later_arrival_may_move_to_an_earlier_group(spark):
    """A repeated name follows its link to an older group once a bridge name has joined it."""
    c = [
        ("Fund Big Old My Fund Xylo Y", "a", 1, "label", "", 0),
        ("Xylo Y", "a", 2, "label", "", 0),
        ("My Fund Xylo Y", "a", 3, "label", "", 0),
        ("Xylo Y", "a", 4, "label", "", 0),
        ("XYLO Y", "b", 1, "label", "", 0),
    ]
    assert built(spark, c) == brute(c)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sequential_clustering(spark, seed):
    rng = random.Random(seed)
    stems = ["Xylo Y", "Zed Q", "Alfa Beta"]
    heads = ["", "My Fund ", "Old My Fund ", "Fund ", "Big Fund Old ", "Fund Big Old My Fund ", "Plain "]
    methods = list(R.PRIORITY) + ["other"]
    c = [
        (rng.choice(heads) + rng.choice(stems), rng.choice("abc"), rng.randint(1, 4), rng.choice(methods), "", i)
        for i in range(60)
    ]
    assert built(spark, c) == brute(c)


def test_set_differences_count_folded_names_once(spark):
    predicted = spark.createDataFrame([("Alpha One",), ("ALPHA ONE",), ("Beta",)], "name string")
    gold = spark.createDataFrame([("beta",), ("Gamma",), ("GAMMA",)], "name string")
    got = sorted(tuple(r) for r in evaluation.set_differences(predicted, gold).collect())
    assert got == [("extra", "ALPHA ONE"), ("missing", "GAMMA")]


def test_missing_class_or_pages_are_errors(spark):
    pages = spark.createDataFrame([("a", 1), ("b", 1)], "document string, page int")
    classes = spark.createDataFrame([("a", "general", None)], "document string, document_type string, primary_fund string")
    anchors = spark.createDataFrame([], "document string")
    with pytest.raises(ValueError, match="'b'"):
        segmentation.segment_documents(pages, anchors, classes, anchors=anchors)
    segments = spark.createDataFrame([("c", 1, 2)], "document string, start_page int, end_page int")
    with pytest.raises(ValueError, match="'c'"):
        chunking.segment_spans(segments, pages)
