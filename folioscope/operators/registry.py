"""Registry building: order-dependent clustering of candidate names, made distributed.

The rule is greedy (first matching group in sorted order), so only names linked by the alias
relation can influence each other. Names fall into connected components of that relation, and
each component is replayed on its own as a process of labels along its links, over distinct names and
not over candidate rows: a name repeated in a third of the corpus is one entry. Rows then find their
group by an equi-join.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import fold_label
from folioscope.operators.components import components
from folioscope.session import durable, settled

# Strength of evidence, unknown methods last; shape of an umbrella prefix.
PRIORITY = {"fund_list_table": 0, "relation": 1, "quoted_title": 2, "label": 3, "label_next": 3}
UNKNOWN_PRIORITY = 9
UMBRELLA_WORD = r"(?iU)\b(?:fund|фонд)\b"
UMBRELLA_WORDS = 4

POSITION = "STRUCT<priority: INT, document: STRING, page: INT, norm: STRING, seq: BIGINT>"
_PARTS = ("priority", "document", "page", "norm", "seq")
_NAME = _PARTS.index("norm")


def method_priority(method: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.element_at(known, method), F.lit(UNKNOWN_PRIORITY)).cast("int")


def positioned(candidates: DataFrame) -> DataFrame:
    """Candidates with their folded name and their place in the clustering order."""
    return candidates.withColumn("norm", fold_label("name")).withColumn(
        "pos", F.struct(method_priority(F.col("method")).alias("priority"), "document", "page", "norm", "seq")
    )


def umbrella_links(names: DataFrame) -> DataFrame:
    """``norm, short``: pairs where dropping a short umbrella prefix turns one name into the other.

    Each long name lists its own admissible suffixes (at most its length), which then meet the
    known names by equality.
    """
    longer = names.filter(F.col("norm").rlike("fund|фонд"))
    prefix = F.trim(F.substr("norm", F.lit(1), F.col("cut") - 1))
    suffixes = (
        longer.select("norm", F.explode(F.sequence(F.lit(2), F.greatest(F.length("norm"), F.lit(2)))).alias("cut"))
        .withColumn("_prefix", prefix)
        .filter((F.size(F.split("_prefix", " ")) <= UMBRELLA_WORDS) & F.col("_prefix").rlike(UMBRELLA_WORD))
        .select("norm", F.substr("norm", F.col("cut"), F.length("norm")).alias("short"))
    )
    return suffixes.join(names.select(F.col("norm").alias("short")), "short").select("norm", "short").distinct()


_STEPS = "component STRING, norm STRING, start " + POSITION + ", group STRING, wants_after BOOLEAN"


def _replay(arrivals: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Labels of the names of one component over time: the steps at which a name's label changes.

    A group is known by its founding arrival. An arriving name takes the earliest label among its own and those
    that linked names have offered it, or founds a group; a label that changes is offered along the name's links, so an
    arrival without change costs nothing and every change its links. Where an offer beats the label of a name that
    is already there, the name's next arrival will move it: that arrival is asked for (``wants_after``).
    """
    near: dict[str, list[str]] = defaultdict(list)
    for long, short in zip(links["norm"], links["short"], strict=True):
        near[long].append(short)
        near[short].append(long)
    places = sorted(arrivals[list(_PARTS)].itertuples(index=False, name=None))
    label: dict[str, int] = {}
    offered: dict[str, int] = {}
    steps: list[tuple[str, tuple, int, bool]] = []
    for at, place in enumerate(places):
        name = place[_NAME]
        earliest = min(label.get(name, at), offered.get(name, at))
        if label.get(name) == earliest:
            continue
        label[name] = earliest
        steps.append((name, place, earliest, False))
        for other in near[name]:
            offered[other] = min(offered.get(other, earliest), earliest)
            if earliest < label.get(other, earliest):
                steps.append((other, place, earliest, True))
    component = (arrivals if len(arrivals) else links)["component"].iloc[0]
    return pd.DataFrame(
        {
            "component": component, "norm": [s[0] for s in steps], "start": [dict(zip(_PARTS, s[1], strict=True)) for s in steps],
            "group": [f"{component}\x1f{s[2]:012d}" for s in steps], "wants_after": [s[3] for s in steps],
        }
    )


def group_steps(rows: DataFrame) -> DataFrame:
    """``norm, steps``: which group a name belongs to from which position on."""
    firsts = durable(rows.groupBy("norm").agg(F.min("pos").alias("pos")))
    links = durable(umbrella_links(firsts.select("norm")))
    lonely = firsts.select(
        "norm", F.array(F.struct(F.col("pos").alias("start"), F.col("norm").alias("group"))).alias("steps")
    )
    if links.isEmpty():
        return lonely
    member = durable(components(links.select(F.col("norm").alias("a"), F.col("short").alias("b"))).withColumnRenamed("node", "norm"))
    linked = durable(links.join(member, "norm").select("component", "norm", "short"))
    arrivals = firsts.join(member, "norm").select("component", "pos.*")
    asked: DataFrame | None = None
    while True:  # every round but the last adds one of finitely many arrivals
        replayed = durable(arrivals.groupBy("component").cogroup(linked.groupBy("component")).applyInPandas(_replay, _STEPS))
        wanted = replayed.filter("wants_after").select("component", "norm", "start").distinct()
        if asked is not None:
            wanted = wanted.join(asked, ["component", "norm", "start"], "left_anti")
        wanted = durable(wanted)
        if wanted.isEmpty():
            break
        upcoming = (
            rows.select("norm", "pos").join(wanted, "norm").filter(F.col("pos") > F.col("start"))
            .groupBy("component", "norm", "start").agg(F.min("pos").alias("pos"))
        )
        asked = wanted if asked is None else asked.unionByName(wanted)
        arrivals = durable(arrivals.unionByName(upcoming.select("component", "pos.*")).distinct())
    moved = replayed.filter(~F.col("wants_after")).groupBy("norm").agg(
        F.array_sort(F.collect_list(F.struct("start", "group"))).alias("steps")
    )
    alone = lonely.join(member, "norm", "left_anti")
    return alone.unionByName(moved)


def assign_groups(candidates: DataFrame) -> DataFrame:
    """Candidates with ``norm``, ``pos`` and the ``group`` they fall into."""
    rows = positioned(candidates)
    steps = group_steps(rows)
    reached = F.filter("steps", lambda s: s["start"] <= F.col("pos"))
    return rows.join(steps, "norm").withColumn("group", F.element_at(reached, -1)["group"]).drop("steps")


def build_registry(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry entries and their evidence rows.

    The preferred name is the last list-table name, else the last relation name, else the
    first seen. Evidence stays a table keyed by the canonical name: it has no size bound.
    """
    rows = settled(lambda: assign_groups(candidates))
    listed, related = F.col("method") == "fund_list_table", F.col("method") == "relation"
    entries = rows.groupBy("group").agg(
        F.coalesce(
            F.max_by(F.when(listed, F.col("name")), F.when(listed, F.col("pos"))),
            F.max_by(F.when(related, F.col("name")), F.when(related, F.col("pos"))),
            F.min_by("name", "pos"),
        ).alias("canonical_name"),
        F.transform(
            F.array_sort(F.collect_set(F.struct("norm", "name"))), lambda s: s["name"]
        ).alias("aliases"),
        F.count("*").alias("evidence_count"),
    )
    registry = entries.select("canonical_name", "aliases", "evidence_count")
    evidence = rows.join(entries.select("group", "canonical_name"), "group").select(
        "canonical_name", "name", "document", "page", "method", "evidence", "seq"
    )
    return registry, evidence
