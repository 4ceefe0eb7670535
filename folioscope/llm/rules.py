"""Quality classifier as a sparse ensemble of rules.

Statistics of whole texts become numeric columns. A forest of shallow trees over labelled rows gives
paths, every path is a rule (a conjunction of comparisons), a lasso logistic regression weighs the
rules, and those with a weight are compiled to one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.wordbytes import BLANKS, PORTION, Words, byte_table, byte_view, portions
from folioscope.session import durable

#: Labelled rows that the forest and the regression see at most, chosen by a hash of the id.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.001

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digits", "marks", "bangs", "pipes", "symbols", "beyond_ascii",
    "breaks", "distinct_words", "top_word", "repeated_next", "distinct_lines", "line_words", "longest_word",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "marks": b".,;:?'\"()-",
    "bangs": b"!", "pipes": b"|", "symbols": b"#$%&*+/<=>@[\\]^_`{}~", "breaks": b"\n\r",
}
_CLASS_OF = np.zeros(256, np.int64)
for _k, _own in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_own)] = _k + 1
_CLASS_OF[128:] = len(_CLASSES) + 1
_LINES = byte_table(b"\n\r")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _runs_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct hashes and how often the most frequent comes."""
    own = hashes.copy()
    for a, b in zip(first[:-1], first[1:], strict=True):
        own[a:b].sort()
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    new[first[:-1][first[:-1] < len(own)]] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(own)))
    at = np.searchsorted(starts, first)
    distinct = np.diff(at)
    most = np.zeros(len(distinct), np.int64)
    filled = np.flatnonzero(distinct)
    if len(filled):
        most[filled] = np.maximum.reduceat(lengths, at[:-1][filled])
    return distinct, most


def _statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    size = np.diff(offsets)
    n, kinds = len(size), len(_CLASSES) + 2
    counts = np.zeros((n, kinds), np.int64)
    for lo in range(0, len(data), PORTION):
        text = np.repeat(np.arange(n), np.diff(np.clip(offsets, lo, lo + PORTION)))
        counts += np.bincount(text * kinds + _CLASS_OF[data[lo : lo + PORTION]], minlength=n * kinds).reshape(n, kinds)
    words, lines = Words(data, offsets, BLANKS), Words(data, offsets, _LINES)
    n_words, n_lines = words.counts(), lines.counts()
    distinct, most = _runs_of(words.hash, words.first)
    distinct_lines, _ = _runs_of(lines.hash, lines.first)
    same = np.zeros(len(words.hash) + 1, np.int64)
    same[1:-1] = words.hash[1:] == words.hash[:-1] if len(words.hash) else same[1:-1]
    same[words.first[:-1]] = 0
    repeats = np.concatenate([[0], np.cumsum(same)])
    length = words.end - words.start
    longest = np.zeros(n, np.int64)
    filled = np.flatnonzero(n_words)
    if len(filled):
        longest[filled] = np.maximum.reduceat(length, words.first[:-1][filled])
    blanks = size - counts[:, 1:].sum(axis=1)
    out = {name: _share(counts[:, k + 1], size - np.minimum(blanks, size)) for k, name in enumerate(_CLASSES)}
    return out | {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n_words), "word_bytes": _share(size, n_words + 1),
        "beyond_ascii": _share(counts[:, -1], size), "distinct_words": _share(distinct, n_words), "top_word": _share(most, n_words),
        "repeated_next": _share(repeats[words.first[1:]] - repeats[words.first[:-1]], n_words), "distinct_lines": _share(distinct_lines, n_lines),
        "line_words": np.log1p(_share(n_words, n_lines)), "longest_word": np.log1p(longest),
    }


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct ``_statistics`` of doubles over the whole text; null counts as empty. All other columns stay."""
    base = docs.drop("_statistics")
    names = base.columns
    place = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, place):
            found = _statistics(*byte_view(batch.column(place)))
            columns = [pa.array(found[s], pa.float64()) for s in STATISTICS]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, list(STATISTICS))], [*names, "_statistics"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{kinds}, _statistics struct<{', '.join(f'{s}: double' for s in STATISTICS)}>")


#: A comparison: statistic, whether it must be greater, and with what.
Condition = tuple[str, bool, float]


@dataclass
class RuleModel:
    """Weighted conjunctions and an intercept of the log odds."""

    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self, of: str = "_statistics") -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.when(holds(rule, of), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def holds(rule: tuple[Condition, ...], of: str = "_statistics") -> Column:
    """A rule as a boolean column."""
    out = F.lit(True)
    for statistic, greater, value in rule:
        column = F.col(f"{of}.{statistic}")
        out = out & (column > value if greater else column <= value)
    return out


def tree_paths(description: str) -> list[tuple[Condition, ...]]:
    """All distinct paths from a root to any other node, of a forest's printed form."""
    found: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        step = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not step:
            continue
        depth = len(step[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (STATISTICS[int(step[2])], step[3] == ">", float(step[4]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (statistic, greater, value) in path:
            key = statistic, greater
            tightest[key] = (max if greater else min)(value, tightest.get(key, value))
        found[tuple(sorted((s, g, v) for (s, g), v in tightest.items()))] = None
    return list(found)


def fit(labelled: DataFrame, label: str, order_by: Column, train_rows: int = TRAIN_ROWS, seed: int = 11) -> RuleModel:
    """Learn from rows with ``_statistics`` and a 0/1 label, at most ``train_rows`` of them, the first by ``order_by``.

    Rows without a label are left out. With no labelled row the score is 0.5 everywhere; with one label
    only it is (rows with label 1 + 1) / (rows + 2).
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(order_by.alias("_order"), F.col(label).cast("double").alias("label"), "_statistics.*")
    sample = durable(rows.orderBy("_order", *STATISTICS, "label").limit(train_rows).coalesce(1)).coalesce(1)
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleModel([], float(np.log((ones + 1) / (n - ones + 1))))
    train = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(sample).select("features", "label", *STATISTICS).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(1, min(20, n // 50)), subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed)
    paths = tree_paths(forest.fit(train).toDebugString)
    if not paths:
        return RuleModel([], float(np.log(ones / (n - ones))))
    nested = train.select("label", F.struct(*STATISTICS).alias("_statistics"))
    hits = nested.select("label", F.array(*(holds(p).cast("double") for p in paths)).alias("hits"))
    from pyspark.ml.functions import array_to_vector

    coded = hits.select("label", array_to_vector("hits").alias("features")).cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(coded)
    weights = model.coefficients.toArray()
    train.unpersist()
    coded.unpersist()
    return RuleModel([(p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-9], float(model.intercept))


def quality(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", label: str = "quality",
    threshold: float = 0.3, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 from ``threshold`` on).

    The score depends on the text alone. ``held_out`` rows (a condition over ``docs``; null is false) aren't
    learnt from. Every row is returned, repeated ones as often as they come; null and empty texts are
    scored like any other, by statistics that are all 0. Several labels of an id are so many training
    rows, null ids have none. Columns of ``docs`` with the added names are replaced. The model is fit
    before this returns.
    """
    given = docs.select(*(c for c in docs.columns if c not in ("held_out", "score", "predicted")), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    marked = labels.select(F.col(id_column).alias("_id"), F.col(label).alias("_label")).where("_label is not null")
    learnt = given.where("not held_out").select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    # Few rows are learnt from: choose them by id before any text is read.
    ids = learnt.select("_id").join(marked, "_id").select("_id", F.xxhash64(F.lit("rules"), "_id").alias("_order")).distinct()
    ids = durable(ids.orderBy("_order", "_id").limit(train_rows))
    chosen = learnt.join(F.broadcast(ids), "_id").join(marked, "_id")
    model = fit(with_statistics(chosen), "_label", F.col("_order"), train_rows)
    score = with_statistics(given, text_column).withColumn("score", model.score()).drop("_statistics")
    return score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
